"""Readers of text formats and writers. Text is read as strings first and cast once, so that odd values become nulls."""
