"""Streaming forms of batch operators, as extensions: the batch forms define the results."""
