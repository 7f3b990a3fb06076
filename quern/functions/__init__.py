"""Scalar functions as SQL text that Spark and other engines evaluate alike, and as Columns."""
