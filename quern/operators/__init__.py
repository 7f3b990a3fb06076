"""Operators over DataFrames. A sparse matrix is a table (row_id, col_id, value) without rows for zeros."""
