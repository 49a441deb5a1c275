"""Operators of a training-data pipeline, one module each, over tables of documents, benchmarks and conversations.

Every operator takes DataFrames and column names and returns DataFrames. Columns that it does not name are left alone or
left out as its docstring says, so extra columns with clashing names do no harm.
"""
