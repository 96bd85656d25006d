"""Parsers of source records: DataFrames of raw text to DataFrames of records."""
