"""Extraction, search, lint and graph operators over DataFrames."""
