"""Operators on DataFrames of documents, spans, tokens and scores."""
