"""Span analytics on Spark: scoring, decoding, cleaning and calibrating labelled text spans."""
