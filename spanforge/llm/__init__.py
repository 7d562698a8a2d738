"""Training-data operators: search, filtering, de-duplication, mixing, tokenising.

Nothing outside this subpackage imports it; ``registry`` holds its queries.
"""
