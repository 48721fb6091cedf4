"""Training-data operators: scoring, deduplication, mixing, tokenising and archiving of text corpora.

Nothing outside this subpackage imports it.
"""
