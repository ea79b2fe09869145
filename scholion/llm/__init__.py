"""Training-data operators: deduplication, fingerprints, scoring, tokenising, extraction, mixing.

Nothing outside this package imports it.
"""
