"""Training-data operators: near-dedup, filters, tokenisation, packing, search, scoring.

Nothing else in the library imports this subpackage.
"""
