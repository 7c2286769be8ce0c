"""Training-data operators (deduplication, filtering, tokenisation, mixing).

Nothing else in the library imports this package; it can be removed whole.
"""
