"""Training-data operators: dedup, similarity joins, tokens, packing, classifiers and vector search.

Nothing else in the library imports this subpackage.
"""
