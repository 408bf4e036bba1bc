"""Training-data operators: ten methods over documents, pages and embeddings.

Nothing else in the library imports this subpackage.
"""
