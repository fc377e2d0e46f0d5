"""Training-data operators: ten numbered operators on documents, pages and embeddings.

Nothing else in the library imports this subpackage.
"""
