"""Operators that prepare training data from the tables documents, pages and embeddings."""
