"""Training-data operators over ``documents``-like and ``embeddings``-like tables."""
