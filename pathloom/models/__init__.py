"""Training of embeddings."""
