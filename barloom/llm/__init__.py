"""Operators for training-data pipelines: text, conversations and embeddings."""
