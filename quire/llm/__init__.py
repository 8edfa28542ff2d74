"""Operators that prepare text corpora, embeddings and web pages for training."""
