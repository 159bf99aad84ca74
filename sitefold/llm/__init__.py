"""Operators for training-data pipelines over document, conversation and embedding tables."""
