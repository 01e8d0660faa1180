"""Operators on texts, vectors and rankings for training data."""
