"""Operators on vectors, source texts and documents for training data. Nothing else in the library imports this."""
