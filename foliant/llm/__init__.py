"""Operators for training data made from the corpus; nothing else in the library imports this."""
