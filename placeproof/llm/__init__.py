"""Operators for building training data from a corpus.  Nothing else in the library imports this package."""
