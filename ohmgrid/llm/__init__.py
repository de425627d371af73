"""Operators that prepare text and free-typed values for training data; nothing else in the library imports them."""
