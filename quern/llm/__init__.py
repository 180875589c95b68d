"""Operators that prepare text for training."""
