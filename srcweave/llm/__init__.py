"""Operators for training data made from source code and texts about it."""
