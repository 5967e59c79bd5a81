"""Operators for building training data at corpus scale."""
