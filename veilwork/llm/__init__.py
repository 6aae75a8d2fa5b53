"""Operators for preparing training data: one module each, free of imports from outside."""
