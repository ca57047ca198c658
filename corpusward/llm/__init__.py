"""Operators for preparing training data: ten operators and the pipeline built from them."""
