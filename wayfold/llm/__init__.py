"""Operators that prepare training data.  Nothing outside imports this package."""
