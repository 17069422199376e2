"""Operators for preparing training data from the memory corpus."""
