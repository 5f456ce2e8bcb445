"""Operators for training data: duplicates, survivors, matching, tokens, packing and look-alike text."""
