"""Operators for training data: co-occurrence, token ids, leaked evaluation texts, shared spans."""
