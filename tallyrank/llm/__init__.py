"""Operators that prepare training data from large text corpora.

Nothing outside this folder imports it, and it imports nothing of the rest.
"""
