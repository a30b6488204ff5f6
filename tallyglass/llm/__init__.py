"""Operators that prepare large text corpora for training.

Nothing outside this folder imports it; the repository works without it.
"""
