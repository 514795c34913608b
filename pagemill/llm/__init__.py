"""Operators for training data: languages, markup residue, garbled text, packing, mixing, personal information.

Nothing outside this package imports it.
"""
