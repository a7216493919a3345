"""Operators of a training-data pipeline: quality, near copies, tokens, packing.

Nothing outside this package imports it.
"""
