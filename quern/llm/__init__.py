"""Operators of a training-data pipeline: language, quality, PII, near copies, mixing, tokens, archives and vectors.

Nothing outside this sub-package imports it.
"""
