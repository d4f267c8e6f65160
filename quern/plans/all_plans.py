"""Imports every module that registers queries."""

from . import cleaning, converting, memory, numeric, stores, streams, training  # noqa: F401
