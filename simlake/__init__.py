"""Similarity engine for code snippets and texts on Spark DataFrames."""

from .params import SearchParams, banding

__all__ = ["SearchParams", "banding"]
