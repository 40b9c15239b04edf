"""Quillstone: a compact SQL dialect with its own exact rules, run as Spark DataFrames."""

from .session import Session

__all__ = ["Session"]
