"""Values in the place of $1, $2, ... in a parsed statement."""

from __future__ import annotations

import dataclasses
import math

import numpy as np

from ..errors import IncompatibleTypeError, InternalError
from . import ast
from .parser import INT_MAX, INT_MIN, fold, real

#: The types a prepared statement may declare for its parameters.
TYPES = ("INT32", "FLOAT32", "CHAR")


def as_literal(value: object, declared: str | None = None) -> ast.Literal:
    """A Python value as a literal, converted to the declared type (null has any)."""
    if value is None:
        return ast.Literal("null", None, "NULL")
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise IncompatibleTypeError(declared or "a parameter", type(value).__name__)
    if declared == "CHAR" or declared is None and isinstance(value, str):
        if not isinstance(value, str):
            raise IncompatibleTypeError("CHAR", type(value).__name__)
        return ast.Literal("str", value, value)
    if isinstance(value, str):
        raise IncompatibleTypeError(declared, "CHAR")
    if declared == "INT32" or declared is None and isinstance(value, int):
        if isinstance(value, float) and not math.isfinite(value):
            raise InternalError("a parameter must be finite")
        n = math.trunc(value)
        if not INT_MIN <= n <= INT_MAX:
            raise InternalError(f"{value} is no 32-bit number")
        return ast.Literal("int", n, str(n))
    if not math.isfinite(np.float32(value)):
        raise InternalError("a parameter must be a finite 32-bit float")
    return real(repr(float(value)))


def numbers(node: object) -> set[int]:
    """The parameters that a statement has."""
    if isinstance(node, ast.Literal):
        return {node.value} if node.kind == "param" else set()
    if isinstance(node, tuple):
        return set().union(*map(numbers, node)) if node else set()
    if dataclasses.is_dataclass(node):
        return set().union(*(numbers(getattr(node, f.name)) for f in dataclasses.fields(node)))
    return set()


def bind(node, values: dict[int, ast.Literal]):
    """The statement with its parameters replaced; constant arithmetic is folded then."""
    if isinstance(node, ast.Literal):
        if node.kind != "param":
            return node
        if node.value not in values:
            raise InternalError(f"no value for ${node.value}")
        return values[node.value]
    if isinstance(node, ast.Arith):
        return fold(node.op, bind(node.left, values), bind(node.right, values))
    if isinstance(node, tuple):
        return tuple(bind(x, values) for x in node)
    if dataclasses.is_dataclass(node):
        return dataclasses.replace(node, **{f.name: bind(getattr(node, f.name), values) for f in dataclasses.fields(node)})
    return node
