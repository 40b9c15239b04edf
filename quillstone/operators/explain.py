"""EXPLAIN ANALYZE: the query's steps with the rows that each makes."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation

from ..plans.analyzer import BoundSelect
from ..plans.builder import Step, plan


def report(bound: BoundSelect) -> list[str]:
    """Lines of the plan tree, children indented.

    One run counts the rows of all steps.  It ends below the last sort,
    projection and limit, whose rows follow: a limit would cut short what is
    below it, and a sort reads its input twice.
    """
    top, again = plan(bound, watched=True), plan(bound)
    core = top
    while core.seen is None:
        core = core.inputs[0]
    core.frame.count()
    counts: dict[int, int] = {}

    def count(step: Step, plain: Step) -> None:
        for a, b in zip(step.inputs, plain.inputs, strict=True):
            count(a, b)
        if step.seen is None:
            below = counts[id(step.inputs[0])]
            counts[id(step)] = max(0, min(bound.limit, below - bound.offset)) if step.kind == "Limit" else below
        else:
            rows = _seen(step.seen)
            counts[id(step)] = plain.frame.count() if rows is None else rows

    count(top, again)
    return _lines(top, 0, counts)


def _seen(observed: Observation) -> int | None:
    """The rows of a step that ran; None where the run could leave it out, as beside an empty join."""
    try:
        return observed.get.get("rows")
    except Py4JJavaError:  # what was left out has a row without columns, which cannot be read
        return None


def _lines(step: Step, depth: int, counts: dict[int, int]) -> list[str]:
    about = [f"{k}=[{', '.join(v)}]" if isinstance(v, list) else f"{k}={v}" for k, v in step.about.items()]
    line = "\t" * depth + f"{step.kind}({', '.join([*about, f'rows={counts[id(step)]}'])})"
    return [line] + [x for child in step.inputs for x in _lines(child, depth + 1, counts)]
