"""Bound queries to DataFrames.  Catalyst does the rest: push-down, pruning, join strategy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import ast
from .analyzer import BoundSelect, BoundUnion, Call, Ref, Test


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Step:
    """One step of a plan, for reports: what it is, its rows, and what feeds it.

    A step that is ``watched`` counts its rows while a later one runs.  The last
    sort, projection and limit need no watching: their rows follow from the rest.
    """

    kind: str
    about: dict
    frame: DataFrame
    inputs: list[Step] = field(default_factory=list)
    watched: bool = False
    seen: Observation | None = None

    def __post_init__(self):
        if self.watched:
            self.seen = Observation()
            self.frame = self.frame.observe(self.seen, F.count(F.lit(1)).alias("rows"))


def _filter(t: Test) -> Column:
    left = quoted(t.left.internal)
    if t.op == "null":
        return left.isNull()
    if t.op == "notnull":
        return left.isNotNull()
    if isinstance(t.right, Ref):
        return X.compare_typed(t.op, left, t.left.type, quoted(t.right.internal), t.right.type)
    return X.compare(t.op, left, X.literal(t.left.type, t.right))


def _scan(bound: BoundSelect, at: int, watched: bool) -> Step:
    source = bound.sources[at]
    frame = source.table.load()
    frame = frame.select(*[quoted(n).alias(f"s{at}_{n}") for n in source.table.columns])
    for s, t in bound.filters:
        if s == at:
            frame = frame.where(_filter(t))
    return Step("Scan", {"table": source.table.name, "type": "SeqScan"}, frame, watched=watched)


def _show(t: Test) -> str:
    return f"{t.left.shown}{t.op}{t.right.shown}"


def _pruned(step: Step, bound: BoundSelect, at: int) -> Step:
    """A scan under a join, cut to the columns that the query needs."""
    if bound.star or bound.grouped:
        return step
    refs = [o.expr for o in bound.outputs if isinstance(o.expr, Ref)] + [e for e, _ in bound.order if isinstance(e, Ref)]
    refs += [r for t in bound.joins for r in (t.left, t.right)]
    need = sorted({r.shown: r for r in refs if r.source == at}.items())
    if not need:
        return step
    return Step("Project", {"columns": [n for n, _ in need]}, step.frame.select(*[quoted(r.internal) for _, r in need]), [step], step.watched)


def _join(bound: BoundSelect, watched: bool) -> Step:
    """All sources joined, each next one by conditions if any source left has some."""
    left = list(range(len(bound.sources)))
    first = left.pop(0)
    step = _scan(bound, first, watched)
    if left:
        step = _pruned(step, bound, first)
    inside, open_ = {first}, list(bound.joins)
    names = [bound.sources[first].table.name]
    while left:
        linked = [i for i in left if any({t.left.source, t.right.source} <= inside | {i} for t in open_)]
        at = (linked or left)[0]
        left.remove(at)
        inside.add(at)
        names.append(bound.sources[at].table.name)
        now = [t for t in open_ if {t.left.source, t.right.source} <= inside]
        open_ = [t for t in open_ if t not in now]
        right = _pruned(_scan(bound, at, watched), bound, at)
        if now:
            on = [X.compare_typed(t.op, quoted(t.left.internal), t.left.type, quoted(t.right.internal), t.right.type) for t in now]
            frame = step.frame.join(right.frame, on, "inner")
        else:
            frame = step.frame.crossJoin(right.frame)
        step = Step("Join", {"tables": sorted(names), "condition": sorted(map(_show, now))}, frame, [step, right], watched)
    return step


def _value(expr, bound: BoundSelect) -> Column:
    if isinstance(expr, (Ref, Call)):
        return quoted(expr.internal)
    return X.constant(expr)[0]


def _having(t: Test, types: dict) -> Column:
    def of(e):
        return types[e] if isinstance(e, Call) else e.type if isinstance(e, Ref) else None

    a, b = of(t.left), of(t.right)
    if a is None and b is None:
        left, right = X.constant(t.left), X.constant(t.right)
        return X.compare_typed(t.op, left[0], left[1], right[0], right[1])
    if b is None:
        return X.compare(t.op, quoted(t.left.internal), _having_value(a, t.right))
    if a is None:
        return X.compare(t.op, _having_value(b, t.left), quoted(t.right.internal))
    return X.compare_typed(t.op, quoted(t.left.internal), a, quoted(t.right.internal), b)


def _having_value(of, value: ast.Literal) -> Column:
    """A constant beside an aggregate keeps its own value; it is not cut to whole numbers."""
    if value.kind == "float" and of.family == "number":
        return F.lit(value.value if of.is_declared else float(value.text))
    return F.lit(None).cast(of.spark) if value.kind == "null" else F.lit(value.value)


def _grouped(step: Step, bound: BoundSelect) -> Step:
    calls = bound.calls()
    made = {c: X.aggregate(c.call, None if c.argument is None else quoted(c.argument.internal), c.argument and c.argument.type, not bound.group, bound.narrow) for c in calls}
    keys = [quoted(r.internal) for r in dict.fromkeys(bound.group)]
    if calls:
        frame = step.frame.groupBy(*keys).agg(*[v.alias(c.internal) for c, (v, _) in made.items()])
    else:
        frame = step.frame.select(*keys).distinct()
    if bound.having:
        types = {c: t for c, (_, t) in made.items()}
        for t in bound.having:
            frame = frame.where(_having(t, types))
    return Step("Aggregate", {"group": [r.shown for r in bound.group]}, frame, [step], step.watched)


def plan(bound: BoundSelect, watched: bool = False) -> Step:
    step = _join(bound, watched)
    if bound.grouped:
        step = _grouped(step, bound)
    frame = step.frame
    if bound.order:
        frame = frame.orderBy(*[X.sort(_value(e, bound), d) for e, d in bound.order])
        step = Step("Sort", {}, frame, [step])
    shown = ["*"] if bound.star else sorted(o.expr.shown if isinstance(o.expr, Ref) else o.name for o in bound.outputs)
    frame = frame.select(*[_value(o.expr, bound).alias(o.name) for o in bound.outputs])
    step = Step("Project", {"columns": shown}, frame, [step])
    if bound.limit is not None:
        if bound.offset:
            frame = frame.offset(bound.offset)
        step = Step("Limit", {}, frame.limit(bound.limit), [step])
    return step


def build_select(bound: BoundSelect) -> DataFrame:
    return plan(bound).frame


def build_union(bound: BoundUnion) -> DataFrame:
    frames = []
    for b in bound.branches:
        frame = build_select(b).toDF(*[f"u{i}" for i in range(len(bound.types))])
        frames.append(frame.select(*[F.col(f"u{i}").cast(t.spark).alias(f"u{i}") for i, t in enumerate(bound.types)]))
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    out = out.distinct()
    if bound.order:
        out = out.orderBy(*[X.sort(F.col(f"u{i}"), d) for i, d in bound.order])
    return out.toDF(*bound.names)
