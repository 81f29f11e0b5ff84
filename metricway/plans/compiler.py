"""A governed metric query as one Spark SQL statement.

All metrics of one fact are conditional aggregates over a single scan; facts are put
together with UNION ALL and one grouped MAX, so a query shuffles once per fact plus once
for the (already aggregated) result. Filter values travel as named parameters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame

from metricway.plans.catalog import (
    MEASURES, METRICS, MODELS, SemanticModel, leaves, model_of_entity, require_declared)

# What a filter may name and hold.
FILTER_DIMENSIONS = ("interaction__category_code", "member__home_branch", "transaction__fee_type")
FILTER_OPS = ("eq", "in")
MAX_VALUE_LENGTH = 100
GRAINS = ("day", "week", "month", "quarter", "year")


# ── validation ────────────────────────────────────────────────────────────────

#: what a filter value must be: (test, message); values are bound as parameters and never become SQL text
VALUE_RULES = (
    (lambda v: type(v) in (str, int, float), "is neither text nor a number"),
    (lambda v: not isinstance(v, float) or math.isfinite(v), "is not finite"),
    (lambda v: not isinstance(v, str) or len(v) <= MAX_VALUE_LENGTH, f"has over {MAX_VALUE_LENGTH} characters"),
    (lambda v: not isinstance(v, str) or not any(unicodedata.category(c) == "Cc" for c in v), "holds control characters"),
)


def _values(clause: dict) -> list:
    value = clause["value"]
    values = list(value) if clause["op"] == "in" and isinstance(value, (list, tuple)) else [value]
    broken = [f"{v!r} {message}" for v in values for test, message in VALUE_RULES if not test(v)]
    if broken or not values:
        raise ValueError(f"filter values: {broken or 'none given'}")
    return values


def checked_filters(where) -> list[tuple[str, list]]:
    """[(dimension, allowed values)], all of which must hold."""
    clauses = [where] if isinstance(where, dict) else list(where or [])
    for c in clauses:
        known = isinstance(c, dict) and all(k in c for k in ("dimension", "op", "value"))
        if not known or c["dimension"] not in FILTER_DIMENSIONS or c["op"] not in FILTER_OPS:
            raise ValueError(f"{c!r}: a filter is a dimension of {FILTER_DIMENSIONS}, an op of {FILTER_OPS} and a value")
    return [(c["dimension"], _values(c)) for c in clauses]


def checked_window(window) -> tuple[date | None, date | None]:
    """(start, end) of a half-open window; either side may be open."""
    sides = {} if window is None else window
    try:
        extra = set(sides) - {"start", "end"}
        start, end = (None if sides.get(k) is None else date.fromisoformat(str(sides[k])) for k in ("start", "end"))
    except (AttributeError, TypeError, ValueError):
        raise ValueError(f"{window!r}: a window is a dict of YYYY-MM-DD start and end") from None
    if extra or (start and end and end <= start):
        raise ValueError(f"{window!r}: a window has a start and a later end, nothing else")
    return start, end


# ── dimensions ────────────────────────────────────────────────────────────────

@dataclass(frozen=True)
class Hop:
    """A many-to-one left join: `near` column of what is already joined to `model`'s key."""
    near: str
    model: SemanticModel
    carry: str  # column or expression wanted from the far table
    name: str


def find_dimension(model: SemanticModel, name: str) -> str | list[Hop]:
    """A local expression, or the join hops (one or two) that bring the dimension in."""
    entity, _, dimension = name.partition("__")
    if entity == "metric_time":
        if dimension not in GRAINS:
            raise ValueError(f"unknown time grain {dimension!r}")
        if model.time is None:
            raise ValueError(f"{model.name} has no time")
        return f"CAST(date_trunc('{dimension}', {model.time}) AS DATE)"
    if entity == model.primary and dimension in model.dimensions:
        return model.dimensions[dimension]
    far = model_of_entity(entity)
    if far is None or dimension not in far.dimensions:
        raise ValueError(f"no dimension {name!r}")
    if entity in model.foreign:
        return [Hop(model.foreign[entity], far, far.dimensions[dimension], name)]
    for via, column in model.foreign.items():
        middle = model_of_entity(via)
        if middle and entity in middle.foreign:
            key = f"{via}__{entity}_key"
            return [Hop(column, middle, middle.foreign[entity], key),
                    Hop(key, far, far.dimensions[dimension], name)]
    raise ValueError(f"{name!r} cannot be reached from {model.name}")


# ── statement ─────────────────────────────────────────────────────────────────

@dataclass
class MetricQuery:
    metrics: list[str]
    group_by: list[str] = field(default_factory=list)
    window: dict | None = None
    where: list[dict] | dict | None = None
    limit: int | None = None
    decimals: int | None = None

    def compile(self) -> "Compiled":
        return Compiled(self)

    def run(self, star) -> DataFrame:
        return self.compile().run(star)


class Compiled:
    """The statement, its parameters and the star tables it reads."""

    def __init__(self, query: MetricQuery):
        self.query = query
        self.args: dict[str, object] = {}
        self.tables: list[str] = []
        require_declared(query.metrics)
        self.start, self.end = checked_window(query.window)
        self.filters = checked_filters(query.where)
        self.simple = list(dict.fromkeys(x for m in query.metrics for x in leaves(m)))
        by_model: dict[str, list[str]] = {}
        for name in self.simple:
            by_model.setdefault(MEASURES[METRICS[name].measure].model, []).append(name)
        self.template = self._combine([(n, self._fact(MODELS[m], n)) for m, n in by_model.items()])

    def _param(self, value) -> str:
        name = f"p{len(self.args)}"
        self.args[name] = value
        return f":{name}"

    def _table(self, name: str) -> str:
        if name not in self.tables:
            self.tables.append(name)
        return "{" + name + "}"

    def _fact(self, model: SemanticModel, names: list[str]) -> str:
        wanted = {g: find_dimension(model, g) for g in self.query.group_by}
        for dimension, _ in self.filters:
            wanted[dimension] = find_dimension(model, dimension)
        for name in names:
            if METRICS[name].where:
                dimension = METRICS[name].where[0]
                wanted[dimension] = find_dimension(model, dimension)

        columns, joins, joined = ["f.*"], [], {}
        for name, found in wanted.items():
            if isinstance(found, str):
                columns.append(f"{found} AS {name}")
                continue
            source = "f"
            for hop in found:
                step = (source, hop.near, hop.model.table, hop.name)
                if step not in joined:
                    alias = joined[step] = f"j{len(joined) + 1}"
                    near = f"{source}.{hop.near}"
                    joins.append(
                        f"LEFT JOIN (SELECT {hop.model.key} AS {alias}_key, {hop.carry} AS {hop.name} "
                        f"FROM {self._table(hop.model.table)}) AS {alias} ON {near} = {alias}.{alias}_key")
                source = joined[step]
            columns.append(f"{source}.{name}")

        keep = []
        for bound, op in ((self.start, ">="), (self.end, "<")):
            if bound is not None:
                if model.time is None:
                    raise ValueError(f"{model.name} has no time to filter by")
                keep.append(f"{model.time} {op} {self._param(bound)}")
        for dimension, values in self.filters:
            keep.append(f"{dimension} IN ({', '.join(self._param(v) for v in values)})")
        conditions = {n: self._condition(n) for n in names}
        if all(conditions.values()):  # a group with no row for any metric is not a result row
            keep.append("(" + " OR ".join(dict.fromkeys(conditions.values())) + ")")

        selected = [*self.query.group_by, *(f"{self._aggregate(n, conditions[n])} AS {n}" for n in names)]
        text = (f"SELECT {', '.join(selected)} FROM (SELECT {', '.join(columns)} "
                f"FROM {self._table(model.table)} AS f {' '.join(joins)}) AS rows_in")
        if keep:
            text += " WHERE " + " AND ".join(keep)
        if self.query.group_by:
            text += " GROUP BY " + ", ".join(self.query.group_by)
        return text

    def _condition(self, name: str) -> str | None:
        where = METRICS[name].where
        return f"{where[0]} = {self._param(where[1])}" if where else None

    @staticmethod
    def _aggregate(name: str, condition: str | None) -> str:
        measure = MEASURES[METRICS[name].measure]
        value = {"average": f"CAST({measure.expr} AS DOUBLE)"}.get(measure.agg, f"({measure.expr})")
        if condition:
            value = f"CASE WHEN {condition} THEN {value} END"
        return {"sum": "SUM({})", "count": "SUM({})", "average": "AVG({})",
                "count_distinct": "COUNT(DISTINCT {})"}[measure.agg].format(value)

    def _combine(self, facts: list[tuple[list[str], str]]) -> str:
        groups = self.query.group_by
        if len(facts) == 1:
            combined = facts[0][1]
        else:
            # One typed NULL column per foreign metric; MAX then picks the one real value.
            parts = [
                "SELECT " + ", ".join([*groups, *(n if n in own else f"NULL AS {n}" for n in self.simple)])
                + f" FROM ({text}) AS fact_{i}"
                for i, (own, text) in enumerate(facts)]
            combined = (
                f"SELECT {', '.join([*groups, *(f'MAX({n}) AS {n}' for n in self.simple)])} "
                f"FROM ({' UNION ALL '.join(parts)}) AS facts"
                + (f" GROUP BY {', '.join(groups)}" if groups else ""))
        shown = [*groups, *(f"{self._value(m)} AS {m}" for m in self.query.metrics)]
        text = f"SELECT {', '.join(shown)} FROM ({combined}) AS combined"
        if self.query.limit is not None:
            order = ", ".join(f"{g} NULLS LAST" for g in groups) or self.query.metrics[0]
            text += f" ORDER BY {order} LIMIT {int(self.query.limit)}"
        return text

    def _value(self, name: str) -> str:
        text = self._formula(name)
        if self.query.decimals is not None:
            return f"ROUND(CAST({text} AS DOUBLE), {int(self.query.decimals)})"
        return text

    def _formula(self, name: str) -> str:
        metric = METRICS[name]
        if metric.kind == "simple":
            return name
        if metric.kind == "ratio":
            top, bottom = (self._formula(i) for i in metric.inputs)
            return f"CAST({top} AS DOUBLE) / CAST(NULLIF({bottom}, 0) AS DOUBLE)"
        text = metric.expr
        for name_in in metric.inputs:
            text = re.sub(rf"/ {name_in}\b", f"/ NULLIF(CAST({name_in} AS DOUBLE), 0)", text)
        return re.sub(r"\b(" + "|".join(metric.inputs) + r")\b",
                      lambda m: f"({self._formula(m[1])})", text)

    # ── use ──

    @property
    def sql(self) -> str:
        """The statement as text, with its values written in: the provenance of the numbers."""
        def literal(match: re.Match) -> str:
            value = self.args[match[1]]
            if isinstance(value, date):
                return f"DATE '{value.isoformat()}'"
            return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

        text = re.sub(r":(p\d+)\b", literal, self.template)
        return re.sub(r"\{(\w+)\}", r"\1", text)

    def run(self, star) -> DataFrame:
        frames = {name: star[name] for name in self.tables}
        return star.spark.sql(self.template, args=self.args or None, **frames)
