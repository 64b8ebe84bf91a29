"""Reads of a warehouse through an allow list: columns and conditions outside it are refused, the rest is pushed to the source.

Works on any table that Spark reads (files, catalog tables, a database connector): columns become a projection and
conditions literals in a filter, so the source scans only what is asked for. Values never become query text.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTIFIER = re.compile(r"[0-9]{1,12}")     # fixed value: the form of a need's identifier
CONDITIONS = {
    "=": lambda c, v: c == F.lit(v), ">=": lambda c, v: c >= F.lit(v), "<=": lambda c, v: c <= F.lit(v), ">": lambda c, v: c > F.lit(v), "<": lambda c, v: c < F.lit(v),
    "in": lambda c, v: c.isin(*v), "is null": lambda c, v: c.isNull(), "is not null": lambda c, v: c.isNotNull(),
}


@dataclass(frozen=True)
class AllowList:
    """``columns``: name given out -> column of the source; ``conditions``: names that may be filtered on; ``fixed``: conditions
    (name, operator, value) that every read has, whatever else is asked."""

    columns: Mapping[str, str]
    conditions: Sequence[str] = ()
    fixed: Sequence[tuple] = ()
    max_rows: int = 10_000_000

    def column(self, name: str) -> Column:
        if name not in self.columns:
            raise ValueError(f"column {name!r} is not on the allow list")
        return F.col(self.columns[name])

    def condition(self, name: str, operator: str, value=None, fixed: bool = False) -> Column:
        if not fixed and name not in self.conditions:
            raise ValueError(f"{name!r} may not be filtered on")
        if operator not in CONDITIONS:
            raise ValueError(f"operator {operator!r} is not known")
        return CONDITIONS[operator](self.column(name), value)


def read(source: DataFrame, allowed: AllowList, columns: Sequence[str] | None = None, where: Sequence[tuple] = (), limit: int | None = None) -> DataFrame:
    """The asked columns (all allowed ones by default) of the rows that meet all conditions, at most ``limit`` of them."""
    rules = [allowed.condition(*c, fixed=True) for c in allowed.fixed] + [allowed.condition(*c) for c in where]
    rows = source.filter(reduce(lambda a, b: a & b, rules)) if rules else source
    names = list(allowed.columns) if columns is None else list(columns)
    out = rows.select(*[allowed.column(n).alias(n) for n in names])
    if limit is None:
        return out
    if not 0 < limit <= allowed.max_rows:
        raise ValueError(f"limit must be between 1 and {allowed.max_rows}")
    return out.limit(limit)


def by_identifier(source: DataFrame, allowed: AllowList, identifier: str, name: str = "external_id") -> DataFrame:
    """The row of one identifier; anything that isn't one gives no row and never reaches the source as a condition."""
    if not IDENTIFIER.fullmatch(str(identifier)):
        return read(source, allowed).filter(F.lit(False))
    rows = read(source.filter(allowed.column(name) == F.lit(int(identifier))), allowed)
    return rows.limit(1)
