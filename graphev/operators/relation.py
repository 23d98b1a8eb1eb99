"""Operators written as one SQL statement over named DataFrames.

A ``Relation`` is a Spark SQL statement with ``{name}`` for each input table and ``:name`` for
each parameter. Called with DataFrames it returns a DataFrame, so Catalyst plans it together with
whatever made its inputs. ``duckdb()`` gives the same statement in DuckDB's spelling, for checks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

#: Numbers with a point are doubles here, not decimals. A value on the edge between two roundings is
#: pushed up a little, so that it rounds alike whatever the last bits of a sum were.
NUDGE = "1e-11"
#: Spellings that differ: Spark's, DuckDB's.
SPELLINGS = [
    (r"\bunix_micros\(", "epoch_us("),
    (r"\bdatediff\((\w+(?:\.\w+)?), (\w+(?:\.\w+)?)\)", r"date_diff('day', \2, \1)"),
    (r"\bsha2\((.*), 256\)", r"sha256(\1)"),
    (r"\belement_at\(", "list_extract("),
    (r"\bsplit\(", "string_split("),
    (r"\barray_size\(", "len("),
    (r"\bCAST\((.*?) AS STRING\)", r"CAST(\1 AS VARCHAR)"),
    (r"\bexplode\(", "unnest("),
]


def literal(value: Any) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else repr(value)


@dataclass(frozen=True)
class Relation:
    sql: str
    inputs: tuple[str, ...]
    params: dict[str, Any] = field(default_factory=dict)
    note: str = ""

    def bound(self, **params: Any) -> str:
        values = self.params | params
        out = re.sub(r"(?<!:):([a-z_]\w*)", lambda m: literal(values[m[1]]) if m[1] in values else m[0], self.sql)
        out = re.sub(r"(?<![\w'.])(\d+\.\d+)(?![\d.e])", r"\1e0", out)
        return re.sub(r"\bround\(", f"round({NUDGE} + ", out)

    def __call__(self, *frames: DataFrame, **params: Any) -> DataFrame:
        tables = dict(zip(self.inputs, frames, strict=True))
        return frames[0].sparkSession.sql(self.bound(**params), **tables)

    def duckdb(self, *names: str, **params: Any) -> str:
        out = self.bound(**params).format(**dict(zip(self.inputs, names or self.inputs, strict=True)))
        for ours, theirs in SPELLINGS:
            out = re.sub(ours, theirs, out)
        return out


@dataclass(frozen=True)
class Stepped(Relation):
    """A relation that Spark works out in steps, each kept before the next; the statement says the
    same in one, for checks."""

    run: Callable[..., DataFrame] | None = None

    def __call__(self, *frames: DataFrame, **params: Any) -> DataFrame:
        return self.run(*frames, **params)
