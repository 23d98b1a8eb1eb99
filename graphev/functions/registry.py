"""What users can add by name: semirings of path weights, strategies, metrics, verifiers, weights.

A semiring is two column functions, so paths of any length stay in generated code. A strategy is a
function from DataFrames to votes. A metric is a function of two arrays, run once for each group of
rows. A verifier is a column expression. All are found by their names; a name that is not there
raises an error that lists the names that are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Registry(dict):
    def add(self, name: str, value=None):
        """Adds a value, or the function that follows as a decorator."""
        if value is None:
            return lambda made: self.add(name, made)
        self[name] = value
        return value

    def __missing__(self, name: str):
        raise KeyError(f"{name!r} is not registered; there are {', '.join(sorted(self)) or 'none'}")


@dataclass(frozen=True)
class Semiring:
    """along: a path's weight from an array of edge weights, its last argument the identity;
    across: the aggregate over parallel paths."""

    times: Callable[[Column, Column], Column]
    one: float
    across: Callable[[Column], Column]

    def along(self, weights: Column) -> Column:
        """Null for an array with a null; the identity for an empty one."""
        return F.aggregate(weights, F.lit(float(self.one)), self.times)


SEMIRINGS = Registry(
    product=Semiring(lambda x, y: x * y, 1.0, F.max),
    sum=Semiring(lambda x, y: x + y, 0.0, F.min),
    widest=Semiring(lambda x, y: F.when(y.isNull(), None).otherwise(F.least(x, y)), float("inf"), F.max),
    reach=Semiring(lambda x, y: F.when(y.isNull(), None).when((x > 0) & (y > 0), 1.0).otherwise(0.0), 1.0, F.max),
    clipped=Semiring(lambda x, y: F.when(y.isNull(), None).otherwise(F.greatest(F.lit(0.0), x + y - 1)), 1.0, F.max),
)
STRATEGIES, METRICS, VERIFIERS = Registry(), Registry(), Registry()


def path_weights(paths: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """Paths (..., weights: array<double>) -> one row per group of by and a column per semiring:
    the weight over all of a group's paths."""
    return paths.groupBy(*by).agg(*[SEMIRINGS[n].across(SEMIRINGS[n].along(F.col("weights"))).alias(n) for n in names or SEMIRINGS])


def votes_of(names: list[str], *inputs: DataFrame) -> DataFrame:
    """M7: source, target, strategy, confidence of the named strategies, each of which takes the
    inputs and gives source, target, confidence. No name: an error, as votes need a schema."""
    out = None
    for name in names:
        one = STRATEGIES[name](*inputs).select("source", "target", F.lit(name).alias("strategy"), F.col("confidence").cast("double").alias("confidence"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no strategy was named")
    return out


def metric_by(rows: DataFrame, by: str, metric: str) -> DataFrame:
    """M8: rows (by, score, label) -> by, value of a metric of (scores, labels) as numpy arrays, one
    call for a group. A group is one task's work and must fit there: the groups are resamples or
    folds, whose size is chosen. Null scores and labels reach no metric."""
    f, kind = METRICS[metric], dict(rows.dtypes)[by]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [part[by].iloc[0]], "value": [float(f(part["score"].to_numpy(), part["label"].to_numpy()))]})

    return rows.select(by, "score", "label").dropna(subset=["score", "label"]).groupBy(by).applyInPandas(run, f"{by} {kind}, value double")


def verified(claims: DataFrame, verifier: str) -> DataFrame:
    """Claims with the verdict of a verifier, a column expression over them. REJECT is not
    stored; what is stored but HOLLOW is quarantined, so that recall leaves it out. A null verdict
    counts as REJECT."""
    verdict = F.coalesce(VERIFIERS[verifier](), F.lit("REJECT"))
    return claims.withColumn("verdict", verdict).filter("verdict <> 'REJECT'").withColumn("quarantined", F.col("verdict") == "HOLLOW")


def next_steps(states: DataFrame, transitions: DataFrame, weight: Callable[[], Column] | None = None) -> DataFrame:
    """States (item, state, score) and transitions (state, successor, ...) -> item, successor,
    score: the sum of the scores that reach a successor, times the user's weight over the
    transitions' columns (1 without one). States are summed before they meet their transitions."""
    summed = states.groupBy("item", "state").agg(F.sum("score").alias("score"))
    steps = transitions.select("state", "successor", (weight() if weight else F.lit(1.0)).alias("w"))
    return summed.join(steps, "state").groupBy("item", "successor").agg(F.sum(F.col("score") * F.col("w")).alias("score"))
