"""One order over all rows: row numbers by a range shuffle, and tests that shuffle labels."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphev.functions.shared import saved
from graphev.operators.relation import Relation


def row_numbers(rows: DataFrame, order: list, to: str = "k") -> DataFrame:
    """rows with their numbers from 1 in the given order, which should leave no ties.

    Rows are dealt to ranges and sorted in them; a range's first number comes from the counts of
    the ranges before it, one row for each shuffle partition, so no task holds the whole order."""
    placed = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = saved(placed.withColumn("_place", F.monotonically_increasing_id()))
    place = placed.withColumn("_range", F.shiftright("_place", 33)).withColumn("_in", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    sizes = place.groupBy("_range").agg(F.max("_in").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return place.join(F.broadcast(starts), "_range").withColumn(to, F.col("_start") + F.col("_in")).drop("_place", "_range", "_in", "_start")


@dataclass(frozen=True)
class Ranked(Relation):
    """SELECT *, k FROM rows, k being the place in an order. In Spark k comes from row_numbers; the
    statement says the same with a window, for checks."""

    order: tuple[str, ...] = ()

    def __call__(self, *frames: DataFrame, **params) -> DataFrame:
        keys = [F.desc(o.removesuffix(" DESC")) if o.endswith(" DESC") else F.asc(o) for o in self.order]
        return row_numbers(frames[0].filter(self.params.get("where", "true")), keys)


def ranked(*order: str, where: str = "true") -> Ranked:
    return Ranked(f"SELECT *, row_number() OVER (ORDER BY {', '.join(order)}) AS k FROM {{rows}} WHERE {where}", ("rows",), {"where": where}, "M2: a stable order over all rows", order)


def permutation_test(scores: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """F16: one row: replicates, observed AUROC, mean AUROC of shuffled labels, p (the share of
    shuffles that reach the observed one). No rows or one class: observed 0.5 and p 1.

    A shuffle of labels decides only how many positives each distinct score gets, which is a draw
    from the multivariate hypergeometric law. Scores have six digits, so a replicate is a million
    levels at most; replicates are dealt over the tasks, each with its own seed."""
    levels = saved(scores.groupBy("score").agg(F.count("*").alias("n"), F.count_if("label").alias("p")))

    def draw(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("score", kind="stable")
        n, p = part["n"].to_numpy(np.int64), part["p"].to_numpy(np.int64)
        if key[0]:
            p = np.random.default_rng([seed, key[0]]).multivariate_hypergeometric(n, p.sum(), method="marginals")
        q = n - p
        pairs = float(p.sum()) * float(q.sum())
        auroc = float((p * (np.cumsum(q) - q / 2)).sum()) / pairs if pairs else 0.5
        return pd.DataFrame({"r": [key[0]], "auroc": [auroc]})

    each = levels.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).groupBy("r").applyInPandas(draw, "r int, auroc double")
    each = saved(each)
    observed = each.filter("r = 0").agg(F.coalesce(F.max("auroc"), F.lit(0.5)).alias("observed"))
    return each.filter("r > 0").crossJoin(F.broadcast(observed)).agg(  # one row is broadcast
        F.count("*").alias("replicates"),
        F.coalesce(F.max("observed"), F.lit(0.5)).alias("observed"),
        F.coalesce(F.avg("auroc"), F.lit(0.5)).alias("mean_shuffled"),
        F.coalesce(F.avg(F.when(F.col("auroc") >= F.col("observed"), 1.0).otherwise(0.0)), F.lit(1.0)).alias("p"),
    )
