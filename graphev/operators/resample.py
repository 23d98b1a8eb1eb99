"""Bootstrap of ranking metrics (F5): replicates weigh rows by Poisson(1) counts, drawn for each
distinct score and label, so that a replicate is as small as the number of distinct scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def poisson(n: pd.Series, seed: pd.Series) -> pd.Series:
    """Poisson(n) draws, each from its own seed, so that a recomputed task draws the same."""
    return pd.Series([int(np.random.default_rng(s & 0x7FFFFFFFFFFFFFFF).poisson(k)) for k, s in zip(n, seed)])


def bootstrap_auroc(scores: DataFrame, replicates: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: replicates, mean, low, high; replicates with one class are left out."""
    # both classes of a score are one row, so that a replicate's rows are moved once, to their order
    counts = scores.groupBy("score").agg(F.count_if("label").alias("_p"), F.count_if(~F.col("label")).alias("_q"))
    draws = counts.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    each = draws.select("r", "score", *[poisson(f"_{n}", F.xxhash64(F.lit(seed), "r", "score", F.lit(label))).alias(n) for n, label in (("p", True), ("q", False))])
    below = F.coalesce(F.sum("q").over(W.partitionBy("r").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    auroc = each.groupBy("r").agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q")).filter("p > 0 and q > 0")
    auroc = auroc.select((F.col("won") / (F.col("p") * F.col("q"))).alias("auroc"))
    return auroc.agg(F.count("*").alias("replicates"), F.avg("auroc").alias("mean"), F.percentile("auroc", alpha / 2).alias("low"), F.percentile("auroc", 1 - alpha / 2).alias("high"))
