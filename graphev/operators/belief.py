"""General combination of evidence (D17b): masses on sets of answers, discounted and combined."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combined(masses: DataFrame, keys: list[str], answers: int) -> DataFrame:
    """masses: keys, source, subset (bits of the answers, 1 to 2^answers - 1), mass, reliability
    (0 to 1) -> keys, subset, mass, conflict for every subset with a mass; a key whose sources
    exclude each other altogether (conflict 1) has one row with null subset and mass.

    A source's unreliable share goes to the whole frame. The orthogonal sum is taken by
    commonalities: a subset's is the mass of all that contain it, and those of independent sources
    multiply, so that sources combine in any order and before they are moved."""
    full = (1 << answers) - 1
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("reliability")))
    told = masses.select(*keys, "source", "subset", (sure * F.col("mass")).alias("mass"))
    rest = masses.groupBy(*keys, "source").agg((1 - F.max(sure)).alias("mass")).select(*keys, "source", F.lit(full).alias("subset"), "mass")
    subsets = range(1, full + 1)
    holds = [F.sum(F.when(F.col("subset").bitwiseAND(F.lit(a)) == a, F.col("mass")).otherwise(0.0)).alias(f"_q{a}") for a in subsets]
    joint = told.unionByName(rest).groupBy(*keys, "source").agg(*holds).groupBy(*keys).agg(*[F.product(f"_q{a}").alias(f"_q{a}") for a in subsets])
    sign = lambda a, b: (-1) ** (b & ~a).bit_count()
    parts = [reduce(add, [F.lit(float(sign(a, b))) * F.col(f"_q{b}") for b in subsets if a & b == a]) for a in subsets]
    joint = joint.select(*keys, F.array(*parts).alias("_m"))
    whole = F.aggregate("_m", F.lit(0.0), lambda s, x: s + x)
    joint = joint.withColumn("conflict", 1 - whole)
    clash = joint.filter("abs(conflict - 1) < 1e-12").select(*keys, F.lit(None).cast("int").alias("subset"), F.lit(None).cast("double").alias("mass"), F.lit(1.0).alias("conflict"))
    rows = joint.filter("abs(conflict - 1) >= 1e-12").select(*keys, F.posexplode("_m").alias("_at", "_x"), "conflict").filter("_x > 1e-12")
    return rows.select(*keys, (F.col("_at") + 1).alias("subset"), (F.col("_x") / (1 - F.col("conflict"))).alias("mass"), "conflict").unionByName(clash)
