"""Strong groups against brute force, and what users add by name."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphev.functions import registry
from graphev.operators.strong import strong_groups


def test_strong_groups(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(22)] + [(20, 20), (30, 31), (None, 3), (3, None)]
    edges += [(x, x % 4 + 41) for x in range(41, 45)] + [(44, 0)]
    got = sorted(map(tuple, strong_groups(spark.createDataFrame(edges, "a long, b long")).collect()))
    whole = [(a, b) for a, b in edges if a is not None and b is not None]
    nodes = sorted({x for e in whole for x in e})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in whole:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    assert got == [(n, min(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes]
    assert strong_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_semirings(spark):
    rows = spark.createDataFrame([("x", [0.5, 0.5]), ("x", [0.9, 0.2]), ("y", []), ("z", [0.5, None])], "k string, weights array<double>")
    got = {r.k: r for r in registry.path_weights(rows, ["k"]).collect()}
    assert [round(v, 6) for v in got["x"][1:]] == [0.25, 1.0, 0.5, 1.0, 0.1]
    assert (got["y"]["product"], got["y"]["sum"]) == (1.0, 0.0)
    assert list(got["z"][1:]) == [None] * 5


def test_plug_ins(spark, monkeypatch):
    for name in ("STRATEGIES", "METRICS", "VERIFIERS"):
        monkeypatch.setattr(registry, name, registry.Registry())
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5), ("b", "d", None)], "source string, target string, w double")
    registry.STRATEGIES.add("direct", lambda e: e.select("source", "target", F.col("w").alias("confidence")))
    assert sorted(map(str, registry.votes_of(["direct"], edges).collect()))[0].startswith("Row(source='a', target='b', strategy='direct', confidence=0.5")
    with pytest.raises(KeyError, match="direct"):
        registry.votes_of(["other"], edges)
    registry.METRICS.add("mean_of_ones", lambda scores, labels: np.mean(scores[labels]))
    rows = spark.createDataFrame([(1, 0.2, True), (1, 0.4, True), (1, 0.9, False), (2, 1.0, True), (2, None, True)], "fold int, score double, label boolean")
    got = {r.fold: round(r.value, 6) for r in registry.metric_by(rows, "fold", "mean_of_ones").collect()}
    assert got == {1: 0.3, 2: 1.0}
    registry.VERIFIERS.add("by_weight", lambda: F.when(F.col("w") > 1, "VERIFIED").when(F.col("w") > 0, "HOLLOW"))
    kept = registry.verified(edges.withColumn("w", F.col("w") + F.when(F.col("target") == "c", 1).otherwise(0)), "by_weight")
    assert sorted((r.target, r.verdict, r.quarantined) for r in kept.collect()) == [("b", "HOLLOW", True), ("c", "VERIFIED", False)]
    states = spark.createDataFrame([(1, "a", 0.25), (1, "a", 0.25)], "item int, state string, score double")
    steps = edges.select(F.col("source").alias("state"), F.col("target").alias("successor"), "w")
    assert [tuple(r) for r in registry.next_steps(states, steps, lambda: 2 * F.col("w")).collect()] == [(1, "b", 0.5)]
