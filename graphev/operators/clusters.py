"""Clusters of vectors: components of all pairs at a cosine of ``least`` or more, over all vectors.

An exact similarity self-join by blocks. Unit vectors at a cosine of c are sqrt(2 - 2c) apart, so by the
triangle inequality their distances from any pivot differ by no more. Distinct vectors are put in the
order of their distance from a first pivot and cut into blocks of ``block`` rows, each with the range
of its distances from every pivot; two blocks are compared only if their ranges come near enough for
all pivots. A comparison is a matrix product of two blocks in one task, which hands on a spanning
forest of the links it finds, not the links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphev.functions.shared import saved
from graphev.operators.components import components
from graphev.operators.ranks import row_numbers

PIVOTS, BLOCK, TILE = 4, 4096, 1024
SLACK = 1e-6


def _rows(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def smallest_joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that the edges (i, j) join it with: labels fall along edges, then
    along themselves, until none does."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[label]
        if (label == before).all():
            return label


def _compare(part: pa.Table, least: float) -> pa.Table:
    part = part.sort_by([("side", "ascending"), ("id", "ascending")])
    ids, x, m = part["id"].to_numpy(), _rows(part["vec"]), int((part["side"].to_numpy() == 0).sum())
    ones, twos = [], []
    for k in range(0, m, TILE):
        base = m if m < len(x) else 0
        i, j = np.nonzero(np.round(x[k : min(k + TILE, m)] @ x[base:].T, 12) >= least)
        ones.append(i + k)
        twos.append(j + base)
    root = smallest_joined(len(x), np.concatenate(ones), np.concatenate(twos))
    some = np.flatnonzero(root != np.arange(len(x)))
    return pa.table({"a": ids[some], "b": ids[root[some]]})


def threshold_clusters(vectors: DataFrame, least: float = 0.7, block: int = BLOCK) -> DataFrame:
    """Vectors (vec_id, embedding) of one length -> vec_id, cluster (its smallest vec_id), size. Null,
    zero and non-finite vectors are clusters of their own; equal vectors are one cluster."""
    vec = F.col("embedding").cast("array<double>")
    fit = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", vec.alias("vec"), fit.alias("fit"))
    kinds = saved(rows.filter("fit").groupBy("vec").agg(F.min("vec_id").alias("id")))
    pivots = [np.array(r.vec) / np.linalg.norm(r.vec) for r in kinds.orderBy(F.xxhash64("vec"), "id").limit(PIVOTS).collect()]
    if not pivots:
        return rows.select("vec_id", F.col("vec_id").alias("cluster"), F.lit(1).cast("long").alias("size"))
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK

    def far(batches):
        for batch in batches:
            x = _rows(batch.column(0))
            gaps = [np.sqrt(np.maximum(0, 2 - 2 * (x @ p))) for p in pivots]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(list(np.stack(gaps, axis=1)), pa.list_(pa.float64()))], names=["id", "vec", "gaps"])

    measured = kinds.select("vec", "id").mapInArrow(far, f"id {dict(kinds.dtypes)['id']}, vec array<double>, gaps array<double>")
    placed = row_numbers(measured.withColumn("gap", F.col("gaps")[0]), [F.asc("gap"), F.asc("id")])
    placed = saved(placed.select("id", "vec", "gaps", F.expr(f"(k - 1) div {block}").alias("block")))
    ranges = placed.groupBy("block").agg(*[f(F.col("gaps")[i]).alias(f"{n}{i}") for i in range(len(pivots)) for n, f in (("lo", F.min), ("hi", F.max))])
    # cells as wide as the reach along the first pivot: blocks that are near enough share one
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    left = ranges.withColumn("cell", F.explode(F.sequence(cell("lo0"), cell("hi0")))).alias("x")
    right = ranges.withColumn("cell", F.explode(F.sequence(cell("lo0") - 1, cell("hi0") + 1))).alias("y")
    near = [(F.col(f"x.lo{i}") <= F.col(f"y.hi{i}") + reach) & (F.col(f"y.lo{i}") <= F.col(f"x.hi{i}") + reach) for i in range(len(pivots))]
    met = left.join(right, F.col("x.cell") == F.col("y.cell")).filter("x.block <= y.block")
    for one in near:
        met = met.filter(one)
    met = saved(met.select(F.col("x.block").alias("a"), F.col("y.block").alias("b")).distinct().withColumn("pair", F.monotonically_increasing_id()))
    sides = met.select("pair", F.explode(F.expr("if(a = b, array(named_struct('side', 0, 'block', a)), array(named_struct('side', 0, 'block', a), named_struct('side', 1, 'block', b)))")).alias("s")).select("pair", "s.*")
    work = sides.join(placed.select("id", "vec", "block"), "block").select("pair", "side", "id", "vec")
    kind = dict(kinds.dtypes)["id"]
    links = work.groupBy("pair").applyInArrow(lambda part: _compare(part, least), f"a {kind}, b {kind}")
    roots = components(links).withColumnRenamed("node", "id")
    named = rows.filter("fit").join(kinds, "vec").select("vec_id", "id").join(roots, "id", "left").select("vec_id", F.coalesce("root", "id").alias("cluster"))
    named = saved(named.unionByName(rows.filter("not fit").select("vec_id", F.col("vec_id").alias("cluster"))))
    return named.join(named.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("vec_id", "cluster", "size")
