"""Betti numbers of a flag complex, and how they drift between two graphs.

b0 counts connected groups, b1 independent loops that no triangles fill. With V vertices, E edges, and r
the rank of the boundary of the triangles over GF(2), b1 = E - V + b0 - r. The rank is found by rounds of
column elimination: every triangle is the set of its edges, its pivot the largest of them; of the columns
with one pivot the smallest stays, the others take its symmetric difference and so get smaller pivots. A
round is one grouping and one join on the pivot; it ends when no two columns share one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphev.functions.shared import saved
from graphev.operators.components import components
from graphev.operators.relation import NUDGE


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, once; loops and nulls left out."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """edges (a < b) -> (u, v, w), each once. Edges are turned from the end of lower degree to the other,
    so that a hub's neighbours are not paired: no node has more than sqrt(2 E) edges out."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    x, y = degree.select(F.col("n").alias("a"), F.col("d").alias("da")), degree.select(F.col("n").alias("b"), F.col("d").alias("db"))
    low_first = F.struct("da", "a") < F.struct("db", "b")
    out = edges.join(x, "a").join(y, "b").select(F.when(low_first, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(low_first, F.col("b")).otherwise(F.col("a")).alias("t"))
    out = saved(out)
    two = out.alias("f").join(out.alias("g"), F.col("f.s") == F.col("g.s")).filter("f.t < g.t").select(F.col("f.s").alias("s"), F.col("f.t").alias("a"), F.col("g.t").alias("b"))
    corners = F.array_sort(F.array("s", "a", "b"))
    return two.join(edges, ["a", "b"], "left_semi").select(*[corners[i].alias(n) for i, n in enumerate("uvw")])


def radius_triangles(cells: DataFrame, reach: float) -> DataFrame:
    """cells (cell, x, y) -> (u, v, w, filtration), u < v < w: no side over reach, the longest side. Every square
    of a grid as wide as the reach takes a list of the cells in and around it; a cell's triangles are made
    where it meets that list, so that cells are moved, not edges or triangles."""
    at = lambda c: F.floor(F.col(c) / reach).cast("int")
    placed = cells.select("cell", "x", "y", at("x").alias("gx"), at("y").alias("gy"))
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = placed.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    around = around.groupBy((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy")).agg(F.collect_list(F.struct("cell", "x", "y")).alias("cells"))
    squared = lambda a, b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])
    side = lambda a, b: F.round(F.lit(float(NUDGE)) + F.sqrt(squared(a, b)), 6)
    u, v, w = (F.col(c) for c in "uvw")
    rows = placed.join(around.hint("merge"), ["gx", "gy"]).select(F.struct("cell", "x", "y").alias("u"), "cells")
    rows = rows.select("u", F.filter("cells", lambda p: (p["cell"] > u["cell"]) & (squared(u, p) <= reach * reach)).alias("near")).filter(F.size("near") > 1)
    rows = rows.select("u", "near", F.explode("near").alias("v")).select("u", "v", F.explode("near").alias("w"))
    rows = rows.filter((w["cell"] > v["cell"]) & (squared(v, w) <= reach * reach))
    return rows.select(u["cell"].alias("u"), v["cell"].alias("v"), w["cell"].alias("w"), F.greatest(side(u, v), side(u, w), side(v, w)).alias("filtration"))


def rank_over_two(columns: DataFrame) -> int:
    """columns (rows: array of orderable values, each once) -> the rank of the matrix over GF(2)."""
    found, now = 0, saved(columns.filter("size(rows) > 0").select("rows", F.array_max("rows").alias("pivot")))
    while True:
        lead = now.groupBy("pivot").agg(F.count("*").alias("n"), F.min(F.struct(F.size("rows").alias("k"), "rows")).alias("least"))
        lead = saved(lead.select("pivot", "n", F.col("least.rows").alias("base")))
        if lead.filter("n > 1").limit(1).isEmpty():
            return found + lead.count()
        # a pivot that one column has stays as it is until another column falls to it
        x = F.col("rows")
        met = now.join(lead, "pivot")
        changed = met.filter(x != F.col("base")).select(F.array_union(F.array_except(x, "base"), F.array_except("base", x)).alias("rows"))
        kept = lead.select(F.col("base").alias("rows"), "pivot")
        now = saved(kept.unionByName(changed.filter("size(rows) > 0").select("rows", F.array_max("rows").alias("pivot"))))


def betti(edges: DataFrame, nodes: DataFrame | None = None) -> dict[str, int]:
    """edges (a, b), nodes (node) or None for the ends of edges -> vertices, edges, triangles, b0,
    cycle_rank (loops before triangles fill any), b1."""
    links = saved(undirected(edges))
    ends = links.select(F.explode(F.array("a", "b")).alias("node"))
    n_nodes = (ends if nodes is None else ends.unionByName(nodes.select("node").dropna())).distinct().count()
    n_edges, n_ends = links.count(), ends.distinct().count()
    groups = components(links).agg(F.count_distinct("root")).first()[0] + n_nodes - n_ends if n_edges else n_nodes
    faces = saved(triangles(links))
    side = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    filled = rank_over_two(faces.select(F.array(side("u", "v"), side("u", "w"), side("v", "w")).alias("rows")))
    cycles = n_edges - n_nodes + groups
    return {"vertices": n_nodes, "edges": n_edges, "triangles": faces.count(), "b0": groups, "cycle_rank": cycles, "b1": cycles - filled}


def drift(before: DataFrame, after: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Two graphs' edges (a, b), over the same nodes if they are given -> one row: b0 and b1 of both,
    their changes, anomaly (fragmentation: more groups; loop_formation: more loops; merging: fewer
    groups; in this order, or null) and severity by the sum of both changes."""
    x, y = betti(before, nodes), betti(after, nodes)
    d0, d1 = y["b0"] - x["b0"], y["b1"] - x["b1"]
    kind = "fragmentation" if d0 > 0 else "loop_formation" if d1 > 0 else "merging" if d0 < 0 else None
    size = abs(d0) + abs(d1)
    severity = "none" if size == 0 else "low" if size <= 2 else "medium" if size <= 5 else "high"
    row = (x["b0"], y["b0"], x["b1"], y["b1"], d0, d1, kind, severity)
    names = "groups_before long, groups_after long, loops_before long, loops_after long, change long, loop_change long, anomaly string, severity string"
    return before.sparkSession.createDataFrame([row], names)
