"""Graph analytics on undirected simple neighbours, cells in space, and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphev.functions.shared import saved
from graphev.operators import signed
from graphev.operators.relation import NUDGE, Relation, Stepped

neighbours = Relation(
    """SELECT source_name AS a, target_name AS b FROM {view} WHERE name = 'interacts_with' AND source_name <> target_name
UNION SELECT target_name, source_name FROM {view} WHERE name = 'interacts_with' AND source_name <> target_name""",
    ("view",), {}, "both directions of every interaction, once",
)
degrees = Relation("SELECT a AS node, count(*) AS degree FROM {neighbours} GROUP BY a", ("neighbours",), {}, "I3")
curvature = Relation(
    """WITH d AS (SELECT a, count(*) AS n FROM {neighbours} GROUP BY a), m AS (SELECT max(n) AS most FROM d),
o AS (SELECT x.a, x.b, count(*) AS n FROM {neighbours} x JOIN {neighbours} y ON x.a = y.a JOIN {neighbours} z ON z.a = x.b AND z.b = y.b WHERE x.a < x.b GROUP BY x.a, x.b),
k AS (SELECT e.a, e.b, 1.0 / m.most - 1 + coalesce(o.n, 0) / CAST(greatest(da.n, db.n) AS DOUBLE) AS kappa FROM {neighbours} e JOIN d da ON da.a = e.a JOIN d db ON db.a = e.b
LEFT JOIN o ON o.a = e.a AND o.b = e.b, m WHERE e.a < e.b)
SELECT a, b, round(kappa + :alpha * (1 - kappa), 6) AS kappa, CASE WHEN kappa + :alpha * (1 - kappa) > 0.2 THEN 'SPHERICAL' WHEN kappa + :alpha * (1 - kappa) < -0.2 THEN 'HYPERBOLIC' ELSE 'EUCLIDEAN' END AS class FROM k""",
    ("neighbours",), {"alpha": 0.5}, "I1: lower bound of curvature",
)
node_curvature = Relation(
    "SELECT node, round(avg(kappa), 6) AS kappa, count(*) AS edges FROM (SELECT a AS node, kappa FROM {curvature} UNION ALL SELECT b, kappa FROM {curvature}) q GROUP BY node", ("curvature",), {}, "I1, I2"
)
curvature_vote = Relation(
    """SELECT e.a AS source, e.b AS target, round(least(0.85, 0.75 + greatest(0.0, 0.15 - 0.3 * abs(x.kappa - y.kappa))), 6) AS confidence FROM {curvature} e JOIN {nodes} x ON x.node = e.a JOIN {nodes} y ON y.node = e.b""",
    ("curvature", "nodes"), {}, "D13: ends of like curvature",
)
short_cycles = Relation(
    """SELECT DISTINCT m.source_name AS node, 2 AS length FROM {view} m JOIN {view} w ON m.source_name = w.target_name AND m.target_name = w.source_name WHERE m.name = 'interacts_with' AND w.name = 'interacts_with'
UNION SELECT a.source_name, 3 FROM {view} a JOIN {view} b ON a.target_name = b.source_name JOIN {view} c ON b.target_name = c.source_name AND c.target_name = a.source_name
WHERE a.name = 'interacts_with' AND b.name = 'interacts_with' AND c.name = 'interacts_with'""",
    ("view",), {}, "I4: nodes on cycles of two or three edges",
)
triangles = Relation(
    "SELECT x.a AS u, x.b AS v, y.b AS w FROM {neighbours} x JOIN {neighbours} y ON x.b = y.a JOIN {neighbours} z ON z.a = x.a AND z.b = y.b WHERE x.a < x.b AND y.a < y.b", ("neighbours",), {}, "I8: triangles"
)
complex_counts = Relation(
    "SELECT (SELECT count(DISTINCT a) FROM {neighbours}) AS vertices, (SELECT count(*) FROM {neighbours} WHERE a < b) AS edges, (SELECT count(*) FROM {triangles}) AS triangles", ("neighbours", "triangles"), {}, "I8"
)
signed_coverage = Relation(
    """SELECT name, count(*) AS n, count(*) FILTER (WHERE sign = 1) AS plus, count(*) FILTER (WHERE sign = -1) AS minus FROM (SELECT name, CASE name WHEN 'activates' THEN 1 WHEN 'inhibits' THEN -1 WHEN 'driver_of' THEN 1 ELSE 0 END AS sign
FROM {view}) q GROUP BY name""",
    ("view",), {}, "I11",
)


def _spread(view: DataFrame) -> DataFrame:
    panel = view.filter("target_type = 'Disease'").select(F.col("target_name").alias("part"), F.col("target_name").alias("node"), F.lit(1.0).alias("x")).distinct()
    found = signed.effects(signed.saved(signed.signed_edges(view)), panel)
    return found.filter("node LIKE 'S%'").select(F.col("node").alias("drug"), F.col("part").alias("node"), F.round(F.lit(float(NUDGE)) + F.col("total"), 8).alias("total"))


def _reaches(view: DataFrame) -> DataFrame:
    edges = view.select(F.col("source_name").alias("s"), F.col("target_name").alias("t"))
    return signed.reverse_reach(edges, view.filter("target_type = 'Disease'").select(F.col("target_name").alias("node")))


signed_spread = Stepped(
    """WITH e AS (SELECT source_name AS s, target_name AS t, (CASE name WHEN 'inhibits' THEN -1.0 ELSE 1.0 END) / count(*) OVER (PARTITION BY source_name) AS w FROM {view} WHERE name <> 'modulates'),
x1 AS (SELECT s AS drug, t AS node, sum(w) AS x FROM e WHERE s LIKE 'S%' GROUP BY s, t), x2 AS (SELECT p.drug, e.t AS node, sum(p.x * e.w) AS x FROM x1 p JOIN e ON e.s = p.node GROUP BY p.drug, e.t),
x3 AS (SELECT p.drug, e.t AS node, sum(p.x * e.w) AS x FROM x2 p JOIN e ON e.s = p.node GROUP BY p.drug, e.t), x4 AS (SELECT p.drug, e.t AS node, sum(p.x * e.w) AS x FROM x3 p JOIN e ON e.s = p.node GROUP BY p.drug, e.t)
SELECT drug, node, round(sum(x), 8) AS total FROM (SELECT drug, node, 0.5 * x AS x FROM x1 UNION ALL SELECT drug, node, 0.25 * x FROM x2 UNION ALL SELECT drug, node, 0.125 * x FROM x3 UNION ALL SELECT drug, node, 0.0625 * x FROM x4) q
WHERE node LIKE 'N%' GROUP BY drug, node""",
    ("view",), {}, "I12, I13: signed effects over four steps, each weaker by half, read at the diseases and spread backwards from them", _spread,
)
reaches = Stepped(
    """WITH r1 AS (SELECT DISTINCT source_name AS node FROM {view} WHERE target_type = 'Disease'), r2 AS (SELECT DISTINCT v.source_name AS node FROM {view} v JOIN r1 r ON r.node = v.target_name),
r3 AS (SELECT DISTINCT v.source_name AS node FROM {view} v JOIN r2 r ON r.node = v.target_name), r4 AS (SELECT DISTINCT v.source_name AS node FROM {view} v JOIN r3 r ON r.node = v.target_name)
SELECT node, min(k) AS steps FROM (SELECT node, 1 AS k FROM r1 UNION ALL SELECT node, 2 FROM r2 UNION ALL SELECT node, 3 FROM r3 UNION ALL SELECT node, 4 FROM r4) q GROUP BY node""",
    ("view",), {}, "I14: what reaches a disease, in how many steps", _reaches,
)
section_gap = Relation(
    """SELECT name, count(*) AS edges, round(avg(abs(x.size_value - y.size_value) / greatest(abs(x.size_value), abs(y.size_value), 1)), 6) AS mean_gap, round(sum((x.size_value - y.size_value) * (x.size_value - y.size_value)), 2) AS variation
FROM {view} v JOIN {objects} x ON x.name = v.source_name JOIN {objects} y ON y.name = v.target_name GROUP BY v.name""".replace("SELECT name", "SELECT v.name AS name"),
    ("view", "objects"), {}, "I17",
)
# --- space: the first two dimensions of a vector are a cell's place ------------------------------
cells = Relation(
    """SELECT vec_id AS cell, label AS kind, round(CAST(element_at(embedding, 1) AS DOUBLE) * 100, 4) AS x, round(CAST(element_at(embedding, 2) AS DOUBLE) * 100, 4) AS y,
round(abs(CAST(element_at(embedding, 3) AS DOUBLE)) * 10, 4) AS ligand, round(abs(CAST(element_at(embedding, 4) AS DOUBLE)) * 10, 4) AS receptor FROM {vectors}""",
    ("vectors",), {}, "A21",
)
proximity = Relation(
    """WITH c AS (SELECT *, CAST(floor(x / :reach) AS INT) AS gx, CAST(floor(y / :reach) AS INT) AS gy FROM {cells}), o AS (VALUES (-1), (0), (1)),
near AS (SELECT c.*, c.gx + ox.d AS nx, c.gy + oy.d AS ny FROM c, (SELECT * FROM o) AS ox(d), (SELECT * FROM o) AS oy(d))
SELECT a.cell AS a, b.cell AS b, round(least(a.ligand, b.receptor) * exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / (2 * :reach * :reach / 4.0)), 6) AS confidence
FROM near a JOIN c b ON b.gx = a.nx AND b.gy = a.ny WHERE a.cell <> b.cell AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= :reach * :reach AND a.ligand >= 0.5 AND b.receptor >= 0.5""",
    ("cells",), {"reach": 2.0}, "K2: ligand and receptor of cells within reach, over a grid of that width",
)
motif_scores = Relation(
    """SELECT x.kind AS from_kind, y.kind AS to_kind, count(*) AS edges, round(avg(p.confidence), 6) AS mean_confidence FROM {proximity} p JOIN {cells} x ON x.cell = p.a JOIN {cells} y ON y.cell = p.b GROUP BY x.kind, y.kind""",
    ("proximity", "cells"), {}, "K4",
)


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """Edges (a, b, w) -> (node, rank). Rank of nodes without out-edges is dealt to all. The
    ranks are written to the shared folder every few rounds."""
    edges = edges.groupBy("a", "b").agg(F.sum("w").alias("w"))
    weighed = edges.join(edges.groupBy("a").agg(F.sum("w").alias("out")), "a").select("a", "b", (F.col("w") / F.col("out")).alias("w"))
    weighed = saved(weighed)
    nodes = saved(weighed.select(F.col("a").alias("node")).union(weighed.select("b")).distinct())
    n = nodes.count()
    sinks = saved(nodes.join(weighed.select(F.col("a").alias("node")), "node", "left_anti"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        lost = ranks.join(sinks, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = weighed.join(ranks, weighed["a"] == ranks["node"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        ranks = nodes.join(got, "node", "left").crossJoin(F.broadcast(lost)).select(
            "node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")
        )  # one row is broadcast
        if i % every == every - 1:
            ranks = saved(ranks)
    return ranks


def kcore(neighbours: DataFrame) -> DataFrame:
    """Neighbours (a, b), both directions -> (node, core). Every node starts with its degree
    and takes, round by round, the largest h such that h of its neighbours have h or more; this
    settles at the core numbers. Neighbours of equal value are counted before they are ordered,
    so a hub is no long list."""
    links = saved(neighbours.select("a", "b").distinct())
    now = saved(links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("core")))
    while True:
        counts = links.join(now, links["b"] == now["node"]).groupBy("a", "core").agg(F.count("*").alias("n"))
        many = F.sum("n").over(W.partitionBy("a").orderBy(F.desc("core")))
        after = counts.withColumn("h", F.least("core", many)).groupBy(F.col("a").alias("node")).agg(F.max("h").alias("core"))
        after = saved(after)
        moved = after.alias("x").join(now.alias("y"), "node").filter("x.core <> y.core")
        now = after
        if moved.isEmpty():
            return now


def refined(edges: DataFrame) -> DataFrame:
    """C14: edges (a, b, w) with each weight raised to the best product of two others, again and
    again until nothing gains."""
    now = saved(edges.groupBy("a", "b").agg(F.max("w").alias("w")))
    while True:
        f, g = now.alias("f"), now.alias("g")
        two = f.join(g, F.col("f.b") == F.col("g.a")).select(F.col("f.a").alias("a"), F.col("g.b").alias("b"), (F.col("f.w") * F.col("g.w")).alias("v"))
        best = two.join(now.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.max("v").alias("v"))
        after = saved(now.join(best, ["a", "b"], "left").select("a", "b", F.greatest("w", F.coalesce("v", F.lit(0.0))).alias("w"), (F.col("v") > F.col("w")).alias("gained")))
        now = after.select("a", "b", "w")
        if after.filter("gained").limit(1).isEmpty():
            return now
