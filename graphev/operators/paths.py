"""Joins over the graph: compositions, bounded paths, gaps and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphev.functions.shared import saved, stored
from graphev.operators.ranks import row_numbers
from graphev.operators.relation import NUDGE, Relation, Stepped

#: Drug edges of one part of the chains; a part is what a task groups or sorts.
EDGES_AT_ONCE, EDGES_LEAST = 200_000, 10_000


def parts_of(edges: DataFrame) -> int:
    """Into how many parts rows are dealt that are opened there: the more edges, the more parts."""
    n = edges.count()
    return max(1, min(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // EDGES_LEAST), -(-n // EDGES_AT_ONCE))


def chains(view: DataFrame, labels: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """a, b, c, f_name, g_name, fc, gc, b_type, b_ends: every edge from a drug a to b with every edge from b to
    a disease c; b_type is b's type, b_ends the number of b's diseases. With labels: treated. With ids (b, b_id):
    b_id.

    Chains are many times the edges and are never moved. A node's edges to diseases are made one list of
    codes and confidences, the drug edges meet these lists and are dealt by their drug, and the lists are
    opened there, so that whatever is grouped by a and other columns stays where it is. Codes are numbers
    of the distinct diseases and relations, which are few and broadcast. More edges make more parts, not
    larger ones."""
    into = view.filter("target_type = 'Disease'").select(F.col("source_name").alias("b"), F.col("target_name").alias("c"), F.col("name").alias("g_name"), F.col("confidence").alias("gc"))
    codes = F.broadcast(into.select(F.col("c").alias("_c"), F.col("g_name").alias("_g")).distinct().withColumn("code", F.row_number().over(W.orderBy("_c", "_g"))))
    named = into.join(codes, F.expr("c <=> _c AND g_name <=> _g"))
    lists = named.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("code", "gc"))).alias("g"), F.size(F.collect_set("c")).alias("b_ends"))
    lists = lists.select("b", F.col("g.code").alias("codes"), F.col("g.gc").alias("gcs"), "b_ends")
    lists = lists if ids is None else lists.join(ids, "b")
    out = view.filter("source_type = 'Drug'").select(F.col("source_name").alias("a"), F.col("target_name").alias("b"), F.col("name").alias("f_name"), F.col("confidence").alias("fc"), F.col("target_type").alias("b_type"))
    rows = out.join(lists.hint("merge"), "b").repartition(parts_of(out), "a")
    columns = ["a", "b", "f_name", "fc", "b_type", "b_ends", *(["b_id"] if ids is not None else [])]
    if labels is not None:
        treats = labels.groupBy(F.col("source_name").alias("_a")).agg(F.collect_set("target_name").alias("_treats"))
        rows, columns = rows.join(treats.hint("shuffle_hash"), F.col("a") == F.col("_a"), "left"), [*columns, "_treats"]
    rows = rows.select(*columns, F.explode(F.arrays_zip("codes", "gcs")).alias("g")).withColumns({"code": F.col("g.codes"), "gc": F.col("g.gcs")}).drop("g").join(codes, "code").drop("code").withColumnsRenamed({"_c": "c", "_g": "g_name"})
    return rows if labels is None else rows.withColumn("treated", F.coalesce(F.array_contains("_treats", F.col("c")), F.lit(False))).drop("_treats")


_horns = Relation("SELECT a, b, c, f_name, g_name, round(fc * gc, 4) AS composite, treated, b_type, b_ends FROM {chains}", ("chains",))
inner_horns = Stepped(
    """SELECT f.source_name AS a, f.target_name AS b, g.target_name AS c, f.name AS f_name, g.name AS g_name, round(f.confidence * g.confidence, 4) AS composite,
EXISTS (SELECT 1 FROM {labels} l WHERE l.source_name = f.source_name AND l.target_name = g.target_name) AS treated
FROM {view} f JOIN {view} g ON f.target_name = g.source_name WHERE f.source_type = 'Drug' AND g.target_type = 'Disease'""",
    ("view", "labels"), {}, "C1: drug to intermediate to disease, with its product; b_type and b_ends of chains() come with it",
    lambda view, labels: _horns(chains(view, labels)),
)
horn_counts = Relation(
    "SELECT a, c, count(*) AS horns, round(max(composite), 6) AS best, round(sum(composite), 4) AS total, bool_or(treated) AS treated FROM {horns} GROUP BY a, c", ("horns",), {}, "C1 by pair"
)
best_fillers = Relation(
    """SELECT a, c, b, f_name, g_name, composite FROM (SELECT *, row_number() OVER (PARTITION BY a, c ORDER BY composite DESC, b, f_name, g_name) AS k FROM {horns}) q WHERE k = 1""",
    ("horns",), {}, "C2: a pair's best intermediate",
)


def _best_fillers(view: DataFrame) -> DataFrame:
    """a, c, b, f_name, g_name, composite of C2 without sorting chains: what the order asks for is one number, the
    composite in ten-thousandths above the place of (b, f_name, g_name) from the last, and its maximum is
    taken where the chains are made."""
    names = view.select(F.col("name").alias("said")).distinct().withColumn("name", F.row_number().over(W.orderBy("said")))
    bs = view.filter("source_type = 'Drug'").select(F.col("target_name").alias("b"))
    bs = bs.join(view.filter("target_type = 'Disease'").select(F.col("source_name").alias("b")).distinct(), "b", "left_semi").distinct()
    ids = saved(row_numbers(bs, [F.asc("b")], "b_id"))
    base = names.count() + 1
    bits = ((ids.count() + 1) * base * base).bit_length()
    numbered = view.withColumnRenamed("name", "said").join(F.broadcast(names), "said").drop("said")
    place = (F.col("b_id") * base + F.col("f_name")) * base + F.col("g_name")
    tenths = F.round(F.round(F.lit(float(NUDGE)) + F.col("fc") * F.col("gc"), 4) * 10_000).cast("long")
    rows = chains(numbered, ids=ids).groupBy("a", "c").agg(F.max(F.shiftleft(tenths, bits) + (F.lit((1 << bits) - 1) - place)).alias("key"))
    rows = rows.withColumns({"place": F.lit((1 << bits) - 1) - F.col("key").bitwiseAND(F.lit((1 << bits) - 1)), "composite": F.shiftright("key", bits) / 10_000.0})
    rows = rows.withColumns({"g": F.col("place") % base, "f": F.expr(f"place div {base} % {base}"), "b_id": F.expr(f"place div {base * base}")}).join(ids, "b_id")
    for n in "fg":
        rows = rows.join(F.broadcast(names.select(F.col("name").alias(n), F.col("said").alias(f"{n}_name"))), n)
    return rows.select("a", "c", "b", "f_name", "g_name", "composite")


best_fillers_by_places = Stepped("", ("view",), {}, "C2 from edges", _best_fillers)
conflicts = Relation(
    """SELECT a, c, count(*) AS chains, max(composite) AS high, min(composite) AS low, round(max(composite) - min(composite), 4) AS spread FROM {horns}
GROUP BY a, c HAVING count(*) >= 2 AND max(composite) >= :hi AND min(composite) <= :lo""",
    ("horns",), {"hi": 0.5, "lo": 0.2}, "C10: pairs with a strong and a weak chain",
)
invertible_pairs = Relation(
    """SELECT DISTINCT m.source_name AS a, m.target_name AS b FROM {morphisms} m JOIN {morphisms} w ON m.source_name = w.target_name AND m.target_name = w.source_name
WHERE m.source_name < m.target_name""",
    ("morphisms",), {}, "C9: pairs with edges both ways",
)
def _over(last: DataFrame) -> DataFrame:
    """a, b, c, composed, direct. Edges bring lists instead of two-edge paths: for a disease c the ends of an
    edge a, b bring their edges to diseases; for another c the ends of an edge b, c bring hashes of what leads
    to them, and only what they share looks up its edges."""
    edges = last.filter("source_name <> target_name").select(F.col("source_name").alias("s"), F.col("target_name").alias("t"), F.col("confidence").alias("w"), F.coalesce(F.col("target_type") == "Disease", F.lit(False)).alias("ends"))
    ends, others = edges.filter("ends"), edges.filter("NOT ends")
    codes = F.broadcast(ends.select(F.col("t").alias("c")).distinct().withColumn("code", F.row_number().over(W.orderBy("c"))))
    lists = ends.join(codes, F.col("t") == F.col("c")).groupBy("s").agg(F.sort_array(F.collect_list(F.struct("code", "w"))).alias("l")).select("s", F.col("l.code").alias("codes"), F.col("l.w").alias("ws"))
    of = lambda to, codes, ws: lists.select(F.col("s").alias(to), F.col("codes").alias(codes), F.col("ws").alias(ws)).hint("merge")
    f = edges.select(F.col("s").alias("a"), F.col("t").alias("b"), F.col("w").alias("fw"))
    two = f.join(of("a", "hs", "hw"), "a").join(of("b", "gs", "gw"), "b").withColumn("g", F.explode(F.arrays_zip("gs", "gw")))
    two = two.withColumn("at", F.array_position("hs", F.col("g.gs"))).filter("at > 0").select("a", "b", F.col("g.gs").alias("code"), "fw", F.col("g.gw").alias("gw"), F.expr("element_at(hw, CAST(at AS INT))").alias("direct"))
    two = two.filter("fw * gw > direct + 1e-9").join(codes, "code").select("a", "b", "c", "fw", "gw", "direct")
    by = lambda rows, to, name: rows.groupBy(F.col("t").alias(to)).agg(F.collect_set(F.hash("s")).alias(name)).hint("merge")
    g = others.select(F.col("s").alias("b"), F.col("t").alias("c"), F.col("w").alias("gw"))
    into = edges.join(others.select(F.col("s").alias("t")).distinct(), "t", "left_semi")
    met = g.join(by(into, "b", "x"), "b").join(by(others, "c", "y"), "c").select("b", "c", "gw", F.explode(F.array_intersect("x", "y")).alias("code"))
    met = met.join(f.withColumn("code", F.hash("a")), ["b", "code"]).join(others.select(F.col("s").alias("a"), F.col("t").alias("c"), F.col("w").alias("direct")), ["a", "c"])
    return two.unionByName(met.filter("fw * gw > direct + 1e-9").select("a", "b", "c", "fw", "gw", "direct"))


_axiom = Relation("SELECT a, b, c, round(fw * gw, 6) AS composed, direct FROM {over}", ("over",))
composition_axiom = Stepped(
    """SELECT f.source_name AS a, f.target_name AS b, g.target_name AS c, round(f.confidence * g.confidence, 6) AS composed, h.confidence AS direct
FROM {last} f JOIN {last} g ON f.target_name = g.source_name JOIN {last} h ON h.source_name = f.source_name AND h.target_name = g.target_name
WHERE f.source_name <> f.target_name AND g.source_name <> g.target_name AND f.source_name <> g.target_name AND f.confidence * g.confidence > h.confidence + 0.000000001""",
    ("last",), {}, "C8: where a direct edge is weaker than a composition", lambda last: _axiom(_over(last)),
)
propagated = Relation(
    """SELECT DISTINCT i.target_name AS source_name, k.target_name, 'associated_with' AS name, :confidence AS confidence
FROM {view} k JOIN {view} i ON i.source_name = k.source_name AND i.name = 'interacts_with'
WHERE k.name = 'driver_of' AND NOT EXISTS (SELECT 1 FROM {view} e WHERE e.source_name = i.target_name AND e.target_name = k.target_name)""",
    ("view",), {"confidence": 0.5}, "C12: what drives a disease passes to its interaction partners",
)
fused_edges = Relation(
    """SELECT source_name, target_name, max(confidence) AS confidence, count(*) AS sources, count(DISTINCT name) AS relations, max(provenance) AS last_source FROM {view}
WHERE target_type = 'Disease' GROUP BY source_name, target_name""",
    ("view",), {}, "C13: an edge from all its sources",
)
transferred = Relation(
    """SELECT b.target_name AS source_name, e.target_name, e.name, round(max(e.confidence * b.confidence), 6) AS confidence
FROM {view} b JOIN {view} e ON e.source_name = b.source_name AND e.target_type = 'Disease' WHERE b.name = 'interacts_with' AND b.confidence >= :least
GROUP BY b.target_name, e.target_name, e.name""",
    ("view",), {"least": 0.8}, "C15: edges copied over a bridge, scaled by it",
)
recoverable = Relation(
    """SELECT count(*) AS labels, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM {horns} h WHERE h.a = l.source_name AND h.c = l.target_name)) AS recoverable FROM {labels} l""",
    ("labels", "horns"), {}, "C16: labels that a chain explains",
)
reachable_share = Relation(
    """SELECT count(*) AS pairs, count(h.a) AS reached, round(count(h.a) / CAST(count(*) AS DOUBLE), 6) AS share
FROM {pairs} p LEFT JOIN (SELECT DISTINCT a, c FROM {horns}) h ON h.a = p.source_name AND h.c = p.target_name""",
    ("pairs", "horns"), {}, "C17: pairs within two hops",
)
coverage_gaps = Relation(
    """WITH reached AS (SELECT DISTINCT source_name AS p, target_name AS d FROM {view} WHERE target_type = 'Disease'),
hit AS (SELECT target_name AS p, count(DISTINCT source_name) AS drugs FROM {view} WHERE source_type = 'Drug' GROUP BY target_name),
seen AS (SELECT p, count(*) AS n FROM reached GROUP BY p),
gap AS (SELECT h.p, h.drugs, coalesce(s.n, 0) AS n, o.name AS d FROM hit h JOIN {objects} o ON o.type_name = 'Disease' LEFT JOIN seen s ON s.p = h.p
  WHERE NOT EXISTS (SELECT 1 FROM reached r WHERE r.p = h.p AND r.d = o.name)),
ranked AS (SELECT p, d, drugs, row_number() OVER (PARTITION BY p ORDER BY d) AS depth, CASE WHEN n = 0 THEN 0 ELSE 1 END AS known FROM gap)
SELECT p AS source_name, d AS target_name, drugs, depth, known FROM ranked""",
    ("view", "objects"), {}, "C11: druggable targets without an edge to a disease; order by depth, known, drugs descending, name for the round robin",
)
walks = Relation(
    """SELECT f.source_name AS source, g.target_name AS target, 2 AS length, f.confidence * g.confidence AS weight, f.target_name AS n1, CAST(NULL AS STRING) AS n2
FROM {last} f JOIN {last} g ON f.target_name = g.source_name WHERE f.source_type = 'Drug' AND g.target_type = 'Disease'
UNION ALL
SELECT f.source_name, h.target_name, 3, f.confidence * g.confidence * h.confidence, f.target_name, g.target_name
FROM {last} f JOIN {last} g ON f.target_name = g.source_name JOIN {last} h ON g.target_name = h.source_name
WHERE f.source_type = 'Drug' AND g.target_type NOT IN ('Drug', 'Disease') AND h.target_type = 'Disease' AND f.target_name <> g.target_name""",
    ("last",), {}, "C3: simple paths from drugs to diseases over two or three edges",
)
path_counts = Relation(
    "SELECT source, target, length, count(*) AS n, round(max(weight), 6) AS best FROM {walks} GROUP BY source, target, length", ("walks",), {}, "C3, C6 by pair"
)
_pair_counts = Relation("SELECT source, target, length, n, round(best, 6) AS best FROM {counts}", ("counts",))


def _counts(last: DataFrame) -> DataFrame:
    """source, target, length, n, best without walks of three edges: what leads on from a node to a disease is
    one row of their number and best weight, and a drug's edge takes it over whole. Each step is stored, so
    that its shuffles are gone before the next; lists hold numbers of the diseases, which are few."""
    many, best = F.count("*").alias("n"), F.max(F.col("fc") * F.col("gc")).alias("best")
    two = stored(chains(last).groupBy("a", "c").agg(many, best), "two-edges")
    inner = last.filter("target_type NOT IN ('Drug', 'Disease') AND source_name <> target_name").withColumn("source_type", F.lit("Drug"))
    onward = chains(inner.unionByName(last.filter("target_type = 'Disease'").withColumn("source_type", F.lit("")))).groupBy(F.col("a").alias("b"), "c").agg(many, best)
    codes = F.broadcast(last.filter("target_type = 'Disease'").select(F.col("target_name").alias("_c")).distinct().withColumn("code", F.row_number().over(W.orderBy("_c"))))
    lists = onward.join(codes, F.col("c") == F.col("_c")).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("code", "n", "best"))).alias("g")).select("b", *[F.col(f"g.{x}").alias(x) for x in ("code", "n", "best")])
    lists = stored(lists, "onward")
    out = last.filter("source_type = 'Drug'").select(F.col("source_name").alias("a"), F.col("target_name").alias("b"), F.col("confidence").alias("fc"))
    rows = out.join(lists.hint("merge"), "b").repartition(parts_of(out), "a").select("a", "fc", F.explode(F.arrays_zip("code", "n", "best")).alias("g"))
    three = rows.groupBy("a", F.col("g.code").alias("code")).agg(F.sum("g.n").alias("n"), F.max(F.col("fc") * F.col("g.best")).alias("best")).join(codes, "code").withColumnRenamed("_c", "c")
    of = lambda rows, length: rows.select(F.col("a").alias("source"), F.col("c").alias("target"), F.lit(length).alias("length"), "n", "best")
    return of(two, 2).unionByName(of(three, 3))


path_counts_by_steps = Stepped("", ("last",), {}, "C3, C6 by pair from edges", lambda last: _pair_counts(_counts(last)))
top_paths = Relation(
    """SELECT source, target, k, length, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY round(weight, 6) DESC, length, n1, n2) AS k
FROM {walks}) q WHERE k <= :k_most""",
    ("walks",), {"k_most": 5}, "C7: the k best paths of a pair",
)
_semirings = Relation(
    """SELECT a AS source, c AS target, round(max(fc * gc), 6) AS product_best, round(max(fc + gc), 6) AS sum_best, round(max(1 - (1 - fc) * (1 - gc)), 6) AS either_best, round(max(greatest(fc, gc)), 6) AS max_best,
round(max(least(fc, gc)), 6) AS min_best FROM {chains} GROUP BY a, c""",
    ("chains",),
)
semiring_weights = Stepped(
    """SELECT source, target, round(max(weight), 6) AS product_best, round(max(a + b), 6) AS sum_best, round(max(1 - (1 - a) * (1 - b)), 6) AS either_best, round(max(greatest(a, b)), 6) AS max_best,
round(max(least(a, b)), 6) AS min_best FROM (SELECT f.source_name AS source, g.target_name AS target, f.confidence AS a, g.confidence AS b, f.confidence * g.confidence AS weight
FROM {last} f JOIN {last} g ON f.target_name = g.source_name WHERE f.source_type = 'Drug' AND g.target_type = 'Disease') q GROUP BY source, target""",
    ("last",), {}, "C5: the best two-edge path under five semirings", lambda last: _semirings(chains(last)),
)
gap_fillers = Relation(
    """WITH e AS (SELECT source_name AS s, target_name AS t, name, confidence AS w, source_type AS kind, target_type AS ends FROM {last} WHERE confidence * 0.9 >= :least),
two AS (SELECT f.s, f.t AS n1, g.t, f.name, f.w * g.w AS w, g.ends FROM e f JOIN e g ON g.s = f.t WHERE f.kind = 'Drug' AND g.t <> f.s AND g.t <> f.t AND f.w * g.w * 0.9 >= :least),
three AS (SELECT p.s, p.n1, p.t AS n2, g.t, p.name, p.w * g.w AS w, g.ends FROM two p JOIN e g ON g.s = p.t WHERE p.ends <> 'Disease' AND g.t <> p.s AND g.t <> p.n1 AND g.t <> p.t AND p.w * g.w * 0.7 >= :least),
four AS (SELECT p.s, g.t, p.name, p.w * g.w AS w FROM three p JOIN e g ON g.s = p.t WHERE p.ends <> 'Disease' AND g.ends = 'Disease' AND g.t <> p.s AND g.t <> p.n1 AND g.t <> p.n2 AND p.w * g.w * 0.5 >= :least),
f AS (SELECT s, t, name, w * 0.9 AS c FROM two WHERE ends = 'Disease' UNION ALL SELECT s, t, name, w * 0.7 FROM three WHERE ends = 'Disease' UNION ALL SELECT s, t, name, w * 0.5 FROM four)
SELECT f.s AS source, f.t AS target, f.name AS relation, round(max(f.c), 6) AS confidence FROM f
WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.source_name = f.s AND l.target_name = f.t) AND NOT EXISTS (SELECT 1 FROM {last} d WHERE d.source_name = f.s AND d.target_name = f.t)
GROUP BY f.s, f.t, f.name""",
    ("last", "labels"), {"least": 0.4}, "C18: pairs without an edge that paths of two to four edges fill, penalised by length, the best by first relation; a path is left as soon as its product cannot reach the bar any more",
)
