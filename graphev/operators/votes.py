"""Link-prediction votes: each is one relation of (source, target, confidence)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphev.functions.shared import saved
from graphev.operators.paths import chains, parts_of
from graphev.operators.relation import Relation, Stepped

_composition = Relation(
    """SELECT a AS source, c AS target, round(max(fc * gc), 6) AS confidence, count(*) AS chains, round(sum(fc * gc), 4) AS total FROM {chains} WHERE b_type NOT IN ('Drug', 'Disease') GROUP BY a, c""", ("chains",)
)
_pathway_support = Relation(
    """SELECT a AS source, c AS target, round(least(:cap, avg(fc * gc) * (1 + 0.1 * least(count(*) - 1, 4))), 6) AS confidence FROM {chains} WHERE b_type NOT IN ('Drug', 'Disease') GROUP BY a, c""", ("chains",)
)
composition = Stepped(
    """SELECT f.source_name AS source, g.target_name AS target, round(max(f.confidence * g.confidence), 6) AS confidence, count(*) AS chains, round(sum(f.confidence * g.confidence), 4) AS total
FROM {last} f JOIN {last} g ON f.target_name = g.source_name WHERE f.source_type = 'Drug' AND g.target_type = 'Disease' AND f.target_type NOT IN ('Drug', 'Disease')
GROUP BY f.source_name, g.target_name""",
    ("last",), {}, "D1: one path for each intermediate; only where no edge exists, which a strict view gives",
    lambda last: _composition(chains(last)),
)
pathway_support = Stepped(
    """SELECT f.source_name AS source, g.target_name AS target, round(least(:cap, avg(f.confidence * g.confidence) * (1 + 0.1 * least(count(*) - 1, 4))), 6) AS confidence
FROM {view} f JOIN {view} g ON f.target_name = g.source_name WHERE f.source_type = 'Drug' AND g.target_type = 'Disease' AND f.target_type NOT IN ('Drug', 'Disease')
GROUP BY f.source_name, g.target_name""",
    ("view",), {"cap": 0.85}, "D2: all parallel edges",
    lambda view, cap=0.85: _pathway_support(chains(view), cap=cap),
)
overlaps = Relation(
    """WITH o AS (SELECT DISTINCT source_name AS s, target_name AS t FROM {typed} WHERE source_type = 'Drug'), r AS (SELECT DISTINCT source_name AS s, name AS t FROM {typed} WHERE source_type = 'Drug'),
ot AS (SELECT a.s AS a, b.s AS b, count(*) AS n FROM o a JOIN o b ON a.t = b.t AND a.s <> b.s GROUP BY a.s, b.s),
rt AS (SELECT a.s AS a, b.s AS b, count(*) AS n FROM r a JOIN r b ON a.t = b.t AND a.s <> b.s GROUP BY a.s, b.s),
os AS (SELECT s, count(*) AS n FROM o GROUP BY s), rs AS (SELECT s, count(*) AS n FROM r GROUP BY s)
SELECT rt.a, rt.b, coalesce(ot.n, 0) AS targets, rt.n AS relations, oa.n AS a_targets, ob.n AS b_targets, ra.n AS a_relations, rb.n AS b_relations
FROM rt LEFT JOIN ot ON ot.a = rt.a AND ot.b = rt.b JOIN os oa ON oa.s = rt.a JOIN os ob ON ob.s = rt.b JOIN rs ra ON ra.s = rt.a JOIN rs rb ON rb.s = rt.b""",
    ("typed",), {}, "shared targets and relations of drugs, through join keys, never all pairs",
)


def analogs(typed: DataFrame, labels: DataFrame) -> DataFrame:
    """D4 without pairs of drugs: what a drug shares with all drugs of a label is added up by shared target and by
    set of relations, of which there are few. A drug that has the label itself gets no vote, so that it
    never meets itself. Shared targets count only for drugs that share a relation too."""
    own = typed.filter("source_type = 'Drug'")
    kinds = own.groupBy(F.col("source_name").alias("b")).agg(F.sort_array(F.collect_set("name")).alias("rel"))
    targets = own.select(F.col("source_name").alias("b"), F.col("target_name").alias("x")).distinct()
    named = labels.select(F.col("source_name").alias("b"), F.col("target_name").alias("t")).join(kinds, "b")
    by_kind = named.groupBy("t", "rel").agg(F.count("*").alias("n"))
    common = F.size(F.array_intersect("own", "rel"))
    drug_kinds = F.broadcast(kinds.select(F.col("rel").alias("own")).distinct())
    whole = drug_kinds.crossJoin(F.broadcast(by_kind)).withColumn("k", common).filter("k > 0").groupBy("own", "t").agg(F.sum("n").alias("analogs"), F.sum(F.col("n") * F.col("k")).alias("relations"))
    votes_ = kinds.withColumnRenamed("rel", "own").join(F.broadcast(whole), "own").select(F.col("b").alias("a"), "t", "analogs", "relations")
    codes = F.broadcast(by_kind.select(F.col("t").alias("_t"), F.col("rel").alias("_rel"), F.row_number().over(W.orderBy("t", "rel")).alias("code")))
    at = targets.join(named, "b").join(codes, F.expr("t = _t AND rel = _rel")).groupBy("x", "code").agg(F.count("*").alias("n"))
    lists = at.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("l")).select("x", F.col("l.code").alias("codes"), F.col("l.n").alias("ns"))
    mine = targets.select(F.col("b").alias("a"), "x")
    rows = mine.join(lists.hint("merge"), "x").select("a", "codes", "ns").repartition(parts_of(own), "a")
    rows = rows.select("a", F.explode(F.arrays_zip("codes", "ns")).alias("l")).groupBy("a", F.col("l.codes").alias("code")).agg(F.sum("l.ns").alias("n"))
    rows = rows.join(kinds.select(F.col("b").alias("a"), F.col("rel").alias("own")), "a").join(codes, "code").filter(F.arrays_overlap("own", "_rel"))
    shared = rows.groupBy("a", F.col("_t").alias("t")).agg(F.sum("n").alias("targets"))
    have = labels.select(F.col("source_name").alias("a"), F.col("target_name").alias("t")).distinct()
    return votes_.join(shared, ["a", "t"], "left").join(have, ["a", "t"], "left_anti").fillna({"targets": 0})


_by_counts = Relation("SELECT a AS source, t AS target, least(0.90, round(0.4 + 0.1 * analogs + 0.05 * (targets + relations), 6)) AS confidence, analogs FROM {analogs}", ("analogs",))
analog_by_counts = Stepped("", ("typed", "labels"), {}, "D4 from edges", lambda typed, labels: _by_counts(analogs(typed, labels)))
analog = Relation(
    """SELECT o.a AS source, l.target_name AS target, least(0.90, round(0.4 + 0.1 * count(*) + 0.05 * sum(o.targets + o.relations), 6)) AS confidence, count(*) AS analogs
FROM {overlaps} o JOIN {labels} l ON l.source_name = o.b
WHERE NOT EXISTS (SELECT 1 FROM {labels} k WHERE k.source_name = o.a AND k.target_name = l.target_name) GROUP BY o.a, l.target_name""",
    ("overlaps", "labels"), {}, "D4: drugs alike that reach the target",
)
pattern = Relation(
    """SELECT a AS source, target_name AS target, round(max(least(0.80, 0.5 + 0.4 * sim)), 6) AS confidence FROM (
SELECT o.a, l.target_name, (o.relations / CAST(o.a_relations + o.b_relations - o.relations AS DOUBLE) + o.targets / CAST(o.a_targets + o.b_targets - o.targets AS DOUBLE)) / 2 AS sim
FROM {overlaps} o JOIN {labels} l ON l.source_name = o.b) q WHERE sim > :least GROUP BY a, target_name""",
    ("overlaps", "labels"), {"least": 0.3}, "D5: the most alike drug of the same type",
)


def patterns(typed: DataFrame, labels: DataFrame) -> DataFrame:
    """a, t, sim: D5's most alike drug of each label, without pairs of drugs that share relations only. Of these
    the similarity hangs on the two sets of relations, of which there are few; pairs with a shared target
    are grouped where a drug's rows are, from lists of each target's labelled drugs."""
    own = typed.filter("source_type = 'Drug'")
    kinds = own.groupBy(F.col("source_name").alias("b")).agg(F.sort_array(F.collect_set("name")).alias("rel"))
    targets = own.select(F.col("source_name").alias("b"), F.col("target_name").alias("x")).distinct()
    have = labels.select(F.col("source_name").alias("b"), F.col("target_name").alias("t")).distinct()
    common = F.size(F.array_intersect("own", "rel"))
    jaccard = lambda k, n, m: k / (n + m - k).cast("double")
    by_kind = have.join(kinds, "b").groupBy("t", "rel").agg(F.count("*").alias("n"))
    whole = F.broadcast(kinds.select(F.col("rel").alias("own")).distinct()).crossJoin(F.broadcast(by_kind)).withColumn("k", common).filter("k > 0")
    whole = whole.withColumns({"same": F.col("own") == F.col("rel"), "sim": (jaccard(F.col("k"), F.size("own"), F.size("rel")) + 0.0) / 2})
    whole = whole.groupBy("own", "t").agg(F.max(F.expr("CASE WHEN NOT same THEN sim END")).alias("other"), F.max(F.expr("CASE WHEN same THEN n END")).alias("n"))
    apart = kinds.withColumnRenamed("rel", "own").join(F.broadcast(whole), "own").join(have.withColumn("mine", F.lit(1)), ["b", "t"], "left")
    # a drug is not like itself: another one with its relations must have the label
    apart = apart.select(F.col("b").alias("a"), "t", F.expr("greatest(other, CASE WHEN n > coalesce(mine, 0) THEN 0.5D END)").alias("sim"))
    facts = kinds.join(targets.groupBy("b").agg(F.count("*").alias("n")), "b")
    lists = targets.join(have.select("b").distinct(), "b").groupBy("x").agg(F.collect_list("b").alias("bs"))
    rows = targets.select(F.col("b").alias("a"), "x").join(lists.hint("merge"), "x").select("a", "bs").repartition(parts_of(own), "a")
    pairs = rows.select("a", F.explode("bs").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = pairs.join(facts, "b").join(facts.select(F.col("b").alias("a"), F.col("rel").alias("own"), F.col("n").alias("m")), "a").withColumn("k", common).filter("k > 0")
    near = pairs.withColumn("sim", (jaccard(F.col("k"), F.size("own"), F.size("rel")) + jaccard(F.col("shared"), F.col("m"), F.col("n"))) / 2)
    near = near.join(have, "b").groupBy("a", "t").agg(F.max("sim").alias("sim"))
    return apart.unionByName(near)


_by_patterns = Relation("SELECT a AS source, t AS target, round(max(least(0.80, 0.5 + 0.4 * sim)), 6) AS confidence FROM {patterns} WHERE sim > :least GROUP BY a, t", ("patterns",), {"least": 0.3})
pattern_by_counts = Stepped("", ("typed", "labels"), {}, "D5 from edges", lambda typed, labels: _by_patterns(patterns(typed, labels)))
#: A drug that has the label gets no vote, so that a fiber's best label of a target is never a voter's own.
_fiber_lift = Relation(
    """WITH e AS (SELECT l.source_name AS s, l.target_name AS t, o.sector AS fiber, l.confidence AS c FROM {labels} l JOIN {objects} o ON o.name = l.source_name),
best AS (SELECT fiber, t, max(least(0.70, 0.8 * c)) AS c FROM e GROUP BY fiber, t), d AS (SELECT DISTINCT name, sector FROM {objects} WHERE type_name = 'Drug')
SELECT d.name AS source, b.t AS target, round(max(b.c), 6) AS confidence FROM d JOIN best b ON b.fiber = d.sector WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.s = d.name AND x.t = b.t) GROUP BY d.name, b.t""",
    ("labels", "objects"),
)
fiber_lift = Stepped(
    """WITH e AS (SELECT l.source_name AS s, l.target_name AS t, o.sector AS fiber, l.confidence AS c FROM {labels} l JOIN {objects} o ON o.name = l.source_name)
SELECT o.name AS source, e.t AS target, round(max(least(0.70, 0.8 * e.c)), 6) AS confidence FROM {objects} o JOIN e ON e.fiber = o.sector AND e.s <> o.name
WHERE o.type_name = 'Drug' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.s = o.name AND x.t = e.t) GROUP BY o.name, e.t""",
    ("labels", "objects"), {}, "D6: objects of one fiber share their targets", _fiber_lift,
)


def descendants(view: DataFrame) -> DataFrame:
    """a, b, shared: a drug and what points to the same nodes, without an edge between them. A node brings a list of
    what points to it to the drug's rows, which are dealt by the drug; the drug's own edges lie among them."""
    own = view.filter("source_type = 'Drug'").select(F.col("source_name").alias("a"), F.col("target_name").alias("x")).distinct()
    others = view.filter("source_type NOT IN ('Drug', 'Disease')").select(F.col("source_name").alias("b"), F.col("target_name").alias("x")).distinct()
    lists = others.join(own.select("x").distinct(), "x", "left_semi").groupBy("x").agg(F.collect_list("b").alias("bs"))
    rows = own.join(lists.hint("merge"), "x").select("a", "bs", F.lit(0).alias("has"))
    rows = rows.unionByName(own.select("a", F.array("x").alias("bs"), F.lit(1).alias("has"))).repartition(parts_of(own), "a")
    rows = rows.select("a", "has", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("has").alias("has"))
    return rows.filter("has = 0").drop("has")


_common = Relation("SELECT a AS source, b AS target, 0.5 AS confidence, shared FROM {descendants}", ("descendants",))
common_descendants = Stepped(
    """SELECT f.source_name AS source, g.source_name AS target, 0.5 AS confidence, count(DISTINCT f.target_name) AS shared FROM {view} f JOIN {view} g ON f.target_name = g.target_name
WHERE f.source_type = 'Drug' AND g.source_type NOT IN ('Drug', 'Disease') AND NOT EXISTS (SELECT 1 FROM {view} e WHERE e.source_name = f.source_name AND e.target_name = g.source_name)
GROUP BY f.source_name, g.source_name""",
    ("view",), {}, "D7: both point to the same thing", lambda view: _common(descendants(view)),
)
fingerprints = Relation(
    """SELECT who, other, rel, max(c) AS c FROM (SELECT source_name AS who, target_name AS other, name AS rel, confidence AS c FROM {view} WHERE source_type = 'Drug'
UNION ALL SELECT target_name, source_name, name, confidence FROM {view} WHERE target_type = 'Drug') q GROUP BY who, other, rel""",
    ("view",), {}, "D8: a drug's neighbours and relations with their best confidence",
)


def meetings(prints: DataFrame) -> DataFrame:
    """a, b, m: for drugs with a relation to the same node, the sum of the lesser confidences. The drugs of a
    node and relation are one list; each drug's rows carry these lists and are dealt by the drug, so that
    the meetings, many times the rows, stay where they are."""
    lists = prints.groupBy("other", "rel").agg(F.sort_array(F.collect_list(F.struct("who", "c"))).alias("x")).filter(F.size("x") > 1)
    lists = lists.select("other", "rel", F.col("x.who").alias("bs"), F.col("x.c").alias("cs"))
    rows = prints.hint("merge").join(lists.hint("merge"), ["other", "rel"]).select(F.col("who").alias("a"), "c", "bs", "cs")
    rows = rows.repartition(parts_of(prints), "a").select("a", "c", F.explode(F.arrays_zip("bs", "cs")).alias("x")).filter("x.bs <> a")
    return rows.select("a", F.col("x.bs").alias("b"), F.least("c", "x.cs").alias("m")).groupBy("a", "b").agg(F.sum("m").alias("m"))


_closest = Relation(
    """WITH size AS (SELECT who, sum(c) AS n FROM {prints} GROUP BY who)
SELECT co.a AS source, l.target_name AS target, round(max(m / (x.n + y.n - m)), 6) AS confidence
FROM {meetings} co JOIN size x ON x.who = co.a JOIN size y ON y.who = co.b JOIN {labels} l ON l.source_name = co.b GROUP BY co.a, l.target_name""",
    ("prints", "meetings", "labels"),
)
weighted_similarity = Stepped(
    """WITH size AS (SELECT who, sum(c) AS n FROM {prints} GROUP BY who),
co AS (SELECT a.who AS a, b.who AS b, sum(least(a.c, b.c)) AS m FROM {prints} a JOIN {prints} b ON a.other = b.other AND a.rel = b.rel AND a.who <> b.who GROUP BY a.who, b.who)
SELECT co.a AS source, l.target_name AS target, round(max(m / (x.n + y.n - m)), 6) AS confidence
FROM co JOIN size x ON x.who = co.a JOIN size y ON y.who = co.b JOIN {labels} l ON l.source_name = co.b GROUP BY co.a, l.target_name""",
    ("prints", "labels"), {}, "D8: the closest drug that treats the disease, sum of minima over sum of maxima",
    lambda prints, labels: _closest(prints, meetings(prints), labels),
)
incoming_distance = Relation(
    """WITH p AS (SELECT target_name AS who, source_name AS s, max(confidence) AS c FROM {view} WHERE target_type = 'Disease' GROUP BY target_name, source_name),
n AS (SELECT who, sum(c) AS n FROM p GROUP BY who),
b AS (SELECT x.who AS a, y.who AS b, sum(least(x.c, y.c)) AS low, sum(greatest(x.c, y.c) - least(x.c, y.c)) AS gap, sum(x.c) AS xa, sum(y.c) AS yb FROM p x JOIN p y ON x.s = y.s AND x.who < y.who GROUP BY x.who, y.who)
SELECT b.a, b.b, round(low / (na.n + nb.n - low), 6) AS overlap, round((gap + (na.n - xa) + (nb.n - yb)) / (na.n + nb.n - low), 6) AS distance FROM b JOIN n na ON na.who = b.a JOIN n nb ON nb.who = b.b""",
    ("view",), {}, "D8b: distance of incoming profiles",
)
birth_influence = Relation(
    """SELECT a.name AS source, b.name AS target, CASE WHEN b.birth > a.birth AND b.birth - a.birth <= 50 THEN 0.70 WHEN b.birth > a.birth THEN 0.50 ELSE 0.55 END AS confidence,
CASE WHEN b.birth > a.birth THEN 'influenced' ELSE 'collaborated' END AS relation FROM {objects} a JOIN {objects} b ON a.sector = b.sector AND a.name <> b.name
WHERE a.type_name = 'Drug' AND b.type_name = 'Drug' AND (b.birth > a.birth OR a.birth - b.birth <= 20)""",
    ("objects",), {}, "D10: earlier objects of a sector influence later ones",
)
size_influence = Relation(
    """SELECT source, target, CASE WHEN r > 5 THEN round(least(0.70, least(0.65, 0.45 + 0.005 * r) + 0.05), 6) ELSE 0.55 END AS confidence FROM (
SELECT a.name AS source, b.name AS target, a.size_value / b.size_value AS r FROM {objects} a JOIN {objects} b ON a.sector = b.sector AND a.name <> b.name
WHERE a.type_name = 'Drug' AND b.type_name = 'Drug' AND a.size_value > 0 AND b.size_value > 0) q WHERE r > 0.2""",
    ("objects",), {}, "D11: larger objects of a sector influence smaller ones",
)
type_prior = Relation(
    """SELECT source_type, target_type, name AS relation, round(least(0.70, 0.4 + 0.3 * n / CAST(every AS DOUBLE)), 6) AS confidence FROM (
SELECT source_type, target_type, name, count(*) AS n, sum(count(*)) OVER (PARTITION BY source_type, target_type) AS every,
row_number() OVER (PARTITION BY source_type, target_type ORDER BY count(*) DESC, name) AS k FROM {typed} GROUP BY source_type, target_type, name) q WHERE k = 1""",
    ("typed",), {}, "D12: the usual relation of a pair of types",
)


#: Objects that one row of a pair of blocks is compared with.
BLOCK = 4_000


def bridges(view: DataFrame, least: float = 0.7) -> DataFrame:
    """a, b, s, na, nb: the diseases of an object are bits, so that two objects' shared ones are counted without
    being joined. Only sizes that can reach least meet: those of the same or the next power of 1 / least."""
    if not 0 < least < 1:
        raise ValueError("least lies between 0 and 1")
    ends = lambda who, other: view.filter(f"{other}_type = 'Disease' AND {who}_type IN ('Oncogene', 'Kinase')").select(F.col(f"{who}_name").alias("who"), F.col(f"{who}_type").alias("kind"), F.col(f"{other}_name").alias("other"))
    near = ends("source", "target").unionByName(ends("target", "source")).dropna(subset=["who", "other"]).distinct()
    codes = saved(near.select(F.col("other").alias("_o")).distinct().withColumn("code", F.row_number().over(W.orderBy("_o")) - 1))
    words = [f"w{i}" for i in range(-(-codes.count() // 64))] or ["w0"]
    bits = [F.coalesce(F.bit_or(F.expr(f"CASE WHEN code div 64 = {i} THEN shiftleft(1L, code % 64) END")), F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)]
    sets = near.join(F.broadcast(codes), F.col("other") == F.col("_o")).groupBy("who", "kind").agg(F.count("*").alias("n"), *bits)
    sets = saved(sets.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / -math.log(least)).cast("int")))
    side = lambda kind, x: sets.filter(F.col("kind") == kind).select(F.col("who").alias(x), F.col("n").alias(f"n{x}"), *[F.col(w).alias(f"{x}{w}") for w in words], "size")
    blocks = max(1, -(-sets.filter("kind = 'Kinase'").count() // BLOCK))
    one = side("Oncogene", "a").withColumn("size", F.explode(F.array(*[F.col("size") + i for i in (-1, 0, 1)]))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    two = side("Kinase", "b").withColumn("block", F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int"))
    # dealt by a too, as there are few pairs of size and block
    one = one.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(16)).cast("int"))
    two = two.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    shared = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a{w}").bitwiseAND(F.col(f"b{w}"))) for w in words])
    both = one.hint("merge").join(two.hint("merge"), ["size", "block", "part"]).withColumn("s", shared.cast("long"))
    return both.filter((F.col("s") > 0) & (F.col("s") / (F.col("na") + F.col("nb") - F.col("s")).cast("double") >= least)).select("a", "b", "s", "na", "nb")


_bridges = Relation("SELECT a AS source, b AS target, round(s / CAST(na + nb - s AS DOUBLE), 6) AS confidence FROM {bridges}", ("bridges",))
cross_type_bridge = Stepped(
    """WITH n AS (SELECT source_name AS who, source_type AS kind, target_name AS other FROM {view} WHERE target_type = 'Disease' UNION SELECT target_name, target_type, source_name FROM {view} WHERE source_type = 'Disease'),
d AS (SELECT who, count(*) AS n FROM n GROUP BY who),
b AS (SELECT x.who AS a, y.who AS b, count(*) AS n FROM n x JOIN n y ON x.other = y.other WHERE x.kind = 'Oncogene' AND y.kind = 'Kinase' GROUP BY x.who, y.who)
SELECT a AS source, b AS target, round(b.n / CAST(dx.n + dy.n - b.n AS DOUBLE), 6) AS confidence FROM b JOIN d dx ON dx.who = a JOIN d dy ON dy.who = b WHERE b.n / CAST(dx.n + dy.n - b.n AS DOUBLE) >= :least""",
    ("view",), {"least": 0.7}, "D15: objects of two types with almost the same neighbours", lambda view, least=0.7: _bridges(bridges(view, least)),
)


def decomposed(view: DataFrame) -> DataFrame:
    """D16. An interaction's source brings the nodes that it leads to, its target those that lead to it: two lists
    of an edge instead of all two-edge paths between them. Lists keep only nodes that edges enter and leave,
    and those that come to an interaction's source or leave its target."""
    edges = view.select(F.col("source_name").alias("s"), F.col("target_name").alias("t")).distinct()
    asked = view.filter("name = 'interacts_with'").select("id", F.col("source_name").alias("a"), F.col("target_name").alias("c"))
    out = edges.join(edges.select(F.col("s").alias("t")).distinct(), "t", "left_semi").join(asked.select(F.col("a").alias("s")).distinct(), "s", "left_semi")
    into = edges.join(out.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(asked.select(F.col("c").alias("t")).distinct(), "t", "left_semi")
    lists = out.groupBy(F.col("s").alias("a")).agg(F.sort_array(F.collect_list("t")).alias("to"))
    back = into.groupBy(F.col("t").alias("c")).agg(F.sort_array(F.collect_list("s")).alias("by"))
    rows = asked.join(lists.hint("merge"), "a", "left").join(back.hint("merge"), "c", "left")
    both = F.array_except(F.array_intersect("to", "by"), F.array("a", "c"))
    return rows.select("id", F.coalesce(F.size(both) > 0, F.lit(False)).alias("decomposes"))


decomposable = Stepped(
    """SELECT e.id, EXISTS (SELECT 1 FROM {view} f JOIN {view} g ON f.target_name = g.source_name WHERE f.source_name = e.source_name AND g.target_name = e.target_name
AND f.target_name <> e.source_name AND f.target_name <> e.target_name) AS decomposes FROM {view} e WHERE e.name = 'interacts_with'""",
    ("view",), {}, "D16: edges that two others compose to", decomposed,
)
belief = Relation(
    """SELECT source, target, count(*) AS sources, round(1 - exp(sum(ln(1 - least(confidence, 0.999999)))), 6) AS belief, 1.0 AS plausibility,
round(1 - exp(sum(ln(1 - least(confidence, 0.999999)))) / 2, 6) AS pignistic FROM {votes} GROUP BY source, target HAVING max(confidence) >= :least""",
    ("votes",), {"least": 0.3}, "D17: fusion of simple support from independent votes",
)
all_votes = Relation(
    """SELECT 'composition' AS strategy, source, target, confidence FROM {composition} UNION ALL SELECT 'pathway_support', source, target, confidence FROM {pathway}""",
    ("composition", "pathway"), {}, "the votes of a strict view",
)
conjectures = Relation(
    """WITH c AS (SELECT 'composition' AS generator, source, target, confidence FROM {composition} UNION ALL SELECT 'analog', source, target, confidence FROM {analog}
  UNION ALL SELECT 'fiber', source, target, confidence FROM {fiber})
SELECT source, target, count(DISTINCT generator) AS generators, round(avg(confidence), 6) AS score FROM c GROUP BY source, target HAVING avg(confidence) >= :least""",
    ("composition", "analog", "fiber"), {"least": 0.5}, "D18, D19: candidates of several generators",
)
agreement = Relation(
    """SELECT source, target, strategy, round(CASE WHEN n > 1 THEN least(0.98, confidence + least(0.15, 0.05 * n)) ELSE confidence * 0.8 END, 6) AS adjusted FROM (
SELECT *, count(*) OVER (PARTITION BY source, target) AS n FROM {votes}) q""",
    ("votes",), {}, "D21: votes that agree gain, lone votes lose",
)
