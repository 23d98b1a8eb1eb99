"""Leave-one-label-out over all votes.

Every label is held out once. Instead of scoring all pairs again for each fold, one job with the fold
as columns works out which votes a held label touches, and only those:

* the overlaps of its drug with other drugs lose a target and, with its last label, a relation, which
  changes the analog and pattern votes of that drug, and those that other drugs get through it;
* the votes for its disease through its drug go (fiber lift, fingerprints, analog, pattern). A best vote
  is replaced by the best one through another drug, which the two best by drug give.

A fold then has rows for its touched pairs only, at most its disease's and its drug's labels' pairs with
every drug and the drug's pairs with every disease; all other pairs keep their score, and what a fold
ranks is the counts of those scores, corrected by its touched pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphev.functions.shared import stored
from graphev.operators import scoring, votes
from graphev.operators.relation import Relation

#: Strategies that labels touch.
TOUCHED = ("analog", "pattern", "fiber_lift", "fingerprint")
PAIR = ["d", "e", "source", "target"]

positives = Relation(
    """SELECT source_name, target_name, max(confidence) AS confidence FROM {typed} WHERE name = 'treats' AND source_type = 'Drug' AND target_type = 'Disease' GROUP BY source_name, target_name""", ("typed",), {}, "one row per label"
)
folds = Relation(
    """SELECT l.source_name AS d, l.target_name AS e, o.sector, NOT EXISTS (SELECT 1 FROM {typed} x WHERE x.source_name = l.source_name AND x.target_name = l.target_name AND x.name <> 'treats') AS drop_t,
NOT EXISTS (SELECT 1 FROM {typed} x WHERE x.source_name = l.source_name AND x.name = 'treats' AND x.target_name <> l.target_name) AS drop_r
FROM {labels} l JOIN {objects} o ON o.name = l.source_name""",
    ("labels", "typed", "objects"), {}, "what a held label takes from its drug: a target, a relation",
)
moved = Relation(
    """SELECT f.d, f.e, o.a AS x, o.targets, o.relations, o.targets - CASE WHEN f.drop_t AND t.s IS NOT NULL THEN 1 ELSE 0 END AS new_targets, o.relations - CASE WHEN f.drop_r AND r.s IS NOT NULL THEN 1 ELSE 0 END AS new_relations,
o.a_targets AS x_targets, o.a_relations AS x_relations, o.b_targets - CASE WHEN f.drop_t THEN 1 ELSE 0 END AS d_targets, o.b_relations - CASE WHEN f.drop_r THEN 1 ELSE 0 END AS d_relations
FROM {folds} f JOIN {overlaps} o ON o.b = f.d LEFT JOIN (SELECT DISTINCT source_name AS s, target_name AS t FROM {typed}) t ON t.s = o.a AND t.t = f.e
LEFT JOIN (SELECT DISTINCT source_name AS s FROM {typed} WHERE name = 'treats') r ON r.s = o.a""",
    ("folds", "overlaps", "typed"), {}, "a held label's drug with each other drug: overlaps before and after",
)
alike = Relation(
    """SELECT d, e, x, targets + relations AS old_sum, new_targets + new_relations AS new_sum, new_relations > 0 AS stays,
CASE WHEN new_relations > 0 THEN (new_relations / CAST(x_relations + d_relations - new_relations AS DOUBLE) + new_targets / CAST(x_targets + d_targets - new_targets AS DOUBLE)) / 2 END AS sim FROM {moved}""",
    ("moved",), {}, "",
)
own_pairs = Relation(
    """SELECT m.d, m.e, m.d AS source, l.target_name AS target, CASE WHEN bool_or(m.stays) THEN least(0.90, round(0.4 + 0.1 * count_if(m.stays) + 0.05 * sum(CASE WHEN m.stays THEN m.new_sum ELSE 0 END), 6)) END AS analog,
round(max(CASE WHEN m.sim > :least THEN least(0.80, 0.5 + 0.4 * m.sim) END), 6) AS pattern FROM {alike} m JOIN {labels} l ON l.source_name = m.x
GROUP BY m.d, m.e, l.target_name""",
    ("alike", "labels"), {"least": 0.3}, "the held drug's own analog and pattern votes, anew",
)
others_pairs = Relation(
    """WITH n AS (SELECT o.a AS x, l.target_name AS t, count(*) AS n, sum(o.targets + o.relations) AS s FROM {overlaps} o JOIN {labels} l ON l.source_name = o.b GROUP BY o.a, l.target_name),
q AS (SELECT m.*, l.target_name AS t, m.stays AND l.target_name <> m.e AS keeps FROM {alike} m JOIN {labels} l ON l.source_name = m.d)
SELECT d, e, source, target, analog, CASE WHEN sim IS NOT NULL THEN round(least(0.80, 0.5 + 0.4 * sim), 6) END AS pattern FROM (
SELECT q.d, q.e, q.x AS source, q.t AS target, CASE WHEN q.keeps OR n.n > 1 THEN least(0.90, round(0.4 + 0.1 * (n.n - 1 + CASE WHEN q.keeps THEN 1 ELSE 0 END) + 0.05 * (n.s - q.old_sum + CASE WHEN q.keeps THEN q.new_sum ELSE 0 END), 6)) END AS analog,
greatest(CASE WHEN b.best_by = q.d THEN b.next ELSE b.best END, CASE WHEN q.keeps AND q.sim > :least THEN q.sim END) AS sim
FROM q JOIN n ON n.x = q.x AND n.t = q.t LEFT JOIN {best} b ON b.source = q.x AND b.target = q.t) a""",
    ("alike", "labels", "overlaps", "best"), {"least": 0.3}, "other drugs' analog and pattern votes through the held drug",
)
pattern_ways = Relation(
    """SELECT o.a AS source, l.target_name AS target, o.b AS way, (o.relations / CAST(o.a_relations + o.b_relations - o.relations AS DOUBLE) + o.targets / CAST(o.a_targets + o.b_targets - o.targets AS DOUBLE)) / 2 AS c
FROM {overlaps} o JOIN {labels} l ON l.source_name = o.b""",
    ("overlaps", "labels"), {}, "D5 by the drug it comes through",
)
fiber_ways = Relation(
    """SELECT o.name AS source, l.target_name AS target, l.source_name AS way, least(0.70, 0.8 * l.confidence) AS c FROM {labels} l JOIN {objects} p ON p.name = l.source_name JOIN {objects} o ON o.sector = p.sector AND o.name <> p.name WHERE o.type_name = 'Drug'""",
    ("labels", "objects"), {}, "D6 by the drug it comes through",
)
print_ways = Relation(
    """WITH size AS (SELECT who, sum(c) AS n FROM {prints} GROUP BY who), co AS (SELECT a.who AS a, b.who AS b, sum(least(a.c, b.c)) AS m FROM {prints} a JOIN {prints} b ON a.other = b.other AND a.rel = b.rel AND a.who <> b.who GROUP BY a.who, b.who)
SELECT co.a AS source, l.target_name AS target, co.b AS way, m / (x.n + y.n - m) AS c FROM co JOIN size x ON x.who = co.a JOIN size y ON y.who = co.b JOIN {labels} l ON l.source_name = co.b""",
    ("prints", "labels"), {}, "D8 by the drug it comes through",
)
lost = Relation(
    """SELECT DISTINCT f.d, f.e, w.source, w.target, round(CASE WHEN b.best_by = f.d THEN b.next ELSE b.best END, 6) AS c FROM {folds} f JOIN {ways} w ON w.target = f.e AND (w.way = f.d OR w.source = f.d)
JOIN {best} b ON b.source = w.source AND b.target = w.target""",
    ("folds", "ways", "best"), {}, "best votes for the held disease, without those through the held drug",
)


def two_best(ways: DataFrame) -> DataFrame:
    """source, target, way, c (one row per way) -> the best c, its way, and the best through another way."""
    top = F.max_by(F.struct("c", "way"), F.struct("c", "way"))
    first = ways.groupBy("source", "target").agg(top.alias("top")).select("source", "target", F.col("top.c").alias("best"), F.col("top.way").alias("best_by"))
    second = ways.join(first, ["source", "target"]).filter("way <> best_by").groupBy("source", "target").agg(F.max("c").alias("next"))
    return first.join(second, ["source", "target"], "left")


def touched_votes(typed: DataFrame, objects: DataFrame, prints: DataFrame, labels: DataFrame) -> DataFrame:
    """d, e (the held label), source, target, strategy, confidence: every vote that the fold changes;
    null where the vote is gone."""
    overlaps = stored(votes.overlaps(typed), "overlaps")
    held = folds(labels, typed, objects)
    pairs = alike(moved(held, overlaps, typed))
    pattern = two_best(pattern_ways(overlaps, labels).filter("c > 0.3"))
    both = own_pairs(pairs, labels).unionByName(others_pairs(pairs, labels, overlaps, pattern))
    rows = both.unpivot(PAIR, ["analog", "pattern"], "strategy", "confidence")
    for name, ways in (("fiber_lift", fiber_ways(labels, objects)), ("fingerprint", print_ways(prints, labels))):
        ways = stored(ways, name)
        rows = rows.unionByName(lost(held, ways, two_best(ways)).select(*PAIR, F.lit(name).alias("strategy"), F.col("c").alias("confidence")))
    # a fold's other labels are no negatives
    other = labels.select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), F.lit(True).alias("label"))
    return rows.join(other, ["source", "target"], "left").filter("label IS NULL OR (source = d AND target = e)").select(*PAIR, "strategy", "confidence")


def rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round(F.col("score") + 1e-9, 6))


def every_vote(typed: DataFrame, objects: DataFrame, prints: DataFrame, fixed: DataFrame, labels: DataFrame) -> DataFrame:
    """source, target, strategy, confidence: the fixed votes and those that labels give."""
    whole = {"analog": votes.analog_by_counts(typed, labels), "pattern": votes.pattern_by_counts(typed, labels), "fiber_lift": votes.fiber_lift(labels, objects), "fingerprint": votes.weighted_similarity(prints, labels)}
    every = fixed.select("source", "target", "strategy", "confidence")
    for name in TOUCHED:
        every = every.unionByName(stored(whole[name].select("source", "target", F.lit(name).alias("strategy"), "confidence"), name))
    return every


def fold_scores(typed: DataFrame, objects: DataFrame, prints: DataFrame, fixed: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """typed edges, objects, fingerprints of drugs, votes that no label touches (source, target, strategy,
    confidence), paths (source, target, chains, total) -> labels; the negatives' scores with all labels
    (source, target, score; no row: 0); each fold's scores of its touched pairs (d, e, source, target,
    score, votes), the held one among them if it has any vote."""
    labels = stored(positives(typed), "labels")
    every = every_vote(typed, objects, prints, fixed, labels)
    every = stored(every, "votes")
    pair = [F.col("source_name").alias("source"), F.col("target_name").alias("target")]
    base = rounded(scoring.score_breakdown(every, paths)).select("source", "target", "score").join(labels.select(*pair), ["source", "target"], "left_anti")
    changed = stored(touched_votes(typed, objects, prints, labels), "touched")
    asked = changed.select(*PAIR).unionByName(labels.select(F.col("source_name").alias("d"), F.col("target_name").alias("e"), *pair)).distinct()
    same = asked.join(every, ["source", "target"]).join(changed.select(*PAIR, "strategy"), [*PAIR, "strategy"], "left_anti")
    now = changed.dropna(subset=["confidence"]).unionByName(same.select(*changed.columns))
    scored = rounded(scoring.score_breakdown(now, paths, by=("d", "e"))).select(*PAIR, "score", "votes")
    return labels, stored(base, "base"), stored(asked.join(scored, PAIR, "left").fillna({"score": 0.0, "votes": 0}), "folds")


def universe(objects: DataFrame, labels: DataFrame) -> int:
    """The number of pairs of a drug and a disease that are no label."""
    kinds = objects.groupBy("type_name").agg(F.count("*").alias("n"))
    n = kinds.agg(F.sum(F.when(F.col("type_name") == "Drug", F.col("n"))), F.sum(F.when(F.col("type_name") == "Disease", F.col("n")))).first()
    return (n[0] or 0) * (n[1] or 0) - labels.count()


results = Relation(
    """WITH h AS (SELECT source, target, score, votes FROM {touched} WHERE source = d AND target = e),
levels AS (SELECT score, sum(n) AS n FROM (SELECT score, count(*) AS n FROM {base} GROUP BY score UNION ALL SELECT 0.0 AS score, :every - count(*) AS n FROM {base} UNION ALL SELECT DISTINCT score, 0 AS n FROM h) x GROUP BY score),
c AS (SELECT score, n AS at, sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS below FROM levels),
m AS (SELECT t.d, t.e, sum(CASE WHEN t.score < h.score THEN 1 ELSE 0 END - CASE WHEN coalesce(b.score, 0.0) < h.score THEN 1 ELSE 0 END) AS below, sum(CASE WHEN t.score = h.score THEN 1 ELSE 0 END - CASE WHEN coalesce(b.score, 0.0) = h.score THEN 1 ELSE 0 END) AS at
  FROM {touched} t JOIN h ON h.source = t.d AND h.target = t.e LEFT JOIN {base} b ON b.source = t.source AND b.target = t.target WHERE NOT (t.source = t.d AND t.target = t.e) GROUP BY t.d, t.e)
SELECT h.source, h.target, h.score, h.votes, CAST(c.below + coalesce(m.below, 0) AS BIGINT) AS concordant, CAST(:every - c.below - c.at - coalesce(m.below, 0) - coalesce(m.at, 0) AS BIGINT) AS discordant, CAST(c.at + coalesce(m.at, 0) AS BIGINT) AS tied
FROM h JOIN c ON c.score = h.score LEFT JOIN m ON m.d = h.source AND m.e = h.target""",
    ("base", "touched"), {"every": 0}, "F8: each held label against all negatives of its fold",
)
averaged = Relation(
    """WITH b AS (SELECT source, target, sum(base) AS base, sum(delta) AS delta FROM (SELECT source, target, score AS base, 0.0 AS delta FROM {base}
  UNION ALL SELECT t.source, t.target, 0.0, t.score - coalesce(b.score, 0.0) FROM {touched} t LEFT JOIN {base} b ON b.source = t.source AND b.target = t.target WHERE NOT (t.source = t.d AND t.target = t.e)) x GROUP BY source, target)
SELECT source, target, score, false AS label FROM (SELECT source, target, round(1e-9 + base + delta / (SELECT greatest(1, count(*)) FROM {labels}), 6) AS score FROM b) a WHERE score > 0
UNION ALL SELECT source, target, score, true FROM {touched} WHERE source = d AND target = e""",
    ("labels", "base", "touched"), {}, "F8: held scores and the negatives' means over folds; a negative without a row has 0",
)


def leave_one_out(typed: DataFrame, objects: DataFrame, prints: DataFrame, fixed: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F8: one row per held label (source, target, score, votes, concordant, discordant, tied); and the
    ranking of all pairs (source, target, score, label), for the metrics. A held label without any vote
    scores 0. No labels: no folds, and a ranking without rows."""
    labels, base, touched = fold_scores(typed, objects, prints, fixed, paths)
    return results(base, touched, every=universe(objects, labels)), averaged(labels, base, touched)


outcome = Relation(
    """WITH levels AS (SELECT score, sum(p) AS p, sum(n) AS n FROM (SELECT score, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM {ranking} GROUP BY score
  UNION ALL SELECT 0.0 AS score, 0 AS p, :every - count(*) FILTER (WHERE NOT label) AS n FROM {ranking}) x GROUP BY score),
c AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM levels),
t AS (SELECT coalesce(sum(p), 0) AS held, coalesce(sum(n), 0) AS negatives, coalesce(sum(p * below), 0) AS concordant, coalesce(sum(p * n), 0) AS tied FROM c)
SELECT CAST(held AS BIGINT) AS held, CAST(negatives AS BIGINT) AS negatives, CAST(concordant AS BIGINT) AS concordant, CAST(held * negatives - concordant - tied AS BIGINT) AS discordant, CAST(tied AS BIGINT) AS tied,
CASE WHEN held = 0 OR negatives = 0 THEN 0.5 ELSE round((concordant + tied / 2.0) / (CAST(held AS DOUBLE) * negatives), 6) END AS auroc FROM t""",
    ("ranking",), {"every": 0}, "a ranking's labels against all negatives; those without a row have 0",
)


def held_after(labels: DataFrame, years: DataFrame, cutoff: int = 2013, include: bool = False) -> DataFrame:
    """source, target of the labels (source_name, target_name) later than a year, or of it too, by a
    table of years (source, target, year). A label without a year is an error, as it could be on either side;
    of several years the first holds."""
    first = years.dropna().groupBy("source", "target").agg(F.min("year").alias("year"))
    rows = labels.select(F.col("source_name").alias("source"), F.col("target_name").alias("target")).distinct().join(first, ["source", "target"], "left")
    if missing := rows.filter("year IS NULL").count():
        raise ValueError(f"{missing} labels have no year")
    return rows.filter(F.col("year") >= cutoff if include else F.col("year") > cutoff).select("source", "target")


def held_out(typed: DataFrame, objects: DataFrame, prints: DataFrame, fixed: DataFrame, paths: DataFrame, held: DataFrame) -> DataFrame:
    """source, target, score, votes, label of the pairs that are no label of the training part, scored
    by all votes of typed without the held labels (source, target). A held label without any vote has 0;
    other pairs without one have no row. Pairs of held that are no labels change nothing."""
    known = positives(typed).select(F.col("source_name").alias("source"), F.col("target_name").alias("target"))
    held = held.select("source", "target").distinct().join(known, ["source", "target"], "left_semi")
    gone = held.select(F.col("source").alias("source_name"), F.col("target").alias("target_name"), F.lit("treats").alias("name"))
    used = typed.select("name", "source_name", "target_name", "source_type", "target_type", "confidence")
    train = stored(used.join(gone, ["source_name", "target_name", "name"], "left_anti"), "train")
    labels = stored(positives(train), "labels")
    rows = rounded(scoring.score_breakdown(every_vote(train, objects, prints, fixed, labels), paths)).select("source", "target", "score", "votes")
    rows = rows.join(labels.select(F.col("source_name").alias("source"), F.col("target_name").alias("target")), ["source", "target"], "left_anti")
    rows = rows.join(held.withColumn("label", F.lit(True)), ["source", "target"], "full")
    return stored(rows.fillna({"score": 0.0, "votes": 0, "label": False}), "held-out")


def fold_recall(labels: DataFrame, predicted: DataFrame, folds: int = 5) -> DataFrame:
    """labels (source_name, target_name) in folds by a hash of their names, and the share of each fold
    that was predicted (source, target), with mean and standard deviation over folds. A fold that no label
    falls into has no row and does not count. No labels: no rows."""
    named = F.concat_ws("|", "source_name", "target_name")
    rows = labels.select("source_name", "target_name").distinct().withColumn("fold", (F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long") % folds))
    hits = rows.join(predicted.select(F.col("source").alias("source_name"), F.col("target").alias("target_name"), F.lit(1).alias("hit")).distinct(), ["source_name", "target_name"], "left")
    by = hits.groupBy("fold").agg(F.count("*").alias("labels"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("labels"))
    spread = by.agg(F.avg("recall").alias("mean_recall"), F.stddev_pop("recall").alias("std_recall"))
    return by.crossJoin(F.broadcast(spread)).select("fold", "labels", "found", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("recall", "mean_recall", "std_recall")])
