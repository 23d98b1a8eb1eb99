"""Registered queries of what users add by name: strategies and the full score over them, metrics,
verifiers with a quarantine, weights of successors; with statements of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphev.functions import registry
from graphev.operators import claims, holdout, scoring
from graphev.plans import texts
from graphev.plans.catalog import frame, head

#: Strategies that vote on drugs and diseases: their nodes. Fingerprints only add a bonus.
NODES = {"composition": "d1_composition", "pathway_support": "d2_pathway_support", "analog": "d4_analog", "pattern": "d5_pattern", "fiber_lift": "d6_fiber_lift", "fingerprint": "d8_weighted_similarity"}
for _name, _node in NODES.items():
    registry.STRATEGIES.add(_name, lambda node_of, node=_node: node_of(node))
registry.METRICS.add("gap", lambda score, label: score[label].mean() - score[~label].mean() if label.any() and not label.all() else 0.0)
registry.VERIFIERS.add("relation_gate", lambda: claims.verdict_by(claims.gate_rules()))


def votes_query(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """M7: the votes of all strategies, by name."""
    made = {} if made is None else made
    return registry.votes_of(list(NODES), lambda node: frame(spark, sf_dir, node, made))


def breakdown_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made: dict[str, DataFrame] = {}
    rows = scoring.score_breakdown(votes_query(spark, sf_dir, made), frame(spark, sf_dir, "d1_composition", made))
    # means of two votes stand on the edge between two roundings: both engines go up
    return rows.withColumns({c: F.round(F.col(c) + 1e-9, d) for c, d in {"base": 4, "path_bonus": 4, "like_bonus": 4, "total": 4, "raw": 4, "score": 6}.items()})


def metric_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: a metric of the user for each of ten folds of drugs."""
    rows = frame(spark, sf_dir, "scores").select(F.expr("int(substring(source, 2)) % 10").alias("fold"), "score", "label")
    return registry.metric_by(rows, "fold", "gap").withColumn("value", F.round("value", 6))


def quarantine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges' claims that are stored, by subject and relation: how many a recall finds, and how
    many wait in quarantine."""
    rows = texts.first_sentences(spark, sf_dir)
    stored = registry.verified(rows, "relation_gate")
    return stored.groupBy("subject", "relation").agg(F.count_if(~F.col("quarantined")).alias("recalled"), F.count_if("quarantined").alias("quarantined"))


def successors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may follow each entity's events, weighed by how often it followed."""
    events = frame(spark, sf_dir, "stream").select(F.col("entity").alias("item"), F.col("source").alias("state"), F.col("weight").cast("double").alias("score"))
    steps = frame(spark, sf_dir, "l1_transitions").select(F.col("source").alias("state"), F.col("target").alias("successor"), "n")
    steps = steps.join(steps.groupBy("state").agg(F.sum("n").alias("every")), "state")
    rows = registry.next_steps(events, steps, lambda: F.col("n") / F.col("every"))
    return rows.withColumn("score", F.round("score", 5))


def leave_one_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made: dict[str, DataFrame] = {}
    node = lambda name: frame(spark, sf_dir, name, made)
    fixed = registry.votes_of(["composition", "pathway_support"], node)
    return holdout.leave_one_out(node("typed"), node("objects"), node("vote_prints"), fixed, node("d1_composition"))


def folds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: every label held out of all votes, against all negatives of its fold."""
    return leave_one_out(spark, sf_dir)[0]


def fold_ranking_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: held scores and mean scores of negatives, the ranking that the metrics read."""
    return leave_one_out(spark, sf_dir)[1]


#: The held labels of F9 are those of drugs born later; the tables have no other years of labels.
CUTOFF = 1950


def _temporal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    made: dict[str, DataFrame] = {}
    node = lambda name: frame(spark, sf_dir, name, made)
    typed, fixed = node("typed"), registry.votes_of(["composition", "pathway_support"], node)
    labels = holdout.positives(typed)
    years = labels.join(node("objects"), F.col("source_name") == F.col("name")).select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), F.col("birth").alias("year"))
    ranking = holdout.held_out(typed, node("objects"), node("vote_prints"), fixed, node("d1_composition"), holdout.held_after(labels, years, CUTOFF))
    return ranking, holdout.universe(node("objects"), labels)


def temporal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the pairs that no older label covers, scored by all votes without the later labels."""
    return _temporal(spark, sf_dir)[0]


def temporal_outcome_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the later labels against all negatives."""
    ranking, every = _temporal(spark, sf_dir)
    return holdout.outcome(ranking, every=every)


def fold_recall_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the labels' folds, and how many of them have a strong composition."""
    return holdout.fold_recall(frame(spark, sf_dir, "labels_"), frame(spark, sf_dir, "d1_composition").filter("confidence >= 0.8"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "e2_score_breakdown": breakdown_query, "m7_strategy_votes": votes_query, "m8_metric_by_fold": metric_query, "g10_quarantine": quarantine_query, "m10_next_steps": successors_query,
    "f8_all_votes": folds_query, "f8_fold_ranking": fold_ranking_query,
    "f9_held_out": temporal_query, "f9_held_out_outcome": temporal_outcome_query, "f18_fold_spread": fold_recall_query,
}

_VOTES = " UNION ALL ".join(f"SELECT source, target, '{name}' AS strategy, confidence::DOUBLE AS confidence FROM n_{node}" for name, node in NODES.items())
_BREAKDOWN = f"""w AS MATERIALIZED ({_VOTES}), v AS (SELECT source, target, count(DISTINCT strategy) AS votes, string_agg(DISTINCT strategy, '+' ORDER BY strategy) AS strategies,
coalesce(avg(confidence) FILTER (WHERE strategy <> 'fingerprint'), 0) AS base, coalesce(max(confidence) FILTER (WHERE strategy = 'fingerprint'), 0) AS sim FROM w GROUP BY 1, 2),
p AS (SELECT v.*, coalesce(c.chains, 0) AS chains, coalesce(c.total, 0) AS total FROM v LEFT JOIN n_d1_composition c ON c.source = v.source AND c.target = v.target),
q AS (SELECT *, CASE WHEN total > 6.25 THEN 0.25 ELSE 0.04::DOUBLE * total END AS pb, CASE WHEN 0.06::DOUBLE * sim > 0.1 THEN 0.1 ELSE 0.06::DOUBLE * sim END AS lb FROM p), z AS (SELECT *, (base + pb + lb) * CASE WHEN chains > 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS raw FROM q)
SELECT source, target, votes, strategies, round(base + 1e-9, 4) AS base, chains, round(total + 1e-9, 4) AS total, round(pb + 1e-9, 4) AS path_bonus, round(lb + 1e-9, 4) AS like_bonus, chains = 0 AS discounted, round(raw + 1e-9, 4) AS raw, round(1e-9 + CASE WHEN raw > 1 THEN 1 ELSE raw END, 6) AS score FROM z"""

#: The plain loop over folds as one statement: all votes of all folds, made from the labels that are left.
#: In these tables a drug's edges to diseases are its labels only.
_FOLDS = """l AS MATERIALIZED (SELECT source_name AS s, target_name AS t, max(confidence) AS c FROM n_typed WHERE name = 'treats' AND source_type = 'Drug' AND target_type = 'Disease' GROUP BY 1, 2),
lf AS MATERIALIZED (SELECT f.s AS d, f.t AS e, l.* FROM l f, l WHERE NOT (f.s = l.s AND f.t = l.t)), k AS MATERIALIZED (SELECT d, e, s, count(*) AS n FROM lf GROUP BY 1, 2, 3),
o AS (SELECT DISTINCT source_name AS s, target_name AS t FROM n_typed WHERE source_type = 'Drug' AND name <> 'treats'), r AS (SELECT DISTINCT source_name AS s, name AS t FROM n_typed WHERE source_type = 'Drug' AND name <> 'treats'),
ot AS MATERIALIZED (SELECT a.s AS a, b.s AS b, count(*) AS n FROM o a JOIN o b ON a.t = b.t AND a.s <> b.s GROUP BY 1, 2), rt AS MATERIALIZED (SELECT a.s AS a, b.s AS b, count(*) AS n FROM r a JOIN r b ON a.t = b.t AND a.s <> b.s GROUP BY 1, 2),
os AS (SELECT s, count(*) AS n FROM o GROUP BY 1), rs AS (SELECT s, count(*) AS n FROM r GROUP BY 1), lt AS MATERIALIZED (SELECT a.d, a.e, a.s AS a, b.s AS b, count(*) AS n FROM lf a JOIN lf b ON a.d = b.d AND a.e = b.e AND a.t = b.t AND a.s <> b.s GROUP BY 1, 2, 3, 4),
ov AS MATERIALIZED (SELECT f.s AS d, f.t AS e, rt.a, rt.b, coalesce(ot.n, 0) + coalesce(lt.n, 0) AS st, rt.n + CASE WHEN ka.n > 0 AND kb.n > 0 THEN 1 ELSE 0 END AS sr, oa.n + coalesce(ka.n, 0) AS na, ob.n + coalesce(kb.n, 0) AS nb,
  ra.n + CASE WHEN ka.n > 0 THEN 1 ELSE 0 END AS ar, rb.n + CASE WHEN kb.n > 0 THEN 1 ELSE 0 END AS br FROM l f CROSS JOIN rt LEFT JOIN ot ON ot.a = rt.a AND ot.b = rt.b LEFT JOIN lt ON lt.d = f.s AND lt.e = f.t AND lt.a = rt.a AND lt.b = rt.b
  LEFT JOIN k ka ON ka.d = f.s AND ka.e = f.t AND ka.s = rt.a LEFT JOIN k kb ON kb.d = f.s AND kb.e = f.t AND kb.s = rt.b JOIN os oa ON oa.s = rt.a JOIN os ob ON ob.s = rt.b JOIN rs ra ON ra.s = rt.a JOIN rs rb ON rb.s = rt.b),
ways AS (SELECT ov.d, ov.e, a, lf.t, st + sr AS w, (sr / (ar + br - sr)::DOUBLE + st / (na + nb - st)::DOUBLE) / 2 AS sim FROM ov JOIN lf ON lf.d = ov.d AND lf.e = ov.e AND lf.s = ov.b),
z AS (SELECT who, sum(c) AS n FROM n_vote_prints GROUP BY 1), co AS MATERIALIZED (SELECT a.who AS a, b.who AS b, sum(least(a.c, b.c)) AS m FROM n_vote_prints a JOIN n_vote_prints b ON a.other = b.other AND a.rel = b.rel AND a.who <> b.who GROUP BY 1, 2),
fp AS MATERIALIZED (SELECT a, b, m / (x.n + y.n - m) AS sim FROM co JOIN z x ON x.who = a JOIN z y ON y.who = b),
v AS MATERIALIZED (SELECT d, e, a AS s, t, 'analog' AS k, least(0.9::DOUBLE, round(1e-11 + 0.4::DOUBLE + 0.1::DOUBLE * count(*) + 0.05::DOUBLE * sum(w), 6)) AS c FROM ways GROUP BY 1, 2, 3, 4
  UNION ALL SELECT d, e, a, t, 'pattern', round(1e-11 + max(least(0.8::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * sim)), 6) FROM ways WHERE sim > 0.3 GROUP BY 1, 2, 3, 4
  UNION ALL SELECT d, e, q.name, t, 'fiber_lift', round(1e-11 + max(least(0.7::DOUBLE, 0.8::DOUBLE * lf.c)), 6) FROM lf JOIN n_objects p ON p.name = lf.s JOIN n_objects q ON q.sector = p.sector AND q.name <> p.name AND q.type_name = 'Drug' GROUP BY 1, 2, 3, 4
  UNION ALL SELECT d, e, fp.a, t, 'fingerprint', round(1e-11 + max(sim), 6) FROM lf JOIN fp ON fp.b = lf.s GROUP BY 1, 2, 3, 4
  UNION ALL SELECT l.s, l.t, source, target, 'composition', confidence::DOUBLE FROM l, n_d1_composition UNION ALL SELECT l.s, l.t, source, target, 'pathway_support', confidence::DOUBLE FROM l, n_d2_pathway_support),
g AS (SELECT d, e, v.s, v.t, count(*) AS votes, coalesce(avg(c) FILTER (WHERE k <> 'fingerprint'), 0) AS base, coalesce(max(c) FILTER (WHERE k = 'fingerprint'), 0) AS sim FROM v WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.s = v.s AND l.t = v.t AND NOT (v.d = v.s AND v.e = v.t)) GROUP BY 1, 2, 3, 4),
y AS MATERIALIZED (SELECT g.*, round(1e-9 + least(1.0::DOUBLE, (base + least(0.25::DOUBLE, 0.04::DOUBLE * coalesce(p.total, 0)) + least(0.1::DOUBLE, 0.06::DOUBLE * sim)) * CASE WHEN coalesce(p.chains, 0) > 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END), 6) AS score
  FROM g LEFT JOIN n_d1_composition p ON p.source = g.s AND p.target = g.t),
u AS (SELECT count(*) AS n FROM n_objects a, n_objects b WHERE a.type_name = 'Drug' AND b.type_name = 'Disease' AND NOT EXISTS (SELECT 1 FROM l WHERE l.s = a.name AND l.t = b.name)),
h AS MATERIALIZED (SELECT l.s, l.t, coalesce(y.score, 0) AS score, coalesce(y.votes, 0) AS votes FROM l LEFT JOIN y ON y.d = l.s AND y.e = l.t AND y.s = l.s AND y.t = l.t)"""

ORACLES: dict[str, str] = {
    "e2_score_breakdown": f"{head(*NODES.values())}, {_BREAKDOWN}",
    "m7_strategy_votes": f"{head(*NODES.values())} {_VOTES}",
    "m8_metric_by_fold": f"{head('scores')} SELECT substring(source, 2)::INT % 10 AS fold, round(coalesce(avg(score) FILTER (WHERE label) - avg(score) FILTER (WHERE NOT label), 0), 6) AS value FROM n_scores GROUP BY 1",
    "g10_quarantine": texts.ORACLES["g8_relation_gate"].replace("SELECT id, v.verdict,", "SELECT s AS subject, r AS relation, count(*) FILTER (WHERE verdict = 'AGREE') AS recalled, count(*) FILTER (WHERE verdict = 'HOLLOW') AS quarantined FROM (SELECT s, r, v.verdict,", 1).replace("FROM (SELECT id, CASE", "FROM (SELECT s, r, CASE", 1) + ") g WHERE verdict <> 'REJECT' GROUP BY s, r",
    "m10_next_steps": f"""{head('stream', 'l1_transitions')}, t AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS w FROM n_l1_transitions)
SELECT entity AS item, target AS successor, round(sum(weight * w), 5) AS score FROM n_stream e JOIN t ON t.source = e.source GROUP BY 1, 2""",
    "f8_all_votes": f"""{head('typed', 'objects', 'vote_prints', 'd1_composition', 'd2_pathway_support')}, {_FOLDS}
SELECT h.s AS source, h.t AS target, h.score, h.votes, count(y.s) FILTER (WHERE y.score < h.score) + CASE WHEN h.score > 0 THEN max(u.n) - count(y.s) ELSE 0 END AS concordant, count(y.s) FILTER (WHERE y.score > h.score) AS discordant,
count(y.s) FILTER (WHERE y.score = h.score) + CASE WHEN h.score = 0 THEN max(u.n) - count(y.s) ELSE 0 END AS tied FROM h CROSS JOIN u LEFT JOIN y ON y.d = h.s AND y.e = h.t AND NOT (y.s = h.s AND y.t = h.t) GROUP BY h.s, h.t, h.score, h.votes""",
    "f8_fold_ranking": f"""{head('typed', 'objects', 'vote_prints', 'd1_composition', 'd2_pathway_support')}, {_FOLDS}
SELECT s AS source, t AS target, score, true AS label FROM h UNION ALL SELECT s, t, round(1e-9 + sum(score) / (SELECT count(*) FROM l), 6), false FROM y WHERE NOT (d = s AND e = t) GROUP BY s, t""",
    "f18_fold_spread": f"""{head('labels_', 'd1_composition')}, f AS (SELECT DISTINCT source_name AS s, target_name AS t, ('0x' || md5(source_name || '|' || target_name)[1:8])::BIGINT % 5 AS fold FROM n_labels_),
r AS (SELECT fold, count(*) AS labels, count(p.source) AS found FROM f LEFT JOIN n_d1_composition p ON p.source = s AND p.target = t AND p.confidence >= 0.8 GROUP BY fold)
SELECT fold, labels, found, round(1e-9 + found / labels, 6) AS recall, round(1e-9 + avg(found / labels) OVER (), 6) AS mean_recall, round(1e-9 + stddev_pop(found / labels) OVER (), 6) AS std_recall FROM r""",
}
#: F9 is F8's statement with one fold, named like no pair, in which only the older labels are left.
_LATER = _FOLDS.replace("lf AS MATERIALIZED (SELECT f.s AS d, f.t AS e, l.* FROM l f, l WHERE NOT (f.s = l.s AND f.t = l.t))", f"""lf AS MATERIALIZED (SELECT 1 AS d, 1 AS e, l.* FROM l JOIN n_objects b ON b.name = l.s WHERE b.birth <= {CUTOFF})""").replace("SELECT f.s AS d, f.t AS e, rt.a", "SELECT f.d, f.e, rt.a").replace("FROM l f CROSS JOIN rt", "FROM (SELECT 1 AS d, 1 AS e) f CROSS JOIN rt").replace("lt.d = f.s AND lt.e = f.t", "lt.d = f.d").replace("ka.d = f.s AND ka.e = f.t", "ka.d = f.d").replace("kb.d = f.s AND kb.e = f.t", "kb.d = f.d")
_LATER = _LATER.replace("SELECT l.s, l.t, source, target, 'composition', confidence::DOUBLE FROM l, n_d1", "SELECT 1, 1, source, target, 'composition', confidence::DOUBLE FROM n_d1").replace("SELECT l.s, l.t, source, target, 'pathway_support', confidence::DOUBLE FROM l, n_d2", "SELECT 1, 1, source, target, 'pathway_support', confidence::DOUBLE FROM n_d2")
_LATER = _LATER.replace("NOT EXISTS (SELECT 1 FROM l WHERE l.s = v.s AND l.t = v.t AND NOT (v.d = v.s AND v.e = v.t))", "NOT EXISTS (SELECT 1 FROM lf WHERE lf.s = v.s AND lf.t = v.t)")
_LATER = _LATER[: _LATER.index(",\nh AS MATERIALIZED")] + """, held AS (SELECT s, t FROM l EXCEPT SELECT s, t FROM lf),
w AS MATERIALIZED (SELECT coalesce(y.s, held.s) AS source, coalesce(y.t, held.t) AS target, coalesce(score, 0) AS score, coalesce(votes, 0) AS votes, held.s IS NOT NULL AS label FROM y FULL JOIN held ON held.s = y.s AND held.t = y.t)"""
_NODES = head("typed", "objects", "vote_prints", "d1_composition", "d2_pathway_support")
ORACLES["f9_held_out"] = f"{_NODES}, {_LATER} SELECT * FROM w"
ORACLES["f9_held_out_outcome"] = f"""{_NODES}, {_LATER}, x AS (SELECT max(u.n) AS every, count(*) FILTER (WHERE NOT label) AS seen, count(*) FILTER (WHERE label) AS held FROM w, u),
c AS (SELECT count(*) FILTER (WHERE b.score < a.score) AS less, count(*) FILTER (WHERE b.score = a.score) AS same FROM w a, w b WHERE a.label AND NOT b.label), z0 AS (SELECT count(*) FILTER (WHERE score > 0) AS pos, count(*) FILTER (WHERE score = 0) AS zero FROM w WHERE label)
SELECT held, every AS negatives, less + pos * (every - seen) AS concordant, held * every - less - pos * (every - seen) - same - zero * (every - seen) AS discordant, same + zero * (every - seen) AS tied,
CASE WHEN held * every = 0 THEN 0.5 ELSE round(1e-11 + (less + pos * (every - seen) + (same + zero * (every - seen)) / 2.0) / (held * every), 6) END AS auroc FROM x, c, z0"""
