"""Scores of pairs, rankings and worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphev.operators.relation import Relation, Stepped

pair_scores = Relation(
    """SELECT p.source_name AS source, p.target_name AS target, coalesce(v.votes, 0) AS votes, coalesce(c.chains, 0) AS chains,
round(least(1.0, (coalesce(v.base, 0) + least(0.25, 0.04 * coalesce(c.total, 0)) + least(0.10, 0.06 * coalesce(s.confidence, 0))) * CASE WHEN coalesce(c.chains, 0) = 0 THEN 0.8 ELSE 1.0 END), 6) AS score,
l.source_name IS NOT NULL AS label
FROM {pairs} p LEFT JOIN (SELECT source, target, avg(confidence) AS base, count(*) AS votes FROM {votes} GROUP BY source, target) v ON v.source = p.source_name AND v.target = p.target_name
LEFT JOIN {composition} c ON c.source = p.source_name AND c.target = p.target_name LEFT JOIN {similarity} s ON s.source = p.source_name AND s.target = p.target_name
LEFT JOIN {labels} l ON l.source_name = p.source_name AND l.target_name = p.target_name""",
    ("pairs", "votes", "composition", "similarity", "labels"), {}, "E1, E2: mean vote, path bonus, likeness bonus, discount without chains",
)
triage = Relation(
    """SELECT target, k, source, score, chains, CASE WHEN label THEN 'APPROVED' ELSE 'NOT_APPROVED' END AS status FROM (
SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, source) AS k FROM {scores}) q WHERE k <= :most""",
    ("scores",), {"most": 10}, "E3: a disease's best drugs",
)
triage_by_drug = Relation(
    """SELECT source, k, target, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS k FROM {scores}) q WHERE k <= :most""",
    ("scores",), {"most": 10}, "E4: a drug's best diseases",
)
chain_quality = Relation(
    """SELECT a, c, b, CASE WHEN low >= 0.70 THEN 'high' WHEN low >= 0.40 THEN 'mid' ELSE 'low' END AS quality FROM (
SELECT f.source_name AS a, f.target_name AS b, g.target_name AS c, least(f.confidence, g.confidence) AS low FROM {last} f JOIN {last} g ON f.target_name = g.source_name
WHERE f.source_type = 'Drug' AND g.target_type = 'Disease') q""",
    ("last",), {}, "E5, E6: chains by their weakest edge",
)
_direction = Relation(
    """SELECT a, b, c, CASE WHEN g_name = 'associated_with' THEN 'NOT_ASSESSED' WHEN f_name = 'modulates' THEN 'UNKNOWN_SIGN'
WHEN (f_name = 'inhibits') = (b_type <> 'TumorSuppressor') THEN 'COHERENT' ELSE 'REJECT_WRONG_DIRECTION' END AS verdict FROM {horns}""",
    ("horns",),
)
_signed_superposition = Relation(
    """SELECT a, c, round(sum(composite * s), 4) AS net_strict, round(sum(CASE WHEN s = 0 THEN composite ELSE composite * s END), 4) AS net_open, count(*) FILTER (WHERE s <> 0) AS signed FROM (
SELECT a, c, composite, -(CASE f_name WHEN 'inhibits' THEN -1 WHEN 'activates' THEN 1 ELSE 0 END) * (CASE WHEN g_name = 'driver_of' THEN 1 WHEN b_type = 'Oncogene' THEN 1
WHEN b_type = 'TumorSuppressor' THEN -1 ELSE 0 END) AS s FROM {horns}) q GROUP BY a, c""",
    ("horns",),
)
direction = Stepped(
    """SELECT h.a, h.b, h.c, CASE WHEN h.g_name = 'associated_with' THEN 'NOT_ASSESSED' WHEN h.f_name = 'modulates' THEN 'UNKNOWN_SIGN'
WHEN (h.f_name = 'inhibits') = (o.type_name <> 'TumorSuppressor') THEN 'COHERENT' ELSE 'REJECT_WRONG_DIRECTION' END AS verdict FROM {horns} h JOIN {objects} o ON o.name = h.b""",
    ("horns", "objects"), {}, "E10: does the drug push its target the right way; horns bring b's type", lambda horns, objects: _direction(horns),
)
specific_lift = Relation(
    """SELECT source, target, round(score - avg(score) OVER (PARTITION BY source), 6) AS lift, sum(CASE WHEN k <= :top THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS hub_count
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, source) AS k FROM {scores}) q""",
    ("scores",), {"top": 5}, "E11: what a score has over the drug's mean",
)
novelty = Relation(
    """SELECT source, target, round(score * greatest(0.0, 1 - ln(1 + chains) / ln(2001)), 6) AS ranked FROM {scores} WHERE NOT label AND chains > 0 AND score >= :least""",
    ("scores",), {"least": 0.3}, "E12: good scores with little written about them",
)
signed_superposition = Stepped(
    """SELECT a, c, round(sum(composite * s), 4) AS net_strict, round(sum(CASE WHEN s = 0 THEN composite ELSE composite * s END), 4) AS net_open, count(*) FILTER (WHERE s <> 0) AS signed FROM (
SELECT h.*, -(CASE h.f_name WHEN 'inhibits' THEN -1 WHEN 'activates' THEN 1 ELSE 0 END) * (CASE WHEN h.g_name = 'driver_of' THEN 1 WHEN o.type_name = 'Oncogene' THEN 1
WHEN o.type_name = 'TumorSuppressor' THEN -1 ELSE 0 END) AS s FROM {horns} h JOIN {objects} o ON o.name = h.b) q GROUP BY a, c""",
    ("horns", "objects"), {}, "E22: chains with and against the disease; horns bring b's type", lambda horns, objects: _signed_superposition(horns),
)
chain_aggregates = Relation(
    """SELECT a, c, max(composite) AS best, round(1 - exp(sum(ln(1 - least(composite, 0.999999)))), 6) AS noisy_or,
round(max(composite) + 0.3 * tanh(sum(composite) - 1) * (1 - max(composite)), 6) AS corroborated, round(1 / (1 + 0.5 * ln(count(*))), 6) AS promiscuity FROM {horns} GROUP BY a, c""",
    ("horns",), {}, "E21: aggregators of a pair's chains",
)
within_ranks = Relation(
    """SELECT source, count(*) AS targets, round(avg(1.0 / r), 6) AS mrr, round(avg(CASE WHEN r <= 1.5 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3
FROM (SELECT source, target, label, rank() OVER (PARTITION BY source ORDER BY score DESC) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS r FROM {scores}) q WHERE label GROUP BY source""",
    ("scores",), {}, "E23: average-tie ranks of a drug's labels",
)
wilson = Relation(
    """SELECT target, n, k, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS low,
round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS high
FROM (SELECT target, count(*) AS n, count(*) FILTER (WHERE label) AS k, count(*) FILTER (WHERE label) / CAST(count(*) AS DOUBLE) AS p, 1.959964 AS z FROM {scores} GROUP BY target) q""",
    ("scores",), {}, "E24: interval of a share",
)
evidence_odds = Relation(
    """SELECT source, target, round(1 / (1 + exp(-(ln(:prior / (1 - :prior)) + sum(ln((0.5 + 0.5 * confidence) / 0.5))))), 8) AS posterior FROM {votes} GROUP BY source, target""",
    ("votes",), {"prior": 0.001}, "E26: odds of a pair after all its evidence, in any order",
)
strategy_weights = Relation(
    """SELECT v.strategy, count(*) AS n, count(l.source_name) AS hits, round(1 + 2 * (count(l.source_name) / CAST(count(*) AS DOUBLE) - 0.5), 6) AS weight FROM {votes} v
LEFT JOIN {labels} l ON l.source_name = v.source AND l.target_name = v.target GROUP BY v.strategy""",
    ("votes", "labels"), {}, "E28: precision as a weight",
)
label_worklist = Relation(
    """SELECT target, source, k, score, round(1.0 / k, 6) AS impact FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, source) AS k FROM {scores}) q WHERE k <= :most AND NOT label""",
    ("scores",), {"most": 20}, "E16: unlabelled pairs that would matter most",
)
actionability = Relation(
    """SELECT source, target, round(tier_factor * score * CASE WHEN label THEN 0.5 ELSE 1.0 END, 6) AS actionable, CASE WHEN tier_factor * score >= 0.7 THEN 1 WHEN tier_factor * score >= 0.3 THEN 2 ELSE 3 END AS tier FROM (
SELECT *, CASE WHEN chains >= 2 THEN 1.0 WHEN chains = 1 THEN 0.5 ELSE 0.1 END AS tier_factor FROM {scores}) q""",
    ("scores",), {}, "E30",
)


def score_breakdown(votes: DataFrame, paths: DataFrame, likeness: str = "fingerprint", by: tuple[str, ...] = ()) -> DataFrame:
    """Votes (source, target, strategy, confidence) of any strategies, paths (source, target, chains,
    total) -> a row per pair with a vote: the best vote of each strategy, their mean but for ``likeness``,
    which adds a bonus of its own, the bonus of paths, the discount without any, and the score.

    Pairs without a vote score 0 and have no row. ``by``: columns of votes that keep folds apart."""
    best = votes.groupBy(*by, "source", "target", "strategy").agg(F.max("confidence").alias("c"))
    other = F.col("strategy") != likeness
    rows = best.groupBy(*by, "source", "target").agg(
        F.count("*").alias("votes"), F.array_join(F.array_sort(F.collect_list("strategy")), "+").alias("strategies"),
        F.coalesce(F.sum(F.when(other, F.col("c"))) / F.nullif(F.count_if(other), F.lit(0)), F.lit(0.0)).alias("base"), F.coalesce(F.max(F.when(~other, F.col("c"))), F.lit(0.0)).alias("like"),
    )
    rows = rows.join(paths.select("source", "target", "chains", "total"), ["source", "target"], "left").fillna({"chains": 0, "total": 0.0})
    rows = rows.withColumns({"path_bonus": F.least(F.lit(0.25), 0.04 * F.col("total")), "like_bonus": F.when(F.col("like") > 0, F.least(F.lit(0.10), 0.06 * F.col("like"))).otherwise(0.0), "discounted": F.col("chains") == 0})
    raw = (F.col("base") + F.col("path_bonus") + F.col("like_bonus")) * F.when(F.col("discounted"), 0.8).otherwise(1.0)
    return rows.withColumn("raw", raw).withColumn("score", F.least(F.lit(1.0), "raw")).drop("like")
