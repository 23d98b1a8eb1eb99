"""Leave-one-label-out by deltas against the plain loop over folds."""

import random

import pytest

from graphev.operators import holdout, scoring, votes

EDGE = "name string, source_name string, target_name string, source_type string, target_type string, confidence double"
OBJECT = "name string, type_name string, sector int"


def edges():
    """Drugs with two labels and with none, a label beside another edge of the same ends, a repeated label, a
    drug that nothing but a label joins to others."""
    rng = random.Random(4)
    out = [(rng.choice(["inhibits", "activates"]), f"d{i}", f"p{rng.randrange(6)}", "Drug", "Protein", round(rng.uniform(0.3, 0.9), 2)) for i in range(5) for _ in range(3)]
    out += [("driver_of", f"p{rng.randrange(6)}", f"e{rng.randrange(3)}", "Protein", "Disease", round(rng.uniform(0.3, 0.9), 2)) for _ in range(7)]
    labels = [("d0", "e0", 0.9), ("d0", "e1", 0.5), ("d1", "e0", 0.6), ("d2", "e2", 0.8), ("d3", "e0", 0.7), ("d3", "e0", 0.4), ("alone", "e2", 0.55)]
    out += [("treats", s, t, "Drug", "Disease", c) for s, t, c in labels]
    return out + [("studied_in", "d2", "e2", "Drug", "Disease", 0.3), ("studied_in", "d4", "e0", "Drug", "Disease", 0.3)]


def inputs(spark, rows):
    typed = spark.createDataFrame(rows, EDGE)
    names = [(f"d{i}", "Drug", i % 2) for i in range(5)] + [("alone", "Drug", 0)] + [(f"e{i}", "Disease", 0) for i in range(3)] + [(f"p{i}", "Protein", 1) for i in range(6)]
    strict = typed.filter("NOT (source_type = 'Drug' AND target_type = 'Disease')")
    paths = votes.composition(strict)
    fixed = paths.selectExpr("source", "target", "'composition' AS strategy", "confidence")
    return typed, spark.createDataFrame(names, OBJECT), votes.fingerprints(strict), fixed, paths


def plain_scores(typed, objects, prints, fixed, paths):
    labels, overlaps = holdout.positives(typed), votes.overlaps(typed)
    every = fixed
    for name, rows in (("analog", votes.analog(overlaps, labels)), ("pattern", votes.pattern(overlaps, labels)), ("fiber_lift", votes.fiber_lift(labels, objects)), ("fingerprint", votes.weighted_similarity(prints, labels))):
        every = every.unionByName(rows.selectExpr("source", "target", f"'{name}' AS strategy", "confidence"))
    return {(r.source, r.target): (r.score, r.votes) for r in holdout.rounded(scoring.score_breakdown(every, paths)).collect()}


def test_folds_equal_the_plain_loop(spark):
    rows = edges()
    results, ranking = holdout.leave_one_out(*inputs(spark, rows))
    got = {(r.source, r.target): r for r in results.collect()}
    labels = sorted({r[1:3] for r in rows if r[0] == "treats"})
    assert sorted(got) == labels
    negatives = [(d, e) for d in [*(f"d{i}" for i in range(5)), "alone"] for e in ("e0", "e1", "e2") if (d, e) not in labels]
    sums = dict.fromkeys(negatives, 0.0)
    for held in labels:
        scores = plain_scores(*inputs(spark, [r for r in rows if not (r[0] == "treats" and r[1:3] == held)]))
        score, n = scores.get(held, (0.0, 0))
        others = [scores.get(x, (0.0, 0))[0] for x in negatives]
        r = got[held]
        assert (r.score, r.votes) == (score, n)
        assert (r.concordant, r.discordant, r.tied) == (sum(x < score for x in others), sum(x > score for x in others), sum(x == score for x in others))
        for x, s in zip(negatives, others):
            sums[x] += s
    means = {(r.source, r.target): r.score for r in ranking.filter("NOT label").collect()}
    assert set(means) == {x for x, s in sums.items() if s > 0}
    assert all(means[x] == pytest.approx(sums[x] / len(labels), abs=1e-6) for x in means)
    assert {(r.source, r.target): r.score for r in ranking.filter("label").collect()} == {x: r.score for x, r in got.items()}


def test_without_labels_there_are_no_folds(spark):
    results, ranking = holdout.leave_one_out(*inputs(spark, [r for r in edges() if r[0] != "treats"]))
    assert results.count() == 0 and ranking.filter("label").count() == 0


def test_later_labels_are_held_out_together(spark):
    rows = edges()
    labels = holdout.positives(spark.createDataFrame(rows, EDGE))
    years = [("d0", "e0", 2010), ("d0", "e1", 2014), ("d1", "e0", 2013), ("d2", "e2", 2020), ("d3", "e0", 2001), ("d3", "e0", 2019), ("alone", "e2", 2014), ("no", "label", 2030)]
    table = spark.createDataFrame(years, "source string, target string, year int")
    held = holdout.held_after(labels, table)
    later = {("d0", "e1"), ("d2", "e2"), ("alone", "e2")}
    assert {tuple(r) for r in held.collect()} == later
    assert {tuple(r) for r in holdout.held_after(labels, table, include=True).collect()} == later | {("d1", "e0")}
    with pytest.raises(ValueError, match="1 labels"):
        holdout.held_after(labels, table.filter("target <> 'e1'"))
    got = {(r.source, r.target): r for r in holdout.held_out(*inputs(spark, rows), held).collect()}
    left = {r[1:3] for r in rows if r[0] == "treats"} - later
    plain = plain_scores(*inputs(spark, [r for r in rows if not (r[0] == "treats" and r[1:3] in later)]))
    assert {x: (r.score, r.votes) for x, r in got.items()} == {x: v for x, v in plain.items() if x not in left} | {x: plain.get(x, (0.0, 0)) for x in later}
    assert {x for x, r in got.items() if r.label} == later


def test_outcome_counts_pairs_without_a_row(spark):
    ranking = spark.createDataFrame([("a", "x", 0.5, True), ("b", "x", 0.0, True), ("c", "x", 0.5, False), ("d", "x", 0.7, False)], "source string, target string, score double, label boolean")
    r = holdout.outcome(ranking, every=5).first()
    assert (r.held, r.negatives, r.concordant, r.discordant, r.tied) == (2, 5, 3, 3, 4) and r.auroc == 0.5
    r = holdout.outcome(ranking.limit(0), every=0).first()
    assert (r.held, r.negatives, r.auroc) == (0, 0, 0.5)


def test_recall_of_folds_has_mean_and_deviation(spark):
    labels = spark.createDataFrame([(f"d{i}", f"e{i % 7}") for i in range(40)] * 2, "source_name string, target_name string")
    predicted = spark.createDataFrame([(f"d{i}", f"e{i % 7}") for i in range(0, 40, 3)] * 2 + [("d1", "e0")], "source string, target string")
    got = holdout.fold_recall(labels, predicted).collect()
    assert sum(r.labels for r in got) == 40 and sum(r.found for r in got) == 14
    shares = [r.found / r.labels for r in got]
    mean = sum(shares) / len(shares)
    assert all(abs(r.mean_recall - mean) < 1e-6 and abs(r.std_recall - (sum((x - mean) ** 2 for x in shares) / len(shares)) ** 0.5) < 1e-6 for r in got)
    assert holdout.fold_recall(labels.limit(0), predicted).count() == 0
