"""Small graphs with answers worked out by hand, and all queries against DuckDB."""

import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphev.operators import analytics, belief, evidence, metrics, more, paths, ranks, records, vectors, views, votes
from graphev.plans import catalog
from graphev.sources import works
from graphev.streaming import forecast

SMALL = "/root/testdata/sf0.001"


def edges(spark, rows):
    out = spark.createDataFrame(rows, "source_name string, name string, target_name string, confidence double, source_type string, target_type string")
    return out.select("*", F.concat("name", F.lit(":"), "source_name", F.lit("->"), "target_name").alias("id"), F.lit("2020-01-01").cast("timestamp").alias("created_at"), F.lit("STRING").alias("provenance"))


@pytest.fixture(scope="module")
def small(spark):
    return edges(spark, [("A", "inhibits", "P", 0.9, "Drug", "Kinase"), ("P", "driver_of", "D", 0.8, "Kinase", "Disease"), ("A", "binds", "Q", 0.5, "Drug", "Kinase"), ("Q", "driver_of", "D", 0.2, "Kinase", "Disease")])


def test_two_hop_composition_is_the_product(spark, small):
    labels = spark.createDataFrame([("A", "D", 1.0)], "source_name string, target_name string, confidence double")
    rows = paths.inner_horns(small, labels).orderBy("b").collect()
    assert [(r.b, r.composite, r.treated) for r in rows] == [("P", 0.72, True), ("Q", 0.1, True)]
    vote = votes.composition(small).first()
    assert (vote.confidence, vote.chains, vote.total) == (0.72, 2, 0.82)


def test_pathway_support_and_conflicts(spark, small):
    assert votes.pathway_support(small).first().confidence == pytest.approx(0.41 * 1.1)
    labels = spark.createDataFrame([], "source_name string, target_name string, confidence double")
    clash = paths.conflicts(paths.inner_horns(small, labels)).first()
    assert (clash.high, clash.low, clash.spread) == (0.72, 0.1, 0.62)


def test_fusion_of_two_votes(spark):
    got = votes.belief(spark.createDataFrame([("s", "t", 0.6), ("s", "t", 0.7)], "source string, target string, confidence double")).first()
    assert (got.belief, got.pignistic) == (0.88, 0.94)


def test_strict_view_drops_labels_and_bridges(spark, small):
    more = small.unionByName(edges(spark, [("A", "treats", "D", 1.0, "Drug", "Disease")])).unionByName(
        edges(spark, [("R", "driver_of", "D", 0.9, "Kinase", "Disease")]).withColumn("provenance", F.lit("x via_drug y"))
    )
    assert {r.source_name for r in views.strict_view(more).collect()} == {"A", "P", "Q"}
    assert "treats" not in {r.name for r in views.strict_view(more).collect()}


def test_zero_confidence_counts_as_one(spark):
    assert views.strict_view(edges(spark, [("A", "binds", "P", 0.0, "Drug", "Kinase")])).first().confidence == 1.0


@pytest.mark.parametrize("monotone", [lambda s: s, lambda s: s**3])
def test_auroc_with_ties(spark, monotone):
    rows = [("a", "x", monotone(s), y) for s, y in [(0.9, True), (0.8, False), (0.8, True), (0.2, False)]]
    got = metrics.auroc(spark.createDataFrame(rows, "source string, target string, score double, label boolean")).first()
    assert got.auroc == pytest.approx((2 + 1 + 0.5) / 4)


def test_auroc_of_one_class_is_a_half(spark):
    assert metrics.auroc(spark.createDataFrame([("a", "x", 0.5, True)], "source string, target string, score double, label boolean")).first().auroc == 0.5


def test_step_up_is_monotone_and_not_below_p(spark):
    given = [0.0005, 0.92, 0.028, 0.046, 0.32]
    rows = evidence.step_up(spark.createDataFrame(list(enumerate(given)), "compound int, p double")).orderBy("p").collect()
    assert all(r.q >= r.p for r in rows) and [r.q for r in rows] == sorted(r.q for r in rows)
    assert [r.q for r in rows] == pytest.approx([0.0025, 0.07, 0.046 * 5 / 3, 0.4, 0.92])


def test_normal_tail(spark):
    at = [0.01, 0.5, 1.0, 1.96, 3.0, 4.0, 5.0, 8.0, 20.0]
    got = spark.createDataFrame([(z,) for z in at], "z double").selectExpr(evidence.tail("z") + " AS p").collect()
    assert [r.p for r in got] == pytest.approx([math.erfc(z / math.sqrt(2)) for z in at], rel=2e-7)


def test_rank_test_of_separated_and_equal_groups(spark):
    rows = [("far", i % 2 * 9, 0.1 * i if i % 2 else 0.1 * i + 5) for i in range(20)] + [("tied", i % 2 * 9, 0.5) for i in range(20)]
    got = {r.compound: r for r in evidence.rank_test(spark.createDataFrame(rows, "compound string, lineage int, auc double")).collect()}
    z = (50 - 0.5) / math.sqrt(100 * 21 / 12)
    assert got["far"].u == 100 and got["far"].z == pytest.approx(z, abs=1e-6) and got["far"].p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)
    assert got["tied"].u == 50 and got["tied"].p == 1


def test_parallel_paths_by_their_best_edges(spark):
    rows = [("A", "r", "B", 0.8, "Drug", "Kinase"), ("B", "r", "D", 0.7, "Kinase", "Disease"), ("A", "r", "C", 0.75, "Drug", "Kinase"), ("C", "r", "D", 0.72, "Kinase", "Disease")]
    assert more.parallel_paths(edges(spark, rows)).first().score == 0.95
    assert more.parallel_paths(edges(spark, rows[:2])).count() == 0


def test_scores_between_and_past_bins(spark):
    bins = spark.createDataFrame([(0, 0.0, 0.2, 0.1), (1, 0.4, 0.6, 0.5), (2, 0.7, 0.9, 0.8)], "bin int, score_min double, score_max double, label_rate double")
    scores = spark.createDataFrame([("a", "x", s) for s in (0.1, 0.3, 0.6, 0.65, 0.95)], "source string, target string, score double")
    assert [(r.bin, r.rate) for r in more.calibrated(scores.coalesce(1), bins).orderBy("bin", "rate").collect()] == [(0, 0.1), (1, 0.5), (1, 0.5), (2, 0.8), (2, 0.8)]


def test_signed_spread_over_four_steps(spark):
    rows = [("S1", "inhibits", "P1", 1.0, "Drug", "Kinase"), ("P1", "activates", "P2", 1.0, "Kinase", "Kinase"), ("P1", "modulates", "P9", 1.0, "Kinase", "Kinase"), ("P2", "inhibits", "P3", 1.0, "Kinase", "Kinase"), ("P2", "activates", "P4", 1.0, "Kinase", "Kinase"), ("P3", "driver_of", "N1", 1.0, "Kinase", "Disease")]
    assert [tuple(r) for r in analytics.signed_spread(edges(spark, rows)).collect()] == [("S1", "N1", 0.5**4 * -1 * 1 * -0.5)]


def test_kcore_and_pagerank(spark):
    # a square with both diagonals has core 3; a tail has core 1
    pairs = [(a, b) for a in "wxyz" for b in "wxyz" if a != b] + [("z", "t"), ("t", "z")]
    cores = {r.node: r.core for r in analytics.kcore(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert cores == {"w": 3, "x": 3, "y": 3, "z": 3, "t": 1}
    ranks = {r.node: r["rank"] for r in analytics.pagerank(spark.createDataFrame([("a", "c", 1.0), ("b", "c", 1.0)], "a string, b string, w double"), 40).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["c"] > ranks["a"] == pytest.approx(ranks["b"])


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "cast(user_id as string) entity", "event_type source", "value weight", "props")
    steps = forecast.transitions(rows)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = forecast.decayed_stream(live, steps, "60 days").writeStream.outputMode("complete").format("memory").queryName("parts").start()
    query.processAllAvailable()
    query.stop()
    batch = {r.target: r.score for r in forecast.decayed_scores(rows, steps).collect()}
    now = rows.agg(F.max("ts")).first()[0]
    got = {r.target: r.score for r in forecast.decayed_total(spark.table("parts"), now).collect()}
    assert got.keys() == batch.keys() and all(got[k] == pytest.approx(batch[k], rel=1e-4, abs=1e-5) for k in got)


def test_late_rows_are_dropped_past_the_watermark(spark, tmp_path):
    def feed(name, rows):
        spark.createDataFrame(rows, "ts timestamp, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1, h)
    feed("a", [(at(1), "x"), (at(20), "x")])
    live = spark.readStream.schema("ts timestamp, source string").parquet(str(tmp_path / "in"))
    query = forecast.windowed_stream(live).writeStream.outputMode("update").format("memory").queryName("late").start()
    query.processAllAvailable()
    feed("b", [(at(2), "x"), (at(20), "x")])
    query.processAllAvailable()
    query.stop()
    starts = {r.window.start.hour for r in spark.table("late").collect()}
    assert 2 not in starts and 20 in starts


def rows_of(frame):
    text = lambda v: "" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_duckdb(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ours, theirs = catalog.QUERIES[name](spark, SMALL).toPandas(), db.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_refinement_takes_the_better_factorization(spark):
    got = analytics.refined(spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.8), ("A", "C", 0.3)], "a string, b string, w double"))
    assert {(r.a, r.b): round(r.w, 6) for r in got.collect()} == {("A", "B"): 0.9, ("B", "C"): 0.8, ("A", "C"): 0.72}


def test_components(spark):
    from graphev.operators.components import components

    chain = [(i, i + 1) for i in range(20, 0, -1)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert got == {**{i: 1 for i in range(1, 22)}, 100: 100, 101: 100}


def test_bootstrap_brackets_the_estimate(spark):
    from graphev.operators.resample import bootstrap_auroc

    rows = [("s", str(i), i / 100, i % 10 > 3 and i > 30) for i in range(100)]
    frame = spark.createDataFrame(rows, "source string, target string, score double, label boolean")
    got, exact = bootstrap_auroc(frame, 100).first(), metrics.auroc(frame).first().auroc
    assert got.low <= exact <= got.high and got.replicates == 100


def test_loaders(spark, tmp_path):
    from graphev.sources import loaders

    (tmp_path / "o.csv").write_text('name,type_name,metadata,era\nA,Drug,"{""x"": ""1""}",old\n,Drug,,\nB,,not json,\n')
    got = {r.name: (r.type_name, r.metadata) for r in loaders.load_objects_csv(spark, str(tmp_path / "o.csv"), "Thing").collect()}
    assert got == {"A": ("Drug", {"x": "1", "era": "old"}), "B": ("Thing", {})}
    (tmp_path / "m.csv").write_text("name,source_name,target_name,confidence\nr,A,B,0.5\nr,A,,1\nr,B,A,oops\n")
    assert sorted(tuple(r) for r in loaders.load_morphisms_csv(spark, str(tmp_path / "m.csv")).collect()) == [("r", "A", "B", 0.5), ("r", "B", "A", 1.0)]
    (tmp_path / "g.json").write_text('{"objects": [{"name": "A"}, {"type_name": "x"}], "morphisms": [{"name": "r", "source": "A", "target": "B"}, {"name": "r", "source": "A"}]}')
    objects, edges = loaders.load_graph_json(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in objects.collect()] == [("A", "Object")] and [tuple(r) for r in edges.collect()] == [("r", "A", "B", 1.0)]


def test_cosine_ties_take_the_smallest_ids(spark):
    """More equal vectors than a query has places: the smallest vec_ids win, whatever their order."""
    rng = random.Random(4)
    ids = list(range(1, 400))
    rng.shuffle(ids)
    rows = spark.createDataFrame([(i, [1.0, 2.0] if i % 4 else [2.0, 1.0]) for i in ids], "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1000, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in vectors.cosine_top_k(rows, asked, 10).orderBy("k").collect()]
    assert got == [i for i in range(1, 400) if i % 4][:10]


def test_vectors_that_are_null_or_ragged_meet_nothing(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.similarity for r in vectors.cosine_pairs(table, table.filter("vec_id in (0, 2)"), None).collect()}
    assert got == {(0, 1): 0.707107, (0, 5): 0.0}
    assert vectors.cosine_top_k(table.limit(0), table.limit(0)).count() == 0


def test_votes_and_transfers_by_likeness(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.65), (1, 4, 0.75)], "query_id long, vec_id long, similarity double")
    edges = spark.createDataFrame([(2, 9, "binds"), (4, 9, "binds"), (4, 1, "binds"), (1, 3, "binds")], "a long, b long, name string")
    got = {(r.target, r.kind): round(r.confidence, 6) for r in vectors.similarity_votes(pairs, edges).collect()}
    assert got == {(2, "direct"): 0.85, (4, "direct"): 0.75, (9, "through"): 0.81}
    known = spark.createDataFrame([(1, "D"), (4, "D")], "node long, disease string")
    assert [(r.vec_id, r.similarity, r.reference, r.k) for r in vectors.transfer_edges(pairs, known).orderBy("k").collect()] == [(2, 0.9, 1, 1), (3, 0.65, 1, 2)]


def test_row_numbers_follow_the_order(spark):
    rows = [(i * 37 % 101, "x") for i in range(101)]
    frame = spark.createDataFrame(rows, "v int, w string").repartition(5)
    assert all(r.k == r.v + 1 for r in ranks.row_numbers(frame, [F.asc("v")]).collect())
    assert ranks.row_numbers(frame.limit(0), [F.asc("v")]).count() == 0


def test_shuffled_labels(spark):
    kind = "score double, label boolean"
    good = ranks.permutation_test(spark.createDataFrame([(i / 40, i >= 20) for i in range(40)], kind), 200).first()
    assert good.observed == 1 and good.p == 0 and good.mean_shuffled == pytest.approx(0.5, abs=0.03)
    flat = ranks.permutation_test(spark.createDataFrame([(0.5, i % 2 == 0) for i in range(10)], kind), 50).first()
    assert (flat.observed, flat.p) == (0.5, 1)
    assert ranks.permutation_test(spark.createDataFrame([], kind), 20).first().observed == 0.5


def test_combined_masses_equal_the_pairwise_sum(spark):
    """The rule by its definition: products of all subsets, empty intersections set aside."""
    sources = [({1: 0.6, 7: 0.4}, 0.9), ({2: 0.3, 3: 0.5, 7: 0.2}, 0.7), ({4: 0.2, 6: 0.8}, 1.0)]
    rows = [("k", str(i), s, m, w) for i, (ms, w) in enumerate(sources) for s, m in ms.items()] + [("clash", "a", 1, 1.0, 1.0), ("clash", "b", 2, 1.0, 1.0)]
    got = belief.combined(spark.createDataFrame(rows, "k string, source string, subset int, mass double, reliability double"), ["k"], 3).collect()
    now = {7: 1.0}
    for ms, w in sources:
        told = {s: m * w for s, m in ms.items()}
        told[7] = told.get(7, 0) + 1 - w
        after = {}
        for a, x in now.items():
            for b, y in told.items():
                after[a & b] = after.get(a & b, 0) + x * y
        now = after
    lost = now.pop(0, 0.0)
    assert {r.subset: r.mass for r in got if r.k == "k"} == pytest.approx({s: m / (1 - lost) for s, m in now.items() if m > 1e-12})
    assert [(r.subset, r.mass, r.conflict) for r in got if r.k == "clash"] == [(None, None, 1.0)]


def test_paths_of_four_edges_fill_a_gap(spark):
    rows = [("A", "binds", "P", 0.95, "Drug", "Kinase"), ("P", "r", "Q", 0.95, "Kinase", "Kinase"), ("Q", "r", "R", 0.95, "Kinase", "Kinase"), ("R", "driver_of", "D", 0.95, "Kinase", "Disease"), ("P", "r", "A", 0.9, "Kinase", "Drug")]
    none = spark.createDataFrame([], "source_name string, target_name string")
    assert [tuple(r) for r in paths.gap_fillers(edges(spark, rows), none).collect()] == [("A", "D", "binds", round(0.95**4 * 0.5, 6))]


def test_records_and_signed_networks(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text(
        '{"id": "https://openalex.org/W1", "title": "", "display_name": null, "publication_year": null, "abstract_inverted_index": {"b": [1, 3], "a": [0, 2]}, "referenced_works": ["https://openalex.org/W2", "W9"]}\n'
        'no json\n{"id": "W2", "title": "T", "publication_year": 1980}\n{"id": "W3", "title": "T", "publication_year": 2001, "concepts": [{"display_name": "Big Idea"}, {"display_name": null}]}\n'
    )
    got = {r.id: r for r in works.load_works(spark, str(tmp_path / "w.jsonl"), 1990).collect()}
    assert set(got) == {"W1", "W3"} and (got["W1"].title, got["W1"].abstract, got["W1"].citations) == ("W1", "a b a b", ["W2", "W9"])
    ideas = spark.createDataFrame([("big_idea", ["top"], ["W1"])], "id string, parent_ids array<string>, related_ids array<string>")
    found = works.work_edges(works.load_works(spark, str(tmp_path / "w.jsonl")), ideas).collect()
    assert {tuple(r)[:3] for r in found} == {("cites", "W1", "W2"), ("about", "W3", "big_idea"), ("related_to", "big_idea", "W1")}
    lines = ["a\tb\ts\tt\td\tp\tm", "1\t2\tA\tB\tTrue\tTrue\tFalse", "1\t2\t\tC\tTrue\tFalse\tTrue", "1\t2\tA\tD\tTrue\tTrue\tTrue", "1\t2\tA\tE\tFalse\tTrue\tFalse", "1\t2\tA"]
    (tmp_path / "n.tsv").write_text("\n".join(lines))
    assert {tuple(r) for r in works.load_signed_edges(spark, str(tmp_path / "n.tsv")).collect()} == {("A", "B", 1), ("1", "C", -1)}


@pytest.mark.parametrize("make", [votes.composition, votes.pathway_support, more.parallel_paths, paths.semiring_weights, lambda v: paths.horn_counts(paths.inner_horns(v, v)), lambda v: more.retrodiction(paths.inner_horns(v, v)), lambda v: more.sheet_check(paths.inner_horns(v, v))])
def test_chains_are_grouped_where_they_are_made(spark, small, make):
    """A pair's chains are never moved: no shuffle comes after the lists of edges are opened."""
    text = make(small)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in text and "Exchange hashpartitioning" not in text.split("Generate explode")[0]


def test_chains_keep_parallel_edges_and_labels(spark, small):
    rows = [("A", "binds", "P", 0.4, "Drug", "Kinase"), ("P", "marks", "D", 0.1, "Kinase", "Disease"), ("P", "marks", "E", 0.3, "Kinase", "Disease")]
    labels = spark.createDataFrame([("A", "E", 1.0), ("B", "D", 1.0)], "source_name string, target_name string, confidence double")
    got = paths.inner_horns(small.unionByName(edges(spark, rows)), labels).select("a", "b", "c", "f_name", "g_name", "composite", "treated", "b_ends").collect()
    want = [("A", "P", c, f, g, round(x * y, 4), c == "E", 2) for f, x in (("inhibits", 0.9), ("binds", 0.4)) for c, g, y in (("D", "driver_of", 0.8), ("D", "marks", 0.1), ("E", "marks", 0.3))]
    assert sorted(map(tuple, got)) == sorted([*want, ("A", "Q", "D", "binds", "driver_of", 0.1, False, 1)])


def test_meetings_of_drugs_are_added_up_where_they_are_made(spark, small):
    prints = votes.fingerprints(small)
    labels = spark.createDataFrame([("A", "D", 1.0)], "source_name string, target_name string, confidence double")
    assert "Generate explode" in votes.weighted_similarity(prints, labels)._jdf.queryExecution().executedPlan().toString()
    text = votes.meetings(prints)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text.split("Generate explode")[0]


def test_decomposable_without_all_two_edge_paths(spark):
    names = [("A", "B"), ("B", "C"), ("A", "C"), ("C", "C"), ("D", "E"), ("E", "D"), ("D", "D")]
    rows = edges(spark, [(a, "interacts_with", b, 0.5, "Kinase", "Kinase") for a, b in names])
    found = votes.decomposable(rows)
    got = {r.id.split(":")[1]: r.decomposes for r in found.collect()}
    # a middle node that is one of the ends does not count; a loop has the other node between its ends
    assert got == {"A->B": False, "B->C": False, "A->C": True, "C->C": False, "D->E": False, "E->D": False, "D->D": True}
    assert "array_intersect" in found._jdf.queryExecution().executedPlan().toString()


def test_analog_votes_without_pairs_of_drugs(spark):
    rng = random.Random(7)
    drugs, parts_, ends = [f"S{i}" for i in range(12)], [f"P{i}" for i in range(6)], ["N0", "N1", "N2"]
    rows = {(d, rng.choice(["binds", "blocks", "marks"]), rng.choice(parts_), 0.5, "Drug", "Kinase") for d in drugs for _ in range(rng.randrange(4))}
    typed = edges(spark, sorted(rows | {(d, "treats", rng.choice(ends), 1.0, "Drug", "Disease") for d in drugs[:8]} | {("S1", "treats", "N0", 1.0, "Drug", "Disease")}))
    labels = typed.filter("name = 'treats'").select("source_name", "target_name", "confidence")
    got = votes.analog_by_counts(typed, labels)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, votes.analog(votes.overlaps(typed), labels).collect()))
    assert catalog.OTHERWISE["d4_analog"][0] is votes.analog_by_counts


def test_fiber_votes_by_best_labels(spark):
    objects = spark.createDataFrame([("A", "Drug", "x"), ("B", "Drug", "x"), ("C", "Drug", "x"), ("D", "Drug", "y"), ("P", "Kinase", "x")], "name string, type_name string, sector string")
    labels = spark.createDataFrame([("A", "N", 0.5), ("B", "N", 0.7), ("C", "M", 1.0), ("D", "K", 1.0), ("Z", "N", 1.0)], "source_name string, target_name string, confidence double")
    rows = votes.fiber_lift(labels, objects)
    assert sorted(map(tuple, rows.collect())) == [("A", "M", 0.7), ("B", "M", 0.7), ("C", "N", 0.56)]
    # labels are grouped before they meet drugs: no join compares a drug with each label of its fiber
    assert "NOT (" not in rows._jdf.queryExecution().optimizedPlan().toString()
