"""What large queries must not move or sort: held against plans and plain loops on small inputs."""

import re

from graphev.operators import more, paths, resample, vectors, views, votes

EDGE = "id string, name string, source_name string, target_name string, source_type string, target_type string, confidence double, created_at timestamp"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_edges_are_dealt_before_they_are_sorted(spark):
    import datetime as dt

    days = [dt.datetime(2000, 1, d) for d in (1, 2)]
    rows = [(f"{n}:s{i}->t{i % 3}", n, f"s{i}", f"t{i % 3}", "Drug", "Protein", c, d) for i in range(20) for n, c, d in (("activates", 0.1 + i / 100, days[i % 2]), ("inhibits", 0.5 + i / 100, days[i // 2 % 2]))]
    found = views.last_edges(spark.createDataFrame(rows, EDGE))
    plan = plan_of(found)
    want = {(r[2], r[3]): max((str(x[7]) + x[0], x[6], x[1]) for x in rows if x[2:4] == r[2:4])[1:] for r in rows}
    assert {(r.source_name, r.target_name): (r.confidence, r.name) for r in found.collect()} == want
    assert plan.rindex("Aggregate") < plan.index("Exchange"), plan  # no aggregate, so no sort, below the exchange


def test_a_bootstrap_moves_its_replicates_once(spark):
    scores = spark.createDataFrame([(i % 7 / 10, i % 3 == 0) for i in range(50)], "score double, label boolean")
    row = resample.bootstrap_auroc(scores, 20)
    plan = plan_of(row)
    again = resample.bootstrap_auroc(scores.repartition(3), 20).first()
    assert row.first() == again and again.replicates == 20 and again.low <= again.mean <= again.high
    assert plan.count("hashpartitioning(r") == 1 and "hashpartitioning(score" in plan
    assert resample.bootstrap_auroc(scores.filter("label"), 20).first().replicates == 0


LAST = "source_name string, target_name string, source_type string, target_type string, confidence double, name string"


def graph(spark):
    import random

    rng = random.Random(7)
    kinds = {"d": "Drug", "p": "Protein", "e": "Disease"}
    ends = [(f"{s}{i}", f"{t}{j}") for s, n, t, m in (("d", 4, "p", 7), ("p", 7, "p", 7), ("p", 7, "e", 3), ("e", 3, "p", 7)) for i in range(n) for j in range(m) if rng.random() < 0.4]
    rows = [(a, b, kinds[a[0]], kinds[b[0]], round(rng.uniform(0.1, 1), 4), "interacts_with") for a, b in ends]
    return rows, spark.createDataFrame(rows, LAST)


def test_paths_are_counted_without_being_made(spark):
    rows, last = graph(spark)
    found = paths.path_counts_by_steps(last)
    plan = plan_of(found)
    want = sorted(tuple(r) for r in paths.path_counts(paths.walks(last)).collect())
    assert any(r[2] == 3 and r[3] > 1 for r in want) and any(r[0] == r[1] for r in rows)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "sum(" in plan and paths.path_counts_by_steps(last.limit(0)).count() == 0


def test_peers_are_counted_by_lists(spark):
    rows, last = graph(spark)
    found = more.peer_layer(last)
    plan = plan_of(found)
    to = {a: {r[1] for r in rows if r[0] == a and r[3] == "Disease"} for a in {r[0] for r in rows}}
    want = {}
    for a, b, _, kind, *_ in rows:
        for e in to[a] & to.get(b, set()) if kind not in ("Drug", "Disease") else ():
            want[a, e] = want.get((a, e), 0) + 1
    assert {(r.protein, r.disease): (r.peers, r.score) for r in found.collect()} == {k: (n, round(min(1, 0.3 * n), 6)) for k, n in want.items()}
    assert "array_intersect" in plan


def test_family_classes_do_not_pair_what_is_asked_with_targets(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.4), (2, 2, 1.0)], "query_id long, vec_id long, similarity double")
    targets = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 9), ("b", 8)], "drug string, node long")
    labels = spark.createDataFrame([("b", "x"), ("c", "x"), ("b", "y")], "drug string, disease string")
    asked = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("a", "z"), ("c", "y")], "drug string, disease string")
    found = vectors.family_classes(pairs, targets, labels, asked, 0.8, 0.3)
    got = {(r.drug, r.disease): (r["class"], r.similarity) for r in found.collect()}
    assert got == {("a", "x"): ("Family Extrapolation", 0.9), ("b", "x"): ("Cross-Family Novel", 0.0), ("b", "y"): ("No Reference", 0.0), ("a", "z"): ("No Reference", 0.0), ("c", "y"): ("Cross-Family Novel", 0.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # no join on the drug alone but that of targets and labels: asked pairs wait until targets are grouped
    assert len(re.findall(r"Inner, \(drug#\d+ = drug#\d+\)", plan)) == 1, plan


def test_analogs_are_grouped_by_drug_and_code_only(spark):
    typed = spark.createDataFrame([("inhibits", "d1", "p1", "Drug"), ("inhibits", "d2", "p1", "Drug"), ("treats", "d2", "e1", "Drug")], "name string, source_name string, target_name string, source_type string")
    labels = spark.createDataFrame([("d2", "e1")], "source_name string, target_name string")
    found = votes.analogs(typed, labels)
    plan = plan_of(found)
    assert [tuple(r) for r in found.select("a", "t", "analogs", "relations", "targets").collect()] == [("d1", "e1", 1, 1, 1)]
    assert not any("keys=[a#" in line and "own#" in line for line in plan.split("\n"))


def test_patterns_do_not_pair_drugs_by_relation(spark):
    import random

    rng = random.Random(3)
    rows = {(n, f"d{i}", f"p{rng.randrange(40)}", "Drug") for i in range(25) for n in ("inhibits", "activates", "binds") for _ in range(3) if rng.random() < 0.5}
    rows |= {("treats", f"d{i}", f"e{i % 4}", "Drug") for i in range(0, 25, 2)} | {("treats", "d1", "e9", "Drug"), ("treats", "alone", "e9", "Drug"), ("only", "odd", "p1", "Drug"), ("treats", "d3", "e7", "Drug")}
    typed = spark.createDataFrame(sorted(rows), "name string, source_name string, target_name string, source_type string")
    labels = typed.filter("name = 'treats'").select("source_name", "target_name")
    found = votes.pattern_by_counts(typed, labels)
    want = sorted(tuple(r) for r in votes.pattern(votes.overlaps(typed), labels).collect())
    assert len(want) > 50 and sorted(tuple(r) for r in found.collect()) == want
    assert ("d3", "e7") not in {r[:2] for r in want}  # its only holder
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Inner, .*\(name#\d+ = name#\d+\)|Inner, .*\(t#\d+ = t#\d+\) AND NOT \(s#", plan), plan
    assert votes.pattern_by_counts(typed.limit(0), labels.limit(0)).count() == 0


def test_radius_triangles_move_cells_only(spark):
    import math
    import random

    from graphev.operators import homology

    rng = random.Random(3)
    at = {i: (round(rng.uniform(-3, 3), 4), round(rng.uniform(-3, 3), 4)) for i in range(40)} | {50: (0.0, 0.0), 51: (2.0, 0.0), 52: (2.0, 2.0)}
    cells = spark.createDataFrame([(i, x, y) for i, (x, y) in at.items()], "cell long, x double, y double")
    found = homology.radius_triangles(cells, 2.0)
    plan = plan_of(found)
    d = lambda a, b: math.dist(at[a], at[b])
    want = {(u, v, w): round(max(d(u, v), d(u, w), d(v, w)), 6) for u in at for v in at for w in at if u < v < w and max(d(u, v), d(u, w), d(v, w)) <= 2}
    assert {tuple(r)[:3]: r.filtration for r in found.collect()} == want and len(want) > 100
    assert plan.count("Join") == 1 and plan.rindex("Exchange") > plan.rindex("Generate explode(near"), plan


def test_the_axiom_makes_no_two_edge_paths(spark):
    rows, last = graph(spark)
    found = paths.composition_axiom(last)
    w = {(a, b): c for a, b, _, _, c, _ in rows if a != b}
    want = {(a, b, c, round(w[a, b] * w[b, c], 6), w[a, c]) for a, b in w for x, c in w if x == b and a != c and (a, c) in w and w[a, b] * w[b, c] > w[a, c] + 1e-9}
    assert {tuple(r) for r in found.collect()} == want and any(x[2][0] == "e" for x in want) and any(x[2][0] == "p" for x in want)
    plan = plan_of(found)
    assert "array_intersect" in plan and "array_position" in plan, plan
    assert paths.composition_axiom(last.limit(0)).count() == 0


def test_best_fillers_are_not_sorted(spark):
    edges = [("d1", "p2", "x", 0.5), ("d1", "p1", "y", 0.5), ("d1", "p1", "x", 0.5), ("d1", "p10", "x", 0.9), ("d2", "p2", "y", 0.3), ("d3", "p9", "x", 0.3)]
    ends = [("p1", "e1", "z", 0.8), ("p1", "e1", "x", 0.8), ("p2", "e1", "x", 0.8), ("p10", "e2", "z", 0.1), ("p1", "e2", "z", 0.00006), ("p2", "e2", "z", 0.1)]
    rows = [(a, b, "Drug", "Protein", w, n) for a, b, n, w in edges] + [(a, b, "Protein", "Disease", w, n) for a, b, n, w in ends]
    view = spark.createDataFrame(rows, LAST)
    found = paths.best_fillers_by_places(view)
    labels = spark.createDataFrame([], "source_name string, target_name string, confidence double")
    want = {tuple(r) for r in paths.best_fillers(paths.inner_horns(view, labels)).collect()}
    assert {tuple(r) for r in found.collect()} == want and ("d1", "e1", "p1", "x", "x", 0.4) in want and len(want) == 4
    plan = plan_of(found)
    assert "Window" not in plan.split("max(")[0] and "SortAggregate" not in plan, plan
    assert paths.best_fillers_by_places(view.limit(0)).count() == 0


def test_bridges_compare_bits(spark):
    import random

    rng = random.Random(5)
    sets = {f"{k}{i}": {e for e in range(70) if rng.random() < p} for k in "ok" for i, p in enumerate((0.05, 0.5, 0.9, 0.92, 0.95, 1.0, 0.01))}
    sets |= {"o7": {1, 2}, "k7": {1, 2, 3}, "k8": {64, 69}, "o8": {64, 69}}
    kind = {"o": "Oncogene", "k": "Kinase"}
    edges = [(n, f"e{e}", kind[n[0]], "Disease", 0.5, "x") if e % 2 else (f"e{e}", n, "Disease", kind[n[0]], 0.5, "x") for n, s in sets.items() for e in s]
    view = spark.createDataFrame(edges + edges[:9], LAST)
    found = votes.cross_type_bridge(view, least=0.6)
    plan = plan_of(found)
    like = {(a, b): len(s & t) / max(1, len(s | t)) for a, s in sets.items() for b, t in sets.items() if a[0] == "o" and b[0] == "k"}
    assert {(r.source, r.target): r.confidence for r in found.collect()} == {k: round(v, 6) for k, v in like.items() if v >= 0.6} and like["o7", "k7"] > 0.6
    assert "Aggregate" not in plan and "bit_count" in plan, plan  # pairs are not grouped
    assert votes.cross_type_bridge(view.limit(0)).count() == 0


def test_common_descendants_are_grouped_where_the_drug_is(spark):
    edges = [("d1", "p1"), ("d1", "p2"), ("d1", "p3"), ("d2", "p2"), ("d2", "p2")]
    others = [("p3", "p1"), ("p4", "p1"), ("p4", "p2"), ("p4", "p2"), ("p5", "p9"), ("p2", "e1")]
    rows = [(a, b, "Drug", "Protein", 0.5, "x") for a, b in edges] + [(a, b, "Protein", "Disease" if b[0] == "e" else "Protein", 0.5, "x") for a, b in others]
    found = votes.common_descendants(spark.createDataFrame(rows, LAST))
    plan = plan_of(found)
    assert sorted(tuple(r) for r in found.collect()) == [("d1", "p4", 0.5, 2), ("d2", "p4", 0.5, 1)]  # d1 leads to p3 itself
    assert "hashpartitioning(a#" in plan and not re.search(r"hashpartitioning\(a#\d+, b#", plan), plan


def test_what_is_stored_leaves_no_shuffle_behind(spark):
    import time

    from graphev.functions import shared
    from graphev.plans import catalog

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "/shuffle_" in f}

    was = files()
    rows = spark.range(1000).selectExpr("id * 7 % 13 AS k", "id").groupBy("k").agg({"id": "sum"})
    a, b = shared.stored(rows, "rows"), shared.saved(rows)
    for _ in range(50):  # files go in the background
        if not files() - was:
            break
        time.sleep(0.2)
    assert not files() - was
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 13
    made = {}
    catalog.frame(spark, "/root/testdata/sf0.001", "votes", made)
    assert all("parquet" in plan_of(made[n]).lower() and "Exchange" not in plan_of(made[n]) for n in ("d1_composition", "d2_pathway_support"))


def test_edges_by_kind_are_the_typed_edges(spark):
    import datetime as dt
    import random

    from graphev.plans import catalog
    from graphev.sources import starmap

    rng, day = random.Random(4), lambda k: None if k == 0 else dt.datetime(1995, 1, 1) + dt.timedelta(days=k % 3, microseconds=k % 2 * 500_000)
    pick = lambda *x: rng.choice(x)
    rows = {
        "lineitem": ([(pick(1, 2, 3, 4, None), pick(1, 2, 3, 9, None), pick(1, 2, 8, None), rng.randrange(4), rng.randrange(11) / 100, rng.randrange(9) / 100, pick("A", "N", "R", "Z", None), pick("F", "O", "P", None), day(rng.randrange(9))) for _ in range(400)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": ([(k, pick(1, 2, 3, None), pick("A", "O", "OO", "P", "Q", None), day(k), pick("1-X", "2-X", "5-X", None)) for k in (1, 2, 3, 3, 5)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(1, 0), (2, 1), (3, 1), (3, None)], "c_custkey long, c_nationkey int"),
        "supplier": ([(1, 0, 5.0), (1, 0, -5.0), (2, 1, -1.0), (7, 6, 0.0), (3, None, None)], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "part": ([(1, "LARGE", 1, 2.0, "b"), (2, "PROMO", 1, 2.0, "b"), (2, "SMALL", 1, 2.0, "b"), (3, None, 1, 2.0, "b")], "p_partkey long, p_type string, p_size int, p_retailprice double, p_brand string"),
        "nation": ([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
    }
    made = {name: spark.createDataFrame(*x) for name, x in rows.items()}
    typed = views.TYPED(starmap.OBJECTS(*(made[t] for t in ("supplier", "part", "nation"))), starmap.MORPHISMS(*(made[t] for t in starmap.MORPHISMS.inputs)))
    kinds = [kind(*(made[t] for t in kind.inputs)) for kind in starmap.KINDS.values()]
    of = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    strict = views.strict_view(typed)
    assert of(starmap.TYPED_EDGES(*kinds)) == of(typed) and typed.count() > 60
    assert of(starmap.STRICT_EDGES(*kinds)) == of(strict)
    untyped = [kind(*(made[t] for t in kind.inputs)) for kind in starmap.UNTYPED.values()]
    assert of(starmap.EVERY_EDGE(*untyped)) == of(starmap.MORPHISMS(*(made[t] for t in starmap.MORPHISMS.inputs)))
    # flags that mean one relation leave two edges of one id; of those of one time either is the last
    of_flags = lambda df: of(df.filter("name <> 'modulates' OR name IS NULL"))
    assert of_flags(starmap.LAST_EDGES(*kinds)) == of_flags(views.last_edges(strict)) and starmap.LAST_EDGES(*kinds).count() == views.last_edges(strict).count()
    assert of(starmap.LABELS(kinds[-1])) == of(typed.filter("name = 'treats'").select("source_name", "target_name", "confidence")) != []
    # labels make no other edges, and the views are read from the kinds' files without another exchange
    assert catalog.OTHERWISE["b12_positive_labels"][1] == catalog.OTHERWISE["labels_"][1] == ("treat_edges",)
    assert "Exchange" not in plan_of(catalog.frame(spark, "/root/testdata/sf0.001", "last"))


def test_best_chains_sort_only_what_can_lead(spark):
    import random

    rng = random.Random(9)
    rows = [(f"d{i % 3}", f"p{rng.randrange(60)}", f"e{rng.randrange(4)}", rng.choice("xy"), rng.choice("xy"), rng.choice([None, 0.1, 0.2, 0.9, 0.9, rng.random()])) for i in range(900)]
    rows += [("d9", "p1", "e1", "x", n, 0.5 + k / 10) for k, n in enumerate("xyz")] + [("d8", "p1", "e1", "x", "x", 0.5)] * 2
    horns = spark.createDataFrame(rows, "a string, b string, c string, f_name string, g_name string, composite double")
    of = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    for most in (1, 3, 30):
        want = of(more._best_chains(horns, most=most))
        assert of(more.best_chains(horns, most=most)) == want and len(want) > 12
    led = more._leading(horns, 3)
    assert led.count() < 300 and {r.a for r in led.collect()} >= {"d8", "d9"}  # pairs with few intermediates are whole


def test_path_counts_store_their_steps(spark):
    rows, last = graph(spark)
    plan = plan_of(paths.path_counts_by_steps(last))
    # chains are opened by the jobs before: what is left reads their counts
    assert "inhibits" not in plan and plan.count("Generate") == 1 and plan.lower().count("scan parquet") >= 2, plan


def test_best_paths_keep_one_group_of_sources_at_a_time(spark):
    import os

    from graphev.functions import shared
    from graphev.operators import routes

    rows, last = graph(spark)
    edges = last.selectExpr("source_name s", "target_name t", "confidence w")
    sources, ends = (last.filter(f"{x}").selectExpr(f"{c}_name AS {n}") for x, c, n in (("source_type = 'Drug'", "source", "source"), ("target_type = 'Disease'", "target", "target")))
    of = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    folder = shared.shared_dir(spark).removeprefix("file:")
    labels = lambda: {f for f in os.listdir(folder) if f.startswith("labels-")}
    was = labels()
    whole = routes.best_paths(edges, sources, max_edges=4)
    assert len(labels() - was) == 1  # the last round's are the result
    apart = routes.best_paths(edges, sources, max_edges=4, at_once=20)
    assert of(apart) == of(whole) and len(of(whole)) > 20
    some = labels()
    to = routes.best_paths(edges.selectExpr("s", "t", "1 - w AS w"), sources, ends, 4, routes.SUM, at_once=20)
    assert labels() == some
    assert of(to) == of(routes.best_paths(edges.selectExpr("s", "t", "1 - w AS w"), sources, None, 4, routes.SUM).join(ends.distinct(), "target", "left_semi").select(to.columns))
