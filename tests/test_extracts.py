"""Betti numbers against ranks by plain elimination; relational extracts on rows with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphev.operators import extract, homology


def plain_betti(edges, nodes):
    links = sorted({tuple(sorted(e)) for e in edges if e[0] != e[1]})
    ends = sorted({v for e in links for v in e} | set(nodes))

    def rank(columns):
        pivots, n = {}, 0
        for column in columns:
            now = set(column)
            while now and max(now) in pivots:
                now ^= pivots[max(now)]
            if now:
                pivots[max(now)] = now
                n += 1
        return n

    faces = [t for t in itertools.combinations(ends, 3) if all(e in set(links) for e in itertools.combinations(t, 2))]
    r1, r2 = rank([set(e) for e in links]), rank([set(itertools.combinations(t, 2)) for t in faces])
    b0 = len(ends) - r1
    return {"vertices": len(ends), "edges": len(links), "triangles": len(faces), "b0": b0, "cycle_rank": len(links) - len(ends) + b0, "b1": len(links) - r1 - r2}


@pytest.mark.parametrize("n,m", [(8, 20), (14, 40), (7, 0)])
def test_betti_numbers(spark, n, m):
    rng = random.Random(m)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    frame = spark.createDataFrame(edges, "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)] + [(None,)], "node int")
    assert homology.betti(frame, nodes) == plain_betti(edges, range(n + 2))
    if m == 20:
        assert homology.betti(frame) == plain_betti(edges, [])


def test_drift_of_groups_and_loops(spark):
    pairs = lambda *e: spark.createDataFrame(e, "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node int")
    square, path = ((1, 2), (2, 3), (3, 4), (4, 1)), ((1, 2), (2, 3), (3, 4))
    got = homology.drift(pairs(*path), pairs(*square)).first()
    assert (got.change, got.loop_change, got.anomaly, got.severity) == (0, 1, "loop_formation", "low")
    got = homology.drift(pairs(*square), pairs(*square, (1, 3))).first()
    assert (got.loops_before, got.loops_after, got.anomaly) == (1, 0, None) and got.severity == "low"
    # over the same nodes, lost edges split groups, where edges alone would seem to merge them
    got = homology.drift(pairs((1, 2), (2, 3), (5, 6)), pairs((1, 2)), nodes).first()
    assert (got.groups_before, got.groups_after, got.anomaly, got.severity) == (3, 5, "fragmentation", "low")
    assert homology.drift(pairs(*path), pairs(*path, (4, 5)), nodes).first().anomaly == "merging"


def test_names_lose_their_salts(spark):
    raw = ["IMATINIB MESYLATE", "  valproate disodium phosphate", "TENOFOVIR ALAFENAMIDE FUMARATE", "SODIUM", "ALPHA-BETA acid", "tenofovir disoproxil", None]
    got = spark.createDataFrame(list(enumerate(raw)), "i int, n string").select("i", extract.drug_name(F.col("n")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == ["Imatinib", "Valproate Disodium", "Tenofovir Alafenamide", "Sodium", "Alpha-Beta Acid", "Tenofovir", None]


def test_first_source_wins_in_any_order_of_rows(spark):
    kind = "drug string, target string, score double, rank struct<source: int, x: double>"
    rows = [("a", "t", 0.5, (1, -9.0)), ("a", "t", 0.7, (0, -1.0)), ("a", "t", 0.6, (0, -4.0)), ("a", "t", 0.4, (0, -4.0)), ("b", "t", 0.1, (1, -7.0))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        one = extract.first_wins(spark.createDataFrame(rows[:2], kind), spark.createDataFrame(rows[2:], kind))
        assert {tuple(r) for r in one.collect()} == {("a", "t", 0.4), ("b", "t", 0.1)}


def test_mechanisms_and_activities(spark):
    make = spark.createDataFrame
    molecules = make([(1, "C1", "ALPHA SODIUM", 4), (2, "C2", "BETA", 2), (3, "C3", None, 4), (4, "C4", "", 4)], "molregno int, chembl_id string, pref_name string, max_phase int")
    targets = make([(1, "T1", "Homo sapiens", "SINGLE PROTEIN"), (2, "T2", "Mus musculus", "SINGLE PROTEIN"), (3, "T3", "Homo sapiens", "PROTEIN FAMILY")], "tid int, target_id string, organism string, target_type string")
    parts = make([(1, 11), (2, 12), (3, 13)], "tid int, component_id int")
    names = make([(11, "EGFR", "GENE_SYMBOL"), (11, None, "GENE_SYMBOL"), (11, "P00533", "UNIPROT"), (12, "Egfr", "GENE_SYMBOL"), (13, "FAM", "GENE_SYMBOL")], "component_id int, synonym string, syn_type string")
    proteins = extract.single_proteins(targets, parts, names)
    assert [tuple(r) for r in proteins.collect()] == [(1, "T1", "EGFR")]
    docs = make([(7, 123, "10.1/x", "D7"), (8, None, "10.1/y", "D8"), (9, None, "", None)], "doc_id int, pubmed_id int, doi string, chembl_id string")
    mechanisms = make([(1, 1, 1, "EGFR inhibitor", "INHIBITOR"), (2, 2, 1, None, None), (3, 3, 1, "x", "y"), (4, 4, 1, "x", "y"), (5, 1, 2, "x", "y")], "mec_id int, molregno int, tid int, mechanism_of_action string, action_type string")
    refs = make([(1, 7), (1, 8), (2, 9)], "mec_id int, ref_id int")
    got = {(r.drug, r.target, r.score, r.moa, r.provenance) for r in extract.from_mechanisms(mechanisms, molecules, proteins, refs, docs, approved_only=False).collect()}
    assert got == {("Alpha", "EGFR", 1.0, "INHIBITOR: EGFR inhibitor", "PMID:123"), ("Alpha", "EGFR", 1.0, "INHIBITOR: EGFR inhibitor", "DOI:10.1/y"), ("Beta", "EGFR", 0.7, "unknown: unknown", "ChEMBL:C2")}
    assert extract.from_mechanisms(mechanisms, molecules, proteins, refs, docs).filter("drug = 'Beta'").count() == 0
    assays = make([(1, 1, "B", 9), (2, 1, "F", 9), (3, 1, "B", 7)], "assay_id int, tid int, assay_type string, confidence_score int")
    acts = make([(1, 1, 7, 8.0, "IC50"), (1, 1, 9, 5.9, "Ki"), (1, 2, 7, 9.0, "Ki"), (1, 3, 7, 9.0, "Ki"), (2, 1, 9, 7.25, None), (2, 1, 8, None, "Ki")], "molregno int, assay_id int, doc_id int, pchembl double, standard_type string")
    got = extract.from_activities(acts, assays, molecules, proteins, docs, approved_only=False)
    assert {(r.drug, round(r.score, 6), r.moa.split(".")[0], r.provenance) for r in got.collect()} == {("Alpha", 0.832, "IC50: pChEMBL=8", "PMID:123"), ("Beta", 0.679, "unknown: pChEMBL=7", "ChEMBL:C2")}
    edges = extract.edges_of(extract.first_wins(extract.from_mechanisms(mechanisms, molecules, proteins, refs, docs), got))
    assert {tuple(r) for r in edges.collect()} == {("Alpha", "EGFR", "inhibits", 1.0, "DOI:10.1/y"), ("Beta", "EGFR", "targets", 0.679, "ChEMBL:C2")}
