"""Search over small records: all words, rank, snippets, and records or queries without words."""

import math

from graphev.operators import search


def test_and_queries_rank_and_snippets(spark):
    body = {1: "Alpha beta, gamma.", 2: "x " * 30 + "beta alpha x alpha " + "y " * 40, 3: "alpha", 4: None, 5: "", 6: "ALPHA BETA gamma", 7: "beta beta beta"}
    records = spark.createDataFrame([(k, v, 9) for k, v in body.items()], "id int, body string, k int").select("id", "body")
    queries = spark.createDataFrame([("q", "beta Alpha alpha!"), ("none", "..."), ("null", None), ("odd", "alpha zebra"), ("one", "gamma")], "query string, text string")
    rows = search.search(search.postings(records), records, queries).orderBy("query", "k").collect()
    lengths = {1: 3, 2: 74, 3: 1, 6: 3, 7: 3}
    mean, n = sum(lengths.values()) / 5, 5
    part = lambda df, tf, length: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    want = {1: part(4, 1, 3) * 2, 6: part(4, 1, 3) * 2, 2: part(4, 2, 74) + part(4, 1, 74)}
    got = {r.id: r.score for r in rows if r.query == "q"}
    assert got == {k: round(v, 6) for k, v in want.items()}
    assert [r.id for r in rows if r.query == "q"] == sorted(got, key=lambda k: (-got[k], k)) and {r.query for r in rows} == {"q", "one"}
    shown = {r.id: r.snippet for r in rows if r.query == "q"}
    assert shown[1] == "[Alpha] [beta] gamma" and shown[2] == "...[beta] [alpha] x [alpha] " + " ".join("y" * 20) + "..."
    assert search.search(search.postings(records), records, queries, limit=1).filter("query = 'q'").count() == 1
    assert search.search(search.postings(records.filter("id > 9")), records, queries).count() == 0
