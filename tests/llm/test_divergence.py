"""Source divergence against plain sums over every term, with nulls, empty texts, ties, repeats and clashing columns."""

import collections
import random
import re

import numpy as np
import pytest

from graphev.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def brute(rows, min_docs=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        terms = TERM.findall(lower(text))
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for (g, t), k in docs.items() if g == lang and k >= min_docs)
        sources = {r[1] for r in rows if r[0] == lang}
        share = lambda n: {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}
        n_of = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        p_of = {s: share(n_of[s]) for s in sources}
        all_p = share({t: sum(n_of[s][t] for s in sources) for t in kept})
        price = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(-sum(price(p_of[s][t], p_of[x][t]) for t in kept), x.encode()) for x in sources if x != s]
            terms = [(-price(p_of[s][t], all_p[t]), t.encode()) for t in kept if n_of[s][t] and p_of[s][t] > all_p[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


WORDS = ["Alpha", "beta", "BETA", "Éa", "éa", "x1y", "naïve", "漢字", "z", "don't", "ÀB", "under_score"]


def some_rows(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", "é", None]), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))) for _ in range(n)]
    return [*rows, ("en", "silent", None), ("en", "silent", ""), ("en", "digits", "1 2 3 _ - 4"), ("fr", "a", "only once"), ("fr", "b", "seen twice twice"), ("nl", "alone", "one one"), rows[0], rows[0], ("en", "long", "Alpha " * 5000 + "w" * 300)]


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_all_groups_against_plain_sums(spark, monkeypatch, block):
    monkeypatch.setattr(dv, "BLOCK", block)
    rows = some_rows(150)
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, source string, text string, rank int, part string").repartition(3)
    got = sorted(tuple(r) for r in dv.source_divergence(docs).collect())
    assert got == brute(rows)
    assert sorted(tuple(r) for r in dv.source_divergence(docs, 1, 2).collect()) == brute(rows, 1, 2)
    none = dv.source_divergence(docs.filter("lang = 'xx'"))
    assert none.columns == ["lang", "source", "part", "item", "value", "rank"] and none.count() == 0


def test_query_reads_the_whole_table(spark, tmp_path):
    rows = some_rows(60, 2)
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in dv.op11_source_divergence(spark, str(tmp_path)).collect()) == brute(rows)


def test_equal_subtrees_are_one_node():
    counts = np.array([[0, 0, 0, 0, 5, 1, 0, 0], [5, 1, 0, 0, 0, 0, 0, 0]])
    leaves, levels, roots = dv.consed(counts)
    assert leaves.tolist() == [0, 1, 5] and [len(left) for left, _ in levels] == [2, 2, 2] and roots[0] != roots[1]


def test_walk_in_blocks_of_pairs_and_large_counts(monkeypatch):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (5, 64)) * rng.integers(0, 2**40, (5, 64))
    of = counts.sum(1) + 64
    a, b = np.triu_indices(5, 1)
    ab, ba = dv.walk(dv.consed(counts), of, a, b)
    p = [[1 + 10**9 * (int(n) + 1) // int(of[g]) for n in counts[g]] for g in range(5)]
    for i, j, x, y in zip(a, b, ab, ba):
        assert x == sum((u - v) ** 2 // v for u, v in zip(p[i], p[j])) and y == sum((u - v) ** 2 // u for u, v in zip(p[i], p[j]))


def test_slices_cut_between_terms(monkeypatch):
    text = " ".join(random.Random(3).choice(WORDS) for _ in range(500)).encode()
    whole = [t for part in dv.terms_of(text) for t in part]
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(dv, "SLICE", size)
        assert [t for part in dv.terms_of(text) for t in part] == whole
