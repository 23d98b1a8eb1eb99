"""Periodic runs against every stretch and period, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphev.llm import period_runs as pr


def brute(words, least, times):
    """All runs by definition: stretches of each period that cannot be longer, with their smallest period."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), st.integers(1, 9), st.integers(0, 60), st.sampled_from([(24, 3), (4, 2), (6, 3), (2, 2), (9, 4)]))
def test_runs_are_those_of_the_definition(words, p, a, rule):
    words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words)) if a + (i - a) % p < len(words)]
    assert pr.find_runs(words, *rule) == brute(words, *rule)


def test_runs_that_overlap_meet_or_nest():
    ab, abc = [b"a", b"b"] * 20, [b"a", b"b", b"c"] * 12
    for words in (ab + abc, abc + ab, [*ab, b"x", *ab, b"x", *ab, b"x"], [b"a"] * 23, [b"a"] * 24, [b"a"] * 71 + ab, (ab + [b"q"]) * 4):
        assert pr.find_runs(words) == brute(words, 24, 3)


def test_one_word_repeated_very_often():
    assert pr.find_runs([b"w"] * 200_000) == [(0, 200_000, 1)]


def test_collapse_keeps_the_first_period():
    words = [b"x", *[b"a", b"b", b"c"] * 10, b"y"]
    assert pr.collapse(words, pr.find_runs(words)) == b"x a b c y"
    assert pr.collapse([], []) == b""


ROWS = [(1, "one two three"), (2, None), (3, ""), (4, " \t\n"), (None, "a b " * 20), (5, "a b\t" * 20), (5, "a b\t" * 20), (6, "x " + "u v w " * 30 + "end"), (7, "Ä ä " * 13), (8, "w " * 50_000)]


def test_operator_gives_a_row_for_a_row(spark):
    docs = spark.createDataFrame([(a, b, 7, "r") for a, b in ROWS], "doc_id long, text string, n_words int, runs string")
    got = sorted((tuple(r) for r in pr.word_runs(docs).collect()), key=repr)
    want = []
    for doc_id, text in ROWS:
        words = (text or "").encode().split()
        runs = brute(words[:200], 24, 3) if len(words) < 200 else [(0, len(words), 1)]
        want.append((doc_id, len(words), runs, pr.collapse(words, runs).decode()))
    assert [(a, b, [tuple(r) for r in c], d) for a, b, c, d in got] == sorted(want, key=repr)
    none = pr.word_runs(docs.filter("doc_id > 99"))
    assert none.columns == ["doc_id", "n_words", "runs", "collapsed"] and none.count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_query_on_a_small_table(spark, tmp_path, empty):
    rng = random.Random(5)
    rows = [] if empty else [*ROWS, *[(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 300)))) for i in range(150)]]
    spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, start string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        words = pr.planted(doc_id, (text or "").encode().split())
        runs = pr.find_runs(words) if len(words) > 400 else brute(words, 24, 3)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(said.encode()), sha(pr.collapse(words, runs))))
    got = [tuple(r) for r in pr.op13_period_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert empty or sum(r[1] > 0 for r in want) > 10
