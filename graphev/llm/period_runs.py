"""Periodic runs of words: stretches that repeat their first words again and again.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of
``min_words`` words and ``times`` periods at least, that no neighbouring word extends. Words are
[^\\x20\\x09-\\x0D]+ of the whole text, compared as they are.

Descending-LCP Kruskal. Two suffixes of a document that share their first l words become one
class when l is reached from above: the neighbours in the suffix array are united in the order of
decreasing LCP, with union-find over ordered sets of positions, the smaller set going into the
larger. Positions i < j that become neighbours in a set at level l share exactly l words; where
j - i <= l they seed a run of period j - i that ends at j + l. Every run's first two periods are
such a pair: a position between them in the same class would give the stretch a smaller period
(Fine and Wilf). For the same reason no seed has a period that is not the smallest. So a run's
start is the first seed with its period and end, and nothing has to be extended or compared again.

A run's first suffix pair shares ``least_lcp`` words (16 for 24 words and 3 periods), so classes
below that level are never built, and a document in which no stretch of so many words occurs twice
has no runs. That is told by hashes of all its stretches; a chance hit only costs time.

Spark deals the documents; one document is one task's work, about 200 bytes a word where something
repeats and 50 where nothing does. Null and empty texts have no words and no runs; their
collapsed text is empty. Each row stands for itself: repeated rows and rows with equal or null
doc_ids give one row each. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphev.llm.common import table

MIN_WORDS, TIMES = 24, 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Bytes of text after which a task hands on its rows.
BATCH_BYTES = 16 << 20
#: Odd multipliers of the stretches' hashes, one for each doubling.
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def least_lcp(min_words: int, times: int) -> int:
    """The fewest words that the first two suffixes of a wanted run share."""
    q = min_words // times  # up to this period the length decides, beyond it the number of periods
    return max(1, min(min_words - q, (times - 1) * (q + 1)))


def may_repeat(words: list[bytes], k: int) -> bool:
    """False only if no stretch of k words occurs twice. Stretches of the largest power of two in k."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    at = 1
    for m in MIX:
        if 2 * at > k or len(h) <= at:
            break
        h = h[:-at] * m + (h[at:] ^ (h[at:] >> np.uint64(29)))
        at *= 2
    h = np.sort(h)
    return bool((h[1:] == h[:-1]).any())


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and their ranks, by doubling."""
    n, at = len(ids), 1
    rank = ids.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:-at] = rank[at:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if rank[order[-1]] == n - 1:
            return order, rank
        at *= 2


def neighbour_lcp(ids: list[int], order: list[int], rank: list[int]) -> np.ndarray:
    """For each place in the order, the words shared with the suffix before it (0 for the first)."""
    n, shared, out = len(ids), 0, np.zeros(len(ids), np.int64)
    for i in range(n):
        if rank[i] == 0:
            shared = 0
            continue
        j = order[rank[i] - 1]
        most = n - max(i, j)
        while shared < most and ids[i + shared] == ids[j + shared]:
            shared += 1
        out[rank[i]] = shared
        shared = max(shared - 1, 0)
    return out


def seeds(order: list[int], lcp: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """(period, end) of every run of two periods or more that the levels from ``least`` up show: its start."""
    root, members, found = list(range(len(order))), {}, {}
    at = np.flatnonzero(lcp >= least)
    at = at[np.argsort(-lcp[at], kind="stable")]

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for place, level in zip(at.tolist(), lcp[at].tolist()):
        a, b = top(order[place - 1]), top(order[place])
        one, two = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(one) < len(two):
            a, b, one, two = b, a, two, one
        for k, x in enumerate(two):
            i = bisect_left(one, x)
            if i and (k == 0 or one[i - 1] > two[k - 1]) and x - one[i - 1] <= level:
                end = (x - one[i - 1], x + level)
                found[end] = min(found.get(end, x), one[i - 1])
            if i < len(one) and (k + 1 == len(two) or one[i] < two[k + 1]) and one[i] - x <= level:
                end = (one[i] - x, one[i] + level)
                found[end] = min(found.get(end, x), x)
        if len(two) == 1:
            one.insert(bisect_left(one, two[0]), two[0])
        else:
            one += two
            one.sort()  # two rising stretches are merged in linear time
        root[b] = a
        members[a] = one
    return found


def find_runs(words: list[bytes], min_words: int = MIN_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    least = least_lcp(min_words, times)
    if len(words) < min_words or not may_repeat(words, least):
        return []
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    order, rank = suffix_array(np.array(ids))
    order = order.tolist()
    lcp = neighbour_lcp(ids, order, rank.tolist())
    runs = ((start, end - start, period) for (period, end), start in seeds(order, lcp, least).items())
    return sorted((s, n, q) for s, n, q in runs if n >= min_words and n >= times * q)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def word_runs(docs: DataFrame, min_words: int = MIN_WORDS, times: int = TIMES, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length, period; by start, then period),
    collapsed: the text without the repeats. ``prepare`` gives a document other words first."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            ids, kept, size = [], [], 0

            def made():
                n, runs, text = zip(*kept)
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in one] for one in runs], pa.list_(RUN))
                return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(n, pa.int64()), runs, pa.array(text, pa.large_binary()).view(pa.large_string()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                words = (text.as_py() or b"").split()  # for bytes: [\x20\x09-\x0D] only
                if prepare:
                    words = prepare(doc_id, words)
                runs = find_runs(words, min_words, times)
                ids.append(doc_id)
                kept.append((len(words), runs, collapse(words, runs)))
                size += len(kept[-1][2])
                if size > BATCH_BYTES:
                    yield made()
                    ids, kept, size = [], [], 0
            if kept:
                yield made()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query's documents: one in ten repeats a stretch from some word on."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    g, rest = divmod(zlib.crc32(b"%d" % doc_id), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_period_runs(spark, sf_dir: str) -> DataFrame:
    rows = word_runs(table(spark, sf_dir, "documents"), prepare=planted)
    # the first of the greatest exponents, compared as fractions; runs come by start, then period
    best = F.expr("reduce(runs, named_struct('start', cast(null as bigint), 'length', 0L, 'period', 1L), (x, r) -> if(r.length * x.period > x.length * r.period, r, x))")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
