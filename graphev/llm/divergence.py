"""Source divergence audit: how far each source's use of words is from every other source of its
language, and by which words, over hash-consed segment trees of term counts.

Terms are stretches of ASCII letters and of characters from U+0080 on, A-Z lower-cased. A language
keeps the V terms that at least ``min_docs`` of its documents (rows) hold. A group (lang, source)
gives each kept term p = 1 + floor(10^9 (count + 1) / (N + V)), N being its count of kept terms;
a language does the same with all its documents. The price of p against q is floor((p - q)^2 / q).

Segment trees. A language's kept terms are numbered, frequent ones first. A group's counts over the
numbers are the leaves of a segment tree, whose nodes are hash-consed: a node is its pair of
children, and equal pairs of children are one node, in whichever groups and places they stand, so
that the long stretches of rare terms, which most groups have not or have once, are few nodes. Two
groups' trees are walked together from their roots. Of each level the walk keeps each pair of nodes
once, with the number of places where the two stand opposite each other, so equal pairs are priced
once for two groups (the price depends on the two groups' N). Numbers are cut into blocks of
``BLOCK`` terms, which are the trees' lower parts: a task builds one block's nodes for all groups
of the language and walks all pairs of groups, and the trees' upper parts are Spark's sum of the
blocks. A block holds at most BLOCK counts for a group, whatever the language's share of the rows,
and its walks take at most ``STATES`` node pairs at once.

Counts are exact: shares are computed in 64 bits, beyond 9 * 10^9 occurrences in whole numbers of
any size.

Null text, lang and source count as ''. Repeated rows are documents of their own. Groups whose texts
have no terms take part; with V = 0 all prices are 0. A group without other sources has no pairs. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphev.llm.common import saved, table
from graphev.llm.sharding import numbered

SCALE = 1_000_000_000
MIN_DOCS, TOP_TERMS = 3, 200
BLOCK, STATES = 1 << 10, 1 << 20
#: Distinct terms of groups that a task counts before it hands them on, and bytes of one text cut.
HELD, SLICE = 400_000, 1 << 22
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes):
    """Lists of the terms of a text, in slices that end between terms (a longer term ends them)."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        part = text[at:end].translate(LETTERS)
        if end < len(text):
            cut = part.rfind(b" ")
            part, end = (part[:cut], at + cut) if cut >= 0 else (text[at:].translate(LETTERS), len(text))
        yield part.split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed in parts as tasks read; each
    group also has a row whose term is null."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def made():
            cols = [[], [], [], [], []]
            for (lang, source), (n, in_docs) in held.items():
                k = len(n) + 1
                for col, values in zip(cols, ([lang] * k, [source] * k, [None, *n], [0, *n.values()], [0, *(in_docs[t] for t in n)])):
                    col += values
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds)]
            arrays[2] = arrays[2].view(pa.string())
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in terms_of(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                in_docs.update(seen)
                size += len(n) - before
                if size > HELD:
                    yield made()
                    held, size = {}, 0
        if held:
            yield made()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*text).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, of: str):
    """1 + floor(10^9 (n + 1) / of), exactly."""
    return F.expr(f"1 + cast({SCALE} as decimal(11, 0)) * cast({n} + 1 as decimal(20, 0)) div {of}")


def shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    if n.size and n.max() >= 9 * 10**9:
        n, of = n.astype(object), of.astype(object)
    return (1 + SCALE * (n + 1) // of).astype(np.int64)


def consed(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """counts: one row per group, a power of two wide -> the leaves' counts, the levels from the leaves
    up as (left, right) children of each node, and each row's root."""
    leaves, node = np.unique(counts, return_inverse=True)
    node, levels = node.reshape(counts.shape), []
    while node.shape[1] > 1:
        span = int(node.max()) + 1
        kinds, above = np.unique(node[:, ::2] * span + node[:, 1::2], return_inverse=True)
        levels.append((kinds // span, kinds % span))
        node = above.reshape(len(node), -1)
    return leaves, levels, node[:, 0]


def walk(tree, of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows (a, b) of a tree: the summed price of a against b, and of b against a."""
    leaves, levels, roots = tree
    pair, x, y, times = np.arange(len(a)), roots[a], roots[b], np.ones(len(a), np.int64)
    for left, right in reversed(levels):
        x, y = np.concatenate((left[x], right[x])), np.concatenate((left[y], right[y]))
        span = int(max(x.max(), y.max())) + 1
        key = (np.concatenate((pair, pair)) * span + x) * span + y
        key, at = np.unique(key, return_inverse=True)
        times = np.bincount(at, weights=np.concatenate((times, times))).astype(np.int64)  # under 2^53
        pair, x, y = key // span // span, key // span % span, key % span
    there = leaves[x] >= 0  # the places beyond the block's last term are empty in all rows
    pair, x, y, times = pair[there], leaves[x[there]], leaves[y[there]], times[there]
    p, q = shares(x, of[a[pair]]), shares(y, of[b[pair]])
    gap = (p - q) ** 2
    ab, ba = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    np.add.at(ab, pair, gap // q * times)
    np.add.at(ba, pair, gap // p * times)
    return ab, ba


def price_block(part: pd.DataFrame) -> pd.DataFrame:
    """One block of one language: rows (lang, source, of, at, n), at being the term's number, null in
    the one row that each group has in each block."""
    lang, groups = part["lang"].iloc[0], part[part["at"].isna()].sort_values("source")
    sources, of = groups["source"].to_numpy(), groups["of"].to_numpy(np.int64)
    rows = part[part["at"].notna()]
    row = np.searchsorted(sources, rows["source"].to_numpy()) if len(rows) else np.zeros(0, int)
    kinds, col = np.unique(rows["at"].to_numpy(np.int64), return_inverse=True)
    counts = np.full((len(sources), 1 << max(0, len(kinds) - 1).bit_length()), -1, np.int64)
    counts[:, : len(kinds)] = 0
    counts[row, col] = rows["n"].to_numpy(np.int64)
    tree, out = consed(counts), []
    one, two = np.triu_indices(len(sources), 1)
    step = max(1, STATES // counts.shape[1])
    for k in range(0, len(one), step):
        a, b = one[k : k + step], two[k : k + step]
        ab, ba = walk(tree, of, a, b)
        out += [(sources[a], sources[b], ab), (sources[b], sources[a], ba)]
    if not out:
        return pd.DataFrame({"lang": [lang], "source": [lang], "item": [lang], "value": [0]}).iloc[:0]
    source, item, value = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"lang": lang, "source": source, "item": item, "value": value})


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: item is each other source of the language,
    value the price of source against it over all kept terms. Part ``term``: item is each kept term
    that the group holds with a larger share than its language, value its price against the
    language's share, the first ``top_terms`` of them. Ranks count from 1 in each group and part, by
    value from above, then item."""
    counts = saved(term_counts(docs))
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept, _ = numbered(kept.select("lang", "term", "lang_n"), ["lang", F.desc("lang_n"), "term"], "at")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"), F.min("at").alias("first"), F.max("at").alias("last"))
    rows = saved(counts.filter("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = saved(groups.select("lang", "source", (F.coalesce("total", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("of"), (F.col("lang_total") + F.col("v")).alias("lang_of"), *[F.coalesce(F.expr(f"{c} div {BLOCK}"), F.lit(0)).alias(c) for c in ("first", "last")]))

    named = rows.join(groups.select("lang", "source", "of", "lang_of"), ["lang", "source"])
    places = groups.select("lang", F.explode(F.sequence("first", "last")).alias("block"), "source", "of", F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    leaves = named.select("lang", F.expr(f"at div {BLOCK}").alias("block"), "source", "of", "at", "n")
    prices = places.unionByName(leaves).groupBy("lang", "block").applyInPandas(price_block, "lang string, source string, item string, value long")
    pairs = prices.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    terms = named.withColumns({"p": share("n", "of"), "q": share("lang_n", "lang_of")}).filter("n > 0 and p > q")
    terms = terms.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top_terms))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
