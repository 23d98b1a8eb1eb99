"""SimHash near-dedup with pigeonring filtering.

Fingerprints: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of ``k`` words with their
repeats; a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42). Fingerprints link
at ``RADIUS`` or fewer differing bits.

Links are sought between distinct fingerprints only. Cut a fingerprint into 4 segments of 16 bits
on a ring. If two differ in 3 bits at most, then some segment starts a chain whose first l
segments differ in at most 3l/4 bits for every l: 0 in the first, 1 in the first two, 2 in the
first three, 3 in all. The first two conditions together are one join key of 32 bits: the first
segment as it is, and the second once as it is and once with each of its zero bits set, so that
of a pair with one differing bit exactly one side finds the other. The third condition prunes what
the join yields, and then the full distance decides. Nothing is capped; copies never form pairs.

Empty and null texts have fingerprint 0 and are linked like any other. Null doc_ids take part; a
component's id is its smallest doc_id, null only if it has none. Repeated rows are copies. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphev.llm.common import hash128, saved, table
from graphev.llm.decontaminate import BLOOM_MOST, bloom, maybe_in
from graphev.operators.components import components

RADIUS = 3
SHINGLES_AT_ONCE = 1 << 15


def simhash(text: bytes, k: int) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.lower().split()  # for bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return 0
    if len(words) < k:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(k))))
    digest, total, n = xxhash.xxh64_digest, np.zeros(64, np.int64), 0
    while part := [digest(s, 42) for s, _ in zip(shingles, range(SHINGLES_AT_ONCE))]:
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of docs."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [simhash(t.as_py() or b"", k) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def turned(c: str, bits: str) -> Column:
    """c rotated to the left by a number of bits under 64."""
    return F.expr(f"shiftleft({c}, {bits}) | shiftrightunsigned({c}, 64 - {bits})")


def close_pairs(fps: DataFrame) -> DataFrame:
    """fps: distinct fp -> all pairs (a, b) at RADIUS or less, each at least once."""
    ring = fps.select("fp", F.explode(F.array(*[F.lit(16 * i) for i in range(4)])).alias("at")).withColumn("t", turned("fp", "at"))
    ring = ring.select("fp", "at", F.shiftrightunsigned("t", 32).alias("head"))
    key = "at * 268435456L + {}"  # 16 * i * 2^28 = i * 2^32
    probe = ring.select("fp", F.expr(key.format("head")).alias("key"))
    near = F.expr("concat(array(head), transform(filter(sequence(0, 15), j -> (shiftrightunsigned(head, j) & 1L) = 0), j -> head | shiftleft(1L, j)))")
    index = ring.select(F.col("fp").alias("other"), "at", "head", F.explode(near).alias("h"))
    index = index.select("other", "at", (F.col("h") == F.col("head")).alias("same"), F.expr(key.format("h")).alias("key"))
    found = probe.hint("merge").join(index.hint("merge"), "key").filter("fp <> other and (not same or fp < other)")
    found = found.withColumn("x", F.col("fp").bitwiseXOR(F.col("other"))).withColumn("x", turned("x", "at"))
    found = found.filter(F.bit_count(F.shiftrightunsigned("x", 16)) <= 2).filter(F.bit_count("x") <= RADIUS)
    return found.select(F.col("fp").alias("a"), F.col("other").alias("b"))


def simhash_groups(docs: DataFrame, k: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id."""
    rows = saved(with_fingerprints(docs, k))
    reps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(close_pairs(reps.select("fp")))
    named = saved(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "root"), "fp").join(ids, "root").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


# --- near copies by similarity, for filtering a corpus -------------------------------------------

PRINTS, SIMILAR_WORDS, SIMILARITY = 2, 5, 0.8
#: Bits of a parity sketch: for up to 200 shingles, for each more, and at most.
SKETCH_LEAST, SKETCH_PER, SKETCH_MOST = 128, 0.64, 1 << 13
FACTS = ("prints", "sketch", "p", "q", "n")


def word_prints(text: bytes) -> list[int]:
    """PRINTS SimHashes of the distinct words, each with hashes of its own."""
    words = set(text.lower().split())
    if not words:
        return [0] * PRINTS
    raw = b"".join(map(xxhash.xxh3_128_digest, words))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(words), 16), axis=1).sum(axis=0, dtype=np.int64)
    return np.frombuffer(np.packbits(bits * 2 > len(words)).tobytes(), ">i8").tolist()


def word_shingles(text: Column) -> Column:
    """The set of hashed shingles of SIMILAR_WORDS words; of fewer words, the whole sequence."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    k = SIMILAR_WORDS
    many = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    sets = lambda h: F.when(F.size(h) < k, F.array(F.xxhash64(h))).otherwise(many(h))
    return F.array_distinct(F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), sets), F.lit(0)))


def text_class(text: Column) -> Column:
    return F.struct(*[h.alias(n) for n, h in zip(("c0", "c1"), hash128(F.coalesce(text, F.lit(""))))])


CLASS = "class struct<c0:bigint,c1:bigint>"
#: About how many texts are read for the common shingles, the number of these texts that makes a
#: shingle common, and the most that are kept. They only decide the order of shingles.
SAMPLED, COMMON, COMMON_MOST = 20_000, 5, 50_000
LOW = -(1 << 63) + 3 * (1 << 64) // 10
SEEN_MOST = 1 << 18
#: From this number of texts on, those that share a shingle of their prefixes meet with their whole sketches.
HOT = 32


def shingle_numbers(text: bytes) -> np.ndarray:
    """word_shingles of a lower-cased text with hashes of its own, sorted."""
    words = text.split()
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    k = min(SIMILAR_WORDS, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def sketch(s: np.ndarray) -> list[int]:
    """Each bit is the parity of the number of shingles that fall on it. Sets that differ in d
    shingles have sketches that differ in d bits at most."""
    size = SKETCH_LEAST
    while size < min(SKETCH_PER * len(s), SKETCH_MOST):
        size *= 2
    odd = np.bincount(s & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(longs: np.ndarray) -> list[int]:
    """The sketch's smallest form, two numbers."""
    return np.bitwise_xor.reduce(longs.reshape(-1, 2), axis=0).tolist()


def may_be_alike(x: Column, y: Column, n: Column, m: Column, similarity: float) -> Column:
    """False only if sets of n and m shingles with the sketches x and y have a Jaccard under
    similarity: their sizes or their sketches differ by too much. Of sketches of different sizes
    the larger one is folded."""
    half = lambda c: F.transform(F.sequence(F.lit(0), (F.size(c) / 2 - 1).cast("int")), lambda i: F.get(c, i).bitwiseXOR(F.get(c, i + (F.size(c) / 2).cast("int"))))
    differ = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k)
    bits = F.when(F.size(x) == F.size(y), differ(x, y)).when(F.size(x) > F.size(y), differ(half(x), y)).otherwise(differ(x, half(y)))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (bits <= most_apart(n, m, similarity))


def most_apart(n: Column, m: Column, similarity: float) -> Column:
    """How many elements are in one only of two sets of n and m with a Jaccard of similarity."""
    return (1 - similarity) / (1 + similarity) * (n + m) + 1e-6


def of_texts(texts: DataFrame, make, kind: str) -> DataFrame:
    """texts: class, text -> c0, half of the class, and what make gives for the text; a task gives a text's rows once
    unless it meets more than SEEN_MOST others in between."""

    def run(batches):
        seen = set()
        for batch in batches:
            c0, c1 = (batch.column(0).field(i).to_numpy() for i in (0, 1))
            new = []
            for i, c in enumerate(zip(c0.tolist(), c1.tolist())):
                if c not in seen:
                    seen.add(c)
                    new.append(i)
            if len(seen) > SEEN_MOST:
                seen.clear()
            made = [make(shingle_numbers(t.as_py())) for t in batch.column(1).cast(pa.large_binary()).take(pa.array(new, pa.int64()))]
            if not made:
                continue
            at = np.repeat(np.array(new), [len(m[0]) for m in made])
            columns = [pa.array(c0[at]), *[pa.array(np.concatenate(c)) for c in zip(*made)]]
            for start in range(0, len(at), SHINGLES_AT_ONCE):
                part = [c.slice(start, SHINGLES_AT_ONCE) for c in columns]
                yield pa.RecordBatch.from_arrays(part, names=["c0", *[c.split()[0] for c in kind.split(", ")]])

    return texts.select("class", F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, f"c0 bigint, {kind}")


def common_shingles(texts: DataFrame, n: int) -> np.ndarray:
    """The most common shingles of a sample of n texts, sorted; only of those that prefixes reach,
    the ones with hashes under LOW."""
    part = texts.filter(F.pmod(F.col("class.c1"), F.lit(max(1, n // SAMPLED))) == 0)
    rows = of_texts(part, lambda s: [s[s < LOW]], "s long").groupBy("s").count().filter(F.col("count") >= COMMON)
    return np.sort(np.array([r.s for r in rows.orderBy(F.desc("count"), "s").limit(COMMON_MOST).collect()], np.int64))


def prefixes(texts: DataFrame, common: np.ndarray, similarity: float) -> DataFrame:
    """(c0, s, i): of a text's n shingles the first ones, in an order that is the same for all
    texts, with their places i. Common shingles come last, others go by their hash. Sets of n and m
    shingles with a Jaccard of at least ``similarity`` have similarity * max(n, m) in common, so that
    one of these is among the first n - similarity * n + 1 of both."""

    def make(s):
        if len(common):
            last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
            s = np.concatenate([s[~last], s[last]])
        n = len(s)
        k = n - int(np.ceil(similarity * n - 1e-6)) + 1
        return [s[:k], np.arange(k, dtype=np.int32)]

    return of_texts(texts, make, "s long, i int")


def rest_pairs(shared: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of texts in different groups that share a shingle of shared (c0, s, i) and
    that sizes, places and sketches do not rule out. facts: class, root, n, sketch, and the sketch's
    smallest form, p and q, which rules most of them out before pairs are moved. On the way texts
    and groups go by 64-bit hashes: texts with equal ones are both found again at the end.

    Sizes are part of the join key, in steps of 1 / similarity: similar texts are at most one step
    apart, and texts with a frequent shingle are dealt by their size. Shingles of HOT texts or more
    bring the texts' whole sketches, so that of a large group of texts that are near but not alike no
    pair leaves the join; a pair is looked at where it first shares such a shingle, and not again
    where both texts had the same one before."""
    of = W.partitionBy("s")
    light = facts.select("class.c0", F.xxhash64("root").alias("root"), "n", "p", "q")
    named = shared.join(light.hint("merge"), "c0").withColumns({"x": F.min("root").over(of), "y": F.max("root").over(of), "texts": F.count("*").over(of)}).filter("x <> y").drop("x", "y")
    named = saved(named.withColumn("step", F.floor(F.log("n") / F.lit(float(-np.log(similarity))) + 1e-9)))
    found = sharing(named.filter(F.col("texts") < HOT), similarity).unionByName(sharing_often(named.filter(F.col("texts") >= HOT), facts, similarity))
    found = found.distinct()
    for c in "ab":
        ends = facts.select(F.col("class.c0").alias(f"{c}0"), F.col("class").alias(c), F.struct("n", "sketch").alias(f"f{c}"))
        found = found.join(ends.hint("merge"), f"{c}0")
    return saved(found.filter(may_be_alike(F.col("fa.sketch"), F.col("fb.sketch"), F.col("fa.n"), F.col("fb.n"), similarity)).select("a", "b"))


def sharing(named: DataFrame, similarity: float, more: tuple[str, ...] = ()) -> DataFrame:
    """named: s, c0, root, i, n, p, q, step -> the pairs (a0, b0) of rows of one s and different roots that
    sizes, places and smallest sketches allow, with the columns of more and n of both, x and y."""
    x, y = (named.select("s", *[F.col(c).alias(c + e) for c in ("c0", "root", "i", "n", "p", "q", "step", *more)]) for e in "xy")
    x = x.withColumn("stepy", F.explode(F.array("stepx", F.col("stepx") + 1)))
    found = x.hint("merge").join(y.hint("merge"), ["s", "stepy"]).filter("rootx <> rooty and (stepx < stepy or c0x < c0y)")
    most = F.least("ix", "iy") + 1 + F.least(F.expr("nx - ix - 1"), F.expr("ny - iy - 1"))
    found = found.filter(most >= similarity * (F.col("nx") + F.col("ny") - most) - 1e-6)
    found = found.filter(F.expr("bit_count(px ^ py) + bit_count(qx ^ qy)") <= most_apart(F.col("nx"), F.col("ny"), similarity))
    return found.select(F.least("c0x", "c0y").alias("a0"), F.greatest("c0x", "c0y").alias("b0"), *([f"{c}{e}" for c in ("n", *more) for e in "xy"] if more else []))


def sharing_often(named: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """sharing, of shingles that many texts have."""
    known = named.withColumn("before", F.lag("s").over(W.partitionBy("c0").orderBy("i"))).join(facts.select("class.c0", "sketch").distinct().hint("merge"), "c0")
    found = sharing(known, similarity, ("before", "sketch")).filter("beforex is null or beforey is null or beforex <> beforey")
    return found.filter(may_be_alike(F.col("sketchx"), F.col("sketchy"), F.col("nx"), F.col("ny"), similarity)).select("a0", "b0")


def alike(links: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose texts' shingle sets have a Jaccard of at least similarity. Only the
    texts that links ask for are moved: a Bloom filter keeps the others where they are."""
    asked = saved(links.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    bits = min(BLOOM_MOST, max(1 << 16, 1 << (16 * asked.count()).bit_length()))
    marks = bloom(asked.select(F.col("class.c0").alias("s")), bits)
    # copies of a text are combined where they are, before they move
    sets = texts.filter(maybe_in(marks, F.col("class.c0"), bits)).groupBy("class").agg(F.first("text").alias("text")).join(asked.hint("merge"), "class", "left_semi")
    sets = saved(sets.select("class", word_shingles(F.col("text")).alias("s")))
    pairs = links.hint("merge").join(sets.withColumnsRenamed({"class": "a", "s": "sa"}).hint("merge"), "a")
    pairs = pairs.join(sets.withColumnsRenamed({"class": "b", "s": "sb"}).hint("merge"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return saved(pairs.filter(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b"))


def print_links(prints: DataFrame, similarity: float) -> DataFrame:
    """prints: class, prints, sketch, n -> (a, b): texts with equal prints with one of them, and
    close prints by one text each, unless their sketches rule them out."""
    links = None
    for t in range(PRINTS):
        of = prints.select(F.col("prints")[t].alias("fp"), F.struct("class", "sketch", "n").alias("x"))
        reps = saved(of.groupBy("fp").agg(F.min("x").alias("y"), F.count("*").alias("n")))
        star = of.join(reps.filter("n > 1").hint("merge"), "fp").select("x", "y")
        near = close_pairs(reps.select("fp")).distinct()
        near = near.hint("merge").join(reps.select(F.col("fp").alias("a"), F.col("y").alias("x")).hint("merge"), "a")
        near = near.join(reps.select(F.col("fp").alias("b"), "y").hint("merge"), "b")
        both = star.unionByName(near.select("x", "y")).filter(F.col("x.class") != F.col("y.class"))
        both = both.filter(may_be_alike(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"), similarity)).select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
        links = both if links is None else links.unionByName(both)
    return saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(class, root) for every distinct text that has a near copy; root stands for its group.

    Texts are linked if their sets of five-word shingles are similar enough (Jaccard), and groups
    are the components of all such links. First, texts whose SimHashes of distinct words differ in
    RADIUS bits at most in any of PRINTS tables are compared, those with equal fingerprints with one
    of them, close fingerprints by one text each. This joins large groups cheaply but misses links.
    Then the rest: every two texts of different groups that share a shingle of their prefixes, which
    any similar two do. Pairs are compared in full only where their parity sketches allow it. All
    joins here are merged: their sides grow with the texts, and several broadcasts at once would
    fill a driver."""

    def run(batches):
        for batch in batches:
            made = [(word_prints(t), sketch(s := shingle_numbers(t)), len(s)) for t in (x.as_py() for x in batch.column(1).cast(pa.large_binary()))]
            small = [folded(k) for _, k, _ in made]
            lists = [pa.array([list(m[i]) for m in made], pa.list_(pa.int64())) for i in (0, 1)]
            longs = [pa.array([k[i] for k in small], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, *longs, pa.array([m[2] for m in made], pa.int32())], names=["class", *FACTS])

    texts = docs.select(text_class(F.col("text")).alias("class"), "text")
    low = texts.select("class", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    prints = low.mapInArrow(run, f"{CLASS}, prints array<bigint>, sketch array<bigint>, p bigint, q bigint, n int")
    prints = saved(prints.groupBy("class").agg(*[F.first(c).alias(c) for c in FACTS]))
    first = alike(print_links(prints, similarity), texts, similarity)
    roots = components(first).withColumnRenamed("node", "class")
    facts = saved(prints.drop("prints").join(roots.hint("merge"), "class", "left").withColumn("root", F.coalesce("root", "class")))
    # shingles that only copies of one text hold link nothing
    of = W.partitionBy("s")
    firsts = prefixes(texts, common_shingles(texts, prints.count()), similarity).repartition("s")
    shared = firsts.withColumns({"x": F.min("c0").over(of), "y": F.max("c0").over(of)}).filter("x <> y").drop("x", "y").distinct()
    rest = alike(rest_pairs(shared, facts, similarity), texts, similarity)
    return components(first.unionByName(rest)).withColumnRenamed("node", "class")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id (null
    last). Groups are the components of near_groups; equal texts are one group. Rows that repeat
    both doc_id and text are one document. Columns may have any names.

    Most rows stay and are not moved: a Bloom filter tells those that may have to go or that are
    repeated, and only these meet the exact list."""
    key = F.struct("doc_id", "class")
    light = docs.select("doc_id", text_class(F.col("text")).alias("class"))
    light = saved(light.groupBy("doc_id", "class").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "class")).alias("k")
    texts = light.groupBy("class").agg(first).join(near_groups(docs, similarity).hint("merge"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    texts = saved(texts)
    chosen = texts.select("class", "root").join(texts.groupBy("root").agg(F.min("k").alias("k")).hint("merge"), "root").select("class", F.struct("k.doc_id", "k.class").alias("k"))
    asked = light.hint("merge").join(chosen.hint("merge"), "class").withColumn("goes", ~key.eqNullSafe(F.col("k")))
    asked = saved(asked.filter("goes or n > 1").select("doc_id", "class", "goes"))
    bits = min(BLOOM_MOST, max(1 << 16, 1 << (16 * asked.count()).bit_length()))
    hashed = lambda c: F.xxhash64("doc_id", f"{c}.c0", f"{c}.c1")
    marks = bloom(asked.select(hashed("class").alias("s")), bits)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text_class(F.col("text")).alias("class"))
    stays = rows.filter(~maybe_in(marks, hashed("class"), bits)).select("row.*")
    moved = rows.filter(maybe_in(marks, hashed("class"), bits)).alias("d")
    gone = asked.filter("goes").hint("merge").alias("g")
    moved = moved.join(gone, F.expr("d.class = g.class and d.doc_id <=> g.doc_id"), "left_anti")
    return stays.unionByName(moved.dropDuplicates(["doc_id", "class"]).select("row.*"))
