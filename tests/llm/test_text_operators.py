"""The text operators against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from graphev.llm import chat_format, decontaminate, exact_dedup, line_dedup, packing, sharding, simhash_dedup, token_counts, tokens, toxicity, url_filter

WORDS = [f"w{i}x{i * i % 97}" for i in range(400)]
SHARED = "this very line is shared by several documents"


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, text(rng, rng.randrange(5, 80))) for i in range(60)]
    out += [(100, out[3][1]), (101, out[3][1].replace(" ", "\t ")), (102, out[4][1].upper()), (103, None), (104, ""), (105, " \n "), (None, "a text without an id"), (None, None)]
    out += [(110 + i, f"{text(rng, 6)}\n  {SHARED}\r\n{SHARED.upper()}\n{text(rng, 4)}") for i in range(5)]
    out += [(120, out[5][1]), (120, out[5][1]), (121, " ".join(WORDS * 20))]
    near = out[7][1].split() + text(rng, 80).split()
    out += [(130, " ".join(near)), (131, " ".join([*near[:-1], "other"])), (132, " ".join(["new", *near]))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(a, b, "x", 5, True) for a, b in rows], "doc_id long, text string, shard string, n_lines int, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


# --- sharding


def python_place(x, n, seed):
    left, right = sharding.half_bits(n)

    def once(v):
        a, b = v >> right, v & ((1 << right) - 1)
        for i, (k0, k1, k2) in enumerate(sharding.round_keys(seed)):
            mix = lambda h: ((h + k0) % sharding.PRIME) ** 2 % sharding.PRIME * k1 + k2
            if i % 2:
                a ^= mix(b) % sharding.PRIME & ((1 << left) - 1)
            else:
                b ^= mix(a) % sharding.PRIME & ((1 << right) - 1)
        return a << right | b

    x = once(x)
    while x >= n:
        x = once(x)
    return x


def test_shards(docs, rows, none):
    got = sharding.feistel_shards(docs, 8, 5).collect()
    n = len(rows)
    assert sorted(r.row_no for r in got) == list(range(n))
    for r in got:
        p = python_place(r.row_no, n, 5)
        assert (r.shard, r.slot) == (p % 8, p // 8)
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = collections.Counter((a, len((b or "").encode()) + 1, zlib.crc32((b or "").encode())) for a, b in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.feistel_shards(none).count() == 0


# --- line dedup


def python_lines(rows, batches=None):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    docs, owner = collections.Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                docs[k] += 1
                owner[k] = max((o for o in (owner.get(k), i) if o is not None), default=None)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if docs[key(x)] < 3 or i is None or owner[key(x)] in (None, i)]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return collections.Counter(out)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(docs, rows, batches, fanout):
    got = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == python_lines(rows)
    assert "shard" in got.columns


def test_runs_take_batches_one_at_a_time(spark, tmp_path):
    """Runs written as Parquet by one job and taken up by the next give what one job gives."""
    rng = random.Random(9)
    batches = [[(h, h + 1, rng.randrange(1, 4), 1000 - 100 * b - h) for h in rng.sample(range(40), 15)] for b in range(5)]
    levels: list = []
    for b, rows in enumerate(batches):
        levels = line_dedup.add_batch(levels, spark.createDataFrame(rows, "h1 long, h2 long, n long, owner long"), 2)
        for i, level in enumerate(levels):
            for j, run in enumerate(level):
                run.write.parquet(f"{tmp_path}/{b}-{i}-{j}")
            levels[i] = [spark.read.parquet(f"{tmp_path}/{b}-{i}-{j}") for j in range(len(level))]
    assert [len(x) for x in levels] == [1, 0, 1]
    want = {}
    for rows in batches:
        for h, _, n, owner in rows:
            want[h] = (want[h][0] + n, want[h][1]) if h in want else (n, owner)
    assert {r.h1: (r.n, r.owner) for r in line_dedup.all_keys(levels).collect()} == want


def test_line_dedup_of_nothing(none):
    assert line_dedup.dedup_lines(none).count() == 0


# --- exact dedup


def test_exact_dedup(docs, rows, none):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    want = []
    for i, t in rows:
        content = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[content])[2]
        want.append((i, keep, len(groups[content]), i == keep, hashlib.sha256(content.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert exact_dedup.exact_groups(none).count() == 0


# --- SimHash


def test_simhash_groups(docs, rows, none):
    prints = [simhash_dedup.simhash((t or "").encode(), 3) & (2**64 - 1) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    want = collections.Counter((d, prints[i], least[find(i)]) for i, (d, _) in enumerate(rows))
    got = simhash_dedup.simhash_groups(docs).collect()
    assert collections.Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want
    assert simhash_dedup.simhash_groups(none).count() == 0


def test_close_pairs_finds_every_pair(spark):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    every = set(seeds)
    for s in seeds:
        for flips in (1, 2, 3, 3, 4):
            every.add(s ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    got = {frozenset((r.a & (2**64 - 1), r.b & (2**64 - 1))) for r in simhash_dedup.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    every = sorted(every)
    assert got == {frozenset((a, b)) for i, a in enumerate(every) for b in every[:i] if (a ^ b).bit_count() <= 3}


def shingle_set(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies(docs, rows, none):
    """Of planted copies one stays; what has no copy of similarity 0.8 stays."""
    got = collections.Counter(r.doc_id for r in simhash_dedup.drop_near_copies(docs).collect())
    sets = [shingle_set(t) for _, t in rows]
    alone = [d for i, (d, _) in enumerate(rows) if d is not None and not any(i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(len(rows)))]
    assert all(got[d] == 1 for d in alone)
    assert sum(got[d] for d in (130, 131, 132)) == 1 and got[3] == 1 and got[100] == got[101] == got[102] == 0
    assert got[5] == 1 and got[120] == 0 and got[103] == 1 and got[104] == got[105] == 0
    assert simhash_dedup.drop_near_copies(none).count() == 0


def brute_groups(texts):
    """Components of all pairs of similarity 0.8, as sets of indices, without single texts."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    groups = collections.defaultdict(set)
    for i, r in enumerate(root):
        groups[r].add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def groups_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    classes = docs.select("doc_id", simhash_dedup.text_class(F.col("text")).alias("class"))
    groups = collections.defaultdict(set)
    for r in classes.join(simhash_dedup.near_groups(docs), "class").collect():
        groups[r.root].add(r.doc_id)
    return {frozenset(g) for g in groups.values()}


def test_near_groups_are_complete(spark):
    """Copies with an appended block, an inserted block or scattered changes, around 0.8."""
    rng = random.Random(17)
    zipf = lambda n: [f"z{int(rng.paretovariate(0.7)) % 5000}" for _ in range(n)]
    texts = []
    for i in range(40):
        base = zipf(rng.randrange(60, 200))
        block = zipf(round(len(base) * rng.choice([0.1, 0.18, 0.22, 0.26])))
        at = rng.randrange(len(base))
        few = base[:30]
        changed = [*few[:4], "other", *few[5:]]
        texts += [" ".join(x) for x in (base, base + block, base[:at] + block + base[at:], few, changed)]
    assert groups_of(spark, texts) == brute_groups(texts)


def test_near_groups_without_their_representative(spark):
    """Texts of the same words, so of equal fingerprints, that are alike but not like the smallest."""
    rng = random.Random(23)
    parts = [[f"p{i}q{j}" for j in range(10)] for i in range(40)]
    texts = []
    for _ in range(12):
        order = rng.sample(parts, 40)
        texts.append(" ".join(w for p in order for w in p))
        texts.append(" ".join(w for p in [order[1], order[0], *order[2:]] for w in p))
    blocks = rng.sample([w for p in parts for w in p], 400)
    texts += [" ".join(blocks), " ".join([*blocks[20:], *blocks[:20]]), " ".join([*reversed(blocks[:80]), *blocks[80:]])]
    assert groups_of(spark, texts) == brute_groups(texts)


def test_a_large_group_that_is_near_but_not_alike(spark, monkeypatch):
    """Texts that share shingles with many others leave the join with those only that may be alike."""
    rng = random.Random(31)
    base, texts = [f"b{i}" for i in range(300)], []
    for i in range(70):
        own = [f"t{i}w{j}" if rng.random() < 0.08 else w for j, w in enumerate(base)]
        texts += [" ".join(own)] + [" ".join([*own[:150], *(f"{i}n{j}" for j in range(12)), *own[150:]])] * (i % 7 == 0)
    sharing, made = simhash_dedup.sharing, []

    def told(*a):
        made.append((sharing(*a).distinct().count(), len(a)))
        return sharing(*a)

    monkeypatch.setattr(simhash_dedup, "sharing", told)
    often, left = simhash_dedup.sharing_often, []

    def counted(*a):
        found = often(*a)
        left.append((found.count(), plan_of(found)))
        return found

    monkeypatch.setattr(simhash_dedup, "sharing_often", counted)
    assert groups_of(spark, texts) == brute_groups(texts)
    assert [n for n, k in made if k == 3][0] > 2000 and left[0][0] < 300
    join = left[0][1].split("Join Inner")[1].split("\n")[0]
    assert "sketchx" in join and "beforex" in join, left[0][1]  # no pair is made that they rule out


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_near_copies_keep_other_ids(spark):
    """A repeated row leaves documents that share its kind of doc_id, or have none, alone."""
    rows = [(None, "first clean text of no id"), (None, "another one that differs a lot"), (7, "x"), (7, "x"), (8, "one text under id eight"), (8, "and some other text of eight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in simhash_dedup.drop_near_copies(docs).collect())
    assert got == sorted({(a or 0, b) for a, b in rows})


# --- decontamination


def test_contaminated(spark, rows, none):
    rng = random.Random(9)
    items = [(i, text(rng, n)) for i, n in enumerate([15, 20, 30, 57, 60, 3, 5])] + [(7, None), (8, "..."), (9, text(rng, 300))]
    long = items[3][1].split()
    edited = [*long[:28], "changed", *long[29:]]
    planted = [(200, f"{text(rng, 9)} {items[0][1].upper()}, {text(rng, 300)}"), (201, items[1][1]), (202, f"{text(rng, 30)}\n{' '.join(edited)}."), (203, f"x {items[4][1]} {items[2][1]}"),
               (204, " ".join(items[2][1].split()[:20])), (205, f"{items[5][1]} {items[9][1]}"), (None, items[1][1]), (201, items[1][1])]
    every = rows + planted
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    want = {}
    for i, it in items:
        w = words(it)
        k = min(5, len(w))
        if not w:
            continue
        one = collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
        for d, t in every:
            v = words(t)
            for s in range(max(1, len(v) - len(w) + 1)):
                win = v[s : s + len(w)]
                two = collections.Counter(tuple(win[j : j + k]) for j in range(len(win) - k + 1))
                low = (one & two).total()
                if low and low >= 0.8 * (one | two).total():
                    want[d, i] = max(want.get((d, i), 0), low / (one | two).total())
    frame = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, fp int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == pytest.approx(want) and {(200, 0), (201, 1), (202, 3), (203, 4), (203, 2), (205, 5), (205, 9)} <= got.keys() and (204, 2) not in got
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0


# --- chat formatting


def test_reply_trees(spark):
    nasty = r"a\b <s> </s>[INST] x [/INST] \<s> \\ [/INST"
    nodes = [("t", 1, None, "user", nasty, 0.0), ("t", 2, 1, "assistant", "low", 1.0), ("t", 3, 1, "assistant", nasty, 5.0), ("t", 4, 3, "user", None, 0.0), ("t", 5, 4, "assistant", "end", None), ("u", 1, 99, None, "orphan", 1.0)]
    frame = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    out = chat_format.format_trees(frame, branches=2).withColumns({"turns": chat_format.read_turns(F.col("formatted")), "learnt": chat_format.read_loss(F.col("formatted"), F.col("loss"))})
    got = {(r.tree, r["rank"]): r for r in out.collect()}
    assert got.keys() == {("t", 1), ("t", 2), ("u", 1)}
    best = got["t", 1]
    assert [(x.role, x.text) for x in best.turns] == [("user", nasty), ("assistant", nasty), ("user", ""), ("assistant", "end")]
    assert best.learnt == nasty + "end" and best.leaf == 5 and best.n_turns == 4
    assert [(x.role, x.text) for x in got["u", 1].turns] == [("", "orphan")]
    ring = spark.createDataFrame([("t", 1, 2, "user", "x", 0.0), ("t", 2, 1, "user", "y", 0.0)], frame.schema)
    with pytest.raises(ValueError):
        chat_format.format_trees(ring)
    deep = spark.createDataFrame([("d", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(21)], frame.schema)
    only = chat_format.format_trees(deep).withColumn("turns", chat_format.read_turns(F.col("formatted"))).first()
    assert [x.text for x in only.turns] == [str(i) for i in range(21)]
    assert chat_format.format_trees(frame.limit(0)).count() == 0


# --- URL filter


def test_urls(spark):
    page = lambda *to: "".join(f"<a HREF='http://{t}/x'>x</a>" for t in to)
    pages = [(1, "http://a.com/en/1", page("b.org", "b.org", "c.org")), (2, "http://X.Example.com/en/p?q#f", None), (3, "http://bad.net/fr/1", ""), (4, "http://d.org/1", page("bad.net")),
             (5, "http://b.org/2", None), (6, None, None), (7, "no url", "x"), (8, "https://www.example.com/en/", None), (9, "http://bad.net/de/", None), (9, "http://bad.net/de/", None), (10, "x://com", None)]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in url_filter.filter_urls(frame, url_filter.rules_table(spark, url_filter.RULES)).collect()}
    assert (got[1].rule, got[1].verdict) == ("com/", "allow")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("x.example.com", "/en/p", "example.com/en/", "block")
    assert (got[3].rule, got[3].verdict) == ("net/fr/", "block") and (got[8].rule, got[8].verdict) == ("www.example.com/en/", "allow")
    assert got[4].verdict == "block" and got[4].distrust > 0 == got[4].trust
    assert got[5].verdict == "allow" and got[5].trust > 0 and got[9].verdict == "block" and got[9].rule is None
    assert (got[6].host, got[6].path, got[6].verdict) == (got[7].host, got[7].path, got[7].verdict) == ("", "", "allow")
    assert (got[10].host, got[10].path, got[10].rule) == ("com", "", None)
    assert url_filter.filter_urls(frame.limit(0), url_filter.rules_table(spark, url_filter.RULES)).count() == 0


def test_trust_by_hand(spark):
    links = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 1.0), ("b", "c", 1.0)], "src string, dst string, n double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0)], "host string, good double, bad double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.spread_trust(links, seeds, 0.5, 10).collect()}
    # trust: a = .5, b = .5 * .75 * a, c = .5 * (.25 * a + b); distrust: c = .5, b = .5 * .5 * c, a = .5 * (b + .5 * c)
    assert got["a"] == pytest.approx((0.5, 0.1875)) and got["b"] == pytest.approx((0.1875, 0.125)) and got["c"] == pytest.approx((0.15625, 0.5))


# --- tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["  two  spaces\n\nünï 日本 don't <|endoftext|> \t x\xa0y 1234", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "<|endoftext", "a <|endoftext|", "\uffff \ufeff\x00 <|ENDOFTEXT|>"]


def test_ids_are_the_tokenizers_ids(spark, docs, rows, tokenizer):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in tokens.token_rows(odd, 1).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(ODD)}
    ids = collections.Counter((r.doc_id, bytes(r.ids)) for r in tokens.token_rows(docs, 1).collect())
    assert ids == collections.Counter((d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u2").tobytes()) for d, t in rows)


def plain_bm25(docs, idf, mean):
    """Scores of all pairs of documents by loops: the weights of the second over the first's ids."""
    counts = [collections.Counter(d.tolist()) for d in docs]
    size = [len(d) for d in docs]

    def weight(c, n, t):
        return float(idf[t]) * c[t] * (packing.K1 + 1) / (c[t] + packing.K1 * (1 - packing.B + packing.B * n / mean))

    return [[sum(weight(c, n, t) for t in q if t in c) for c, n in zip(counts, size)] for q in counts]


@pytest.mark.parametrize(("cells", "kept"), [(1 << 22, 1 << 24), (300, 1 << 24), (300, 0)])
def test_packing_neighbours_are_bm25s_over_all_ids(monkeypatch, cells, kept):
    """Whole queries against brute force, with few and many columns in the matrix; used documents are no neighbours."""
    monkeypatch.setattr(packing, "CELLS", cells)
    monkeypatch.setattr(packing, "KEPT_CELLS", kept)
    rng = np.random.default_rng(5)
    docs = [np.append(rng.zipf(1.3, rng.integers(1, 90)) % 400 + 2, packing.END).astype("<u2") for _ in range(120)]
    docs += [docs[3], docs[3], np.array([packing.END], "<u2")]
    idf = rng.random(packing.VOCABULARY).astype(np.float32)
    idf[packing.END] = 0
    shard, right = packing.Shard(docs, idf, 40.0), np.array(plain_bm25(docs, idf, 40.0))
    shard.unused[[7, 8, 9]] = False
    for d in range(len(docs)):
        assert np.allclose(shard.scores(d), right[d], rtol=1e-4, atol=1e-5)
        want = np.where(shard.unused, right[d], 0)
        got = shard.neighbours(d)[::-1]
        assert len(got) == min(packing.AT_A_TIME, (want > 0).sum()) and not {7, 8, 9} & set(got)
        assert np.allclose(want[got], np.sort(want)[::-1][: len(got)], rtol=1e-4, atol=1e-5)


def test_packing_fills_a_window_with_the_seeds_best_neighbours(monkeypatch):
    """Every window's documents, in order, against brute force over what was unused; neighbours are taken two at a time."""
    monkeypatch.setattr(packing, "AT_A_TIME", 2)
    rng = np.random.default_rng(8)
    docs = [np.append(rng.integers(2, 60, rng.integers(3, 12)), packing.END).astype("<u2") for _ in range(80)]
    idf = rng.random(packing.VOCABULARY).astype(np.float32)
    idf[packing.END] = 0
    out = packing.Windows(0, 64)
    out.fill(list(range(80)), docs, idf, 8.0)
    right, unused, seed, used = plain_bm25(docs, idf, 8.0), set(range(80)), None, 0
    for d in [p[0] for p in out.pieces if p[1] == 0]:
        if seed is None:
            assert d == min(unused)
        else:
            best = max(right[seed][x] for x in unused)
            assert right[seed][d] >= best - 1e-4 if best > 0 else d == min(unused)
        unused.remove(d)
        opened, used = used == 0 or used + len(docs[d]) > 64, (used + len(docs[d])) % 64
        seed = None if used == 0 else d if opened else seed
    assert not unused


def test_packing(docs, rows, none, tokenizer):
    got = packing.pack(docs, window=64, shard_tokens=500).collect()
    fill = collections.defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(sum(n for _, n in p) < 64 for p in fill.values()) <= docs.rdd.getNumPartitions() + 2
    want = collections.Counter()
    for d, t in rows:
        want[d] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    have = collections.Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == want
    one = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 121)
    ids = np.array([*tokenizer.encode(" ".join(WORDS * 20), add_special_tokens=False).ids, 1], "<u4")
    at = 0
    for start, n, crc in one:
        assert start == at and crc == zlib.crc32(ids[at : at + n].tobytes())
        at += n
    assert at == len(ids)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_documents_across_blocks_and_files(spark, block):
    end = 7
    streams = {1: [[1, 2, 7, 7, 3], [4, 5], [7, 6]], 2: [[7]], 3: [[]], 4: [[1, 2]]}
    files = [(s, k, bytearray(np.array(f, "<u2").tobytes())) for s, fs in streams.items() for k, f in enumerate(fs)]
    blocks = token_counts.scan_blocks(spark.createDataFrame(files, "stream long, file_no int, content binary"), end, block)
    got = sorted(tuple(r) for r in token_counts.documents_of(blocks).collect())
    assert got == [(1, 0, 0, 2, True), (1, 1, 3, 0, True), (1, 2, 4, 3, True), (1, 3, 8, 1, False), (2, 0, 0, 0, True), (4, 0, 0, 2, False)]


def test_token_counts_from_files(docs, rows, tokenizer, tmp_path):
    folder = str(tmp_path / "t")
    token_counts.write_token_files(docs, folder)
    counts = token_counts.documents_of(token_counts.scan_blocks(token_counts.token_files(docs.sparkSession, folder)))
    want = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    assert sorted(r.n_tokens for r in counts.collect()) == want


def test_every_document_gets_its_own_count(spark, rows, tokenizer, tmp_path):
    """The query against the tokenizer, document by document, over several files of several row groups."""
    every = [(i, t) for i, (_, t) in enumerate(rows)] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in every], "doc_id long, text string, n_tokens string, stream int")
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.op6_token_counts(spark, str(tmp_path)).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in every}


# --- toxicity


def test_toxicity(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 150, 0: 300})
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        words, bad = text(rng, rng.randrange(10, 120)).split(), i % 3 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgful", "zorgish", "zorgest"]))
        rows.append((i, " ".join(words), "x"))
        marks.append((i, int(bad)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "w1 " * 3000 + "zorgish zorgful", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    out = toxicity.scored(docs, spark.createDataFrame([*marks, (5, None)], "doc_id long, toxic int")).collect()
    held = [r for r in out if r.doc_id is not None and r.doc_id < 1000 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    right = sum(r.predicted == (r.doc_id % 3 == 0) for r in held)
    assert right >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in out) and len(out) == len(rows)
    bare = toxicity.scored(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in bare.collect()} == {0.0}


def test_gradients():
    net = toxicity.Network([b"a"], 1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    draw = np.random.default_rng(0)
    x, mask = draw.standard_normal((2, toxicity.WINDOW, 32)), np.zeros((2, toxicity.WINDOW), bool)
    mask[0, :5], mask[1, :3] = True, True
    y, w = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        logits = []
        for i in range(2):
            gates = {d: x[i] @ net.p[f"W{d}"] + net.p[f"c{d}"] for d in "fb"}
            logits.append(net.logits(gates, np.arange(toxicity.WINDOW)[None], mask[i : i + 1])[0])
        p = 1 / (1 + np.exp(-np.array(logits, float)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad, _ = net.gradients(x, mask, y, w)
    for k in ("Uf", "Ub", "Wf", "af", "wb", "cb"):
        at = tuple(draw.integers(n) for n in net.p[k].shape)
        step = 1e-3
        net.p[k][at] += step
        up = loss()
        net.p[k][at] -= 2 * step
        down = loss()
        net.p[k][at] += step
        assert grad[k][at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_sketches_never_rule_out_similar_sets(spark):
    draw, rows, real = np.random.default_rng(3), [], {}
    for case in range(300):
        n = int(draw.integers(1, 1500))
        one = np.unique(draw.integers(-(1 << 62), 1 << 62, n))
        two = np.unique(np.concatenate([draw.permutation(one)[: max(1, int(len(one) * draw.uniform(0.7, 1)))], draw.integers(-(1 << 62), 1 << 62, int(n * draw.uniform(0, 0.4)))]))
        real[case] = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        rows.append((case, *[simhash_dedup.sketch(s).tolist() for s in (one, two)], len(one), len(two)))
    frame = spark.createDataFrame(rows, "id int, x array<bigint>, y array<bigint>, n int, m int")
    kept = {r.id for r in frame.filter(simhash_dedup.may_be_alike(F.col("x"), F.col("y"), F.col("n"), F.col("m"), 0.8)).collect()}
    assert {i for i, j in real.items() if j >= 0.8} <= kept and not any(real[i] < 0.4 for i in kept)
    for _, x, y, _, _ in rows:
        apart = lambda a, b: sum(int(p ^ q).bit_count() if p ^ q >= 0 else ((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(a, b))
        if len(x) == len(y):
            assert apart(simhash_dedup.folded(np.array(x)), simhash_dedup.folded(np.array(y))) <= apart(x, y)
