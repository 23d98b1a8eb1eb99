"""Stored runs of lines and batches of documents in any order of their ids."""

import collections
import random

import pytest

from graphev.llm import line_dedup


@pytest.mark.parametrize("order", ["rising", "falling", "mixed"])
def test_batches_in_any_order_give_the_owners_of_all(spark, order):
    rng = random.Random(7)
    ids = list(range(60))
    ids = ids if order == "rising" else ids[::-1] if order == "falling" else rng.sample(ids, 60)
    batches = [[(rng.randrange(9), d) for d in ids[k : k + 12] for _ in range(2)] for k in range(0, 60, 12)]
    batches[2].append((3, None))  # a document without an id counts and owns nothing
    batches[4].append((99, None))
    levels, n, owner = [], collections.Counter(), {}
    for batch in batches:
        keys = collections.defaultdict(set)
        for key, d in batch:
            keys[key].add(d)
        rows = []
        for key, docs in keys.items():
            known = [d for d in docs if d is not None]
            rows.append((key, key * 7, len(docs), max(known) if known else None))
            n[key] += len(docs)
            owner[key] = max([*known, *([owner[key]] if owner.get(key) is not None else [])], default=None)
        levels = line_dedup.add_batch(levels, spark.createDataFrame(rows, "h1 long, h2 long, n long, owner long"), 2)
    got = {(r.h1, r.h2): (r.n, r.owner) for r in line_dedup.all_keys(levels).collect()}
    assert got == {(k, k * 7): (n[k], owner[k]) for k in n}
