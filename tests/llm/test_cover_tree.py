"""Embedding links against all pairs, with nulls, zeros, ties, repeats, hot groups and clashing columns."""

import math

import numpy as np
import pytest

from graphev.llm import cover_tree as ct


def brute(rows, bar=0.98):
    """rows (vec_id, embedding, label) -> sorted (vec_id, n_links, component_id, kept)."""
    ok = [lab is not None and vec is not None and len(vec) > 0 and all(x is not None and math.isfinite(x) for x in vec) and any(vec) for _, vec, lab in rows]
    root, n = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, u, p) in enumerate(rows):
        for j, (_, v, q) in enumerate(rows[:i]):
            if ok[i] and ok[j] and p == q and len(u) == len(v) and np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v)) >= bar:
                n[i], n[j], root[top(i)] = n[i] + 1, n[j] + 1, top(j)
    least: dict = {}
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [x for x in (least.get(top(i)), vec_id) if x is not None]
        least[top(i)] = min(ids) if ids else None
    return sorted(((vec_id, n[i], least[top(i)], vec_id == least[top(i)]) for i, (vec_id, _, _) in enumerate(rows)), key=repr)


def some_rows(n, dims, seed, spread=0.02):
    """Random vectors, groups of near ones, chains of them, and copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(1, n // 8), dims))
    out = []
    for i in range(n):
        kind, at = rng.integers(4), base[rng.integers(len(base))]
        vec = rng.normal(size=dims) if kind == 0 else at * rng.uniform(0.5, 3) if kind == 1 else at + rng.normal(size=dims) * spread * rng.uniform(0, 6) * np.linalg.norm(at) / math.sqrt(dims) * 2
        out.append((i, [float(np.float32(x)) for x in vec], int(rng.integers(3))))
    return out


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0, None] + [0.0] * 6, 1), (904, [float("nan")] + [1.0] * 7, 1), (905, [float("inf")] + [1.0] * 7, 1),
    (906, [1.0] * 8, None), (907, [1.0] * 8, None), (908, [1.0] * 8, 7), (909, [2.0] * 8, 7), (910, [1.0] * 8, 7), (910, [1.0] * 8, 7), (None, [1.0] * 8, 7), (911, [1.0] * 4, 7), (None, [-1.0] * 8, 7), (912, [1e-40] * 8, 7), (913, [3e38] * 8, 7),
]


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_links_are_those_of_all_pairs(spark, block):
    rows = some_rows(240, 8, 1) + ODD + [(2000 + i, [1.0, 0.5, 0.01 * (i % 7)] + [0.0] * 5, 2) for i in range(60)]
    table = spark.createDataFrame([(*r, 1, 2, "g") for r in rows], "vec_id long, embedding array<float>, label int, n_links int, cid int, grp string").repartition(3)
    got = sorted((tuple(r) for r in ct.linked_vectors(table, block=block).collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[1] > 0 for r in got) > 100


def test_pairs_and_other_bars(spark):
    rows = some_rows(150, 5, 2)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for bar in (0.9, 0.999):
        got = {frozenset((r.a, r.b)) for r in ct.near_pairs(table, bar, 32).collect()}
        want = {frozenset((a[0], b[0])) for i, a in enumerate(rows) for b in rows[:i] if a[2] == b[2] and np.dot(a[1], b[1]) / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= bar}
        assert got == want and want


def test_no_rows(spark):
    none = ct.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert none.columns == ["vec_id", "n_links", "component_id", "kept"] and none.count() == 0
    alone = spark.createDataFrame(ODD[:6], "vec_id long, embedding array<float>, label int")
    assert [tuple(r)[1:] for r in ct.linked_vectors(alone).orderBy("vec_id").collect()] == [(0, v, True) for v in range(900, 906)]


@pytest.mark.parametrize("dims", [2, 3, 16])
def test_tasks_find_all_pairs_and_bounds_prune(dims, monkeypatch):
    monkeypatch.setattr(ct, "LEAF", 8)
    rng = np.random.default_rng(3)
    x = ct.units(np.concatenate([rng.normal(size=(1, dims)) + rng.normal(size=(60, dims)) * s for s in (0.01, 0.05, 0.2, 2.0)]))
    y = ct.units(rng.normal(size=(90, dims)))
    for a, b in ((x, None), (x, y)):
        found = [(int(i), int(j)) if b is not None else (int(min(i, j)), int(max(i, j))) for part in ct.links(a, b, 0.98) for i, j in zip(*part[:2])]
        full = a @ (a if b is None else b).T >= 0.98
        want = {(i, j) for i, j in zip(*np.nonzero(full)) if b is not None or i < j}
        assert len(found) == len(set(found)) and set(found) == want
    tree = ct.grow(x, np.arange(len(x)), np.zeros(dims), ct.FIRST_SCALE, 8, 48)
    seen, todo = 0, [tree]
    while todo:
        node = todo.pop()
        assert ct.distance(x[node.points], node.centre).max() <= node.radius + 1e-12
        todo += node.kids
        seen += not node.kids
    pairs = sum(1 for _ in ct.leaf_pairs(tree, tree, 0.2))
    assert dims > 3 or (seen > 5 and pairs < seen * (seen + 1) / 2)


def test_forest_joins_what_the_edges_join():
    i, j = np.array([5, 4, 1, 7]), np.array([4, 3, 0, 8])
    assert ct.forest(9, i, j).tolist() == [0, 0, 2, 3, 3, 3, 6, 7, 7]
