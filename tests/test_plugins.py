"""The score over any strategies, and its parts."""

import random

from graphev.functions import registry
from graphev.operators import scoring
from graphev.plans import plugins


def test_score_is_mean_bonuses_and_discount(spark):
    rng = random.Random(3)
    names = ["composition", "analog", "pattern", "fingerprint"]
    votes = [(f"d{rng.randrange(5)}", f"e{rng.randrange(3)}", rng.choice(names), round(rng.random(), 3)) for _ in range(60)] + [("only", "likeness", "fingerprint", 0.9), ("all", "high", "analog", 1.0), ("all", "high", "composition", 1.0)]
    paths = [("d0", "e0", 3, 1.5), ("d1", "e1", 9, 40.0), ("all", "high", 50, 40.0), ("no", "votes", 1, 0.5)]
    frame = spark.createDataFrame(votes, "source string, target string, strategy string, confidence double")
    got = {(r.source, r.target): r for r in scoring.score_breakdown(frame, spark.createDataFrame(paths, "source string, target string, chains long, total double")).collect()}
    pairs = {v[:2] for v in votes}
    assert set(got) == pairs
    for pair in pairs:
        best = {}
        for s, t, name, c in votes:
            if (s, t) == pair:
                best[name] = max(c, best.get(name, 0))
        base = [c for n, c in best.items() if n != "fingerprint"]
        chains, total = next(((n, x) for s, t, n, x in paths if (s, t) == pair), (0, 0.0))
        raw = (sum(base) / len(base) if base else 0) + min(0.25, 0.04 * total) + min(0.10, 0.06 * best.get("fingerprint", 0))
        raw *= 1 if chains else 0.8
        r = got[pair]
        assert (r.votes, r.strategies, r.chains, r.discounted) == (len(best), "+".join(sorted(best)), chains, not chains)
        assert abs(r.raw - raw) < 1e-9 and abs(r.score - min(1, raw)) < 1e-9
    assert got["all", "high"].score == 1.0


def test_all_names_are_registered():
    assert set(plugins.NODES) <= set(registry.STRATEGIES) and "gap" in registry.METRICS and "relation_gate" in registry.VERIFIERS
