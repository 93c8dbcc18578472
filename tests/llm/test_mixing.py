import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandex.llm import mixing


def corpus(spark):
    rows = [(i, "w " * (i % 50), "big") for i in range(3000)] + [(5000 + i, "w " * (i % 20), f"s{i % 6}") for i in range(600)] + [(9000, None, None), (9001, "a b c", None), (9002, "", "blank")]
    return rows, spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, text string, source string, epoch string, weight int")


def brute_force_weights(tokens, entropy, repetition, budget):
    """By a fine bisection of the same two conditions."""
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items() if t}

    def weights(x):
        z = sum(v**x for v in p.values())
        return {s: v**x / z for s, v in p.items()}

    def holds(x):
        w = weights(x)
        return -sum(v * math.log(v) for v in w.values()) >= entropy * math.log(len(p))

    def fits(x):
        w = weights(x)
        scale = {s: w[s] / p[s] for s in p}
        return max(scale.values()) / (min(scale.values()) if budget is None else total / budget) <= repetition

    def bisect(test, rising):
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if test(mid) == rising else (low, mid)
        return (low + high) / 2

    x = max(1.0 if holds(1.0) else bisect(holds, True), 0.0 if fits(0.0) else bisect(fits, False))
    return weights(x)


@pytest.mark.parametrize(("entropy", "repetition", "share"), [(0.95, 4.0, 1.0), (0.99, 1.5, 0.5), (0.9, 2.0, None)])
def test_weights_quotas_and_passes(spark, entropy, repetition, share):
    rows, docs = corpus(spark)
    n = {i: len((t or "").split()) for i, t, _ in rows}
    tokens = Counter()
    for i, _, s in rows:
        tokens[s] += n[i]
    total = sum(tokens.values())
    budget = None if share is None else int(total * share)
    mixed, planned = mixing.mixture(docs, entropy, repetition, budget, block_tokens=200)
    plan = {r.source: r for r in planned.collect()}
    for s, w in brute_force_weights(tokens, entropy, repetition, budget).items():
        assert plan[s].weight == pytest.approx(w, abs=2e-5)
    taken = defaultdict(Counter)
    for r in mixed.select("row.doc_id", "row.source", F.col("epoch").alias("pass_")).collect():
        taken[r.source][r.doc_id] += 1
    most = max(w for w in n.values())
    for s, t in tokens.items():
        if t:
            got = sum(c * n[i] for i, c in taken[s].items())
            assert plan[s].quota - most <= got <= plan[s].quota
            counts = [taken[s][i] for i, _, o in rows if o == s]
            assert max(counts) - min(counts) <= 1 and max(counts) <= repetition + 1
    if budget is None:
        assert all(taken[s][i] for i, _, s in rows)
    else:
        assert sum(plan[s].quota for s in plan) <= budget


def test_no_rows(spark):
    _, docs = corpus(spark)
    assert mixing.mixture(docs.limit(0))[0].count() == 0
    assert mixing.mixture(docs.where("source = 'blank'"))[0].count() == 1
