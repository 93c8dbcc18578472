import random
import re

import pytest

from strandex.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_force(rows, k, p, q):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 8, 12, 15, 20, 30, 60, 100, 300]))]
        if rng.random() < 0.4:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 9])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[at], "x"]])
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t\n"), (len(rows) + 3, "É é"), (len(rows) + 4, "é é"), (len(rows) + 5, "a\x0bb\x0cc d"), (len(rows) + 6, "a b c d")]


@pytest.mark.parametrize(("seed", "k", "p", "q"), [(1, 3, 9, 10), (2, 5, 4, 5), (3, 2, 4, 5)])
def test_components_as_by_brute_force(spark, seed, k, p, q):
    rows = near_copies(seed)
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, n long, key string")
    got = sorted(map(tuple, ngram_join.jaccard_components(docs, k, p, q).collect()), key=str)
    assert got == brute_force(rows, k, p, q)


def test_repeated_and_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 0, None)], key=str)
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, "c " + b)]
    got = sorted(map(tuple, ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_force(rows, 5, 4, 5)


@pytest.mark.parametrize(("p", "q"), [(9, 10), (4, 5)])
def test_linked_sets_share_a_key(p, q):
    """The guarantee itself, at sizes on either side of the boundary and of levels."""
    import numpy as np

    rng = np.random.default_rng(5)
    plan = ngram_join.plan(p, q)
    for _ in range(1500):
        a = int(rng.integers(1, 60)) if rng.random() < 0.8 else int(rng.integers(60, 700))
        b = int(rng.integers(a, a * q // p + 1))
        o = plan.overlap(a, b)
        if o > a:
            continue
        pool = np.unique(rng.integers(0, 1 << 63, a + b, dtype=np.uint64))[: a + b - o]
        rng.shuffle(pool)
        x, y = np.sort(pool[:a]), np.sort(pool[a - o : a - o + b])
        assert set(ngram_join.keys(x, plan)[0].tolist()) & set(ngram_join.keys(y, plan)[0].tolist())


def test_a_passage_of_all_documents_makes_no_list_of_all(spark):
    """Documents that share a passage and are linked with none leave all lists; near copies among them stay linked."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(3000):
        own = [f"w{rng.randrange(50_000)}" for _ in range(60)]
        rows.append((i, " ".join(own + passage)))
    for i in range(0, 300, 10):
        words = rows[i][1].split(" ")
        words[rng.randrange(60)] = "edited"
        rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r.component for r in ngram_join.jaccard_components(docs).collect()}
    want = {i: i for i in range(3000)} | {3000 + j: 10 * j for j in range(30)}
    assert got == want
    # single shingles of all of them: only near copies are left on lists
    profiles = ngram_join.profiles(docs, "doc_id", "text", 5, 4, 5)
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    nodes = profiles.select(F.col("id").alias("node"), "n")
    left = ngram_join._refined(texts, nodes, 5, 4, 5)
    assert left.groupBy("key").count().agg(F.max("count")).first()[0] == 2
    assert {r.node for r in left.select("node").distinct().collect()} == {i for i in range(0, 300, 10)} | set(range(3000, 3030))


@pytest.mark.parametrize(("seed", "k", "p", "q"), [(4, 3, 9, 10), (5, 5, 4, 5)])
def test_refined_lists_lose_no_link(spark, seed, k, p, q, monkeypatch):
    """With one further round of stars, all that isn't linked to a centre by then goes through single shingles."""
    monkeypatch.setattr(ngram_join, "STARS", 1)
    monkeypatch.setattr(ngram_join, "REFINED", 0)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(docs, k, p, q).collect()), key=str) == brute_force(rows, k, p, q)


def test_lists_go_through_one_shuffle(spark, monkeypatch):
    """Their sizes and their members come from the same rows."""
    plans = {}

    def written(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return kept(df, label)

    kept = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", written)
    rows = near_copies(6)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5)
    assert plans["lists"].count("Exchange hashpartitioning(key") == 1
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, 5, 4, 5)


def test_shingles_that_meet_as_by_brute_force(spark):
    """Whole repeats of a row count once; keys and nodes come back from their packed form."""
    rows = [(i + (i % 3 << 36), t) for i, t in near_copies(7)]
    found = ngram_join._meeting(spark.createDataFrame(rows + rows[:20], "node long, text string"), 3, 7).collect()
    want = {}
    for node, t in rows:
        for s in shingle_set(t, 3):
            want.setdefault(s, set()).add(node)
    got = {}
    for r in found:
        got.setdefault(r.key, (r.size, set()))[1].add(r.node)
    assert sorted(sorted(x) for _, x in got.values()) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    assert all(n == len(x) for n, x in got.values()) and len(found) == sum(n for n, _ in got.values())
