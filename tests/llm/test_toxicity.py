import itertools
import random

import numpy as np
import pytest

from strandex.llm import toxicity as T

BAD = ["grimblot", "snarkhole", "vilepunk", "dreckmaul"]


def slow_kernel(s, t):
    """Kernel of two words, subsequence by subsequence."""

    def phi(w):
        out, w = {}, " " + w
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < T.SPAN:
                u = tuple(T._TABLE[ord(w[x])] for x in (i, j, k))
                out[u] = out.get(u, 0) + T.DECAY ** (k - i - 2)
        return out

    a, b = phi(s), phi(t)
    g = T.norms()
    return sum(v * b.get(u, 0) for u, v in a.items()) / g[min(len(s), T.NORMED)] / g[min(len(t), T.NORMED)]


def test_kernel_is_that_of_the_definition():
    words, fixed = ["idiot", "i.d.i.o.t", "aaaa", "ab", "a", "überlangeswort", "x1y2z3"], ["idiot", "aaa", "überall", "ab"]
    got = T.Kernel(fixed).of(words)
    assert np.allclose(got, [[slow_kernel(a, b) for b in fixed] for a in words], atol=1e-6)


def test_single_characters_join():
    s = T.Stream(["an i d i o t x yz", "a b", "c"])
    assert s.lengths.tolist() == [2, 6, 2, 2, 1]
    assert T.Stream(["", ""]).lengths.tolist() == []


def corpus(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(3, 60))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(1500, 1)
    return T.train([t for _, t, y in rows if y], [t for _, t, y in rows if not y])


def test_held_out_texts(model):
    rows = corpus(1000, 2)
    score = model.scores([t for _, t, _ in rows])
    truth = np.array([y for *_, y in rows])
    assert ((score >= T.THRESHOLD) == truth).mean() > 0.995
    assert ((score >= 0) & (score <= 1)).all()


def test_gaps_insertions_and_length(model):
    toxic, clean = model.scores(["so ta g r i m b l o t ne", "the grimmblot", "vile-punk", "ta " * 50_000 + "dreckmaul"]), model.scores(["ta ri mo", "", " \n", "ta " * 50_000, "neluso tamo"])
    assert toxic.min() > clean.max()


def test_one_class_scores_nothing():
    assert T.train([], ["a"]).scores(["a", ""]).tolist() == [0, 0]
    assert T.train(["", "a"], ["", "b"]).scores(["a", ""]).tolist() == [0, 0]
    assert max(T.train(["", "a b"], ["", "ab"]).scores(["a", ""])) < T.THRESHOLD
    assert T.train(["stupid"], ["", "word"]).scores(["stupid", "word"]).tolist()[0] > 0.5


def test_rows_and_columns_stay(spark, model):
    docs = spark.createDataFrame([(None, None, "x", 1.0), (1, "grimblot", "y", 2.0), (1, "grimblot", "y", 2.0), (2, "", None, None)], "doc_id long, text string, c0 string, score double")
    out = T.toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "c0", "score"]
    rows = {r.doc_id: r.score for r in out.collect()}
    assert out.count() == 4 and rows[1] >= T.THRESHOLD > max(rows[None], rows[2])
    assert T.toxicity(docs.limit(0), model).count() == 0


def test_sample_is_bounded_and_tolerates_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 1) for i in range(50)] + [(None, "n", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(3, 1, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    toxic, clean = T.training_texts(docs, labels, 5, 7)
    assert len(toxic) <= 5 and len(clean) <= 7 and toxic and clean


def test_two_fillers_in_one_text_weigh_more_than_one():
    """A stem that begins insults also begins some words of clean texts: there it comes singly."""
    rng = random.Random(4)
    ends = ["".join(rng.choice("aeioumnr") for _ in range(3)) for _ in range(60)]

    def text(stems):
        words = ["".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "so"]) for _ in range(3)) for _ in range(20)]
        return " ".join(words + ["zukk" + rng.choice(ends) for _ in range(stems)])

    rows = [(text(4 if i % 6 == 0 else int(i % 6 == 1)), int(i % 6 == 0)) for i in range(1800)]
    made = T.train([t for t, y in rows[:1200] if y], [t for t, y in rows[:1200] if not y])
    score, truth = made.scores([t for t, _ in rows[1200:]]), np.array([y for _, y in rows[1200:]])
    assert ((score >= T.THRESHOLD) == truth).mean() > 0.95


def test_the_querys_held_out_rows(spark):
    """On the given tables: at least 0.8 of the toxic rows and a precision of 0.85 among rows that didn't train."""
    d = "/root/testdata/sf0.1"
    found = T.op7_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(int(r.toxic), r.predicted): r["count"] for r in found}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n[1, 0]) and n[1, 1] >= 0.85 * (n[1, 1] + n.get((0, 1), 0))


def test_several_labels_and_texts_of_one_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert T.training_texts(docs, labels) == (["a"], ["c"])
    empty = T.training_texts(docs.limit(0), labels.limit(0))
    assert empty == ([], []) and T.train(*empty).scores(["x"]).tolist() == [0]
