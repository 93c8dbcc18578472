import hashlib
import random
import re

import pytest

from strandex.llm import spotsigs


def signatures(text):
    """Anchor and chain by the definition."""
    w = re.findall(r"[^\W_]+", (text or "").lower())
    out = set()
    for i, x in enumerate(w):
        if x in spotsigs.ANCHORS:
            chain, anchors = [], 0
            for y in w[i + 1 :]:
                if y in spotsigs.ANCHORS:
                    anchors += 1
                    if anchors > spotsigs.AHEAD:
                        break
                else:
                    chain.append(y)
                    if len(chain) == spotsigs.CHAIN:
                        break
            out.add((x, *chain))
    if not out:
        out = set(w) or ({text.lower()} if text else set())
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_force(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + u[:q]
        s = signatures(t)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(s, signatures(edited)), 9), round(jaccard(s, signatures(u)), 9)))
    return sorted(out, key=str)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [*spotsigs.ANCHORS[:30], "Größe", "élan", "niño", *(f"w{i}" for i in range(80))]
    return [(3 * i - 40, rng.choice([" ", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 30, 200])))) for i in range(n)]


@pytest.mark.parametrize("neighbours", [2000, 7])
def test_as_by_brute_force(spark, monkeypatch, neighbours):
    monkeypatch.setattr(spotsigs, "NEIGHBOURS", neighbours)
    rows = [*texts(120, 1), (None, "the null id"), (5000, None), (5001, ""), (5002, "..."), (5003, "the of and in"), (5004, "日本 😀" * 9)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sigs string")
    got = spotsigs.fingerprints(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == brute_force(rows)
    by_text = {}
    for r in got:
        t = dict(rows)[r.doc_id]
        assert by_text.setdefault(t or "", r.fingerprint) == r.fingerprint
        assert len(r.fingerprint) == 8 * len(signatures(t))


def test_one_row_repeated_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "the only row of all")], "doc_id long, text string")
    (r,) = spotsigs.fingerprints(docs).collect()
    assert r.near_next == 1.0
    assert spotsigs.fingerprints(docs.union(docs).union(docs)).count() == 3
    assert spotsigs.fingerprints(docs.limit(0)).count() == 0


def brute_groups(rows, at_least):
    """id of each row's group by comparing all pairs."""
    sets = [signatures(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and jaccard(a, b) >= at_least and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted((i, len(t or ""), min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None)) for (i, t), g in zip(rows, group, strict=True))


def groups(spark, rows, at_least):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, group int")
    return sorted((r.doc_id, r.n_chars, r.group_id) for r in spotsigs.fingerprints(docs, at_least=at_least).collect())


@pytest.mark.parametrize("stars,chunk,changed", [(5, 1000, 0.01), (0, 3, 0.01), (1, 2, 0.05), (5, 1000, 0.05)])
def test_groups_as_by_brute_force(spark, monkeypatch, stars, chunk, changed):
    monkeypatch.setattr(spotsigs, "STARS", stars)
    monkeypatch.setattr(spotsigs, "CHUNK", chunk)
    rng = random.Random(4)
    rows = []
    for _, t in texts(30, 9):
        w = t.split()
        for _ in range(6):
            rows.append((len(rows), " ".join(x if rng.random() > changed else f"changed{rng.randrange(9)}" for x in w)))
    rng.shuffle(rows)
    want = brute_groups(rows, 0.7)
    assert groups(spark, rows, 0.7) == want
    assert 30 < len({g for _, _, g in want}) < 180


def test_groups_of_odd_rows(spark):
    a, b = "the quick fox and the lazy dog of a very old house", "the slow cow and the busy bee of a very new barn"
    docs = [(1, a), (1, b), (None, a), (None, a + " and one more thing"), (2, None), (3, ""), (4, b), (None, "alone in the world")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.doc_id, r.n_chars, r.group_id) for r in spotsigs.fingerprints(frame, at_least=0.5).collect()]
    want = [(1, len(a), 1), (1, len(b), 1), (None, len(a), 1), (None, len(a) + 19, 1), (2, 0, 2), (3, 0, 3), (4, len(b), 1), (None, 18, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert spotsigs.near_groups(frame.limit(0)).count() == 0
    assert spotsigs.near_groups(frame.where("doc_id = 2")).count() == 0


def test_a_passage_of_all_texts_makes_no_group(spark):
    rng = random.Random(6)
    rows = [(i, "the shared opening words. " + " ".join(f"the w{rng.randrange(10_000)} v{rng.randrange(10_000)}" for _ in range(20))) for i in range(1500)]
    assert spotsigs.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_lists_go_through_one_shuffle_and_late_places_make_no_pairs(spark, monkeypatch):
    """Texts that share the last signatures of their prefixes alone are never compared; near copies among them are linked."""
    plans, pairs = {}, []

    def written(df, label):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        out = kept(df, label)
        if label == "pairs":
            pairs.append(out.count())
        return out

    kept = spotsigs.written
    monkeypatch.setattr(spotsigs, "written", written)
    rng = random.Random(8)
    shared = [f"the s{i} t{i}" for i in range(85)]
    rows = [(i, " ".join([f"the u{rng.randrange(10**6)} v{rng.randrange(10**6)}" for _ in range(15)] + shared)) for i in range(30)]
    rows += [(30 + i, rows[i][1] + " the end comes") for i in range(3)]
    got = spotsigs.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 0.8)
    want = [g for _, _, g in brute_groups(rows, 0.8)]
    assert sorted(r.group for r in got.collect()) == sorted(g for g in want if want.count(g) > 1)
    assert plans["lists"].count("Exchange hashpartitioning(key") == 1
    assert sum(pairs) < 30 * 29 // 2
