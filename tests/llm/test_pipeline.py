from collections import Counter

import corpus_pipeline as P
import pytest

from strandex.llm import ngram_join
from tests.llm.test_ngram_join import brute_force, near_copies

SF = "/root/testdata/sf0.001"


def test_one_row_of_each_group_stays(spark):
    rows = near_copies(11)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = ngram_join.without_near_copies(docs)
    assert out.columns == docs.columns
    want = {c if n else d for d, n, c in brute_force(rows, 5, 4, 5)}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    a = " ".join(f"a{i}" for i in range(50))
    rows = [(1, a, 1), (1, a, 2), (None, a + " b", 3), (5, "other text here", 4), (None, None, 5), (None, None, 6), (7, " ", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash int")
    out = ngram_join.without_near_copies(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter([None, 5, None, None, 7])
    assert ngram_join.without_near_copies(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, f in P.STAGES:
        docs = P.written(f(spark, docs, SF), name)
        out[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_stages_keep_what_they_should(stages):
    docs = {r.doc_id: r for r in stages["documents"]}
    clean = {r.doc_id for r in stages["toxicity"]}
    assert clean < set(docs) and len(clean) > 0.7 * len(docs)
    kept = {r.doc_id for r in stages["near_copies"]}
    want = {c if n else d for d, n, c in brute_force([(r.doc_id, r.text) for r in stages["toxicity"]], 5, 4, 5)}
    assert kept == want
    mixed = Counter(r.doc_id for r in stages["mixing"])
    assert set(mixed) == kept and max(mixed.values()) <= 3
    packed = stages["packing"]
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_run_is_its_stages(spark, stages):
    assert P.run(spark, SF).count() == len(stages["packing"])


def test_mixed_rows_stand_in_order_of_epoch_and_turn(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1), "en", "ab"[i % 10 == 0], 1) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    rows, _ = P.mixing.mixture(docs, entropy=0.95, repetition=2.0)
    turns = {}
    for r in rows.collect():
        turns.setdefault(r.row.doc_id, []).append((r.epoch, r.turn))
    assert len({t for own in turns.values() for t in own}) > 2
    at = []
    for r in P.mixed(spark, docs, SF).collect():  # copies of a row come in order of epoch
        turns[r.doc_id].sort()
        at.append(turns[r.doc_id].pop(0))
    assert at == sorted(at) and not any(turns.values())
