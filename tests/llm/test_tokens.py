import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandex.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "  a", "a  b \n c", "x<|endoftext|> y <|endoftext|>", "  a", "a\x1c b", "a\n b", "it's don't 's", "日本 語  z", "a 　 b", "é" * 70 + " b", "tab\t x", "\r\n \r\n", " x  ", "á ² ½ x2 3a"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_have_the_library_ids(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    cached = bpe.Cached(PATH)
    assert np.frombuffer(cached.encoded(text), "<u4").tolist() == want
    assert cached.count(text) == len(want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\tab'sé<|>1.")), st.characters(codec="utf-8")), max_size=40))
def test_any_text_has_the_library_ids(text):
    cached = bpe.Cached(PATH, most=5)
    assert np.frombuffer(cached.encoded(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_counts_of_all_rows(spark):
    rows = [(None, "a b"), (1, None), (1, ""), (2, "word " * 3000), (2, "word " * 3000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in token_counts.token_counts(docs, PATH).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(LIBRARY.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows), key=str)
    assert got == want
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0


def check_packing(rows, texts, capacity):
    by, seen = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        seen.setdefault(r.doc_id, []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for i, t in texts.items():
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(seen[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // capacity)
        at = 0
        for r in own:
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    return len(by)


def test_packing_whole_documents(spark):
    rng = np.random.default_rng(0)
    texts = {i: " ".join(["token"] * int(rng.integers(0, 200))) for i in range(300)} | {300: None, 301: "", 302: "long " * 5000}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, piece int")
    rows = packing.pack(packing.pieces(docs, PATH, 128), 128, group=60).collect()
    bins = check_packing(rows, texts, 128)
    bound = packing.lower_bound(np.bincount([r.length for r in rows], minlength=129), 128)
    assert bound <= bins <= bound * 1.05 + 3
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_packing_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH).collect()
    assert len(rows) == 4 and len({r.sequence_id for r in rows}) == 1


def test_exchanges_go_on_while_they_save(spark):
    lengths = np.random.default_rng(4).integers(20, 45, 3000).tolist()
    rows = spark.createDataFrame([(i, 0, 0, x, 0, i * 7919) for i, x in enumerate(lengths)], "doc_id long, piece long, start long, length long, ids_crc32 long, deal long")
    two = packing.pack(rows, 100, group=60, rounds=2).select("sequence_id").distinct().count()
    out = packing.pack(rows, 100, group=60).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    assert len({r.sequence_id for r in out}) < two
    more, gaps = packing.packed_with_gap(rows, 100, group=60)
    fewer, gaps_before = packing.packed_with_gap(rows, 100, group=60, rounds=0)
    assert 0 <= gaps < gaps_before and more.count() == fewer.count() == 3000


def test_bound_never_exceeds_the_best(spark):
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 21, int(rng.integers(1, 9)))
        best = min_bins(sorted(lengths.tolist(), reverse=True), 20)
        assert packing.lower_bound(np.bincount(lengths, minlength=21), 20) <= best
        bins, offsets, made = packing.best_fit_decreasing(lengths, 20)
        assert made >= best and np.bincount(bins, weights=lengths).max() <= 20


def min_bins(items, capacity):
    best = len(items)

    def place(k, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if k == len(items):
            best = len(loads)
            return
        for j in range(len(loads)):
            if loads[j] + items[k] <= capacity:
                place(k + 1, [*loads[:j], loads[j] + items[k], *loads[j + 1 :]])
        place(k + 1, [*loads, items[k]])

    place(0, [])
    return best
