import os

import numpy as np
import pytest

from strandex.llm import media as M


def slow_fingerprint(pcm):
    """Filters summed box by box, without the integral image."""
    image = M.chroma(pcm)
    out = []
    for i in range(len(image) - M.WIDTH + 1):

        def box(t0, t1, c0, c1, i=i):
            return sum(image[i + t, c % 12] for t in range(t0, t1) for c in range(c0, c1))

        word = 0
        for kind, c, h, w in M.FILTERS:
            if kind == 0:
                a, b = box(0, w, c, c + h), box(0, w, 0, 12) * h / 12
            elif kind == 1:
                a, b = box(0, w // 2, c, c + h), box(w // 2, w, c, c + h)
            elif kind == 2:
                a, b = box(0, w, c, c + h // 2), box(0, w, c + h // 2, c + h)
            else:
                a, b = box(w // 4, 3 * w // 4, c, c + h), box(0, w // 4, c, c + h) + box(3 * w // 4, w, c, c + h)
            v = np.log((1 + a) / (1 + b))
            word = word << 2 | (0, 1, 3, 2)[sum(v >= x for x in M._CUTS)]
        out.append(word)
    return out


def tune(seed, n=48):
    return M.rendered(np.random.default_rng(seed).uniform(-0.3, 0.3, n)[:24])


def test_filters_as_by_definition():
    got = M.fingerprint(tune(1)).tolist()
    want = slow_fingerprint(tune(1))
    assert len(got) == len(want) > 5
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) > 0.95  # sums may round to either side of a cut


def test_pitch_classes():
    t = np.arange(M.RATE) / M.RATE
    for semitone in range(12):
        tone = (9000 * np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t)).astype("<i2").tobytes()
        assert M.chroma(tone).mean(axis=0).argmax() == semitone


def test_short_odd_and_no_audio(spark):
    rows = [(1, None), (2, b""), (3, b"\x01"), (None, tune(1)), (4, tune(1)), (4, tune(1))]
    out = M.fingerprints(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio").collect()
    assert len(out) == 6 and {len(r.prints) for r in out if r.n_samples < 3} == {0}
    assert len({tuple(r.prints) for r in out if r.n_samples > 3}) == 1


def test_alignment_finds_a_noisy_excerpt(spark):
    rng = np.random.default_rng(7)
    long_ = {i: b"".join(tune(100 * i + j) for j in range(3)) for i in range(12)}
    classes = spark.createDataFrame([(i, M.fingerprint(p).tolist()) for i, p in long_.items()], "class long, prints array<long>")
    cut = 20
    queries = []
    for i, p in long_.items():
        x = np.frombuffer(p, "<i2")[cut * M.HOP : cut * M.HOP + 4 * M.RATE]
        queries.append((100 + i, M.fingerprint((x + rng.normal(0, 60, len(x))).astype("<i2").tobytes()).tolist()))
    found = {r.query: r for r in M.matched(spark.createDataFrame(queries, "query long, prints array<long>"), classes).collect()}
    assert all(found[100 + i].match == i and found[100 + i].offset == cut and found[100 + i].bit_error < 0.15 for i in long_)


def test_every_component_becomes_sound(spark, tmp_path):
    v = np.random.default_rng(3).uniform(-0.3, 0.3, 64)
    w = np.concatenate([v[:40], -v[40:]])  # differs from component 41 on only
    assert len(M.rendered(v)) == 2 * 64 * M.RATE // 8 and M.rendered(None) == M.rendered([]) == b""
    rows = [(i, x.tolist()) for i, x in enumerate([v, w, v, v[:30]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {r.vec_id: r for r in M.op1_chroma(spark, str(tmp_path)).collect()}
    assert [out[i].n_samples for i in range(4)] == [64_000, 64_000, 64_000, 30_000]
    assert [out[i].class_id for i in range(4)] == [0, 1, 0, 3]


def brute_force(queries, classes):
    """Least error, class and offset of each query: every class and offset, bits counted one by one."""
    out = {}
    for name, a in queries.items():
        found = []
        for other, b in classes.items():
            if other == name or not len(a) or not len(b):
                continue
            least = max(1, -(-min(len(a), len(b)) // 2))
            for offset in range(-len(a) + 1, len(b)):
                first, last = max(0, -offset), min(len(a), len(b) - offset)
                if last - first >= least:
                    x = np.array(a[first:last]) ^ np.array(b[first + offset : last + offset])
                    found.append((int(np.unpackbits(x.astype("<u4").view(np.uint8)).sum()) / (32 * (last - first)), other, abs(offset), offset))
        if found and min(found)[0] <= M.MAX_ERROR:
            out[name] = (min(found)[1], min(found)[3], min(found)[0])
    return out


def test_recall_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    out = M.op1_chroma(spark, d).collect()
    prints = {r.vec_id: M.fingerprint(M.rendered(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    classes = {r.class_id: prints[r.class_id] for r in out}
    want = brute_force({r.class_id: prints[r.class_id] for r in out if r.vec_id % 50 == 0}, classes)
    got = {r.class_id: (r.match_class, r.offset, r.bit_error) for r in out if r.vec_id % 50 == 0 and r.match_class is not None}
    assert len(want) >= 10
    assert sum(got.get(k) == v for k, v in want.items()) / len(want) >= 0.9
    assert got.keys() <= want.keys()


def test_search_of_any_lengths_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 32, 90)
    rows = {}
    for i, n in enumerate([1, 2, 7, 7, 30, 30, 31, 64, 90, 90, 90]):
        noise = (rng.random((n, 32)) < 0.04 * i) @ (1 << np.arange(32))
        rows[i] = base[:n] ^ noise
    rows[11], rows[12] = rows[9].copy(), rng.integers(0, 1 << 32, 40)
    found = M.search(list(rows.items()), list(rows.items()))
    got = {}
    for i, j, offset, error in sorted(found, key=lambda x: (x[0], x[1])):
        got.setdefault(i, (j, offset, error))
    assert got == brute_force(rows, rows)
