"""Files: parsing, splits, blocked gzip, FAI and GZI."""

import gzip
import io
import os
import random
import struct
import tracemalloc

import pytest
from pyspark.sql import functions as F

from strandex import file_queries
from strandex.operators import fetch
from strandex.plans import build
from strandex.session import SeqIndex
from strandex.sources import bgzf as Z
from strandex.sources import fasta as S
from strandex.sources import files
from strandex.sources.bgzf import EOF_BLOCK
from strandex.sources.bgzf import block as bgzf_block
from strandex.sources.indexes import read_fai, read_gzi


def bgzf(data: bytes, size: int = 60_000) -> bytes:
    return b"".join(bgzf_block(data[i : i + size]) for i in range(0, len(data), size)) + EOF_BLOCK


def scanned(file, low=0, high=1 << 60, keep=True):
    """id, header, offset, length, bases, width, sequence"""
    out = []
    for r in S.scan(file, low, high, keep):
        sequences = r.sequence if keep else [None] * len(r.id)
        out += zip(r.id, r.header, r.first.tolist(), r.length.tolist(), r.bases.tolist(), r.width.tolist(), sequences, strict=True)
    return out


def parse(data: bytes, tmp_path, low=0, high=1 << 60, chunk=7):
    p = tmp_path / "x.fa"
    p.write_bytes(data)
    return scanned(Z.PlainFile(str(p), chunk), low, high)


def test_offsets_and_layouts(tmp_path):
    assert parse(b">zeta description\nACGT\nAC\n>alpha\nTTT\n", tmp_path) == [("zeta", "zeta description", 18, 6, 4, 5, b"ACGTAC"), ("alpha", "alpha", 33, 3, 3, 4, b"TTT")]


@pytest.mark.parametrize(
    ("data", "message"),
    [
        (b"\n>a\nA\n", "before the first"), (b"A\n", "before the first"), (b">\nA\n", "no ID"), (b"> x\nA\n", "no ID"),
        (b">a\nA\n\nC\n", "empty"), (b">a\nA\n\n", "empty"), (b">a\nA C\n", "white space"), (b">a\nA\tC\n", "white space"), (b">a\rA\n", "line end"),
        (b">a\nAC\rG\n", "white space"), (b">a\nACGT\nAC\nACGT\n", "differs"), (b">a\nAC\nACGT\n", "longer"), (b">a\n>b\nA\n", "no sequence"), (b">a\n", "no sequence"),
        (b">\xff\nA\n", "UTF-8"), (b">a x\ry\nA\n", "line end"), (b";c\n>a\nA\n", "before the first"),
    ],
)
def test_errors(data, message, tmp_path):
    with pytest.raises(S.FastaError, match=message):
        parse(data, tmp_path)


def test_accepted_oddities(tmp_path):
    assert parse(b"", tmp_path) == []
    assert parse(b">a\nACGT", tmp_path)[0][3:6] == (4, 4, 4)
    assert parse(b">a d\r\nACGT\r\nAC\r\n", tmp_path)[0] == ("a", "a d", 6, 6, 4, 6, b"ACGTAC")
    assert parse(b">a\x0bb\xc2\xa0c d\nA\n", tmp_path)[0][0] == "a\x0bb\xa0c"
    assert parse(b">a\nA>C\n;x\n"[:7], tmp_path)[0][6] == b"A>C"
    assert parse(b">a\n\xff\xfe\n", tmp_path)[0][6] == b"\xff\xfe"
    assert parse(b">a\nACGT\nACGT\r\n", tmp_path)[0][3] == 8


def fasta(n=60, seed=0):
    rng = random.Random(seed)
    out = io.BytesIO()
    for i in range(n):
        s = bytes(rng.choices(b"ACGTN", k=rng.choice([1, 5, 59, 60, 61, 500, 3000])))
        width = rng.choice([10, 60, 70])
        end = rng.choice([b"\n", b"\r\n"])
        out.write(b">id%d" % (i % 40) + rng.choice([b"", b" some words", b"\ttab"]) + end + b"".join(s[j : j + width] + end for j in range(0, len(s), width)))
    return out.getvalue()


@pytest.mark.parametrize("chunk", [1, 7, 61, 4 << 20])
def test_chunks_change_nothing(tmp_path, chunk):
    data = fasta(20, 5)
    lines = data.split(b">")[1:]
    want = []
    for record in lines:
        head, _, body = record.partition(b"\n")
        want.append((head.rstrip(b"\r").decode(), body.replace(b"\r", b"").replace(b"\n", b"")))
    assert [(r[1], r[6]) for r in parse(data, tmp_path, chunk=chunk)] == want
    assert all(len(r[6]) == r[3] for r in parse(data, tmp_path, chunk=chunk))


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
@pytest.mark.parametrize("blocked", [False, True])
@pytest.mark.parametrize("keep", [False, True])
def test_splits_and_blocks_change_nothing(tmp_path, split, blocked, keep):
    data = fasta()
    plain = parse(data, tmp_path)
    p = tmp_path / "y.fa"
    cut = bgzf_block(data[:100]) + bgzf_block(b"") + bgzf(data[100:], 333)
    stored = cut if blocked else data
    p.write_bytes(stored)
    file = Z.BgzfFile(str(p), 900) if blocked else Z.PlainFile(str(p), 50)
    assert file.size == len(stored)
    got = [r for low in range(0, len(stored), split) for r in scanned(file, low, min(low + split, len(stored)), keep)]
    if not keep:
        plain = [(*r[:6], None) for r in plain]
    if not blocked:
        assert got == plain
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in plain]
    for r in got if keep else []:
        assert fetch.read_sequence(file.read(r[2]), *r[3:6]) == r[6]


def test_cuts_at_every_place(tmp_path):
    data = b">a d\nACGT\nAC\n>b\nT\n>c\r\nGG\r\nG\r\n>d\nA"
    want = parse(data, tmp_path)
    assert len(want) == 4
    p = tmp_path / "x.gz"
    for place in range(1, len(data)):
        assert parse(data, tmp_path, 0, place) + parse(data, tmp_path, place) == want
        first = bgzf_block(data[:place])
        p.write_bytes(first + bgzf_block(data[place:]) + EOF_BLOCK)
        file = Z.BgzfFile(str(p))
        for at in (1, len(first), len(first) + 1):
            assert [r[1:2] + r[3:] for r in scanned(file, 0, at) + scanned(file, at)] == [r[1:2] + r[3:] for r in want]


def test_a_line_of_many_chunks_is_not_held(tmp_path):
    p = tmp_path / "long.fa"
    p.write_bytes(b">one\n" + b"A" * 100_000 + b"\n>two\nC\n")
    file = Z.PlainFile(str(p), 1000)
    assert [r[:6] for r in scanned(file, keep=False)] == [("one", "one", 5, 100_000, 100_000, 100_001), ("two", "two", 100_011, 1, 1, 2)]


def test_a_line_at_a_block_start_has_the_new_blocks_address(tmp_path):
    first, second = bgzf_block(b">a\n"), bgzf_block(b"ACGT\n")
    p = tmp_path / "z.gz"
    p.write_bytes(first + second + EOF_BLOCK)
    (r,) = scanned(Z.BgzfFile(str(p)))
    assert r[2] == len(first) << 16


def test_a_block_is_found_only_where_one_is(tmp_path):
    inner = bgzf_block(b"decoy")[:-1]  # a header that doesn't hold what it says
    data = b"x" * 10 + inner + b"y" * 10
    stored = Z._MAGIC  # noqa: F841
    one = bgzf_block(data)
    p = tmp_path / "d.gz"
    p.write_bytes(one + bgzf_block(b"z\n") + EOF_BLOCK)
    with open(p, "rb") as f:
        size = f.seek(0, 2)
        assert [Z.first_block(f, x, size) for x in (0, 1, len(one), size - 5)] == [0, len(one), len(one), size]


@pytest.mark.parametrize("cut", [gzip.compress(b">a\nA\n"), bgzf(b">a\nACGT\n")[:20], bgzf(b">a\nACGT\n")[:5]])
def test_broken_blocks(cut, tmp_path):
    p = tmp_path / "b.gz"
    p.write_bytes(cut)
    with pytest.raises(Z.BgzfError):
        list(Z.walk(str(p)))


def test_damaged_data(tmp_path):
    data = bytearray(bgzf_block(b">a\nACGT\n"))
    data[-6] ^= 1
    p = tmp_path / "d.gz"
    p.write_bytes(data)
    with pytest.raises(Z.BgzfError):
        b"".join(Z.BgzfFile(str(p)).read(0))


@pytest.mark.parametrize("blocked", [False, True])
def test_index_and_fetch_of_files(spark, tmp_path, blocked):
    data = fasta(80, 3)
    p = tmp_path / "all.fa"
    p.write_bytes(bgzf(data, 700) if blocked else data)
    index = SeqIndex.open_or_build(spark, str(p))
    assert index.stats().first().record_count == 80
    want = parse(data, tmp_path)
    rows = index.fetch(None, pattern="", by_offset=True).orderBy("out_pos").collect()
    assert [(r.full_id, r.header, bytes(r.sequence)) for r in rows] == [(w[0], w[1], w[6]) for w in want]
    numbers = index.frame.orderBy("record_id").collect()
    assert [r.record_id for r in numbers] == list(range(80))
    assert [(r.full_id, r.input_ordinal) for r in numbers] == sorted((r.full_id, r.input_ordinal) for r in numbers)
    out = tmp_path / "out.fa"
    assert fetch.write_fasta(index.fetch(["id3", "id1"]), str(out)) == len([w for w in want if w[0] in ("id1", "id3")])
    text = out.read_bytes()
    assert text.startswith(b">id3") and all(len(x) <= 60 or x.startswith(b">") for x in text.split(b"\n"))


def test_empty_file_makes_an_empty_index(spark, tmp_path):
    p = tmp_path / "none.fa"
    p.write_bytes(b"")
    s = build.build_index(spark, str(p)).first()
    assert (s.record_count, s.block_count, s.ratio) == (0, 0, 0.0)


def test_fai_and_gzi(spark, tmp_path):
    fai, gzi = tmp_path / "x.fai", tmp_path / "x.gzi"
    fai.write_text("zeta\t10\t30\t10\t11\nalpha\t20\t0\t20\t21\n\nduplicate\t5\t20\t5\t6\textra\r\nduplicate\t0\t10\t5\t6\n")
    gzi.write_bytes(struct.pack("<Q", 0))
    build.build_index_from_fai(spark, str(fai), str(gzi))
    index = SeqIndex.open(spark, f"{fai}.seqidx")
    assert [r.virtual_offset for r in index.exact(["duplicate"]).orderBy("record_id").collect()] == [20, 10]
    assert [r.full_id for r in index.prefix(["a"]).collect()] == ["alpha"]
    gzi.write_bytes(struct.pack("<QQQQQ", 2, 100, 10, 300, 25))
    assert [tuple(r) for r in read_gzi(spark, str(gzi)).orderBy("compressed").collect()] == [(100, 10), (300, 25)]
    rows = {(r.full_id, r.input_ordinal): r.virtual_offset for r in build.fai_records(spark, str(fai), str(gzi), "x").collect()}
    assert rows == {("zeta", 0): 300 << 16 | 5, ("alpha", 1): 0, ("duplicate", 3): 100 << 16 | 10, ("duplicate", 4): 100 << 16}


def test_one_blocked_file_is_written_and_walked_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 400, 1, 3).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("header"), F.expr("cast(repeat(substr('ACGTTGCA', 1 + id % 5), 900) as binary)").alias("sequence"), (400 - F.col("id")).alias("out_pos"))
    for module in (fetch, file_queries):
        monkeypatch.setattr(module, "SPLIT", 1500)
    one, gzi = f"file://{tmp_path}/one.fa.gz", f"{tmp_path}/one.gzi"
    sizes, spans, join, each = [], [], fetch.joined, fetch.each
    monkeypatch.setattr(fetch, "joined", lambda s, paths, *a: (sizes.extend(map(files.length, paths)), join(s, paths, *a)))
    monkeypatch.setattr(fetch, "each", lambda s, items, *a: (spans.extend(items), each(s, items, *a))[1])
    fetch.write_fasta_file(rows, one, compression="bgzf")
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)  # no task writes all rows
    assert len(spans) > 4 and max(high - low for _, low, high, _ in spans) <= 1500  # or copies them
    assert os.listdir(tmp_path) == ["one.fa.gz"]
    stored = (tmp_path / "one.fa.gz").read_bytes()
    assert gzip.decompress(stored) == b"".join(S.record_bytes(r.header, bytes(r.sequence)) for r in rows.orderBy("out_pos").collect())
    assert stored.count(Z.EOF_BLOCK) == 1 and stored.endswith(Z.EOF_BLOCK)
    file_queries.write_gzi(spark, one, gzi)
    want, at = [], 0
    for address, _, size in Z.walk(one):
        want.append((address, at))
        at += size
    assert len(want) > 4 and [tuple(r) for r in read_gzi(spark, gzi).orderBy("compressed").collect()] == want[1:]
    spans = [(low, low + 1500) for low in range(0, len(stored), 1500)]
    assert [b for s in spans for b in Z.walk(one, *s)] == list(Z.walk(one))


def test_small_rows_of_large_sequences_are_fetched_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fetch, "PLAIN_BITS", 12)
    (tmp_path / "x.fa").write_bytes(fasta(200, 5))
    index = SeqIndex.open_or_build(spark, str(tmp_path / "x.fa"))
    found = index.fetch(None, pattern="").select(F.spark_partition_id().alias("task"))
    assert len({r.task for r in found.collect()}) > 1


@pytest.mark.parametrize("blocked", [False, True])
def test_fetching_holds_little(tmp_path, blocked):
    data = b">a\n" + b"ACGT" * 15 + b"\n" + b">b\n" + (b"ACGT" * 15 + b"\n") * 150_000 + b"ACG\n"
    (tmp_path / "x.fa").write_bytes(bgzf(data) if blocked else data)
    file = Z.open_file(str(tmp_path / "x.fa"))
    assert fetch.stored_bytes(60, 60, 61) == 60 and fetch.stored_bytes(61, 60, 61) == 62 and fetch.stored_bytes(0, 60, 61) == 0
    short = sum(map(len, file.read(3, 60)) if not blocked else [len(next(file.read(3, 60)))])
    assert short == 60 if not blocked else short <= Z.LARGEST  # not a whole chunk for a short record
    r = scanned(file)[1]
    tracemalloc.start()
    found = fetch.read_sequence(file.read(r[2], fetch.stored_bytes(*r[3:6])), *r[3:6])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == r[6] and most < 3.5 * len(found)  # no object for each line


def test_one_file_of_no_rows_and_of_streams(spark, tmp_path, monkeypatch):
    none = spark.createDataFrame([], "header string, sequence binary, out_pos long")
    fetch.write_fasta_file(none, f"{tmp_path}/none.fa.gz", compression="bgzf")
    assert (tmp_path / "none.fa.gz").read_bytes() == Z.EOF_BLOCK
    rows = spark.range(50).select(F.col("id").cast("string").alias("header"), F.lit(b"ACGT").alias("sequence"), F.col("id").alias("out_pos"))
    fetch.write_fasta_file(rows, f"{tmp_path}/a.fa")
    monkeypatch.setattr(fetch.files, "placed", lambda path: None)
    fetch.write_fasta_file(rows, f"{tmp_path}/b.fa")
    assert (tmp_path / "a.fa").read_bytes() == (tmp_path / "b.fa").read_bytes() == b"".join(b">%d\nACGT\n" % i for i in range(50))


@pytest.mark.parametrize("line", ["a\t1\t2\t3", "a\tx\t2\t3\t4", "a\t-1\t2\t3\t4", "a\t9223372036854775808\t2\t3\t4"])
def test_bad_fai(spark, tmp_path, line):
    p = tmp_path / "bad.fai"
    p.write_text(line + "\n")
    with pytest.raises(Exception):  # noqa: B017
        read_fai(spark, str(p)).collect()


def test_place_past_a_block_is_an_error(spark, tmp_path):
    fai, gzi = tmp_path / "far.fai", tmp_path / "far.gzi"
    fai.write_text("a\t1\t65536\t1\t2\n")
    gzi.write_bytes(struct.pack("<Q", 0))
    with pytest.raises(Exception):  # noqa: B017
        build.fai_records(spark, str(fai), str(gzi), "x").collect()
