import zlib
from collections import defaultdict

from strandex.llm import sharding


def collected(spark, rows, count=4):
    docs = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, size int, shard int")
    return sharding.shards(docs, count).collect()


def test_all_rows_once_near_equal_and_gapless(spark):
    rows = [(i, f"{i} " + "x" * (i * 37 % 400)) for i in range(3000)] + [(None, None), (None, ""), (7, "copy"), (7, "copy")]
    got = collected(spark, rows)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total = sum(r.size for r in got)
    assert sorted(by) == [0, 1, 2, 3]
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 4) < total / 4 * 0.03


def test_small_groups_stay_whole_and_a_huge_one_is_divided(spark):
    rows = [(i, "hot" * 50) for i in range(1500)] + [(2000 + i, f"group {i // 5} " * 5) for i in range(1500)]
    got = collected(spark, rows)
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert len(shards[zlib.crc32(b"hot" * 50)]) > 1
    assert sum(len(s) > 1 for s in shards.values()) <= 4
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_groups_beside_huge_ones_stay_whole(spark):
    rows = [(i, f"hot {i % 3} " * 20) for i in range(1800)] + [(2000 + i, f"group {i // 3} " * 3) for i in range(6000)]
    shards = defaultdict(set)
    for r in collected(spark, rows):
        shards[r.text_crc32].add(r.shard)
    assert all(len(shards[zlib.crc32(t.encode())]) == 1 for i, t in rows if i >= 2000)


def test_huge_groups_of_one_id_or_none_are_divided(spark):
    rows = [(None, "none " * 30)] * 1500 + [(7, "seven " * 30)] * 1500 + [(2000 + i, f"{i} " * 10) for i in range(500)]
    got = collected(spark, rows)
    shards, sizes = defaultdict(set), defaultdict(int)
    for r in got:
        shards[r.doc_id].add(r.shard)
        sizes[r.shard] += r.size
    assert len(got) == 3500 and len(shards[None]) > 1 and len(shards[7]) > 1
    assert len(sizes) == 4 and max(sizes.values()) < 1.1 * min(sizes.values())


def test_empty_table(spark):
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_buckets_are_those_of_a_bisection(spark):
    from bisect import bisect_right

    from strandex.llm.sharding import bucket

    for n in (1, 2, 3, 7, 8, 9, 27, 64, 1000):
        splitters = [3 * i - 50 for i in range(n)]
        df = spark.createDataFrame([(x,) for x in [-(1 << 62), -51, -50, -49, 0, 1, 3 * n - 54, 3 * n - 53, 3 * n, 1 << 62, *range(-60, 3 * n, 17)]], "key long")
        for r in df.withColumn("b", bucket("key", splitters)).collect():
            assert r.b == bisect_right(splitters, r.key), (n, r.key)


def test_extra_columns_and_tables_without_rows(spark):
    docs = spark.createDataFrame([(1, "a", 5, 1), (None, None, 6, 2), (1, "a", 5, 1)], "doc_id long, text string, shard int, range int")
    got = sharding.shards(docs, 2)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and got.count() == 3
    assert sharding.shards(docs.limit(0), 2).count() == 0
