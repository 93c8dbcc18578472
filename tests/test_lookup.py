"""Queries, patterns, order, missing, and the queries' SQL."""

import os
import re
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from strandex.functions import text as T
from strandex.functions.regex import UnsupportedPattern, compiled, to_java
from strandex.operators import lookup as K
from strandex.operators import ordered as O
from strandex.plans.build import valid
from strandex.session import SeqIndex

ROWS = [("a", "a", 10), ("duplicate", "duplicate first description", 20), ("duplicate", "duplicate second description", 30), ("duplicate", "duplicate", 40), ("prefix-1", "prefix-1", 50), ("prefix-2", "prefix-2", 60), ("z", "z", 70)]


@pytest.fixture(scope="module")
def index(spark):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "record_id long, full_id string, header string, virtual_offset long")
    return SeqIndex(spark, "", frame)


def offsets(df, order="record_id"):
    return [r.virtual_offset for r in df.orderBy(order).collect()]


def test_exact_prefix_and_patterns(index):
    assert offsets(index.exact(["duplicate"])) == [20, 30, 40]
    assert offsets(index.exact(["duplicate second description"])) == [30]
    assert offsets(index.exact(["missing", "duplicate  second description"])) == []
    assert offsets(index.exact([f"x{i}" for i in range(30)] + ["z"])) == [70]
    assert offsets(index.prefix(["prefix-"])) == [50, 60]
    assert offsets(index.prefix(["duplicate first"])) == [20]
    assert offsets(index.prefix(["dup fi"])) == []
    assert offsets(index.regex("^(a|z)$")) == [10, 70]
    assert len(offsets(index.regex("^(a|z)$", True))) == 5
    assert offsets(index.regex("second description$")) == [30]
    assert len(offsets(index.regex(""))) == 7 and offsets(index.regex("", True)) == []


def test_order_repeats_and_union(index):
    assert offsets(index.find(["z", "duplicate", "a", "z"]), "out_pos") == [70, 20, 30, 40, 10]
    assert offsets(index.find(["z"], pattern="prefix|z"), "out_pos") == [70, 50, 60]
    assert offsets(index.find(["z", "a"], pattern="second", by_offset=True), "out_pos") == [10, 30, 70]
    assert offsets(index.find(["z"], pattern="a|dup", invert=True), "out_pos") == [70, 50, 60]


def test_missing_counts_each_repeat(index):
    assert [(r.q_ord, r["query"]) for r in index.missing(["no", "z", "z", "", " > no "]).orderBy("q_ord").collect()] == [(0, "no"), (4, "no")]
    assert index.missing(["prefix-1", "pre"], "prefix").count() == 0


def test_what_is_refused(index):
    for wrong in (dict(), dict(ids=[]), dict(ids=["a"], invert=True), dict(ids=["a"], pattern="("), dict(ids=["a"], mode="fuzzy")):
        with pytest.raises(Exception):  # noqa: B017
            index.find(**wrong).collect()


@pytest.mark.parametrize(("raw", "want"), [("seq1 description", "seq1 description"), (">seq1 description\n", "seq1 description"), ("  seq1  ", "seq1"), (">>x", ">x"), ("> x", "x"), ("　x\u0085", "x"), ("​x\x1c", "​x\x1c")])
def test_normalized_queries(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "q string").select(T.normalize_query(F.col("q"))).first()[0] == want


def test_ids_end_at_ascii_white_space_only(spark):
    q = spark.createDataFrame([("a\x0bb c",), ("a b\tc",), ("\na",)], "q string")
    assert [r[0] for r in q.select(T.primary_id(F.col("q"))).collect()] == ["a\x0bb", "a b", ""]


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [(r"^\w+$", "é5", True), (r"^\w+$", "abc\u0085", False), ("(?i)é", "É", True), (r"(?P<n>b)c", "abc", True), ("c$", "abc\n", False), ("(?m)c$", "abc\nd", True), ("[[:alpha:]]+9", "ab9", True), ("(?U)a+", "aa", True), ("a.c", "a\rc", True), ("a.c", "a\nc", False), (r"a\$", "a$", True), ("[$]", "$", True),
     ("^a++$", "aaa", True), ("^(ab)**$", "abab", True), ("^a{2}{3}$", "aaaaaa", True), ("^a{2}{3}$", "aaaa", False), (r"\u{41}", "A", True), (r"^\x{e9}$", "é", True), (r"(?x)a # (", "a", True), ("(?x) a [b c] ", "ab", True),
     ("^[a-z--c]+$", "abd", True) , ("^[a-z--[c]]+$", "abc", False), ("^[[a-d]~~[c-f]]+$", "abef", True), ("^[[a-d]~~[c-f]]+$", "c", False), ("^[a-f&&[^c]]+$", "abd", True), ("[]a]", "]", True), ("[^]a]", "]", False),
     (r"\bcat\b", "a cat.", True), (r"\<cat\>", "a cats", False), (r"\p{Greek}", "α", True), (r"\pL\p{Nd}", "é5", True), (r"\P{Letter}", "a", False), (r"\p{^L}", "5", True), (r"\v", "\n", False), (r"\v", "\x0b", True),
     ("[[:alpha:]]", "é", False), ("(?i)straße", "STRAßE", True), ("(?:a|b(?i)c)d", "bCd", True), ("a|", "zzz", True), ("()", "", True), ("(?m)^b", "a\nb", True), ("a{,2}b", "aab", True), (r"[\w&&[^\d]]", "5", False), (r"[a\-z]", "-", True), ("[a-]", "-", True), ("a}", "a}", True), ("a]", "a]", True)],
)
def test_pattern_dialect(spark, pattern, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(compiled(spark, pattern))).first()[0] is want


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", r"(a)\1", "(?>a)", r"\k<n>", "(?-u)a", "(?R)a", "[a", "a\\", r"\Z", "(abc", "a)", "*a", "[z-a]", "a{2,1}", "a{", "(?P<n>a)(?P<n>b)", r"\u{110000}", "[[:no:]]", r"\p{a b!}", "(?ii)a", "(*)", "|*"])
def test_refused_patterns(pattern):
    with pytest.raises(UnsupportedPattern):
        to_java(pattern)


def test_pushdown_and_no_nested_loops(spark, tmp_path, index):
    index.frame.write.parquet(str(tmp_path / "i"))
    stored = SeqIndex(spark, str(tmp_path / "i"))
    plan = stored.exact(["a", "z"])._jdf.queryExecution().toString()
    assert "In(full_id" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
    few = stored.prefix(["a", "pre", "duplicate first"])._jdf.queryExecution().toString()
    assert "StringStartsWith(full_id,pre)" in few and "EqualTo(full_id,duplicate)" in few and "NestedLoop" not in few
    many = [f"{i % 10}" * (i % 5 + 1) for i in range(40)] + ["pref", "duplicate first"]
    plan = stored.prefix(many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "NestedLoop" not in plan
    assert offsets(stored.prefix(many)) == [20, 50, 60]


def _largest_join(df) -> int:
    """Rows that a join of df's plan made at most."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            p = p.executedPlan()
        if "QueryStage" in p.nodeName():
            p = p.plan()
        if "Join" in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
        plan += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_queries_with_descriptions_meet_equal_headers_only(spark):
    catalog = spark.range(3000).select(F.lit("x").alias("full_id"), F.concat(F.lit("x "), (F.col("id") % 1000).cast("string")).alias("header"))
    queries = catalog.select(F.monotonically_increasing_id().alias("q_ord"), F.col("header").alias("query"))
    for df in (K.exact(catalog, queries), K.exact_counts(catalog, queries)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"Join \[.*?\], \[(.*?)\], Inner", plan)
        assert len(keys) == 1 and re.search(r"\bquery#", keys[0])  # equal by the whole query, not by its ID alone
    assert K.exact(catalog, queries).count() == 9000
    counts = K.exact_counts(catalog, queries)
    assert _largest_join(counts) == 3000  # not 9,000 pairs, nor 9,000,000 of one ID
    assert {r.matches for r in counts.collect()} == {3}


def test_counts_are_those_of_lookups(spark, index):
    asked = ["duplicate", "duplicate second description", "duplicate", "a", "z x", "no", " >a ", "duplicate first description"]
    for queries in (asked, asked[1::6], ["duplicate"], [], [f"x{i}" for i in range(30)] + asked):
        got = {r.q_ord: r.matches for r in K.exact_counts(index.frame, K.query_list(spark, queries)).collect()}
        want = {}
        for i, q in enumerate(queries):
            n = sum(h == q.strip(" >") or i_ == q.strip(" >") for i_, h, _ in ROWS)
            want |= {i: n} if n else {}
        assert got == want
        pairs = index.exact(queries).groupBy("q_ord").count().collect() if queries else []
        assert {r.q_ord: r["count"] for r in pairs} == want


def test_sql_functions(spark, index):
    index.register("my_index")
    got = spark.sql("SELECT virtual_offset FROM seq_lookup(' >duplicate second description\n')").collect()
    assert [r[0] for r in got] == [30]
    assert sorted(r[0] for r in spark.sql("SELECT virtual_offset FROM seq_lookup('duplicate')").collect()) == [20, 30, 40]
    assert spark.sql("SELECT normalize_query('  > a b ') AS q, primary_id('a b') AS i").first() == ("a b", "a")


def test_dense_numbers_need_no_single_partition(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = O.numbered(df, ["k"], "n")
    assert sorted((r.k, r.n) for r in got.collect()) == [(i, i) for i in range(1000)]


def test_floor_lookup_crosses_ranges(spark):
    table = spark.createDataFrame([(10, "a"), (25, "b"), (900, "c")], "k long, v string")
    asked = [0, 9, 10, 24, 25, 500, 899, 900, 5000, None] + [30] * 200
    probes = spark.createDataFrame(list(enumerate(asked)), "i long, p long")
    got = {r.i: (r.v, r.k) for r in O.floor_lookup(probes, "p", table, "k", "v").collect()}
    none, a, b, c = (None, None), ("a", 10), ("b", 25), ("c", 900)
    assert [got[i] for i in range(len(asked))] == [none, none, a, a, b, b, b, c, c, none] + [b] * 200
    assert [r.v for r in O.floor_lookup(probes, "p", table.limit(0), "k", "v").collect()] == [None] * len(asked)
    assert O.floor_lookup(probes.limit(0), "p", table, "k", "v").count() == 0


def test_running_sums_and_descents(spark):
    rows = [(i * 7919 % 500, None if i % 50 == 0 else i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, x long")
    total, want = 0, {}
    for k, x in sorted(rows, key=lambda r: r[0]):
        want[k] = total
        total += x or 0
    assert {r.k: r.before for r in O.running(df, ["k"], "x", "before").collect()} == want
    ids = [f"{i * 31 % 97:02d}" for i in range(300)]
    frame = spark.createDataFrame(list(enumerate(ids)), "input_ordinal long, full_id string")
    assert O.is_sorted(frame).first().descents == sum(a > b for a, b in zip(ids, ids[1:]))
    assert O.is_sorted(frame.limit(0)).first().descents == 0


@pytest.mark.parametrize("row", [("", "", 1, 2), ("a b", "a b", 1, 2), ("a", "b", 1, 2), ("a", "ab", 1, 2), ("a", "a\nb", 1, 2), ("a", "a", 0, 2), ("a", "a", 3, 2)])
def test_invalid_rows(spark, row):
    with pytest.raises(Exception):  # noqa: B017
        valid(spark.createDataFrame([row], "full_id string, header string, line_bases long, line_width long")).collect()


def test_stream_of_queries(spark, index, tmp_path):
    from strandex.streaming.lookup import exact_stream

    K.query_list(spark, ["z", "duplicate", "no"]).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("q_ord long, query string").parquet(str(tmp_path / "q"))
    q = exact_stream(stream, index.frame).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("found").count() == 4


def test_command_line(tmp_path):
    p = tmp_path / "c.fa"
    p.write_bytes(b">b two\nACGT\nAC\n>a\nTT\n")
    run = [sys.executable, "-m", "strandex.cli"]
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([*run, "fetch", "--fasta", str(p), "--no-progress", "--threads", "2", "--verbose-missing", "a", "nope", "b"], capture_output=True, cwd=root, timeout=180)
    assert done.returncode == 0 and done.stdout == b">a\nTT\n>b two\nACGTAC\n" and b"nope" in done.stderr
    for wrong in (["fetch", "--fasta", str(p)], ["fetch", "--fasta", str(p), "-v", "a"], ["index", "--fai", "x"], ["fetch", "--fasta", str(p), "-r", "(?=a)"]):
        assert subprocess.run([*run, *wrong], capture_output=True, cwd=root, timeout=60).returncode == 1


def test_numbers_as_shown():
    from strandex.functions import report as R

    assert [R.human(n) for n in (0, 512, 1023, 1024, 1536, 1 << 21, 5 << 40, 5000 << 40)] == ["0 B", "512 B", "1023 B", "1.0 KiB", "1.5 KiB", "2.0 MiB", "5.0 TiB", "5000.0 TiB"]
    assert [R.duration(s) for s in (0, 59.9, 60, 3600, 3725)] == ["0s", "59s", "1m 0s", "1h 0m 0s", "1h 2m 5s"]
    assert (R.share(1, 4), R.share(0, 0)) == (25.0, 100.0)
    assert (R.rate(3_000_000, 2, "records"), R.rate(1 << 20, 1, "bytes")) == ("1,500,000 records/s", "1.0 MiB/s")
    assert abs(R.smoothed([10, 20]) - 13) < 1e-9 and R.smoothed([]) == 0


def test_index_command_and_id_file(tmp_path):
    p, ids = tmp_path / "c.fa", tmp_path / "ids"
    p.write_bytes(b">b two\nACGT\nAC\n>a\nTT\n")
    ids.write_bytes(b"b\n\n >a \n")
    run, root = [sys.executable, "-m", "strandex.cli"], os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([*run, "index", "--fasta", str(p), "--no-progress", "--threads", "2"], capture_output=True, cwd=root, timeout=180)
    assert done.returncode == 0 and b"2 records in " in done.stderr
    done = subprocess.run([*run, "fetch", "--fasta", str(p), "--no-progress", "--threads", "2", "-f", str(ids)], capture_output=True, cwd=root, timeout=180)
    assert done.returncode == 0 and done.stdout == b">b two\nACGTAC\n>a\nTT\n"
    ids.write_bytes(b"\xff\n")
    assert subprocess.run([*run, "fetch", "--fasta", str(p), "-f", str(ids)], capture_output=True, cwd=root, timeout=60).returncode == 1


def test_queries_equal_their_sql(spark):
    from strandex.file_queries import FILE_QUERIES
    from strandex.queries import QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in os.listdir(d):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{d}/{t}'")
    for name, (run, sql) in {**QUERIES, **FILE_QUERIES}.items():
        df = run(spark, d)
        columns = sorted(df.columns)
        got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
        cursor = con.execute(sql)
        at = [d_[0] for d_ in cursor.description]
        assert sorted(at) == columns, name
        assert got == sorted(str(tuple(r[at.index(c)] for c in columns)) for r in cursor.fetchall()), name
