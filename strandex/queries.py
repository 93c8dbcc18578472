"""The library's own queries over the driver's tables, with SQL of the same results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import lines as L
from .operators import lookup as K
from .operators import ordered as O
from .plans import build as B
from .storage import filesystem, shared_dir

CATALOG = "SELECT p_brand AS full_id, p_brand || ' ' || p_name || ' [' || p_type || ']' AS header, p_partkey AS input_ordinal, p_partkey * 128 AS virtual_offset FROM part"
RECORDS = f"SELECT *, row_number() OVER (ORDER BY full_id, input_ordinal) - 1 AS record_id FROM ({CATALOG})"
SHOWN = ["full_id", "header", "input_ordinal", "virtual_offset"]
PREFIXES = ["Brand#1", "Brand#17", "nope", "Brand#2"]
REQUEST = ["Brand#17", " >Brand#21\n", "absent", "Brand#17", "Brand#1x", "absent"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    return p.select(F.col("p_brand").alias("full_id"), F.concat("p_brand", F.lit(" "), "p_name", F.lit(" ["), "p_type", F.lit("]")).alias("header"), F.col("p_partkey").alias("input_ordinal"), (F.col("p_partkey") * 128).alias("virtual_offset"))


def records(spark: SparkSession, d: str) -> DataFrame:
    return O.numbered(catalog(spark, d), ["full_id", "input_ordinal"], "record_id")


def documents(spark: SparkSession, d: str) -> DataFrame:
    doc = _t(spark, d, "documents")
    return doc.select(F.concat_ws("|", "lang", "source", F.col("doc_id").cast("string")).alias("full_id"), F.col("doc_id").alias("input_ordinal"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))


DOCUMENTS = "SELECT lang || '|' || source || '|' || doc_id AS full_id, doc_id AS input_ordinal, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents"


def _exact(queries: list[str]):
    return lambda s, d: K.exact(catalog(s, d), K.query_list(s, queries)).select("q_ord", *SHOWN)


def _prefix(queries: list[str]):
    return lambda s, d: K.prefix(catalog(s, d), K.query_list(s, queries)).select("q_ord", *SHOWN)


def _regex(pattern: str, invert: bool = False):
    return lambda s, d: K.regex(catalog(s, d), pattern, invert).select(*SHOWN)


def full_header(spark: SparkSession, d: str) -> DataFrame:
    """Every header as a query: each is matched whole."""
    q = catalog(spark, d).select(F.col("input_ordinal").alias("q_ord"), F.col("header").alias("query"))
    return K.exact_counts(catalog(spark, d), q)


def unique_ids(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "pages").select(F.col("url").alias("full_id"), F.concat("url", F.lit(" page "), F.col("page_id").cast("string")).alias("header"), F.col("page_id").alias("input_ordinal"), (F.col("page_id") * 8).alias("virtual_offset"))
    return K.prefix(pages, K.query_list(spark, ["https://m."])).select("q_ord", *SHOWN)


def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    q = K.query_list(spark, REQUEST)
    return K.missing(q, K.exact(catalog(spark, d), q))


def missing_count(spark: SparkSession, d: str) -> DataFrame:
    return missing_ids(spark, d).agg(F.count("*").alias("missing"))


def _fetched(by_offset: bool, pattern: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = records(spark, d)
        hits = K.regex(r, "ring") if pattern else None
        return K.combined(K.prefix(r, K.query_list(spark, PREFIXES)), hits, by_offset).select("out_pos", "record_id", *SHOWN)

    return run


def _fetched_sql(by_offset: bool, pattern: bool) -> str:
    q = " UNION ALL ".join(f"SELECT {i} AS q_ord, '{x}' AS query" for i, x in enumerate(PREFIXES))
    both = "SELECT 0 AS source_rank, q_ord, r.* FROM r JOIN q ON starts_with(full_id, query)" + (" UNION ALL SELECT 1, 0, r.* FROM r WHERE regexp_matches(header, 'ring')" if pattern else "")
    order = "virtual_offset, source_rank, q_ord, record_id" if by_offset else "source_rank, q_ord, record_id"
    return f"""WITH r AS ({RECORDS}), q AS ({q}), b AS ({both}),
        f AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY source_rank, q_ord) AS nth FROM b)
        SELECT row_number() OVER (ORDER BY {order}) - 1 AS out_pos, record_id, {", ".join(SHOWN)} FROM f WHERE nth = 1"""


def normalized(spark: SparkSession, d: str) -> DataFrame:
    raw = catalog(spark, d).select("input_ordinal", F.concat(F.lit(" > "), "header", F.lit(" \t\n")).alias("raw"))
    return raw.select("input_ordinal", T.normalize_query(F.col("raw")).alias("query"), T.primary_id(T.normalize_query(F.col("raw"))).alias("query_id"), T.has_description(T.normalize_query(F.col("raw"))).alias("has_desc"))


def suffixes(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("input_ordinal", T.header_suffix(F.col("header"), F.col("full_id")).alias("suffix"))


def block_directory(spark: SparkSession, d: str) -> DataFrame:
    return B.directory(records(spark, d), 128).drop("first_id")


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """An index of the catalog is written, and its report made: blocks depend on the files, bytes and records don't."""
    layout = {"source_file": F.lit("part"), "file_format": F.lit("plain"), "sequence_length": F.col("input_ordinal") + 1, "line_bases": F.lit(60).cast("long"), "line_width": F.lit(61).cast("long")}
    path = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}.seqidx"
    B.write_index(catalog(spark, d).withColumns(layout), path)
    fs, where = filesystem(spark, path)
    fs.deleteOnExit(where)
    return B.stats(spark, path).select("record_count", "raw_block_bytes", (F.col("ratio") > 0).alias("is_stored"))


def block_skip(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that may hold an ID: those whose least and largest IDs enclose it."""
    return B.directory(records(spark, d), 128).where((F.col("first_id") <= "Brand#17") & (F.col("last_id") >= "Brand#17")).drop("first_id")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "conversations").select("conv_id", "turn", "role", F.octet_length("text").cast("long").alias("width"))
    return L.sessions(t, F.col("role") == "user", "conv_id", "turn")


def _wrapped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Headers and lines of names; every seventh record has a short line before its last, one longer than the others."""
    p = _t(spark, d, "part").select("p_partkey", F.concat("p_name", "p_name", "p_type").alias("s"))
    cut = F.array(F.lit(">"), F.substring("s", 1, 8), F.when(F.col("p_partkey") % 7 == 0, F.substring("s", 9, 5)).otherwise(F.substring("s", 9, 8)), F.substring("s", 17, 8), F.lit("end"))
    return p.select((F.col("p_partkey") % 100).alias("part"), F.col("p_partkey"), F.posexplode(cut).alias("i", "line")).select("part", (F.col("p_partkey") * 8 + F.col("i")).alias("n"), "line", F.octet_length("line").cast("long").alias("width"))


def line_records(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).groupBy("conv_id", "record_no").agg(F.sum("width").cast("long").alias("width"), F.count("*").alias("lines"))


def line_layouts(spark: SparkSession, d: str) -> DataFrame:
    return L.layouts(_turns(spark, d), F.col("role") == "user", "conv_id", "turn", "width")


def violations(spark: SparkSession, d: str) -> DataFrame:
    """Records with lines before the last that differ from the first."""
    is_header = F.col("line") == ">"
    found = L.layouts(L.sessions(_wrapped_lines(spark, d), is_header, "part", "n"), is_header, "part", "n", "width")
    return found.where("violations > 0").select("part", "record_no", "first_width", "violations")


_VIOLATIONS = """WITH p AS (SELECT p_partkey, p_name || p_name || p_type AS s FROM part),
    l AS (SELECT p_partkey % 100 AS part, p_partkey, unnest([1, 2, 3]) AS i, s FROM p),
    w AS (SELECT part, p_partkey, i, strlen(CASE WHEN i = 2 AND p_partkey % 7 = 0 THEN substr(s, 9, 5) ELSE substr(s, 8 * i - 7, 8) END) AS width FROM l),
    r AS (SELECT part, p_partkey, max(CASE WHEN i = 1 THEN width END) AS first_width FROM w GROUP BY 1, 2),
    o AS (SELECT part, p_partkey, row_number() OVER (PARTITION BY part ORDER BY p_partkey) AS record_no, first_width FROM r)
    SELECT o.part, o.record_no, o.first_width::BIGINT AS first_width, count(*) AS violations FROM w JOIN o USING (part, p_partkey)
    WHERE w.width <> o.first_width GROUP BY 1, 2, 3"""


_SESSIONS = """SELECT conv_id, turn, role, strlen(text) AS width, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id
    ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS record_no FROM conversations"""
_LAYOUTS = f"""WITH s AS ({_SESSIONS}), c AS (SELECT *, first_value(width) OVER (PARTITION BY conv_id, record_no ORDER BY turn) AS first_width,
    lead(turn) OVER (PARTITION BY conv_id, record_no ORDER BY turn) IS NULL AS is_last FROM s WHERE role <> 'user' AND record_no > 0)
    SELECT conv_id, record_no, count(*) AS lines, first(first_width)::BIGINT AS first_width, sum(width)::BIGINT AS sequence_length,
    sum(CASE WHEN NOT is_last AND width <> first_width THEN 1 ELSE 0 END)::BIGINT AS violations FROM c GROUP BY conv_id, record_no"""


def sortedness(spark: SparkSession, d: str) -> DataFrame:
    return B.is_sorted(catalog(spark, d))


def offsets(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 977).alias("compressed"), (F.col("o_orderkey") * 9973 % 65536).alias("within"))
    o = o.withColumn("virtual_offset", T.virtual_offset(F.col("compressed"), F.col("within")))
    return o.select("o_orderkey", "virtual_offset", T.block_address(F.col("virtual_offset")).alias("address"), T.place_in_block(F.col("virtual_offset")).alias("place"))


def floor_offsets(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "documents").select(F.col("doc_id").alias("block"), F.octet_length("text").cast("long").alias("size"))
    starts = O.running(own, ["block"], "size", "start")
    probes = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 9973 % 500000).alias("probe"))
    found = O.floor_lookup(probes, "probe", starts, "start", "block")
    return found.select("o_orderkey", "probe", "block", "start", (F.col("probe") - F.col("start")).alias("within"))


def wrapped(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("input_ordinal", T.wrapped(F.col("sequence")).alias("lines"))


def delta_offsets(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).withColumn("block", F.floor(F.col("record_id") / 128).cast("long"))
    return r.select("record_id", (F.col("virtual_offset") - F.lag("virtual_offset", 1, 0).over(Window.partitionBy("block").orderBy("record_id"))).alias("delta"))


def _sql_list(queries: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS q_ord, '{q}' AS query" for i, q in enumerate(queries))


def _exact_sql(queries: list[str]) -> str:
    return f"WITH q AS ({_sql_list(queries)}), c AS ({CATALOG}) SELECT q_ord, c.* FROM c JOIN q ON full_id = split_part(query, ' ', 1) AND (query = full_id OR header = query)"


def _prefix_sql(queries: list[str]) -> str:
    return f"WITH q AS ({_sql_list(queries)}), c AS ({CATALOG}) SELECT q_ord, c.* FROM c JOIN q ON CASE WHEN contains(query, ' ') THEN full_id = split_part(query, ' ', 1) AND starts_with(header, query) ELSE starts_with(full_id, query) END"


def _regex_sql(pattern: str, invert: bool = False) -> str:
    return f"SELECT * FROM ({CATALOG}) WHERE {'NOT ' * invert}regexp_matches(header, '{pattern}')"


_IDS = [f"Brand#{i}" for i in range(11, 36)] + ["Brand#99"]
_MISSING = f"WITH q AS ({_sql_list(['Brand#17', 'Brand#21', 'absent', 'Brand#17', 'Brand#1x', 'absent'])}) SELECT q_ord, query FROM q WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = query)"
_DIRECTORY = f"SELECT record_id // 128 AS block, min(record_id) AS first_record_id, count(*) AS record_count, max(full_id) AS last_id FROM ({RECORDS}) GROUP BY 1"

QUERIES = {
    "exact_id": (_exact(["Brand#17"]), _exact_sql(["Brand#17"])),
    "exact_id_list": (_exact(_IDS), _exact_sql(_IDS)),
    "exact_header": (full_header, f"WITH c AS ({CATALOG}) SELECT a.input_ordinal AS q_ord, count(*) AS matches FROM c a JOIN c b ON a.header = b.header GROUP BY 1"),
    "prefix_id": (_prefix(["Brand#1"]), _prefix_sql(["Brand#1"])),
    "prefix_header": (_prefix(["Brand#17 red", "Brand#1 red"]), _prefix_sql(["Brand#17 red", "Brand#1 red"])),
    "prefix_list_join": (_prefix(PREFIXES), _prefix_sql(PREFIXES)),
    "prefix_unique_ids": (unique_ids, "SELECT 0::BIGINT AS q_ord, url AS full_id, url || ' page ' || page_id AS header, page_id AS input_ordinal, page_id * 8 AS virtual_offset FROM pages WHERE starts_with(url, 'https://m.')"),
    "regex_match": (_regex("ring"), _regex_sql("ring")),
    "regex_invert": (_regex("ring", True), _regex_sql("ring", True)),
    "regex_case_insensitive": (_regex("(?i)RING"), _regex_sql("(?i)RING")),
    "regex_anchor": (_regex(r"^Brand#1\d? .*ring \["), _regex_sql(r"^Brand#1\d? .*ring \[")),
    "missing_ids": (missing_ids, _MISSING),
    "missing_count": (missing_count, f"SELECT count(*) AS missing FROM ({_MISSING})"),
    "fetch_request_order": (_fetched(False, False), _fetched_sql(False, False)),
    "fetch_union_dedup": (_fetched(False, True), _fetched_sql(False, True)),
    "fetch_offset_order": (_fetched(True, True), _fetched_sql(True, True)),
    "normalize_queries": (normalized, f"SELECT input_ordinal, header AS query, full_id AS query_id, header <> full_id AS has_desc FROM ({CATALOG})"),
    "header_suffix": (suffixes, f"SELECT input_ordinal, substr(header, length(full_id) + 1) AS suffix FROM ({CATALOG})"),
    "sorted_index_record_id": (lambda s, d: records(s, d).select("record_id", *SHOWN), f"SELECT record_id, {', '.join(SHOWN)} FROM ({RECORDS})"),
    "block_directory": (block_directory, _DIRECTORY),
    "index_stats": (index_stats, f"SELECT count(*) AS record_count, sum(strlen('part') + strlen('plain') + strlen(full_id) + strlen(header) + 48)::BIGINT AS raw_block_bytes, true AS is_stored FROM ({CATALOG})"),
    "block_skip": (block_skip, f"SELECT record_id // 128 AS block, min(record_id) AS first_record_id, count(*) AS record_count, max(full_id) AS last_id FROM ({RECORDS}) GROUP BY 1 HAVING min(full_id) <= 'Brand#17' AND max(full_id) >= 'Brand#17'"),
    "records_from_lines": (line_records, f"SELECT conv_id, record_no, sum(width)::BIGINT AS width, count(*) AS lines FROM ({_SESSIONS}) GROUP BY 1, 2"),
    "line_layout": (line_layouts, _LAYOUTS),
    "layout_violations": (violations, _VIOLATIONS),
    "sortedness_check": (sortedness, f"SELECT sum(CASE WHEN b > full_id THEN 1 ELSE 0 END)::BIGINT AS descents FROM (SELECT full_id, lag(full_id) OVER (ORDER BY input_ordinal) AS b FROM ({CATALOG}))"),
    "virtual_offsets": (offsets, "SELECT o_orderkey, v AS virtual_offset, v >> 16 AS address, v & 65535 AS place FROM (SELECT o_orderkey, ((o_orderkey * 977) << 16) | (o_orderkey * 9973 % 65536) AS v FROM orders)"),
    "gzi_floor": (floor_offsets, """WITH t AS (SELECT doc_id AS block, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents),
        p AS (SELECT o_orderkey, o_orderkey * 9973 % 500000 AS probe FROM orders)
        SELECT o_orderkey, probe, block, start, probe - start AS within FROM p ASOF JOIN t ON probe >= start"""),
    "sequence_wrap60": (wrapped, f"SELECT input_ordinal, array_to_string(list_transform(range(0, length(sequence), 60), lambda i: substr(sequence, i + 1, 60)), chr(10)) AS lines FROM ({DOCUMENTS})"),
    "delta_offsets": (delta_offsets, f"SELECT record_id, virtual_offset - coalesce(lag(virtual_offset) OVER (PARTITION BY record_id // 128 ORDER BY record_id), 0) AS delta FROM ({RECORDS})"),
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Requested IDs and pattern hits of the catalog, each once, in request order."""
    return QUERIES["fetch_union_dedup"][0](spark, d)
