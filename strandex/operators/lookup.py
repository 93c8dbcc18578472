"""Lookups of queries in a catalog of records. A catalog has record_id, full_id, header and any other columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.regex import compiled
from ..functions.text import has_description, normalize_query, primary_id
from .ordered import numbered

#: Queries, and their bytes, whose table is broadcast at most; above, catalog and queries meet by a shuffle on the ID.
BROADCAST_QUERIES, BROADCAST_BYTES = 1_000_000, 1 << 26
#: IDs or prefixes up to which a lookup is a literal filter that Parquet can push down.
LITERAL_IDS = 10


def query_list(spark: SparkSession, queries: list[str]) -> DataFrame:
    """q_ord, query of a list in order."""
    return spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "q_ord long, query string")


def prepared(queries: DataFrame) -> DataFrame:
    """q_ord, query, query_id, has_desc of normalized queries; empty ones are dropped."""
    q = queries.select("q_ord", normalize_query(F.col("query")).alias("query")).where(F.length("query") > 0)
    return q.withColumn("query_id", primary_id(F.col("query"))).withColumn("has_desc", has_description(F.col("query")))


def _side(q: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """q, broadcast if it is small; size: its queries and their bytes, where they are known."""
    n, bytes_ = size or q.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("query")), F.lit(0))).first()
    return F.broadcast(q) if n <= BROADCAST_QUERIES and bytes_ <= BROADCAST_BYTES else q


def _asked(catalog: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, set[bool]]:
    """The catalog, with the IDs of few queries as a filter; prepared queries; and whether some have descriptions (True)
    and some have none (False). One pass over the queries, two for few IDs."""
    q = prepared(queries)
    size = F.coalesce(F.sum(F.octet_length("query")), F.lit(0))
    n, bytes_, ids, *kinds = q.agg(F.count("*"), size, F.approx_count_distinct("query_id"), F.min("has_desc"), F.max("has_desc")).first()
    if ids <= 2 * LITERAL_IDS:
        few = q.select("query_id").distinct().limit(LITERAL_IDS + 1).collect()
        if len(few) <= LITERAL_IDS:
            catalog = catalog.where(F.col("full_id").isin([r.query_id for r in few]))
    return catalog, _side(q, (n, bytes_)), set(kinds)


def offer(kinds: set[bool]) -> Column:
    """What a record offers to queries: its header to those with a description, its ID to the others. A query meets the
    records that it is equal to, never all those of its ID."""
    if len(kinds) < 2:
        return F.col("header" if True in kinds else "full_id")
    return F.explode(F.array_distinct(F.array("header", "full_id")))


def exact(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """q_ord and the records whose ID is the query's; a query with a description must be the whole header."""
    catalog, q, kinds = _asked(catalog, queries)
    hit = catalog.withColumn("offer_", offer(kinds)).join(q, F.col("offer_") == F.col("query"))
    return hit.where(F.col("full_id") == F.col("query_id")).select("q_ord", *catalog.columns)


def exact_counts(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """q_ord and how many records exact() has for it, if any. Records are counted before they meet queries, so that
    many queries of one header that many records share make no pairs."""
    catalog, q, kinds = _asked(catalog, queries)
    offered = catalog.select(F.col("full_id").alias("id_"), offer(kinds).alias("offer_")).groupBy("id_", "offer_").agg(F.count("*").alias("records_"))
    hit = offered.join(q, (F.col("offer_") == F.col("query")) & (F.col("id_") == F.col("query_id")))
    return hit.groupBy("q_ord").agg(F.sum("records_").alias("matches"))


def prefix(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """q_ord and the records whose ID starts with the query; a query with a description needs its exact ID and a
    header that starts with the query.

    One scan and one hash join, whatever the queries: a record offers its ID cut to each length that queries have, and
    its whole ID for those with a description. Few queries are pushed to the scan as StartsWith and EqualTo."""
    q = prepared(queries).withColumn("n", F.when(F.col("has_desc"), -1).otherwise(F.length("query")))
    q = q.withColumn("start", F.when(F.col("has_desc"), F.col("query_id")).otherwise(F.col("query")))
    few = q.select("n", "start").distinct().limit(LITERAL_IDS + 1).collect()
    if not few:
        return catalog.where(F.lit(False)).select(F.lit(0).cast("long").alias("q_ord"), *catalog.columns)
    if len(few) <= LITERAL_IDS:
        id_, any_ = F.col("full_id"), F.lit(False)
        for r in few:
            any_ = any_ | (id_ == r.start if r.n < 0 else id_.startswith(r.start))
        catalog, lengths = catalog.where(any_), sorted({r.n for r in few})
    else:
        lengths = sorted(r.n for r in q.select("n").distinct().collect())
    offers = [F.struct(F.lit(n).alias("n"), (F.col("full_id") if n < 0 else F.substring("full_id", 1, n)).alias("start")) for n in lengths]
    fitting = F.filter(F.array(*offers), lambda x: (x["n"] < 0) | (x["n"] <= F.length("full_id")))
    cut = catalog.select(F.struct(*(F.col(f"`{c}`") for c in catalog.columns)).alias("record"), F.explode(fitting).alias("offer"))
    own = _side(q.select("q_ord", "query", F.col("n").alias("n_"), F.col("start").alias("start_")))
    hit = cut.join(own, (F.col("offer.n") == F.col("n_")) & (F.col("offer.start") == F.col("start_")))
    hit = hit.where((F.col("n_") > 0) | F.col("record.header").startswith(F.col("query")))
    return hit.select("q_ord", "record.*")


def regex(catalog: DataFrame, pattern: str, invert: bool = False) -> DataFrame:
    """Records whose header has (invert: hasn't) a match anywhere. A pattern that isn't valid is an error at once."""
    hit: Column = F.col("header").rlike(compiled(catalog.sparkSession, pattern))
    return catalog.where(~hit if invert else hit)


def missing(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """q_ord, query of the queries without any match; each repeat counts."""
    return prepared(queries).join(matches.select("q_ord").distinct(), "q_ord", "left_anti").select("q_ord", "query")


def combined(matches: DataFrame | None, hits: DataFrame | None, by_offset: bool = False) -> DataFrame:
    """Records of ID lookups and of a pattern, each once where it comes first, with out_pos from 0: in the order of
    requests and the catalog, then pattern hits in the order of the catalog; or all by file offset."""
    parts = []
    if matches is not None:
        parts.append(matches.withColumn("source_rank", F.lit(0)))
    if hits is not None:
        parts.append(hits.withColumn("q_ord", F.lit(0).cast("long")).withColumn("source_rank", F.lit(1)))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    first = both.withColumn("nth", F.row_number().over(Window.partitionBy("record_id").orderBy("source_rank", "q_ord"))).where("nth = 1")
    order = ["virtual_offset", "source_rank", "q_ord", "record_id"] if by_offset else ["source_rank", "q_ord", "record_id"]
    return numbered(first, order, "out_pos").drop("nth", "source_rank", "q_ord")
