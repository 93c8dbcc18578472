"""Lookups of a stream of queries in an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import offer, prepared


def exact_stream(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Records of a stream of queries (q_ord, query): a stream-static join, without state."""
    q = prepared(queries)
    offered = catalog.withColumn("offer_", offer({True, False}))
    hit = q.join(offered, F.col("query") == F.col("offer_")).where(F.col("full_id") == F.col("query_id"))
    return hit.select("q_ord", *catalog.columns)
