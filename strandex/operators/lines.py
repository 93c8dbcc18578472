"""Records from a table of lines, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(lines: DataFrame, is_header: Column, partition: str, order: str) -> DataFrame:
    """lines with record_no: how many headers came up to the line; 0 is content before the first."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("record_no", F.sum(F.when(is_header, 1).otherwise(0)).over(w).cast("long"))


def layouts(sessions_: DataFrame, is_header: Column, partition: str, order: str, width: str) -> DataFrame:
    """For each record: its lines, the first one's width, their sum, and lines but the last of another width."""
    content = sessions_.where(~is_header & (F.col("record_no") > 0))
    w = Window.partitionBy(partition, "record_no").orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = content.withColumn("first_width", F.first(width).over(whole)).withColumn("is_last", F.lead(order).over(w).isNull())
    odd = ~F.col("is_last") & (F.col(width) != F.col("first_width"))
    return marked.groupBy(partition, "record_no").agg(F.count("*").alias("lines"), F.first("first_width").cast("long").alias("first_width"), F.sum(width).cast("long").alias("sequence_length"), F.sum(odd.cast("int")).cast("long").alias("violations"))
