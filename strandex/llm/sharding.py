"""Shards of near equal size by sampled splitters. DataFrame operations only.

A row's key is the hash of its text, so that equal texts stand side by side. A sample of keys, drawn with a
probability in proportion to a row's size, gives quantiles that cut the keys into ranges of about equal size; each
range's true size is then counted over all rows. In an overfull range, keys that alone exceed the target are subdivided
by a hash of the row's place in the table into parts of about the target; its other keys stay whole, in the range's
first part. Ranges in order of their keys, then parts, form one line, which is cut into shards at equal shares of the
total size: a group of equal texts goes whole to the shard that its middle falls in, unless it was subdivided.

So a shard's size differs from the mean by at most half the target at either end, the target being a
(RANGES / 2)-th of the mean, plus half of the largest row there: places of shards in the line are exact, and only the
group across a cut moves as a whole, which has at most the target's bytes if it wasn't subdivided (one row more than
that if it was). Places in a shard count up without a gap.

Null texts have size 1 and the checksum of the empty text; null ids and repeated rows are rows like others, ties in the
order of a shard are broken by the id. An empty table gives no rows. Columns other than id and text are not read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Ranges for each shard, and keys sampled for each range.
RANGES, SAMPLED = 64, 8
#: Bytes of texts in a range at most before more ranges are made (rows are shuffled without their texts), so that the
#: driver holds a few thousand splitters at 100 TB.
LARGEST = 1 << 33
#: Rows of a table that is broadcast at most.
BROADCAST_ROWS = 1_000_000


def bucket(key: str, splitters: list[int]) -> Column:
    """How many of the ascending splitters are at or below a long column. They are one array literal, of which three
    short slices are searched."""
    if not splitters:
        return F.lit(0)
    n = len(splitters)
    all_ = F.lit(np.array(splitters, np.int64))
    found, width = F.lit(0), n
    for step in (max(1, round(n ** (2 / 3))), max(1, round(n ** (1 / 3))), 1):
        # of the elements found + step, found + 2 step, ... up to width: how many are at or below
        picks = F.sequence(found + step, F.least(found + width, F.lit(n)), F.lit(step))
        fits = F.size(F.filter(picks, lambda i: F.element_at(all_, i) <= F.col(key)))
        found, width = F.when(found + step > F.lit(n), found).otherwise(found + fits * step), step
    return found


def sampled_splitters(rows: DataFrame, key: str, size: str, total: int, ranges: int, *draw_by: str | Column) -> list[int]:
    """Up to ranges - 1 ascending splitters between ranges of about equal size: quantiles of about SAMPLED keys for each
    range, drawn by a hash of draw_by with a probability in proportion to a row's size."""
    chance = F.pmod(F.xxhash64(*draw_by), F.lit(1 << 40)) / float(1 << 40)
    drawn = sorted(r[0] for r in rows.where(F.col(key).isNotNull() & (chance < F.col(size) * (ranges * SAMPLED / max(total, 1)))).select(key).collect())
    return sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []


def _known(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join: broadcast if it has few rows (of a few numbers each)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shards(docs: DataFrame, count: int = 16, id: str = "doc_id", text: str = "text", seed: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of docs."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("key"))
    rows = written(rows, "keys")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = max(RANGES * count, -(-total // LARGEST))

    splitters = sampled_splitters(rows, "key", "size", total, ranges, F.lit(seed), "doc_id", "key")
    placed = written(rows.withColumn("range", bucket("key", splitters)), "placed")
    target = max(1, total // (RANGES // 2 * count))
    overfull = placed.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > target).select("range")
    # at most `ranges` ranges can be overfull, and fewer than RANGES // 2 * count keys hot: each alone exceeds the target
    hot = placed.join(_known(overfull, ranges), "range", "left_semi").groupBy("range", "key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > target)
    hot = hot.withColumn("parts", F.ceil(F.col("bytes") / target).cast("int"))
    earlier = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    hot = hot.select(F.col("key").alias("key_"), "parts", (F.coalesce(F.sum("parts").over(earlier), F.lit(0)) + 1).cast("int").alias("first_part"))
    # the place differs between rows with equal ids
    numbered = placed.withColumn("place", F.monotonically_increasing_id())
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.col("first_part") + F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.col("parts")).cast("int"))
    split = numbered.join(_known(hot, RANGES // 2 * count), F.col("key") == F.col("key_"), "left").withColumn("part", part).select("doc_id", "size", "text_crc32", "key", "range", "part")
    split = written(split, "split")

    # the line of parts: how many bytes and rows stand before each
    line = split.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    order = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = line.select("range", "part", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"))
    before = written(before, "line").select(F.col("range").alias("range_"), F.col("part").alias("part_"), "bytes_before", "rows_before")

    own = Window.partitionBy("range", "part")
    group = Window.partitionBy("range", "part", "key")
    # a line has a row for each range and at most 2 * RANGES // 2 * count parts of hot keys
    lined = split.join(_known(before, ranges + RANGES * count), (F.col("range") == F.col("range_")) & (F.col("part") == F.col("part_")))
    lined = lined.withColumn("row", F.row_number().over(own.orderBy("key", "doc_id")) - 1 + F.col("rows_before"))
    lined = lined.withColumn("end", F.sum("size").over(own.orderBy("key").rangeBetween(Window.unboundedPreceding, 0)) + F.col("bytes_before"))
    lined = lined.withColumn("middle", F.col("end") - F.sum("size").over(group) / 2)
    lined = lined.withColumn("shard", F.least(F.floor(F.col("middle") * count / total), F.lit(count - 1)).cast("int"))
    lined = written(lined.select("doc_id", "size", "text_crc32", "shard", "row"), "lined")
    first = lined.groupBy("shard").agg(F.min("row").alias("first")).withColumnRenamed("shard", "shard_")
    return lined.join(_known(first, count), F.col("shard") == F.col("shard_")).select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
