"""Operators over one order of all rows (dense numbers, running sums, descents, floor lookups) without a window that puts
all rows in one task: rows are dealt by range and sorted there, each range is worked on alone, and the little that it
passes on to the ranges behind it is one row for each range."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

_BITS = 33  # of monotonically_increasing_id, for places in a partition


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df in ranges of the order, sorted, with range_ and within_ (its place there), written: another sample would draw
    other ranges."""
    dealt = df.repartitionByRange(_parts(df), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    dealt = dealt.withColumn("range_", place).withColumn("within_", F.col("range_").bitwiseAND((1 << _BITS) - 1))
    return written(dealt.withColumn("range_", F.shiftright("range_", _BITS).cast("int")), "ranges")


def _before(sizes: DataFrame, size: str, name: str) -> DataFrame:
    """own_ (a range), name: the sizes of the ranges before it. One row for each range, so one task has few."""
    sums = F.sum(size).over(Window.orderBy("range_")) - F.col(size)
    return F.broadcast(sizes.select(F.col("range_").alias("own_"), sums.alias(name)))


def numbered_ranges(ranges: DataFrame, name: str) -> DataFrame:
    """placed() rows with dense numbers from 0."""
    before = _before(ranges.groupBy("range_").count(), "count", "before_")
    out = ranges.join(before, F.col("range_") == F.col("own_"))
    return out.withColumn(name, F.col("before_") + F.col("within_")).drop("range_", "own_", "within_", "before_")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with dense numbers from 0 in the order given; one shuffle."""
    return numbered_ranges(placed(df, order), name)


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of a long column over the rows before each in the order given (null counts as 0)."""
    columns = df.columns
    at = columns.index(value)

    def sums(batches):
        own, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            x = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            after = own + np.cumsum(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after - x), pa.array(np.full(len(x), part, np.int32))], [*columns, name, "range_"])
            own = int(after[-1]) if len(x) else own

    dealt = df.repartitionByRange(_parts(df), *order).sortWithinPartitions(*order)
    ranges = written(dealt.mapInArrow(sums, f"{_ddl(df)}, `{name}` long, range_ int"), "running")
    before = _before(ranges.groupBy("range_").agg(F.coalesce(F.sum(value), F.lit(0)).alias("size")), "size", "before_")
    return ranges.join(before, F.col("range_") == F.col("own_")).select(*columns, (F.col(name) + F.col("before_")).cast("long").alias(name))


def is_sorted(rows: DataFrame, id: str = "full_id", order: str = "input_ordinal") -> DataFrame:
    """descents: how many rows have a smaller ID than the row before."""

    def descents(batches):
        n, first, last = 0, None, None
        for batch in batches:
            x = batch.column(0)
            if not len(x):
                continue
            if last is None:
                first = x[0].as_py()
            else:
                n += last > x[0].as_py()
            n += pc.sum(pc.greater(x[:-1], x[1:])).as_py() or 0
            last = x[-1].as_py()
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([first], pa.string()), pa.array([last], pa.string())], ["range_", "n", "first", "last"])

    dealt = rows.where(F.col(id).isNotNull()).repartitionByRange(_parts(rows), order).sortWithinPartitions(order).select(F.col(id).cast("string"))
    ranges = dealt.mapInArrow(descents, "range_ int, n long, first string, last string")
    over = F.lag("last").over(Window.orderBy("range_")) > F.col("first")
    return ranges.withColumn("over", F.coalesce(over, F.lit(False)).cast("long")).agg(F.coalesce(F.sum(F.col("n") + F.col("over")), F.lit(0)).cast("long").alias("descents"))


def floor_lookup(probes: DataFrame, probe: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """probes with the value and key of the last table row whose key is at or below the probe; null below the first,
    and for null probes. Of table rows with one key the one with the largest value counts.

    Table and probes are dealt together by range of the key (many probes of one key spread over ranges) and sorted, a
    pass through each range carries the last table row on, and the last row of the ranges before is joined."""
    kind = table.schema[value].dataType
    packed = probes.select(F.struct(*probes.columns).alias("r"), F.col(probe).cast("long").alias("k"))
    known = table.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.lit(0).alias("asked"), F.col(value).alias("v"), F.lit(None).cast(packed.schema["r"].dataType).alias("r"))
    asked = packed.select("k", F.lit(1).alias("asked"), F.lit(None).cast(kind).alias("v"), "r")
    both = known.unionByName(asked).withColumn("salt", F.monotonically_increasing_id())
    dealt = both.repartitionByRange(_parts(probes), "k", "asked", "v", "salt").sortWithinPartitions("k", "asked", "v", "salt").drop("salt")

    def fill(batches):
        part, key_, value_ = TaskContext.get().partitionId(), pa.array([None], pa.int64()), None
        for batch in batches:
            k, asked, v, r = batch.columns
            if value_ is None:
                value_ = pa.nulls(1, v.type)
            rows = np.arange(1, len(k) + 1)
            at = pa.array(np.maximum.accumulate(np.where(asked.to_numpy() == 0, rows, 0)))  # 0: what is carried
            keys, values = pa.concat_arrays([key_, k]).take(at), pa.concat_arrays([value_, v]).take(at)
            yield pa.RecordBatch.from_arrays([asked, r, keys, values, pa.array(np.full(len(k), part, np.int32))], ["asked", "r", "found_key", "found", "range_"])
            if len(k):
                key_, value_ = keys[-1:], values[-1:]

    struct, value_ddl = packed.schema["r"].dataType.simpleString(), kind.simpleString()
    filled = written(dealt.select("k", "asked", "v", "r").mapInArrow(fill, f"asked int, r {struct}, found_key long, found {value_ddl}, range_ int"), "filled")
    lasts = filled.where("asked = 0").groupBy("range_").agg(F.max(F.struct("found_key", "found")).alias("last"))
    every = filled.select("range_").distinct().join(lasts, "range_", "left")
    carried = every.select(F.col("range_").alias("own_"), F.last("last", True).over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    out = filled.where("asked = 1").join(F.broadcast(carried), F.col("range_") == F.col("own_"))
    none = F.col("r")[probe].isNull()
    best = F.when(~none, F.coalesce(F.when(F.col("found_key").isNotNull(), F.struct("found_key", "found")), "carry"))
    return out.select("r", best.alias("best")).select("r.*", F.col("best.found").alias(value), F.col("best.found_key").alias(key))
