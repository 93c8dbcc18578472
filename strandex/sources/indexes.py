"""FAI and GZI files as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..schemas import GZI


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """input_ordinal, full_id, sequence_length, raw_offset, line_bases, line_width of each line; blank lines are
    skipped; under five fields or numbers that aren't are errors; further fields are ignored.

    The file is read in splits; a line's number comes from where its split begins and its place there."""
    text = spark.read.option("lineSep", "\n").text(path)
    line = text.select(F.regexp_replace("value", r"\r+\z", "").alias("line"), F.col("_metadata.file_block_start").alias("split_"), F.monotonically_increasing_id().alias("place_"))
    line = numbered(line, ["split_", "place_"], "input_ordinal")
    field = F.split("line", "\t")
    rows = line.where(F.length(F.regexp_replace("line", r"\s", "")) > 0).withColumn("f", field)
    bad = F.when(F.size("f") < 5, F.raise_error(F.concat(F.lit("under five fields: "), F.col("line"))).cast("string"))
    rows = rows.withColumn("name", F.coalesce(bad, F.get("f", F.lit(0))))
    names = ("sequence_length", "raw_offset", "line_bases", "line_width")

    def number(i: int):
        raw = F.get("f", F.lit(i))
        return F.when(raw.rlike(r"^\+?[0-9]+$"), raw.try_cast("long")).otherwise(None)

    out = rows.select(F.col("input_ordinal").cast("long").alias("input_ordinal"), F.col("name").alias("full_id"), *(F.coalesce(number(i + 1), F.raise_error(F.concat(F.lit(f"{c} isn't a number up to 2^63 - 1: "), F.col("line"))).cast("long")).alias(c) for i, c in enumerate(names)))
    return out


def read_gzi(spark: SparkSession, path: str) -> DataFrame:
    """compressed, uncompressed of each entry: a little-endian count, then as many pairs."""

    def pairs(batches):
        for batch in batches:
            for body in batch.column(0).to_pylist():
                count = int.from_bytes(body[:8], "little")
                if len(body) < 8 or len(body) < 8 + 16 * count:
                    raise ValueError("truncated GZI file")
                both = np.frombuffer(body, "<u8", 2 * count, 8)
                if len(both) and both.max() >= 1 << 63:
                    raise ValueError("an offset of 2^63 or more")
                yield pa.RecordBatch.from_arrays([pa.array(both[::2].astype(np.int64)), pa.array(both[1::2].astype(np.int64))], ["compressed", "uncompressed"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(pairs, GZI)
