"""Building an index: a Parquet dataset of records sorted by ID, with dense numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import virtual_offset
from ..operators.fetch import register_fasta
from ..operators.ordered import floor_lookup, is_sorted, numbered, numbered_ranges, placed
from ..schemas import INDEX_COLUMNS
from ..sources.indexes import read_fai, read_gzi
from ..storage import dropped, filesystem, written

__all__ = ["build_index", "build_index_from_fai", "directory", "fai_records", "is_sorted", "read_fasta", "sorted_index", "stats", "valid", "write_index"]

#: Rows in a block (Parquet row group) of the index.
BLOCK_ROWS = 4096
ORDER = ["full_id", "source_file", "input_ordinal"]


def read_fasta(spark: SparkSession, path: str, with_sequence: bool = False, split_bytes: int | None = None) -> DataFrame:
    register_fasta(spark)
    reader = spark.read.format("fasta").option("withSequence", with_sequence)
    return (reader.option("splitBytes", split_bytes) if split_bytes else reader).load(path)


def valid(rows: DataFrame) -> DataFrame:
    """rows, each checked: an ID without white space that begins its header, no line end in the header, a layout."""
    id_, header = F.col("full_id"), F.col("header")
    broken = (
        F.when((F.length(id_) == 0) | id_.rlike(r"[ \t\n\f\r]"), "an ID is empty or has white space")
        .when(~header.startswith(id_) | ((F.length(header) > F.length(id_)) & ~F.substring(header, F.length(id_) + 1, F.lit(1)).rlike(r"[ \t\f]")), "a header doesn't begin with its ID")
        .when(header.rlike(r"[\r\n]"), "a header has a line end")
        .when((F.col("line_bases") <= 0) | (F.col("line_width") < F.col("line_bases")), "line layout isn't valid")
    )
    return rows.withColumn("full_id", F.when(broken.isNotNull(), F.raise_error(broken).cast("string")).otherwise(id_))


def sorted_index(rows: DataFrame) -> DataFrame:
    """rows with record_id: dense in byte order of the ID, then in input order."""
    return numbered(valid(rows), ORDER, "record_id").select(*INDEX_COLUMNS)


def write_index(rows: DataFrame, out: str) -> None:
    """The index of rows at `out`. It is written and checked beside it, then an older index moves aside, the new one
    moves in, and the older one goes; a failed write leaves the older one as it was."""
    spark = rows.sparkSession
    name = uuid.uuid4().hex
    temporary, aside = f"{out}.{name}.tmp", f"{out}.{name}.old"
    fs, source = filesystem(spark, temporary)
    (_, target), (_, old) = filesystem(spark, out), filesystem(spark, aside)
    try:
        # written first, so that the source is read once: ranges are drawn from a sample of their own
        scanned = written(valid(rows), "scanned")
        ranges = placed(scanned, ORDER)
        writer = numbered_ranges(ranges, "record_id").select(*INDEX_COLUMNS).sortWithinPartitions("record_id").write
        writer.option("parquet.block.row.count.limit", str(BLOCK_ROWS)).option("parquet.writer.version", "v2").option("compression", "zstd").parquet(temporary)
        found, stored = scanned.count(), spark.read.parquet(temporary).count()
        if found != stored:
            raise RuntimeError(f"{found} records were scanned, the index has {stored}")
        dropped(scanned, ranges)
        had = fs.exists(target)
        if had and not fs.rename(target, old):
            raise OSError(f"can't move the old index at {out} aside")
        if not fs.rename(source, target):
            if had:
                fs.rename(old, target)
            raise OSError(f"can't move the index to {out}")
        fs.delete(old, True)
    finally:
        fs.delete(source, True)


def build_index(spark: SparkSession, fasta: str, out: str | None = None, split_bytes: int | None = None) -> DataFrame:
    """Index a FASTA file; returns its statistics. Default path: the file's with .seqidx."""
    out = out or f"{fasta}.seqidx"
    write_index(read_fasta(spark, fasta, split_bytes=split_bytes), out)
    return stats(spark, out)


def fai_records(spark: SparkSession, fai: str, gzi: str, source_file: str) -> DataFrame:
    """Records of a FAI file, their offsets made virtual by the last GZI entry at or below, or (0, 0) below the first."""
    rows = floor_lookup(read_fai(spark, fai), "raw_offset", read_gzi(spark, gzi), "uncompressed", "compressed")
    within = F.col("raw_offset") - F.coalesce("uncompressed", F.lit(0))
    return rows.select(F.lit(source_file).alias("source_file"), F.lit("bgzf").alias("file_format"), "input_ordinal", "full_id", F.col("full_id").alias("header"), virtual_offset(F.coalesce("compressed", F.lit(0)), within).alias("virtual_offset"), "sequence_length", "line_bases", "line_width")


def build_index_from_fai(spark: SparkSession, fai: str, gzi: str, out: str | None = None, fasta: str | None = None) -> DataFrame:
    """Index from FAI and GZI files; descriptions aren't in them, so headers are IDs."""
    out = out or f"{fasta or fai}.seqidx"
    write_index(fai_records(spark, fai, gzi, fasta or fai.removesuffix(".fai")), out)
    return stats(spark, out)


def directory(index: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """block, first_record_id, record_count, first_id, last_id of blocks of so many rows; one aggregate."""
    blocks = index.withColumn("block", F.floor(F.col("record_id") / rows).cast("long"))
    return blocks.groupBy("block").agg(F.min("record_id").alias("first_record_id"), F.count("*").alias("record_count"), F.min("full_id").alias("first_id"), F.max("full_id").alias("last_id"))


def raw_bytes() -> Column:
    """Bytes of a row's columns as they are before encoding and compression."""
    texts = sum((F.octet_length(c) for c in ("source_file", "file_format", "full_id", "header")), F.lit(0))
    return texts + 8 * (len(INDEX_COLUMNS) - 4)


def stats(spark: SparkSession, path: str) -> DataFrame:
    """record_count, block_count, raw_block_bytes, file_size, ratio of file_size to raw_block_bytes (0 for an empty
    index)."""
    index = spark.read.parquet(path)
    fs, where = filesystem(spark, path)
    size = fs.getContentSummary(where).getLength()
    per_file = index.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.sum(raw_bytes()).alias("raw"))
    total = per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("record_count"), F.coalesce(F.sum(F.ceil(F.col("n") / BLOCK_ROWS)), F.lit(0)).cast("long").alias("block_count"), F.coalesce(F.sum("raw"), F.lit(0)).cast("long").alias("raw_block_bytes"))
    return total.withColumn("file_size", F.lit(size).cast("long")).withColumn("ratio", F.when(F.col("raw_block_bytes") > 0, F.col("file_size") / F.col("raw_block_bytes")).otherwise(0.0))
