"""Queries that go through files: FASTA is made of the driver's tables by tasks, indexed, and looked up again."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fetch, lookup
from .operators.ordered import running
from .plans import build as B
from .queries import DOCUMENTS, documents
from .session import SeqIndex
from .sources import files
from .sources.bgzf import walk
from .sources.fasta import SPLIT
from .storage import each, filesystem, shared_dir


def _folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    fs, where = filesystem(spark, path)
    fs.deleteOnExit(where)
    return path


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """The documents' sequences, to be written in order of doc_id. Documents without letters have no sequence, which
    FASTA doesn't allow, so they are no records."""
    return documents(spark, d).where(F.length("sequence") > 0).select(F.concat("full_id", F.lit(" document")).alias("header"), F.col("sequence").cast("binary").alias("sequence"), F.col("input_ordinal").alias("out_pos"))


def roundtrip(blocked: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = f"{_folder(spark)}/documents"
        fetch.write_fasta_parts(_rows(spark, d), path, compression="bgzf" if blocked else "none")
        B.write_index(B.read_fasta(spark, path, split_bytes=1 << 22), f"{path}.seqidx")
        found = SeqIndex.open(spark, f"{path}.seqidx").fetch(None, pattern="", by_offset=True)
        return found.select("full_id", "header", "sequence_length", "line_bases", F.col("sequence").cast("string").alias("sequence"))

    return run


def write_gzi(spark: SparkSession, fasta: str, out: str) -> None:
    """The GZI file of one blocked file. Tasks walk the blocks of a range of stored bytes each, and places come from
    running sums; one task writes the entries, 16 bytes for a block."""

    def blocks(span):
        found = np.array([(address, size) for address, _, size in walk(fasta, *span)], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["address", "size"])

    def entries(batches):
        pairs = [np.column_stack([c.to_numpy() for c in batch.columns]).astype("<u8") for batch in batches]
        with files.create(out) as f:
            f.write(struct.pack("<Q", sum(map(len, pairs))) + b"".join(p.tobytes() for p in pairs))
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, pairs))], pa.int64())], ["n"])

    size = files.length(fasta)
    found = each(spark, [(low, low + SPLIT) for low in range(0, size, SPLIT)], blocks, "address long, size long")
    places = running(found, ["address"], "size", "place").where("address > 0").select("address", "place")
    places.repartition(1).sortWithinPartitions("address").mapInArrow(entries, "n long").collect()


def write_fai(spark: SparkSession, fasta: str, out: str) -> None:
    """FAI and GZI files of one blocked file, at out.fai (a folder) and out.gzi. The FAI is written by Spark, in order:
    offsets of blocks come from a floor lookup of their addresses."""
    write_gzi(spark, fasta, out + ".gzi")
    address = F.shiftrightunsigned("virtual_offset", 16)
    rows = B.read_fasta(spark, fasta).withColumn("address", address)
    rows = B.floor_lookup(rows, "address", B.read_gzi(spark, out + ".gzi"), "compressed", "uncompressed")
    raw = F.coalesce("uncompressed", F.lit(0)) + F.col("virtual_offset").bitwiseAND(65535)
    line = F.concat_ws("\t", "full_id", "sequence_length", raw, "line_bases", "line_width")
    rows.select("input_ordinal", line.alias("value")).repartitionByRange("input_ordinal").sortWithinPartitions("input_ordinal").select("value").write.text(out + ".fai")


def fai_build(spark: SparkSession, d: str) -> DataFrame:
    """An index from FAI and GZI files of one blocked file (a FAI describes one), looked up by prefix, sequences read at
    its offsets."""
    path = f"{_folder(spark)}/documents.fa.gz"
    fetch.write_fasta_file(_rows(spark, d), path, compression="bgzf")
    out = f"{_folder(spark)}/documents"
    write_fai(spark, path, out)
    B.write_index(B.fai_records(spark, out + ".fai", out + ".gzi", path), f"{out}.seqidx")
    found = SeqIndex.open(spark, f"{out}.seqidx").fetch(lookup.query_list(spark, ["en|", "de|src1"]), mode="prefix")
    return found.select("full_id", "header", "sequence_length", F.col("sequence").cast("string").alias("sequence"))


_SOME = f"SELECT * FROM ({DOCUMENTS}) WHERE length(sequence) > 0"
_WHOLE = f"SELECT full_id, full_id || ' document' AS header, length(sequence) AS sequence_length, least(length(sequence), 60)::BIGINT AS line_bases, sequence FROM ({_SOME})"
_FAI = f"SELECT full_id, full_id AS header, length(sequence) AS sequence_length, sequence FROM ({_SOME}) WHERE starts_with(full_id, 'en|') OR starts_with(full_id, 'de|src1')"

FILE_QUERIES = {
    "fasta_roundtrip_plain": (roundtrip(False), _WHOLE),
    "fasta_roundtrip_bgzf": (roundtrip(True), _WHOLE),
    "fai_build": (fai_build, _FAI),
}
