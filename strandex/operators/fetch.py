"""Sequences of index rows, read at their offsets, and FASTA output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import wrapped
from ..sources import files
from ..sources.bgzf import EOF_BLOCK, READ, open_file
from ..sources.fasta import SPLIT, WRAP, FastaSource, record_bytes
from ..storage import each

#: Stored bytes of a file, as a power of two, whose rows are read by one task: of offsets in plain and in blocked files.
PLAIN_BITS, BLOCKED_BITS = 24, 22 + 16
#: Bytes of sequences in a batch at most (or one longer sequence).
BATCH_BYTES = 1 << 22


def stored_bytes(length: int, bases: int, width: int) -> int:
    """Bytes from the first base to the last one, of `length` bases in lines of `bases` in `width` bytes."""
    if bases <= 0 or width < bases:
        raise ValueError("line layout isn't valid")
    return length + (width - bases) * ((length - 1) // bases) if length else 0


def read_sequence(chunks: Iterator[bytes], length: int, bases: int, width: int) -> bytes:
    """`length` bases from lines of `bases` in `width` bytes."""
    need = stored_bytes(length, bases, width)
    got, parts = 0, []
    while got < need:
        data = next(chunks, None)
        if data is None:
            raise ValueError("the file ends inside a sequence")
        parts.append(data[: need - got])
        got += len(parts[-1])
    raw = b"".join(parts)
    if width == bases or length <= bases:
        return raw
    parts.clear()
    whole = len(raw) // width  # the last line has no end
    lines = np.frombuffer(raw, np.uint8, whole * width).reshape(whole, width)[:, :bases]
    return b"".join([np.ascontiguousarray(lines).data, memoryview(raw)[whole * width :]])


def ranged(rows: DataFrame) -> DataFrame:
    """rows dealt to tasks by file and range of stored bytes, in order of offsets. The number of tasks is fixed: rows are
    small and what is read for them isn't, so Spark would merge them into one or two tasks that read all sequences."""
    bits = F.when(F.col("file_format") == "bgzf", BLOCKED_BITS).otherwise(PLAIN_BITS)
    place = F.floor(F.col("virtual_offset") / F.pow(F.lit(2.0), bits))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "source_file", place).sortWithinPartitions("source_file", "virtual_offset")


def sequences(rows: DataFrame) -> DataFrame:
    """rows (of an index, with any other columns) with the column sequence. Rows are dealt to tasks by file and range
    of offsets and read in order of offsets, whatever order they are wanted in."""
    columns = rows.columns
    at = {c: columns.index(c) for c in ("source_file", "file_format", "virtual_offset", "sequence_length", "line_bases", "line_width")}

    def fetch(batches):
        opened: dict = {}
        for batch in batches:
            found, held, low = [], 0, 0

            def out(high: int) -> pa.RecordBatch:
                part = batch.slice(low, high - low)  # noqa: B023
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)  # noqa: B023
                bodies = pa.py_buffer(b"".join(found))  # noqa: B023
                found.clear()  # noqa: B023
                return pa.RecordBatch.from_arrays([*part.columns, pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), bodies])], [*columns, "sequence"])

            for i, (path, kind, offset, length, bases, width) in enumerate(zip(*(batch.column(i).to_pylist() for i in at.values()), strict=True)):
                if found and held + length > BATCH_BYTES:
                    yield out(i)
                    held, low = 0, i
                if path not in opened:
                    for f in opened.values():
                        f.file.close()
                    opened = {path: open_file(path, kind)}
                found.append(read_sequence(opened[path].read(offset, stored_bytes(length, bases, width)), length, bases, width))
                held += length
            if found:
                yield out(batch.num_rows)
        pa.default_memory_pool().release_unused()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranged(rows).mapInArrow(fetch, f"{kinds}, sequence binary")


def fasta_text(rows: DataFrame) -> DataFrame:
    """record: the text of each row, wrapped (ASCII sequences)."""
    body = wrapped(F.col("sequence").cast("string"), WRAP)
    return rows.withColumn("record", F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.when(F.octet_length("sequence") > 0, F.concat(body, F.lit("\n"))).otherwise("")))


def register_fasta(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)


def write_fasta_parts(rows: DataFrame, path: str, order: str = "out_pos", parts: int | None = None, compression: str = "none", mode: str = "overwrite") -> None:
    """rows (header, sequence and an order column) as a folder of FASTA files, written by tasks: their names' order, and
    the order in each, is that of the rows."""
    register_fasta(rows.sparkSession)
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, order).sortWithinPartitions(order)
    dealt.select("header", "sequence").write.format("fasta").option("compression", compression).mode(mode).save(path)


def joined(spark: SparkSession, paths: list[str], out: str, tail: bytes = b"") -> None:
    """The files one behind the other as a new one, their `tail` (which each ends with) only once. A task copies up to
    SPLIT bytes to their place; where files can't be written at any place, one task copies all, READ bytes at a time."""
    spans, at, temporary = [], 0, f"{out}.part"
    for path in paths:
        size = files.length(path) - len(tail)
        spans += [(path, low, min(low + SPLIT, size), at + low) for low in range(0, size, SPLIT)]
        at += size

    def chunks(span):
        path, low, high, _ = span
        with files.opened(path) as source:
            source.seek(low)
            while low < high:
                data = source.read(min(READ, high - low))
                if not data:
                    raise OSError(f"{path} ends before {high}")
                yield data
                low += len(data)

    def copied(span):
        with files.placed(temporary) as target:
            target.seek(span[3])
            for data in chunks(span):
                target.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([span[2] - span[1]], pa.int64())], ["n"])

    def streamed(spans):
        with files.create(temporary) as target:
            for span in spans:
                for data in chunks(span):
                    target.write(data)
            target.write(tail)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64())], ["n"])

    files.remove(temporary)
    target = files.placed(temporary)
    if target is not None:
        with target:
            target.seek(at)
            target.write(tail)
    n = sum(r.n for r in (each(spark, [spans], streamed, "n long") if target is None else each(spark, spans, copied, "n long")).collect())
    if n != at or files.length(temporary) != at + len(tail):
        raise OSError(f"{out} should have {at + len(tail)} bytes")
    files.move(temporary, out)


def write_fasta_file(rows: DataFrame, path: str, order: str = "out_pos", compression: str = "none") -> None:
    """rows (header, sequence and an order column) as one file: tasks write parts in order, and copy them to their
    places in it."""
    parts = f"{path}.parts"
    write_fasta_parts(rows, parts, order, compression=compression)
    joined(rows.sparkSession, files.listed(parts) if files.exists(parts) else [], path, EOF_BLOCK if compression == "bgzf" else b"")
    files.remove(parts)


def write_fasta(rows: DataFrame, path: str, order: str = "out_pos") -> int:
    """rows (header, sequence and an order column) to one file; a row at a time passes through the driver."""
    n, temporary = 0, f"{path}.part"
    with files.create(temporary) as f:
        for r in rows.orderBy(order).select("header", "sequence").toLocalIterator():
            f.write(record_bytes(r.header, bytes(r.sequence)))
            n += 1
    files.move(temporary, path)
    return n
