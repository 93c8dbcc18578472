"""Best-fit packing with certified bounds.

Documents become token ids and pieces of at most `capacity`; the pieces are dealt into groups of bounded size, each
packed by best-fit decreasing. Dual-feasible functions over a group's histogram of lengths bound its bins from below.
A group whose bins exceed its bound has a gap: its bins that are not full are opened, their pieces are exchanged
among all such groups by another deal, and packed again; the exchange is kept if it saves bins. Exchanges go on until
one saves nothing or no group has a gap. Nothing is dropped: every token of every row is in one piece. Null and empty texts are the end token alone; repeated rows (also with one
id) are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import logging
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import table, written

CAPACITY, END = 1024, 2
#: Pieces in a group.
GROUP = 25_000
_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of the ids as little-endian 32-bit numbers), deal (a number to deal by)."""
    tail, wide = np.asarray([end], "<u4").tobytes(), 4 * capacity

    def cut(batches):
        cached, turn = bpe.Cached(path), 0
        for batch in batches:
            source, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = (cached.encoded(t) if t else b"") + tail
                start = 0
                stop = len(ids) % wide or wide
                piece = 0
                while start < len(ids):
                    source.append(i)
                    turn += 1
                    crc = zlib.crc32(ids[start:stop])
                    rows.append((piece, start // 4, (stop - start) // 4, crc, zlib.crc32(turn.to_bytes(8, "little"), crc)))
                    start, stop, piece = stop, stop + wide, piece + 1
            numbers = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(numbers[:, k]) for k in range(5))], [*_COLUMNS, "deal"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, deal long")


def lower_bound(histogram: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that pieces of these lengths need at least: the largest of three families of dual-feasible functions.

    histogram[x]: pieces of length x, 0 to capacity. Total length; for each z up to half the capacity, lengths over
    capacity - z count as a whole bin and those under z as nothing; for each k, rounding of (k + 1) x / capacity.
    """
    x, n = np.arange(capacity + 1), histogram.astype(np.int64)
    best = -(-int((n * x).sum()) // capacity)
    count, length = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    for z in range(1, capacity // 2 + 1):
        large = int(count[capacity + 1] - count[capacity - z + 1])
        best = max(best, large - (-int(length[capacity - z + 1] - length[z]) // capacity))
    for k in range(1, 101):
        y = (k + 1) * x
        doubled = np.where(y % capacity == 0, x * k, y // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((n * doubled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins: longest first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    open_, made = 0, 0  # bit r of open_: some bin has room r
    for i in order.tolist():
        x = int(lengths[i])
        fits = open_ >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            b, r, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - r
        if r > x:
            room[r - x].append(b)
            open_ |= 1 << (r - x)
    return bins, offsets, made


def _packed(rows: DataFrame, groups: int, first: int, capacity: int) -> DataFrame:
    """rows with sequence_id, offset, room (of the sequence), gap (of the group). first: the number of the first group."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy()
        bins, offsets, made = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=made).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        frame["sequence_id"] = (int(frame["bucket"].iloc[0]) + first) * (1 << 32) + bins
        frame["offset"], frame["room"], frame["gap"] = offsets, capacity - fill[bins], made - bound
        return frame.drop(columns="bucket")

    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.select(*_COLUMNS, "deal", F.pmod(F.xxhash64("deal", F.lit(first)), F.lit(groups)).cast("long").alias("bucket"))
    # the id may be null or of any type, so it travels as text
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = dealt.groupBy("bucket").applyInPandas(one, "doc_id string, piece long, start long, length long, ids_crc32 long, deal long, sequence_id long, offset long, room long, gap long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def packed_with_gap(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int | None = None) -> tuple[DataFrame, int]:
    """rows (as of pieces()) with sequence_id and offset, and the sum of the gaps left: sequences over the bounds of
    the groups that were packed last. rounds: exchanges at most; None is as many as save sequences."""
    count = rows.count()
    groups = max(1, -(-count // group))
    kept = written(_packed(rows, groups, 0, capacity), "packed")
    first, done = groups, 0
    while True:
        loose = kept.where((F.col("gap") > 0) & (F.col("room") > 0))
        n, before = loose.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if groups < 2 or not n or done == rounds:
            break
        again = max(1, -(-n // group))
        fresh = written(_packed(loose, again, first, capacity), "repacked")
        first += again
        if fresh.where("offset = 0").count() >= before:
            break
        kept, done = kept.where((F.col("gap") <= 0) | (F.col("room") <= 0)).unionByName(fresh), done + 1
    # full sequences of opened groups have no room and count no more
    gaps = loose.groupBy(F.shiftright("sequence_id", 32)).agg(F.max("gap").alias("gap")).agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0]
    return kept.select(*_COLUMNS, "sequence_id", "offset"), gaps


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int | None = None) -> DataFrame:
    """rows (as of pieces()) with sequence_id and offset. The sum of the gaps left is logged."""
    out, gaps = packed_with_gap(rows, capacity, group, rounds)
    logging.getLogger(__name__).info("sum of gaps left: %d sequences", gaps)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(written(pieces(docs, path, capacity, end, id, text), "pieces"), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
