"""Token counts by a map-side lookup of two tiers.

Tier one is a compact table of the lengths (in tokens) of frequent pre-tokens, built once on the driver from a
bounded sample of documents and broadcast. Tier two is a bounded cache in each worker; what misses both is encoded.
The tables only save time: every pre-token of every whole text is counted, whichever tier answers, and no pre-token
is shuffled. Null and empty texts have no tokens; repeated rows, also with one id or a null one, are counted each; an
empty table gives no rows; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import table

#: Entries of the broadcast table, and the documents sampled to find them, with the characters that are looked at. All
#: only decide how often tier two works, not what is counted.
FREQUENT, SAMPLED, SAMPLED_CHARACTERS = 1 << 15, 4_000, 4_000


def frequent_pretokens(docs: DataFrame, text: str, path: str, most: int = FREQUENT, sampled: int = SAMPLED) -> dict[str, int]:
    """At most `most` pre-tokens (without their leading space) that are frequent in the first `sampled` documents, with
    lengths. Only as many partitions are read as hold these; of longer documents the first characters."""
    seen: Counter = Counter()
    for (t,) in docs.select(F.left(F.col(text), F.lit(SAMPLED_CHARACTERS))).limit(sampled).collect():
        seen.update(c for c in (t or "").split(" ")[1:] if c and len(c) <= bpe.LONGEST_KEPT and not c[0].isspace())
    coder = bpe.coder(path)
    return {c: len(coder.ids(" " + c)) for c, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most] if n > 1}


def token_counts(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = 1024, known: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; other columns of docs are not read."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_pretokens(docs, text, path) if known is None else known)

    def count(batches):
        cached = bpe.Cached(path, frequent.value)
        for batch in batches:
            n = [cached.count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
