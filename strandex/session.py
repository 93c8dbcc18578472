"""SeqIndex: an index with its lookups."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.regex import compiled
from .operators import fetch, lookup
from .plans import build
from .sources import files
from .storage import filesystem


class SeqIndex:
    def __init__(self, spark: SparkSession, path: str, frame: DataFrame | None = None):
        self.spark, self.path = spark, path
        self.frame = spark.read.parquet(path) if frame is None else frame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SeqIndex:
        return cls(spark, path)

    @classmethod
    def open_or_build(cls, spark: SparkSession, fasta: str, path: str | None = None) -> SeqIndex:
        """The index beside a FASTA file, built first where there is none. An index older than its file is used, with
        a warning."""
        path = path or f"{fasta}.seqidx"
        fs, index = filesystem(spark, path)
        source_fs, source = filesystem(spark, fasta)
        if not fs.exists(index):
            build.build_index(spark, fasta, path)
        elif source_fs.exists(source) and fs.getFileStatus(index).getModificationTime() < source_fs.getFileStatus(source).getModificationTime():
            warnings.warn(f"{path} is older than {fasta}", stacklevel=2)
        return cls(spark, path)

    def _queries(self, queries: list[str] | DataFrame) -> DataFrame:
        return queries if isinstance(queries, DataFrame) else lookup.query_list(self.spark, queries)

    def exact(self, queries) -> DataFrame:
        return lookup.exact(self.frame, self._queries(queries))

    def prefix(self, queries) -> DataFrame:
        return lookup.prefix(self.frame, self._queries(queries))

    def regex(self, pattern: str, invert: bool = False) -> DataFrame:
        return lookup.regex(self.frame, pattern, invert)

    def _matches(self, queries, mode: str) -> DataFrame:
        if mode not in ("exact", "prefix"):
            raise ValueError(f"id mode {mode!r} is neither exact nor prefix")
        return self.exact(queries) if mode == "exact" else self.prefix(queries)

    def missing(self, queries, mode: str = "exact") -> DataFrame:
        return lookup.missing(self._queries(queries), self._matches(queries, mode))

    def find(self, ids: list[str] | DataFrame | None = None, mode: str = "exact", pattern: str | None = None, invert: bool = False, by_offset: bool = False) -> DataFrame:
        """Index rows with out_pos. Needs ids or a pattern; invert needs a pattern."""
        given = ids is not None and (isinstance(ids, DataFrame) or len(ids) > 0)
        if not given and pattern is None:
            raise ValueError("neither IDs nor a pattern")
        if invert and pattern is None:
            raise ValueError("invert without a pattern")
        if pattern is not None:
            compiled(self.spark, pattern)
        return lookup.combined(self._matches(ids, mode) if given else None, self.regex(pattern, invert) if pattern is not None else None, by_offset)

    def fetch(self, *args, **kwargs) -> DataFrame:
        """find() with sequences."""
        return fetch.sequences(self.find(*args, **kwargs))

    def stats(self) -> DataFrame:
        return build.stats(self.spark, self.path)

    def register(self, view: str = "seq_index") -> None:
        """The index as a view, and beside it the SQL functions normalize_query(s), primary_id(s) and the table function
        seq_lookup(query): the records of one query, exact as in exact()."""
        self.frame.createOrReplaceTempView(view)
        trim = r"regexp_replace(%s, '\\A\\p{IsWhite_Space}+|\\p{IsWhite_Space}+\\z', '')"
        normal = trim % r"regexp_replace(%s, '\\A>', '')" % (trim % "q")
        id_ = r"regexp_extract(%s, '\\A[^ \\t\\n\\f\\r]*', 0)"
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_query(q STRING) RETURNS STRING RETURN {normal}")
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION primary_id(h STRING) RETURNS STRING RETURN {id_ % 'h'}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.frame.schema.fields)
        self.spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION seq_lookup(q STRING) RETURNS TABLE ({columns}) RETURN
            SELECT * FROM {view} WHERE full_id = primary_id(normalize_query(q)) AND (normalize_query(q) = full_id OR header = normalize_query(q))""")


def read_ids(path: str) -> list[str]:
    """IDs of a file, one a line, in order; invalid UTF-8 is an error."""
    with files.opened(path) as f:
        return f.read().decode("utf-8").split("\n")


def missing_count(missing: DataFrame) -> DataFrame:
    return missing.agg(F.count("*").alias("missing"))
