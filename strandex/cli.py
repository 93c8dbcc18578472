"""Command line: index and fetch."""

from __future__ import annotations

import argparse
import os
import sys
import time

from .functions.report import duration, human, rate, share


def _positive(text: str) -> int:
    n = int(text)
    if n <= 0:
        raise argparse.ArgumentTypeError("must be over 0")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandex")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--temp-directory", help="Spark's local folder")
    common.add_argument("--sort-memory", type=_positive, default=512, help="MiB; Spark manages its own memory, so this is only checked")
    common.add_argument("--threads", type=_positive, default=os.cpu_count() or 1)
    common.add_argument("--no-progress", action="store_true")
    i = sub.add_parser("index", parents=[common])
    i.add_argument("--fasta")
    i.add_argument("--fai")
    i.add_argument("--gzi")
    i.add_argument("--output")
    f = sub.add_parser("fetch", parents=[common])
    f.add_argument("--fasta", required=True)
    f.add_argument("--index")
    f.add_argument("-f", "--ids-file")
    f.add_argument("-m", "--id-mode", choices=["exact", "prefix"], default="exact")
    f.add_argument("--full-id", dest="id_mode", action="store_const", const="exact", help=argparse.SUPPRESS)
    f.add_argument("-r", "--id-regexp")
    f.add_argument("-v", "--invert-match", action="store_true")
    f.add_argument("-s", "--sort-by-offset", action="store_true")
    f.add_argument("--verbose-missing", action="store_true")
    f.add_argument("ids", nargs="*")
    return p


def _spark(args):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.appName("strandex").config("spark.ui.showConsoleProgress", str(not args.no_progress).lower())
    if args.temp_directory:
        b = b.config("spark.local.dir", args.temp_directory)
    return b.master(f"local[{args.threads}]").getOrCreate()


def _index(args) -> None:
    from .plans import build

    if bool(args.fai) != bool(args.gzi):
        raise ValueError("--fai and --gzi go together")
    if not args.fasta and not args.fai:
        raise ValueError("nothing to index")
    spark, began = _spark(args), time.monotonic()
    out = build.build_index_from_fai(spark, args.fai, args.gzi, args.output, args.fasta) if args.fai else build.build_index(spark, args.fasta, args.output)
    r = out.first()
    took = time.monotonic() - began
    stored = f"{human(r.file_size)} of {human(r.raw_block_bytes)} ({share(r.file_size, r.raw_block_bytes):.1f} %, ratio {r.ratio:.3f})"
    print(f"{r.record_count:,} records in {r.block_count:,} blocks, {stored}, {duration(took)}, {rate(r.record_count, took, 'records')}", file=sys.stderr)


def _fetch(args) -> None:
    from pyspark.sql import functions as F

    from .functions.regex import to_java
    from .operators import fetch
    from .session import SeqIndex, read_ids

    ids = [*args.ids, *(read_ids(args.ids_file) if args.ids_file else [])]
    if not any(i.strip() for i in ids) and args.id_regexp is None:
        raise ValueError("neither IDs nor a pattern")
    if args.invert_match and args.id_regexp is None:
        raise ValueError("-v needs a pattern")
    if args.id_regexp is not None:
        to_java(args.id_regexp)
    index = SeqIndex.open_or_build(_spark(args), args.fasta, args.index)
    if ids:
        gone = index.missing(ids, args.id_mode)
        n = gone.count()
        if n:
            print(f"{n:,} without a match", file=sys.stderr)
            if args.verbose_missing:
                for r in gone.orderBy("q_ord").toLocalIterator():
                    print(r["query"], file=sys.stderr)
    rows = index.fetch(ids or None, args.id_mode, args.id_regexp, args.invert_match, args.sort_by_offset)
    for r in rows.orderBy(F.col("out_pos")).select("header", "sequence").toLocalIterator():
        sys.stdout.buffer.write(fetch.record_bytes(r.header, bytes(r.sequence)))
    sys.stdout.buffer.flush()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        (_index if args.command == "index" else _fetch)(args)
    except Exception as e:  # one line, as commands do
        print(f"strandex: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
