"""Column expressions on queries, headers, line layouts and offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ends an ID: space, tab, line feed, form feed, carriage return (vertical tab belongs to the ID).
ID_END = r" \t\n\f\r"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def normalize_query(c: Column) -> Column:
    """Trimmed by Unicode White_Space, one leading '>' dropped, trimmed again; the inside stays. Patterns pass over the
    whole text only where its first or last character asks for it."""
    outer = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(outer.rlike(r"[>\p{IsWhite_Space}]"), _trimmed(F.regexp_replace(_trimmed(c), r"\A>", ""))).otherwise(c)


def primary_id(c: Column) -> Column:
    return F.regexp_extract(c, rf"\A[^{ID_END}]*", 0)


def header_suffix(header: Column, full_id: Column) -> Column:
    """What follows the ID in a header, white space included."""
    return F.substring(header, F.length(full_id) + 1, F.length(header))


def has_description(query: Column) -> Column:
    return F.octet_length(query) > F.octet_length(primary_id(query))


def wrapped(sequence: Column, width: int = 60) -> Column:
    """ASCII text in lines of `width`, without a last line end."""
    return F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")


def virtual_offset(compressed: Column, within: Column) -> Column:
    """Block address and place in the block as one number; a place of 65536 or more is an error."""
    checked = F.when(within >= 65536, F.raise_error(F.lit("place in block is 65536 or more")).cast("long")).otherwise(within)
    return F.shiftleft(compressed, 16).bitwiseOR(checked)


def block_address(offset: Column) -> Column:
    return F.shiftrightunsigned(offset, 16)


def place_in_block(offset: Column) -> Column:
    return offset.bitwiseAND(65535)


def line_bases(line: Column) -> Column:
    """Bytes of a line without its one line feed and one carriage return."""
    return F.octet_length(F.regexp_replace(F.regexp_replace(line, r"\n\z", ""), r"\r\z", ""))
