"""Text, time and JSON expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space a Python strip() removes from ordinary text; Spark's trim()
# alone removes spaces only.
BLANKS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def quoted(value: str | None) -> str:
    """A value as a SQL literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(c: Column, allowed: list[str]) -> Column:
    """The member of `allowed` that `c` spells, in any case and with blanks around
    it, or NULL. Works for any spelling of the members, not only initial capitals."""
    return text_map({v.lower(): v for v in allowed})[F.lower(strip(c))]


def points_map(values: dict[str, float]) -> Column:
    pairs = ", ".join(f"{quoted(k)}, {v}D" for k, v in values.items())
    return F.expr(f"map({pairs})")


def text_map(values: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in values.items()) + ")")


def present(c: Column) -> Column:
    """`c`, with the empty string taken as absent."""
    return F.nullif(c, F.lit(""))


def utc_hour(ts: Column) -> Column:
    """Hour of day in UTC, whatever the session zone is."""
    return F.pmod(F.floor(F.unix_seconds(ts) / 3600), F.lit(24)).cast("int")


def utc_date(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def iso_utc(ts: Column) -> Column:
    """ISO text in UTC with offset +00:00; a whole second has no fraction."""
    there = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.unix_micros(ts) % 1_000_000 == 0
    return F.concat(
        F.when(whole, F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.lit("+00:00"),
    )


def as_json(*fields: Column) -> Column:
    """A JSON object that keeps its null members."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def contains_pattern(text: str, escape: bool = False) -> str:
    """The ILIKE pattern for "contains `text`". Wildcards in `text` stay active
    unless `escape` is set; a backslash is always an ordinary character."""
    text = text.replace("\\", "\\\\")
    if escape:
        text = text.replace("%", "\\%").replace("_", "\\_")
    return f"%{text}%"


def fill(template: str, **given: Column) -> Column:
    """`template` with each {name} replaced by the column given for it, or else by the
    column of that name."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[
        (given[piece] if piece in given else F.col(piece)).cast("string") if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
    ])
