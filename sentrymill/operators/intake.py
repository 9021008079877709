"""Validation and normalisation of raw alerts, partial updates and unique keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill.functions.network import is_ipv4
from sentrymill.functions.text import one_of, strip
from sentrymill.operators.skew import lookup_join
from sentrymill.session import cut_lineage


def check_range(name: str, value: int, low: int, high: int | None = None) -> int:
    """Refuse a page parameter outside its bounds before any plan is built."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be an integer")
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be {low} or more" + (f" and at most {high}" if high else ""))
    return value


def normal_severity(c: Column) -> Column:
    return one_of(c, D.SEVERITIES)


def normal_status(c: Column) -> Column:
    return one_of(c, D.STATUSES)


def alert_name(key: Column) -> Column:
    """Readable id from the numeric key; random 32-bit ids would collide."""
    return F.format_string("ALERT-%08X", key)


def type_length_ok(c: Column) -> Column:
    return F.length(c).between(*D.TYPE_LENGTH)


def text_length_ok(c: Column) -> Column:
    """Free text is optional; lengths count before any trim."""
    return c.isNull() | (F.length(c) <= D.TEXT_LENGTH)


def reject_reasons(raw: DataFrame) -> Column:
    """Array of the reasons to refuse a raw alert; empty when it is fine."""
    c = raw.__getitem__
    checks = [
        (c("id").isNull(), "id: required"),
        (c("alert_type").isNull(), "alert_type: required"),
        (~type_length_ok(c("alert_type")), "alert_type: length must be 2 to 100"),
        (c("source_ip").isNull(), "source_ip: required"),
        (~is_ipv4(c("source_ip")), "source_ip: not an IPv4 address"),
        (c("severity").isNotNull() & normal_severity(c("severity")).isNull(), "severity: unknown"),
        (c("status").isNotNull() & normal_status(c("status")).isNull(), "status: unknown"),
        (~text_length_ok(c("description")), "description: longer than 500"),
    ]
    if "_corrupt_record" in raw.columns:
        checks = [(c("_corrupt_record").isNotNull(), "body: not valid JSON")] + checks
    return F.array_compact(F.array(*[F.when(bad, reason) for bad, reason in checks]))


def validate(raw: DataFrame) -> DataFrame:
    """Raw alerts with normalised columns, defaults and `reasons`, in one projection.
    Columns of a row with reasons keep what was sent."""
    reasons = reject_reasons(raw)
    return raw.withColumn("reasons", reasons).withColumns({
        "source_ip": F.when(F.size("reasons") == 0, strip(F.col("source_ip")))
        .otherwise(F.col("source_ip")),
        "severity": F.when(
            F.size("reasons") == 0,
            F.coalesce(normal_severity(F.col("severity")), F.lit(D.DEFAULT_SEVERITY)),
        ).otherwise(F.col("severity")),
        "status": F.when(
            F.size("reasons") == 0,
            F.coalesce(normal_status(F.col("status")), F.lit(D.DEFAULT_STATUS)),
        ).otherwise(F.col("status")),
    })


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") == 0).drop("reasons", "_corrupt_record")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") > 0)


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` written out once, each with a number of its own in `_row`, which also tells
    rows apart that are alike in all columns."""
    return cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))


def first_of_ids(good: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The first row of each id of `good` (from numbered()) that is not in `existing`.

    The earliest row wins; equal times are settled by the smallest row. One aggregate that
    combines on the map side: an id that is sent very often is one row per task.
    """
    rest = [c for c in good.columns if c not in ("id", "created_at", "_row")]
    row = F.min(F.struct("created_at", *rest, "_row")).alias("_r")
    firsts = good.groupBy("id").agg(row).select("id", "_r.*").select(*good.columns)
    if existing is None:
        return firsts
    return firsts.join(existing.select("id").distinct(), "id", "left_anti")


def later_of_ids(good: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of `good` (from numbered()) that are not among `firsts`, with a reason. Rows
    are compared by their number, so no id gathers in one task."""
    return good.join(firsts.select("_row"), "_row", "left_anti").drop("_row").withColumn(
        "reasons", F.array(F.lit("id: already used")))


def unique_ids(good: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(first row of each id that is not in `existing`, all other rows with a reason).

    Every row comes out once: rows alike in all columns count each, one may stay and the
    others are refused. Writes the rows out and starts a job when called.
    """
    rows = numbered(good)
    firsts = cut_lineage(first_of_ids(rows, existing))
    return firsts.drop("_row"), later_of_ids(rows, firsts)


def _patch_is_bad() -> Column:
    return (
        ~F.coalesce(type_length_ok(F.col("alert_type")), F.lit(True))
        | ~text_length_ok(F.col("description"))
        | (F.col("severity").isNotNull() & normal_severity(F.col("severity")).isNull())
        | (F.col("status").isNotNull() & normal_status(F.col("status")).isNull())
    )


PATCH_FIELDS = ["alert_type", "severity", "status", "description"]


def settled_patches(patches: DataFrame) -> DataFrame:
    """One row per id: of each field the value that was supplied last, by `ts` and then `seq`
    (where the table has it), and the last `ts`. Equal order is settled by the larger value.

    Each field is an aggregate of its own over the rows that supply it and combines on the
    map side, so an id that is patched very often is one row per task in the shuffle.
    Updates that break a field rule are left out as a whole; see bad_patches.
    """
    spelled = patches.where(~_patch_is_bad()).withColumns({
        "severity": normal_severity(F.col("severity")), "status": normal_status(F.col("status")),
    })
    order = ["ts", *(["seq"] if "seq" in patches.columns else [])]
    last = [
        F.max(F.when(F.col(f).isNotNull(), F.struct(*order, F.col(f).alias("_v"))))["_v"].alias(f)
        for f in PATCH_FIELDS
    ]
    return spelled.where("id is not null").groupBy("id").agg(*last, F.max("ts").alias("ts"))


def merge_patch(alerts: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply partial updates as if one after another: a NULL field means "not supplied", and
    of several updates of one alert each field keeps what was supplied last. An alert stays
    one row however many updates it gets."""
    offered = settled_patches(patches).select(
        "id", F.lit(True).alias("_patched"), F.col("ts").alias("_ts"), *[F.col(f).alias(f"_{f}") for f in PATCH_FIELDS])
    merged = lookup_join(alerts, offered, ["id"])
    changed = {f: F.coalesce(f"_{f}", f) for f in PATCH_FIELDS}
    changed["updated_at"] = F.when(
        F.col("_patched"), F.greatest("updated_at", "_ts")
    ).otherwise(F.col("updated_at"))
    return merged.withColumns(changed).select(*alerts.columns)


def bad_patches(patches: DataFrame) -> DataFrame:
    """Partial updates refused as a whole because a supplied field breaks its rule."""
    return patches.where(_patch_is_bad())


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key. min_by combines on the map side, so copies of one
    key shrink to a row per task before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*keys, "_r.*").select(*rows.columns)
    )


def new_keys_only(rows: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What may be inserted under a unique key: first of each key, unless it exists."""
    return first_per_key(rows, keys, order).join(
        existing.select(*keys), keys, "left_anti"
    )


def key_clashes(rows: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows a unique key refuses: copies within `rows` and keys that exist.

    `order` must tell rows apart. Losers are found by comparing with the key's first
    row, so no key is sorted or gathered in one task.
    """
    firsts = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    firsts = firsts.join(
        existing.select(*keys).distinct().withColumn("_exists", F.lit(True)), keys, "left"
    )
    return (
        lookup_join(rows, firsts, keys, "inner")
        .where(F.col("_exists").isNotNull() | (F.struct(*order) != F.col("_first")))
        .select(*rows.columns)
    )
