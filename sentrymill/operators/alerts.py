"""Listing, lookup, status changes and deletion of alerts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill.functions.text import contains_pattern
from sentrymill.operators.intake import check_range, normal_status
from sentrymill.operators.skew import lookup_join, sliced_previous


def _newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def matching(
    alerts: DataFrame, severity: str | None = None, status: str | None = None,
    alert_type: str | None = None, escape: bool = False,
) -> DataFrame:
    """Alerts that meet every filter given. `alert_type` is a case-insensitive part of
    the type; empty means no filter."""
    return alerts.where(_condition(severity, status, alert_type, escape))


def _condition(severity, status, alert_type, escape) -> Column:
    wanted = F.lit(True)
    if severity:
        wanted = wanted & (F.col("severity") == severity)
    if status:
        wanted = wanted & (F.col("status") == status)
    if alert_type:
        wanted = wanted & F.col("alert_type").ilike(contains_pattern(alert_type, escape))
    return wanted


def page(
    alerts: DataFrame, skip: int = 0, limit: int = D.ALERT_PAGE[0], after: tuple | None = None,
    **filters,
) -> DataFrame:
    """One page, newest first. `after` takes the (created_at, id) of the last row seen
    and continues from there, which stays cheap however deep the page is."""
    check_range("skip", skip, 0)
    check_range("limit", limit, 1, D.ALERT_PAGE[1])
    rows = matching(alerts, **filters)
    if after is not None:
        at, key = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        rows = rows.where(
            (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < key))
        )
    rows = rows.orderBy(*_newest_first())
    return (rows.offset(skip) if skip else rows).limit(limit)


PAGE_BINS = 1024
PAGE_ROWS = 100_000     # a range of so many rows is sorted as it is


def _narrowed(rows: DataFrame, value: Column, skip: int, want: int) -> tuple[int, int, int]:
    """A range low <= `value` < high that holds the rows `skip` to `skip` + `want` in falling
    order of `value` (long), and how many rows lie above it. Rows are counted in equal
    ranges, and the ranges that the page touches are cut again, until few rows are left or
    a range is one value; each round reads only what the last one left."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return 0, 0, 0
    high, above = high + 1, 0
    while True:
        width = -(-(high - low) // PAGE_BINS)
        counts = {r.b: r.n for r in rows.where((value >= low) & (value < high)).groupBy(
            F.floor((value - low) / width).alias("b")).agg(F.count("*").alias("n")).collect()}
        inside, first, last = 0, None, None
        for b in sorted(counts, reverse=True):
            if first is None and above + counts[b] <= skip:
                above += counts[b]
                continue
            first, last, inside = b if first is None else first, b, inside + counts[b]
            if above + inside >= skip + want:
                break
        if first is None:                       # the page begins behind the last row
            return low, low, above
        low, high = low + last * width, min(high, low + (first + 1) * width)
        if inside <= PAGE_ROWS or width == 1:
            return low, high, above


def deep_page(alerts: DataFrame, skip: int, limit: int = D.ALERT_PAGE[0], **filters) -> DataFrame:
    """page() for an offset of any depth: no task holds the rows ahead of it.

    The page's range of times is found by counting, so only rows around it are sorted; where
    very many rows have one time their ids are narrowed down alike. Rows without a time come
    last. Starts a few counting jobs on the columns of order when called.
    """
    check_range("skip", skip, 0)
    check_range("limit", limit, 1, D.ALERT_PAGE[1])
    rows = matching(alerts, **filters)
    time, timed = F.unix_micros("created_at"), rows.where("created_at is not null")
    low, high, above = _narrowed(timed, time, skip, limit)
    near = timed.where((F.col("created_at") >= F.timestamp_micros(F.lit(low))) & (F.col("created_at") < F.timestamp_micros(F.lit(high))))
    if high - low == 1:
        first, last, ahead = _narrowed(near, F.col("id"), skip - above, limit)
        if last > first:
            near, above = near.where((F.col("id") >= first) & (F.col("id") < last)), above + ahead
    untimed = rows.where("created_at is null")
    there = near.orderBy(*_newest_first()).offset(skip - above).limit(limit) if skip >= above and high > low else near.limit(0)
    if high > low and there.count() == limit:
        return there
    ahead = timed.count()
    low, high, above = _narrowed(untimed, F.col("id"), max(0, skip - ahead), limit)
    tail = untimed.where((F.col("id") >= low) & (F.col("id") < high)).orderBy(F.desc("id")).offset(
        max(0, skip - ahead) - above).limit(limit)
    return there.unionByName(tail).orderBy(*_newest_first()).limit(limit)


def page_with_total(
    alerts: DataFrame, skip: int = 0, limit: int = D.ALERT_PAGE[0], severity: str | None = None,
    status: str | None = None, alert_type: str | None = None, escape: bool = False,
) -> DataFrame:
    """The page with `total` (all alerts) and `total_matching`. An empty page still
    yields one row that carries the totals."""
    totals = alerts.agg(
        F.count("*").alias("total"),
        F.count_if(_condition(severity, status, alert_type, escape)).alias("total_matching"),
    )
    rows = page(
        alerts, skip, limit, severity=severity, status=status, alert_type=alert_type,
        escape=escape,
    )
    # one row against at most one page
    return totals.join(F.broadcast(rows), F.lit(True), "left")


def by_id(alerts: DataFrame, key: int) -> DataFrame:
    return alerts.where(F.col("id") == key)


def by_alert_id(alerts: DataFrame, names: DataFrame) -> DataFrame:
    """Alerts whose readable id is listed in `names` (column alert_id)."""
    return alerts.join(names.select("alert_id").distinct(), "alert_id", "left_semi")


def unknown_ids(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """Requests whose `id` no alert has."""
    return lookup_join(requests, alerts.select("id"), ["id"], "left_anti")


class StatusResult(NamedTuple):
    alerts: DataFrame     # current rows
    history: DataFrame    # id, alert_id, old_status, new_status, ts, seq
    rejects: DataFrame    # changes with an unknown id or status, with a reason


def change_status(alerts: DataFrame, changes: DataFrame) -> StatusResult:
    """Apply a change log (id, new_status, ts, seq); any status may follow any other,
    and a change to the same status counts too."""
    spelled = changes.withColumn("_status", normal_status(F.col("new_status")))
    good = spelled.where("_status is not null").select(
        "id", F.col("_status").alias("new_status"), "ts", "seq", F.unix_micros("ts").alias("_at")
    )
    # Ids without an alert are groups of their own, so they may take part until the
    # one join that also brings the stored status.
    ordered = sliced_previous(good, ["id"], ["_at", "seq"], "_at", "new_status", "_previous")
    stored = alerts.select("id", "alert_id", F.col("status").alias("_stored"))
    history = lookup_join(ordered, stored, ["id"], "inner").select(
        "id", "alert_id", F.coalesce("_previous", "_stored").alias("old_status"), "new_status",
        "ts", "seq",
    )
    # the body of a change is looked at before its alert
    judged = lookup_join(spelled, alerts.select("id", F.lit(True).alias("_known")), ["id"])
    rejects = judged.where("_status is null or _known is null").select(
        *changes.columns,
        F.when(F.col("_status").isNull(), "status: unknown").otherwise("alert not found").alias("reason"),
    )
    return StatusResult(current_status(alerts, good), history, rejects)


def latest_change(changes: DataFrame) -> DataFrame:
    """Last status per id and the time of it; combined on the map side."""
    return changes.groupBy("id").agg(
        F.max(F.struct("ts", "seq", "new_status")).alias("_last")
    ).select("id", F.col("_last.new_status").alias("new_status"), F.col("_last.ts").alias("ts"))


def current_status(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Alerts with their last status; updated_at never moves back."""
    last = latest_change(changes).select(
        "id", F.col("new_status").alias("_new"), F.col("ts").alias("_ts")
    )
    return alerts.join(last, "id", "left").withColumns({
        "status": F.coalesce("_new", "status"),
        "updated_at": F.greatest("updated_at", "_ts"),
    }).select(*alerts.columns)


class DeleteResult(NamedTuple):
    alerts: DataFrame
    timeline: DataFrame
    executions: DataFrame
    deletions: DataFrame   # one AlertDeleted event per deleted alert
    rejects: DataFrame     # requested ids that no alert has


def delete(
    alerts: DataFrame, timeline: DataFrame, executions: DataFrame, requests: DataFrame,
) -> DeleteResult:
    """Remove the requested alerts with their timeline and executions. Write the
    results as a new snapshot; the tables read here stay as they are."""
    from sentrymill.operators.timeline import deletion_events

    ids = requests.groupBy("id").agg(F.min("ts").alias("ts"))
    gone = alerts.join(ids, "id", "inner")
    child = ids.select(F.col("id").alias("alert_db_id"))
    return DeleteResult(
        alerts.join(ids.select("id"), "id", "left_anti"),
        lookup_join(timeline, child, ["alert_db_id"], "left_anti"),
        lookup_join(executions, child, ["alert_db_id"], "left_anti"),
        deletion_events(gone),
        ids.join(alerts.select("id"), "id", "left_anti").select("id"),
    )
