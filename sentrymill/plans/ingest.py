"""The whole intake of raw alerts: validate, enrich, score, record."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill import schemas as S
from sentrymill.functions import scoring
from sentrymill.operators import enrich, intake, timeline
from sentrymill.session import cut_lineage

Feeds = tuple[DataFrame, DataFrame, DataFrame]


class Ingested(NamedTuple):
    alerts: DataFrame
    events: DataFrame
    rejects: DataFrame


def score(enriched: DataFrame, override: str | None = None) -> DataFrame:
    """Adds risk_score from an enriched alert's columns."""
    return enriched.withColumn("risk_score", scoring.risk_score(
        F.col("severity"), F.col("alert_type"), F.col("aggregate_confidence"),
        F.col("created_at"), F.col(override) if override else None,
    ))


def scored_alerts(
    good: DataFrame, abuse: DataFrame, scan: DataFrame, geo: DataFrame, seen: DataFrame | None = None,
    reports: DataFrame | None = None,
) -> DataFrame:
    """Accepted raw alerts, enriched and scored, with their readable ids. `seen` may hold a
    stored table with at least their addresses, where `good` itself is costly to read, and
    `reports` the report_table() of their addresses, where it is there already."""
    named = good.withColumns({
        "alert_id": intake.alert_name(F.col("id")), "updated_at": F.col("created_at"),
    })
    if reports is None:
        reports = enrich.report_table(named if seen is None else seen, abuse, scan, geo)
    return score(enrich.attach(named, reports))


def feeds_as_of(
    abuse: DataFrame, scan: DataFrame, geo: DataFrame, as_of: Column | None = None,
    fallback: Feeds | None = None,
) -> Feeds:
    """The feeds as the intake looks them up: reputation rows within the lookback window
    before `as_of`, and per address the row of `fallback` where the feed has none."""
    if as_of is not None:
        abuse = enrich.recent_reports(abuse, as_of)
    if fallback is None:
        return abuse, scan, geo
    stored_abuse, stored_scan, stored_geo = fallback
    return (
        enrich.prefer(enrich.abuse_feed(abuse), enrich.abuse_feed(stored_abuse), "ip_address", "live", "stored"),
        enrich.prefer(enrich.scan_feed(scan), enrich.scan_feed(stored_scan), "ip_address", "live", "stored"),
        enrich.prefer(enrich.geo_feed(geo), enrich.geo_feed(stored_geo), "ip", "live", "stored"),
    )


def ingest(
    raw: DataFrame, abuse: DataFrame, scan: DataFrame, geo: DataFrame, policy: str = "reference",
    existing: DataFrame | Callable[[DataFrame], DataFrame] | None = None, as_of: Column | None = None,
    fallback: Feeds | None = None,
) -> Ingested:
    """Raw alerts (id, alert_type, source_ip, severity, status, description, created_at)
    to stored alerts, their three events and the refused rows.

    Every row ends up as an alert or as a reject. Rows are validated first; of the good
    ones the first of each id stays, unless `existing` (with column id) has it; a function
    there is given the good rows and gives those of their ids that exist. A null
    severity or status takes the default, whether the field was absent or null.

    Starts jobs when called: the validated rows are written once, the reports of their
    addresses once, and the scored rows once; alerts, events and rejects are read from these.
    """
    checked = intake.numbered(intake.validate(raw))
    good = intake.accepted(checked)
    if callable(existing):
        existing = existing(good.select("id"))
    scored = cut_lineage(scored_alerts(
        intake.first_of_ids(good, existing), *feeds_as_of(abuse, scan, geo, as_of, fallback), seen=good))
    refused = intake.rejected(checked).drop("_row")
    return Ingested(
        scored.select(*S.ALERTS.fieldNames()),
        timeline.lifecycle_events(scored, policy),
        refused.unionByName(intake.later_of_ids(good, scored), allowMissingColumns=True),
    )
