"""The audit timeline: building events, reading them, nesting them per alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill.functions import scoring
from sentrymill.functions.text import as_json, fill
from sentrymill.operators.skew import heavy_keys, sliced_row_number
from sentrymill.session import cut_lineage

# Events of one alert at the same instant are told apart by seq: lifecycle events
# have 1 to 3, later ones the number of their request after this offset.
LATER = 10
CHUNK = 1000

_COLUMNS = ["alert_db_id", "alert_id", "event_type", "seq", "description", "metadata_json",
            "occurred_at"]


def _event(kind: str, seq: int, metadata: Column, **words: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("event_type"), F.lit(seq).cast("long").alias("seq"),
        fill(D.EVENT_TEXT[kind], **words).alias("description"), metadata.alias("metadata_json"),
    )


def lifecycle_events(scored: DataFrame, policy: str = "reference") -> DataFrame:
    """AlertCreated, AlertEnriched and RiskCalculated of each scored alert. One scan:
    the three rows come from one array."""
    c = F.col
    level = scoring.risk_level(c("risk_score"), policy)
    created = _event(
        "AlertCreated", 1, as_json(c("alert_type"), c("source_ip"), c("severity")),
    )
    enriched = _event(
        "AlertEnriched", 2,
        as_json(c("threat_verdict"), F.round("aggregate_confidence", 2).alias("aggregate_confidence"),
                c("abuseipdb_score"), c("vt_malicious")),
        confidence=F.round("aggregate_confidence", 1),
    )
    rated = _event(
        "RiskCalculated", 3,
        as_json(c("risk_score"), level.alias("risk_level")), risk_level=level,
    )
    return scored.select(
        c("id").alias("alert_db_id"), "alert_id", c("created_at").alias("occurred_at"),
        F.inline(F.array(created, enriched, rated)),
    ).select(*_COLUMNS)


def status_events(history: DataFrame) -> DataFrame:
    return history.select(
        F.col("id").alias("alert_db_id"), "alert_id", F.lit("StatusUpdated").alias("event_type"),
        (F.col("seq") + LATER).alias("seq"),
        fill(D.EVENT_TEXT["StatusUpdated"]).alias("description"),
        as_json(F.col("old_status"), F.col("new_status")).alias("metadata_json"),
        F.col("ts").alias("occurred_at"),
    )


def playbook_events(executions: DataFrame) -> DataFrame:
    failed = F.col("status") == "Failed"
    return executions.select(
        "alert_db_id", "alert_id", F.lit("PlaybookExecuted").alias("event_type"),
        (F.col("seq") + LATER).alias("seq"),
        fill(D.EVENT_TEXT["PlaybookExecuted"]).alias("description"),
        as_json(
            F.col("playbook_name").alias("playbook"), F.col("target"), F.col("status"),
            F.when(~failed, F.col("action")).alias("action"),
        ).alias("metadata_json"),
        F.col("executed_at").alias("occurred_at"),
    )


def deletion_events(gone: DataFrame) -> DataFrame:
    """Events for the deletions table: alerts about to go, with the time in `ts`."""
    return gone.select(
        F.col("id").alias("alert_db_id"), "alert_id", F.lit("AlertDeleted").alias("event_type"),
        F.lit(LATER).cast("long").alias("seq"),
        fill(D.EVENT_TEXT["AlertDeleted"]).alias("description"),
        as_json(F.col("alert_type"), F.col("source_ip")).alias("metadata_json"),
        F.col("ts").alias("occurred_at"),
    )


def event_log(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All kinds of events as one table."""
    for part in more:
        first = first.unionByName(part)
    return first


def _oldest_first() -> list[str]:
    return ["occurred_at", "seq", "event_type"]


def of_alert(timeline: DataFrame, key: int) -> DataFrame:
    return timeline.where(F.col("alert_db_id") == key).orderBy(*_oldest_first())


def of_alert_name(timeline: DataFrame, alert_id: str) -> DataFrame:
    return timeline.where(F.col("alert_id") == alert_id).orderBy(*_oldest_first())


def _chunks(timeline: DataFrame, chunk: int) -> DataFrame:
    """The events of an alert by position, in arrays of up to `chunk`."""
    return (
        timeline.withColumn("chunk_no", F.floor((F.col("_pos") - 1) / chunk).cast("long"))
        .groupBy("alert_db_id", "chunk_no")
        .agg(F.sort_array(F.collect_list(F.struct(
            F.col("_pos").alias("position"), "event_type", "description", "metadata_json",
            "occurred_at",
        ))).alias("events"))
    )


def nested(alerts: DataFrame, timeline: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Alerts with their events as an ordered array; no events gives an empty array.

    An alert with more than `chunk` events takes several rows, numbered by `chunk_no`
    from 0, so no array and no group grows without bound and no event is left out.

    Alerts with very many events (see heavy_keys) are placed slice by slice and joined by
    themselves. So the events of all others cross the network once, by alert, for their
    positions, chunks and alerts alike. Counts the events per alert when called.
    """
    timed = timeline.where("alert_db_id is not null").withColumn("_at", F.unix_micros("occurred_at"))
    order = ["_at", "seq", "event_type"]
    head = alerts.select(
        F.col("id").alias("alert_db_id"), "alert_id", "alert_type", "source_ip", "severity",
        "status", "risk_score", "threat_verdict", "created_at",
    )

    def joined(rows: DataFrame, head: DataFrame) -> DataFrame:
        none = F.array().cast(rows.schema["events"].dataType)
        return rows.join(head, "alert_db_id", "right").select(
            F.col("alert_db_id").alias("id"), *[c for c in head.columns if c != "alert_db_id"],
            F.coalesce("chunk_no", F.lit(0).cast("long")).alias("chunk_no"),
            F.coalesce("events", none).alias("events"),
        )

    def plain(events: DataFrame) -> DataFrame:
        inside = Window.partitionBy("alert_db_id").orderBy(*order)
        return _chunks(events.withColumn("_pos", F.row_number().over(inside).cast("long")), chunk)

    heavy = cut_lineage(heavy_keys(timed, ["alert_db_id"]).select("alert_db_id"))
    if heavy.isEmpty():
        return joined(plain(timed), head)
    many = F.broadcast(heavy)
    placed = sliced_row_number(timed.join(many, "alert_db_id", "left_semi"), ["alert_db_id"], order, "_at", "_pos")
    return joined(plain(timed.join(many, "alert_db_id", "left_anti")), head.join(many, "alert_db_id", "left_anti")).unionByName(
        joined(_chunks(placed, chunk), head.join(many, "alert_db_id", "left_semi")))
