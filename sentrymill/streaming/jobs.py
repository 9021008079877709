"""The intake, dashboard counts, block register and status table as streams.

Sinks written from foreachBatch put each micro-batch in its own folder, overwriting it
if the batch is repeated after a failure, so every batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sentrymill import schemas as S
from sentrymill.functions import scoring
from sentrymill.operators.actions import block_entries
from sentrymill.operators.alerts import latest_change
from sentrymill.operators.intake import normal_status
from sentrymill.plans.ingest import ingest
from sentrymill.session import scratch
from sentrymill.sources.id_store import IdStore
from sentrymill.sources.tables import open_or_empty

Feeds = tuple[DataFrame, DataFrame, DataFrame]
_BATCH = T.StructField("batch", T.LongType(), True)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, _BATCH])


def _write_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows written so far, with their batch number."""
    return open_or_empty(spark, path, _with_batch(schema))


def _write_snapshot(rows: DataFrame, path: str, upto: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}-snapshots/upto={upto}")


def _snapshots(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return open_or_empty(
        spark, f"{path}-snapshots", T.StructType([*schema.fields, T.StructField("upto", T.LongType(), True)]))


def _newest(snapshots: DataFrame) -> int | None:
    return snapshots.agg(F.max("upto")).first()[0]


def read_compacted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows written so far: those of the newest snapshot, under the number of its last
    batch, and of the batches after it. A stream may go on writing meanwhile; folders of
    batches up to the snapshot are not read any more and may be removed."""
    snapshots = _snapshots(spark, path, schema)
    newest = _newest(snapshots)
    if newest is None:
        return read_batches(spark, path, schema)
    return snapshots.where(F.col("upto") == newest).withColumnRenamed("upto", "batch").unionByName(
        read_batches(spark, path, schema).where(F.col("batch") > newest))


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def id_store(spark: SparkSession, out: str) -> IdStore:
    """The ids that an intake to `out` has stored."""
    return IdStore(spark, f"{out}/ids")


def intake(
    raw: DataFrame, feeds: Callable[[], Feeds], out: str, checkpoint: str, once: bool = True, **options
) -> StreamingQuery:
    """Validate, dedupe by id, enrich and score a stream of raw alerts.

    Writes `alerts`, `events` and `rejects` under `out`. Every row of the stream becomes an
    alert or a reject, however late it is: ids are compared within the micro-batch and
    with the ids that earlier batches stored, not within a watermark. Those lie in an
    IdStore under `out`/ids, of which a batch reads only files that may hold its ids;
    IdStore.compact() settles them while the stream goes on. `feeds` is asked for
    every micro-batch, so a refreshed feed table is used from the next batch on. `options`
    go to ingest(). What a batch needs in between is removed when it is written.
    """
    def handle(rows: DataFrame, batch: int) -> None:
        with scratch(rows.sparkSession):
            ids = id_store(rows.sparkSession, out)
            result = ingest(rows, *feeds(), existing=lambda good: ids.known(good, batch), **options)
            _write_batch(result.alerts, f"{out}/alerts", batch)
            _write_batch(result.events, f"{out}/events", batch)
            _write_batch(result.rejects, f"{out}/rejects", batch)
            ids.add(result.alerts, batch)

    return _start(raw.writeStream.foreachBatch(handle), checkpoint, once)


def window_counts(
    alerts: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour",
    policy: str = "reference",
) -> DataFrame:
    """Alerts per time window, severity and level. Once the watermark passes a window's end
    its state goes, and rows that come later still are not counted; `delay` says how late a
    row may be."""
    level = scoring.risk_level(F.coalesce("risk_score", F.lit(0.0)), policy)
    return (
        alerts.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", size, slide), "severity", level.alias("risk_level"))
        .agg(F.count("*").alias("count"))
        .select("window.start", "window.end", "severity", "risk_level", "count")
    )


WINDOW_KEYS = ["start", "end", "severity", "risk_level"]
WINDOW_PARTS = T.StructType([
    T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType()),
    T.StructField("severity", T.StringType()), T.StructField("risk_level", T.StringType()),
    T.StructField("count", T.LongType()), T.StructField("late", T.LongType()), T.StructField("seen", T.TimestampType()),
])


def window_counts_job(
    alerts: DataFrame, out: str, checkpoint: str, once: bool = True, size: str = "1 hour",
    slide: str | None = None, delay: str = "1 hour", policy: str = "reference",
) -> StreamingQuery:
    """Keep the counts of all windows, open ones too, without state: a micro-batch writes its
    own counts, and read_window_counts() adds them up. A row whose window had ended `delay`
    before the latest time of earlier batches is late: as in window_counts() it does not
    count any more, but read_late_counts() tells how many there were of each window."""
    level = scoring.risk_level(F.coalesce("risk_score", F.lit(0.0)), policy)

    def handle(rows: DataFrame, batch: int) -> None:
        seen = read_compacted(rows.sparkSession, out, WINDOW_PARTS).where(F.col("batch") < batch).agg(
            (F.max("seen") - F.expr(f"INTERVAL {delay}")).alias("mark"))
        late = F.coalesce(F.col("window.end") <= F.lit(seen.first().mark), F.lit(False))
        _write_batch(
            rows.groupBy(F.window("created_at", size, slide), "severity", level.alias("risk_level"))
            .agg(F.count("*").alias("_n"), F.max("created_at").alias("seen"))
            .select("window.start", "window.end", "severity", "risk_level",
                    F.when(late, 0).otherwise(F.col("_n")).cast("long").alias("count"),
                    F.when(late, F.col("_n")).otherwise(0).cast("long").alias("late"), "seen"), out, batch)

    return _start(alerts.writeStream.foreachBatch(handle), checkpoint, once)


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*WINDOW_KEYS).agg(
        F.sum("count").alias("count"), F.sum("late").alias("late"), F.max("seen").alias("seen"))


def read_window_counts(spark: SparkSession, out: str) -> DataFrame:
    """The count of every window, severity and level over all batches."""
    return _summed(read_compacted(spark, out, WINDOW_PARTS)).where("count > 0").select(*WINDOW_KEYS, "count")


def read_late_counts(spark: SparkSession, out: str) -> DataFrame:
    """How many rows of a window, severity and level came too late to count, where any did."""
    return _summed(read_compacted(spark, out, WINDOW_PARTS)).where("late > 0").select(*WINDOW_KEYS, "late")


def compact_windows(spark: SparkSession, out: str, upto: int) -> None:
    """Settle the counts of batches 0 to `upto` into a snapshot."""
    rows, last = _settled_part(spark, out, WINDOW_PARTS, upto)
    if last is not None:
        _write_snapshot(_summed(rows), out, last)


def block_register(
    runs: DataFrame, register: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Keep the block register from a stream of executions. An address that an earlier
    batch put on it keeps that entry."""
    def handle(rows: DataFrame, batch: int) -> None:
        known = read_compacted(rows.sparkSession, register, S.BLOCKED_IPS).where(F.col("batch") < batch)
        _write_batch(block_entries(rows, known), register, batch)

    return _start(runs.writeStream.foreachBatch(handle), checkpoint, once)


LATEST = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("new_status", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()),
])


def status_table(
    changes: DataFrame, table: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Keep the last change of each id. A batch only appends its own last changes, so its
    cost follows the batch, not the table; read_status() settles between batches."""
    def handle(rows: DataFrame, batch: int) -> None:
        spelled = rows.withColumn("new_status", normal_status(F.col("new_status")))
        last = spelled.where("new_status is not null").groupBy("id").agg(
            F.max(F.struct("ts", "seq", "new_status")).alias("l")
        ).select("id", "l.new_status", "l.ts", "l.seq")
        _write_batch(last, table, batch)

    return _start(changes.writeStream.foreachBatch(handle), checkpoint, once)


def read_status(spark: SparkSession, table: str) -> DataFrame:
    """Current status (id, new_status, ts) over all batches."""
    return latest_change(read_compacted(spark, table, LATEST))


def _settled_part(spark: SparkSession, path: str, schema: T.StructType, upto: int) -> tuple[DataFrame, int | None]:
    """Rows of batches 0 to `upto`, and the last of those that was written (None if there is
    nothing beyond the newest snapshot): one must not stand for batches still to come."""
    rows = read_compacted(spark, path, schema).where(F.col("batch") <= upto)
    last = rows.agg(F.max("batch")).first()[0]
    return rows, None if last == _newest(_snapshots(spark, path, schema)) else last


def compact_status(spark: SparkSession, table: str, upto: int) -> None:
    """Settle the status changes of batches 0 to `upto` into a snapshot."""
    rows, last = _settled_part(spark, table, LATEST, upto)
    if last is not None:
        _write_snapshot(rows.groupBy("id").agg(
            F.max(F.struct("ts", "seq", "new_status")).alias("l")
        ).select("id", "l.new_status", "l.ts", "l.seq"), table, last)


def compact_register(spark: SparkSession, register: str, upto: int) -> None:
    """Put the register entries of batches 0 to `upto` into one snapshot."""
    rows, last = _settled_part(spark, register, S.BLOCKED_IPS, upto)
    if last is not None:
        _write_snapshot(rows.drop("batch"), register, last)
