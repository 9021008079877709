"""Dashboard aggregates. Each is one pass with partial aggregation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill.functions import scoring
from sentrymill.functions.text import text_map, utc_date
from sentrymill.operators.intake import check_range


def _domain(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The few domain values in their fixed order, as a table."""
    rows = ", ".join(f"('{v}', {i})" for i, v in enumerate(values))
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(`{column}`, `position`)")


def _counts(alerts: DataFrame, column: str, values: list[str]) -> DataFrame:
    found = alerts.groupBy(column).agg(F.count("*").alias("_n"))
    return (
        _domain(alerts, column, values).join(found, column, "left")
        .select(column, F.coalesce("_n", F.lit(0)).alias("count"))
    )


def count_all(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("total"))


def by_status(alerts: DataFrame) -> DataFrame:
    return _counts(alerts, "status", D.STATUSES)


def by_severity(alerts: DataFrame) -> DataFrame:
    return _counts(alerts, "severity", D.SEVERITIES)


def by_verdict(alerts: DataFrame, distinct_ips: bool = False) -> DataFrame:
    """Alerts per verdict, or distinct source addresses per verdict."""
    if not distinct_ips:
        return _counts(alerts, "threat_verdict", D.VERDICTS)
    return _counts(
        alerts.select("threat_verdict", "source_ip").distinct(), "threat_verdict", D.VERDICTS
    )


def _mean_score():
    return F.coalesce(F.round(F.avg("risk_score"), 2), F.lit(0.0)).alias("avg_risk_score")


def mean_score(alerts: DataFrame) -> DataFrame:
    """Mean risk score; NULLs do not count, no scores give 0.0."""
    return alerts.agg(_mean_score())


def summary(alerts: DataFrame, blocked: DataFrame) -> DataFrame:
    """The twelve dashboard measures as one row, from one aggregate over the alerts."""
    status, severity, verdict = F.col("status"), F.col("severity"), F.col("threat_verdict")
    measures = alerts.agg(
        F.count("*").alias("total_alerts"),
        F.count_if(status == "Open").alias("open_alerts"),
        F.count_if(status == "Investigating").alias("investigating_alerts"),
        F.count_if(status == "Resolved").alias("resolved_alerts"),
        F.count_if(severity == "Critical").alias("critical_alerts"),
        F.count_if(severity == "High").alias("high_alerts"),
        F.count_if(severity == "Medium").alias("medium_alerts"),
        F.count_if(severity == "Low").alias("low_alerts"),
        F.count_if(verdict == "Malicious").alias("malicious_ips"),
        F.count_if(verdict == "Suspicious").alias("suspicious_ips"),
        _mean_score(),
    )
    # one row beside one row
    return measures.join(F.broadcast(count_blocked(blocked)), F.lit(True), "left")


def risk_distribution(alerts: DataFrame, policy: str = "reference") -> DataFrame:
    """Histogram over the four levels in fixed order, zeros kept. A NULL score counts
    as 0."""
    level = scoring.risk_level(F.coalesce("risk_score", F.lit(0.0)), policy)
    found = alerts.groupBy(level.alias("label")).agg(F.count("*").alias("_n"))
    spread = _domain(alerts, "label", D.LEVELS).join(F.broadcast(found), "label", "left")
    # The total is the sum of at most four rows, so it needs no second pass over the alerts.
    counted = spread.agg(
        F.array_sort(F.collect_list(F.struct(
            "position", "label", F.coalesce("_n", F.lit(0)).alias("count")
        ))).alias("buckets"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
    )
    ranges = text_map(D.BAND_RANGE)
    return counted.select("total", F.inline("buckets")).select(
        "label", ranges[F.col("label")].alias("range"), "count",
        F.when(F.col("total") > 0, F.round(F.col("count") / F.col("total") * 100, 1))
        .otherwise(0.0).alias("pct"),
        "total",
    )


def recent(alerts: DataFrame, limit: int = D.RECENT_PAGE[0]) -> DataFrame:
    check_range("limit", limit, 1, D.RECENT_PAGE[1])
    return alerts.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def trend(alerts: DataFrame, last_day: str, days: int) -> DataFrame:
    """Alerts per UTC day for `days` days up to `last_day`; empty days show 0."""
    check_range("days", days, 1)
    last = (date.fromisoformat(last_day) - date(1970, 1, 1)).days
    calendar = alerts.sparkSession.range(last - days + 1, last + 1, numPartitions=1).select(
        F.date_from_unix_date(F.col("id").cast("int")).alias("date")
    )
    start = F.timestamp_seconds(F.lit((last - days + 1) * 86400))
    stop = F.timestamp_seconds(F.lit((last + 1) * 86400))
    found = (
        alerts.where((F.col("created_at") >= start) & (F.col("created_at") < stop))
        .groupBy(utc_date(F.col("created_at")).alias("date")).agg(F.count("*").alias("_n"))
    )
    return calendar.join(found, "date", "left").select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.coalesce("_n", F.lit(0)).alias("count"),
    )


def by_country(alerts: DataFrame) -> DataFrame:
    """Alerts per country of the enrichment report, most first, with the total. Alerts
    without a report have no country and are not listed."""
    country = (
        F.col("country") if "country" in alerts.columns
        else F.get_json_object("enrichment_data", "$.country")
    )
    found = alerts.groupBy(country.alias("country")).agg(F.count("*").alias("count"))
    listed = found.where("country is not null")
    total = listed.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    return listed.join(F.broadcast(total), F.lit(True)).orderBy(F.desc("count"), "country")


def count_blocked(blocked: DataFrame) -> DataFrame:
    return blocked.agg(F.count("*").alias("blocked_ips"))
