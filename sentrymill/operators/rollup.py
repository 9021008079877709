"""Dashboard measures kept up to date: small partial results per day that add up.

A batch of alerts is reduced to one row for each day and combination of the dashboard's
dimensions: counts, the sum of scores in hundredths (whole numbers, so that any order of
adding gives the same mean) and a sketch of the addresses. Partials of any number of batches
merge into the same measures as one pass over all alerts; only distinct addresses are
estimated. A change of status is a partial too, one less here and one more there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill.functions import scoring
from sentrymill.functions.text import utc_date
from sentrymill.operators import dashboard
from sentrymill.operators.skew import lookup_join

KEYS = ["day", "status", "severity", "threat_verdict", "risk_level", "country"]
SKETCH_BITS = 12      # 4,096 registers: a standard error of about 1.6 %


def _dimensions(alerts: DataFrame, policy: str) -> dict[str, Column]:
    country = F.col("country") if "country" in alerts.columns else F.get_json_object("enrichment_data", "$.country")
    return {
        "day": utc_date(F.col("created_at")),
        "risk_level": scoring.risk_level(F.coalesce("risk_score", F.lit(0.0)), policy),
        "country": country,
    }


_SUMS = ["alerts", "scored", "hundredths"]


def partials(alerts: DataFrame, policy: str = "reference") -> DataFrame:
    """KEYS with `alerts`, `scored` (with a score), `hundredths` (sum of scores) and `ips`."""
    return alerts.withColumns(_dimensions(alerts, policy)).groupBy(*KEYS).agg(
        F.count("*").alias("alerts"), F.count("risk_score").alias("scored"),
        F.coalesce(F.sum(F.round(F.col("risk_score") * 100).cast("long")), F.lit(0)).alias("hundredths"),
        F.hll_sketch_agg("source_ip", F.lit(SKETCH_BITS)).alias("ips"),
    )


def status_partials(alerts: DataFrame, history: DataFrame, policy: str = "reference") -> DataFrame:
    """What changes of status (id, old_status, new_status) do to the partials of `alerts`:
    each takes its alert from the old status and adds it to the new one. The sketch of
    addresses holds for both, as one cannot be taken out."""
    moves = history.select("id", F.explode(F.array(
        F.struct(F.col("old_status").alias("_status"), F.lit(-1).alias("_n")),
        F.struct(F.col("new_status").alias("_status"), F.lit(1).alias("_n")))).alias("_m")).select("id", "_m.*")
    # moves of one alert that cancel out go before the join
    net = moves.groupBy("id", "_status").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    rows = alerts.withColumns(_dimensions(alerts, policy)).drop("status").select(
        "id", *[k for k in KEYS if k != "status"], "risk_score", "source_ip")
    placed = lookup_join(net, rows, ["id"], "inner").withColumnRenamed("_status", "status")
    return placed.groupBy(*KEYS).agg(
        F.sum("_n").alias("alerts"), F.sum(F.when(F.col("risk_score").isNotNull(), F.col("_n")).otherwise(0)).alias("scored"),
        F.coalesce(F.sum(F.col("_n") * F.round(F.col("risk_score") * 100).cast("long")), F.lit(0)).alias("hundredths"),
        F.hll_sketch_agg("source_ip", F.lit(SKETCH_BITS)).alias("ips"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """One row for each combination of KEYS; to compact a table of partials."""
    return parts.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.hll_union_agg("ips").alias("ips"))


def _mean() -> Column:
    return F.coalesce(F.round(F.sum("hundredths") / 100 / F.sum("scored"), 2), F.lit(0.0)).alias("avg_risk_score")


def summary(parts: DataFrame, blocked: DataFrame) -> DataFrame:
    """dashboard.summary() from partials."""
    def count(name: str, column: str, value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(column) == value, F.col("alerts"))), F.lit(0)).alias(name)

    measures = parts.agg(
        F.coalesce(F.sum("alerts"), F.lit(0)).alias("total_alerts"),
        *[count(f"{v.lower()}_alerts", "status", v) for v in ("Open", "Investigating", "Resolved")],
        *[count(f"{v.lower()}_alerts", "severity", v) for v in ("Critical", "High", "Medium", "Low")],
        *[count(f"{v.lower()}_ips", "threat_verdict", v) for v in ("Malicious", "Suspicious")],
        _mean(),
    )
    return measures.join(F.broadcast(dashboard.count_blocked(blocked)), F.lit(True), "left")


def risk_distribution(parts: DataFrame) -> DataFrame:
    """Alerts per level in fixed order, zeros kept."""
    found = parts.groupBy("risk_level").agg(F.sum("alerts").alias("_n"))
    return dashboard._domain(parts, "risk_level", D.LEVELS).join(found, "risk_level", "left").select(
        "risk_level", F.coalesce("_n", F.lit(0)).alias("count"))


def by_day(parts: DataFrame) -> DataFrame:
    """Alerts per UTC day, days with any."""
    return parts.where("day is not null").groupBy("day").agg(F.sum("alerts").alias("count")).where("count > 0")


def by_country(parts: DataFrame) -> DataFrame:
    """Alerts per country of the report; alerts without one are not listed."""
    return parts.where("country is not null").groupBy("country").agg(F.sum("alerts").alias("count")).where("count > 0")


def distinct_ips(parts: DataFrame) -> DataFrame:
    """Distinct source addresses per verdict, estimated from the sketches."""
    found = parts.groupBy("threat_verdict").agg(F.hll_sketch_estimate(F.hll_union_agg("ips")).alias("_n"))
    return dashboard._domain(parts, "threat_verdict", D.VERDICTS).join(found, "threat_verdict", "left").select(
        "threat_verdict", F.coalesce("_n", F.lit(0)).alias("count"))
