"""Ten sample alerts, for demos and tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill import schemas as S
from sentrymill.functions import scoring
from sentrymill.operators.intake import alert_name

# Samples of our own: type, address, severity, status, age in minutes, minutes since the
# last change. Addresses are from the ranges kept for documentation and private use.
SAMPLES = [
    ("Ransomware", "10.20.0.7", "Critical", "Open", 3, 3),
    ("DDoS", "192.0.2.14", "High", "Investigating", 45, 20),
    ("Insider Threat", "10.20.3.99", "Medium", "Open", 95, 95),
    ("Port Scan", "198.51.100.200", "Low", "Resolved", 210, 75),
    ("Lateral Movement", "10.20.1.31", "High", "Open", 330, 330),
    ("Zero-Day Exploit", "203.0.113.77", "Critical", "Investigating", 500, 410),
    ("Phishing", "198.51.100.8", "Medium", "Resolved", 900, 600),
    ("Command Injection", "203.0.113.120", "High", "Resolved", 1500, 1200),
    ("Reconnaissance", "192.0.2.250", "Low", "Open", 2200, 2200),
    ("Suspicious Login", "10.20.9.1", "Low", "Resolved", 4000, 3000),
]


def sample_alerts(spark: SparkSession, anchor: datetime, off_hours: bool | None = False) -> DataFrame:
    """The samples with ages counted back from `anchor` and their scores. Confidence is
    50 for High and Critical, else 20. `off_hours` None takes the hour of creation."""
    rows = [
        (i + 1, kind, ip, severity, status,
         f"Sample: {kind} from {ip}.",
         anchor - timedelta(minutes=age), anchor - timedelta(minutes=touched))
        for i, (kind, ip, severity, status, age, touched) in enumerate(SAMPLES)
    ]
    raw = spark.createDataFrame(
        rows, "id long, alert_type string, source_ip string, severity string, status string, "
              "description string, created_at timestamp, updated_at timestamp",
    )
    confidence = F.when(F.col("severity").isin("High", "Critical"), 50.0).otherwise(20.0)
    night = F.lit(off_hours) if off_hours is not None else None
    return raw.withColumns({
        "alert_id": alert_name(F.col("id")),
        "risk_score": scoring.risk_score(
            F.col("severity"), F.col("alert_type"), confidence, F.col("created_at"), night
        ),
        "threat_verdict": F.lit("Unknown"),
        "enrichment_data": F.lit(None).cast("string"),
    }).select(*S.ALERTS.fieldNames())


def seed_if_empty(alerts: DataFrame, samples: DataFrame) -> DataFrame:
    """`alerts`, or the samples when there are none."""
    any_row = alerts.limit(1).select(F.lit(True).alias("_any"))
    offered = samples.join(F.broadcast(any_row), F.lit(True), "left_anti")
    return alerts.unionByName(offered.select(*alerts.columns))
