"""Threat confidence, verdict, risk score and risk level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill.functions.text import points_map, text_map, utc_hour


def threat_confidence(abuse: Column, malicious: Column, engines: Column) -> Column:
    """0-100 blend of reputation and share of engines. Absent parts count as 0, an
    absent engine count as the default panel."""
    share = F.coalesce(malicious, F.lit(0)) / F.greatest(
        F.coalesce(engines, F.lit(D.DEFAULT_ENGINES)), F.lit(1)
    ) * 100
    return F.round(F.coalesce(abuse, F.lit(0)) * D.ABUSE_SHARE + share * D.SCAN_SHARE, 2)


def threat_verdict(confidence: Column) -> Column:
    """Verdict for a confidence; NULL means no feed knew the address."""
    return (
        F.when(confidence.isNull(), "Unknown")
        .when(confidence >= D.MALICIOUS_FROM, "Malicious")
        .when(confidence >= D.SUSPICIOUS_FROM, "Suspicious")
        .otherwise("Clean")
    )


def severity_points(severity: Column) -> Column:
    return F.coalesce(points_map(D.SEVERITY_POINTS)[severity], F.lit(D.UNKNOWN_SEVERITY_POINTS))


def type_points(alert_type: Column) -> Column:
    return F.coalesce(points_map(D.TYPE_POINTS)[alert_type], F.lit(D.UNKNOWN_TYPE_POINTS))


def threat_points(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) / 100 * 20


def off_hours_points(created_at: Column, override: Column | None = None) -> Column:
    """10 points in the UTC night hours; a non-null `override` flag decides instead."""
    hour = utc_hour(created_at)
    night = (hour >= D.OFF_HOURS_FROM) & (hour < D.OFF_HOURS_TO)
    if override is not None:
        night = F.coalesce(override, night)
    return F.when(night, D.OFF_HOURS_POINTS).otherwise(0.0)


def clamp_score(points: Column) -> Column:
    return F.round(F.least(F.greatest(points, F.lit(0.0)), F.lit(100.0)), 2)


def risk_score(
    severity: Column, alert_type: Column, confidence: Column, created_at: Column,
    override: Column | None = None,
) -> Column:
    return clamp_score(
        severity_points(severity) + type_points(alert_type) + threat_points(confidence)
        + off_hours_points(created_at, override)
    )


def risk_level(score: Column, policy: str = "reference") -> Column:
    """Level of a score.

    `reference` keeps the published bands, whose gaps - (25, 26), (50, 51) and
    (75, 76) - and outsides all count as Critical. `contiguous` closes the gaps.
    """
    if policy not in ("reference", "contiguous"):
        raise ValueError(f"unknown policy {policy!r}")
    level = F.lit(D.BANDS[-1][0])
    for label, low, high in reversed(D.BANDS[:-1]):
        inside = score <= high if policy == "contiguous" else score.between(low, high)
        level = F.when(inside, label).otherwise(level)
    return level


def score_summary(score: Column, policy: str = "reference") -> Column:
    legend = text_map(D.BAND_LEGEND)
    return F.struct(
        score.alias("risk_score"), risk_level(score, policy).alias("risk_level"),
        legend.alias("bands"),
    )
