"""Threat-intelligence enrichment: alerts against three feed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill import schemas as S
from sentrymill.functions import scoring
from sentrymill.functions.text import as_json
from sentrymill.operators.skew import lookup_join, sliced_last
from sentrymill.session import cut_lineage


def recent_reports(abuse: DataFrame, as_of: Column, days: int = D.LOOKBACK_DAYS) -> DataFrame:
    """Reputation rows last reported within the lookback window before `as_of`. Put
    it ahead of the lookup, so that the bound reaches the feed's scan."""
    return abuse.where(F.col("last_reported_at") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def newest_rows(feed: DataFrame, key: str, time: str | None = None) -> DataFrame:
    """One row per key: the one with the latest `time`. Equal or absent times are settled
    by the largest row, so the choice does not depend on the order of rows. Feeds repeat
    an address; without this each repeat would double its alerts."""
    row = F.struct(*[c for c in feed.columns if c != key])
    order = F.struct(*([time] if time else []), row)
    return feed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, order).alias("_r")).select(
        key, "_r.*").select(*feed.columns)


def abuse_feed(abuse: DataFrame) -> DataFrame:
    return newest_rows(abuse, "ip_address", "last_reported_at")


def scan_feed(scan: DataFrame) -> DataFrame:
    return newest_rows(scan, "ip_address", "last_analysis_date")


def geo_feed(geo: DataFrame) -> DataFrame:
    return newest_rows(geo, "ip")


def prefer(primary: DataFrame, fallback: DataFrame, key: str, live: str, other: str) -> DataFrame:
    """One row per key: the primary feed's row if it has one, else the fallback's,
    with the origin in `source`."""
    rest = [c for c in primary.columns if c not in (key, "source")]
    both = primary.select(key, F.struct(*rest).alias("_p")).join(
        fallback.select(key, F.struct(*rest).alias("_f")), key, "full_outer"
    )
    row = F.coalesce("_p", "_f")
    return both.select(
        key, *[row[c].alias(c) for c in rest],
        F.when(F.col("_p").isNotNull(), live).otherwise(other).alias("source"),
    )


def watchlist_flag(ip: Column, watchlist: list[str] = D.WATCHLIST) -> Column:
    """Membership of the short built-in list; use on_watchlist for a table."""
    return ip.isin(watchlist)


def on_watchlist(alerts: DataFrame, watchlist: DataFrame) -> DataFrame:
    return lookup_join(
        alerts, watchlist.select(F.col("ip_address").alias("source_ip")).distinct(),
        ["source_ip"], "left_semi"
    )


def _abuse_row() -> Column:
    return F.struct(*S.TI_ABUSE.fieldNames())


def _scan_row() -> Column:
    return F.struct(*S.TI_SCAN.fieldNames())


def _geo_row() -> Column:
    return F.struct(*S.TI_GEO.fieldNames())


def lookup_abuse(alerts: DataFrame, abuse: DataFrame) -> DataFrame:
    feed = abuse_feed(abuse).select(F.col("ip_address").alias("source_ip"), _abuse_row().alias("abuse"))
    return lookup_join(alerts, feed, ["source_ip"])


def abuse_as_of(alerts: DataFrame, abuse: DataFrame, days: int = D.LOOKBACK_DAYS) -> DataFrame:
    """`alerts` with `abuse`: the newest reputation row of its address that was there when
    the alert came, if not older than `days` days then. Of rows with one time the largest
    counts; a row of the alert's own time does.

    Alerts and feed rows are put in one order by address and time, and each alert takes the
    last feed row ahead of it, so an address costs one sort however many rows it has on both
    sides; heavy addresses are cut by time. Alerts without address or time get none.
    """
    report, known = _abuse_row(), F.col("source_ip").isNotNull() & F.col("created_at").isNotNull()
    row = F.struct(*[F.col(f"`{c}`") for c in alerts.columns])
    mine = alerts.where(known).select(
        F.col("source_ip").alias("_key"), F.unix_micros("created_at").alias("_at"), F.lit(1).alias("_kind"), row.alias("_row"))
    theirs = abuse.where("ip_address is not null and last_reported_at is not null").select(
        F.col("ip_address").alias("_key"), F.unix_micros("last_reported_at").alias("_at"), F.lit(0).alias("_kind"),
        report.alias("_report"))
    both = sliced_last(
        mine.unionByName(theirs, allowMissingColumns=True), ["_key"], ["_at", "_kind", "_report"], "_at", "_report", "_found")
    fresh = F.col("_found.last_reported_at") >= F.col("_row.created_at") - F.expr(f"INTERVAL {int(days)} DAYS")
    columns = [F.col(f"_row.`{c}`").alias(c) for c in alerts.columns]
    found = both.where("_kind = 1").select(*columns, F.when(fresh, F.col("_found")).alias("abuse"))
    return found.unionByName(alerts.where(~known), allowMissingColumns=True)


def enrich_as_of(
    alerts: DataFrame, abuse: DataFrame, scan: DataFrame, geo: DataFrame, days: int = D.LOOKBACK_DAYS,
) -> DataFrame:
    """As enrich(), for a back-fill: reputation as it was known when each alert came. Scan
    and place rows are the newest of the address, as they have no history."""
    plain = alerts.drop("threat_verdict", "enrichment_data", "country", "aggregate_confidence")
    known = lookup_geo(lookup_scan(abuse_as_of(plain, abuse, days), scan), geo).withColumnsRenamed(
        {"abuse": "abuseipdb", "scan": "virustotal", "geo": "ipinfo"})
    some = F.expr("abuseipdb is not null or virustotal is not null or ipinfo is not null")
    return _reported(known).withColumns({
        "enrichment_data": F.when(some, report_json()),
        "threat_verdict": F.when(some, F.col("threat_verdict")).otherwise("Unknown"),
        "abuseipdb_score": F.coalesce("abuseipdb.abuse_confidence_score", F.lit(0)),
        "vt_malicious": F.coalesce("virustotal.malicious_count", F.lit(0)),
        "country": F.when(some, F.col("country")),
    }).select(*plain.columns, "aggregate_confidence", "threat_verdict", "abuseipdb_score", "vt_malicious", "country", "enrichment_data")


def lookup_scan(alerts: DataFrame, scan: DataFrame) -> DataFrame:
    feed = scan_feed(scan).select(F.col("ip_address").alias("source_ip"), _scan_row().alias("scan"))
    return lookup_join(alerts, feed, ["source_ip"])


def lookup_geo(alerts: DataFrame, geo: DataFrame) -> DataFrame:
    feed = geo_feed(geo).select(F.col("ip").alias("source_ip"), _geo_row().alias("geo"))
    return lookup_join(alerts, feed, ["source_ip"])


def reports(ips: DataFrame, abuse: DataFrame, scan: DataFrame, geo: DataFrame) -> DataFrame:
    """One combined report per address (column source_ip) that any feed knows.

    `ips` holds each address once and of each feed the newest row counts, so the three
    joins are one-to-one and share a single partitioning by address.
    """
    a = abuse_feed(abuse).select(F.col("ip_address").alias("source_ip"), _abuse_row().alias("abuseipdb"))
    v = scan_feed(scan).select(F.col("ip_address").alias("source_ip"), _scan_row().alias("virustotal"))
    g = geo_feed(geo).select(F.col("ip").alias("source_ip"), _geo_row().alias("ipinfo"))
    known = (
        ips.select("source_ip").join(a, "source_ip", "left").join(v, "source_ip", "left")
        .join(g, "source_ip", "left")
        .where("abuseipdb is not null or virustotal is not null or ipinfo is not null")
    )
    return _reported(known).select("source_ip", *REPORT_FIELDS)


def _reported(known: DataFrame) -> DataFrame:
    """The fields of a report beside the three rows it is made of."""
    confidence = scoring.threat_confidence(
        F.col("abuseipdb.abuse_confidence_score"), F.col("virustotal.malicious_count"),
        F.col("virustotal.total_engines"),
    )
    return known.withColumns({
        "country": F.coalesce("ipinfo.country", "abuseipdb.country_code", F.lit("")),
        "asn": F.coalesce("ipinfo.asn", F.lit("")),
        "org": F.coalesce("ipinfo.org", "abuseipdb.isp", F.lit("")),
        "aggregate_confidence": confidence,
    }).withColumn("threat_verdict", scoring.threat_verdict(F.col("aggregate_confidence")))


REPORT_FIELDS = [
    "abuseipdb", "virustotal", "ipinfo", "country", "asn", "org", "aggregate_confidence",
    "threat_verdict",
]


def report_json() -> Column:
    return as_json(F.col("source_ip").alias("ip_address"), *[F.col(c) for c in REPORT_FIELDS])


def report_table(alerts: DataFrame, abuse: DataFrame, scan: DataFrame, geo: DataFrame) -> DataFrame:
    """The reports of the addresses of `alerts`, written out once, when this is called.

    Each address is looked up once however many alerts it has, and all that is derived
    from the alerts afterwards shares the table. Being stored, its size is known, so a
    small one is broadcast to the alerts and a large one joined by key.
    """
    return cut_lineage(
        reports(alerts.select("source_ip").distinct(), abuse, scan, geo).select(
            "source_ip",
            "aggregate_confidence",
            F.col("threat_verdict").alias("_verdict"),
            F.coalesce("abuseipdb.abuse_confidence_score", F.lit(0)).alias("abuseipdb_score"),
            F.coalesce("virustotal.malicious_count", F.lit(0)).alias("vt_malicious"),
            "country",
            report_json().alias("enrichment_data"),
        )
    )


def attach(alerts: DataFrame, table: DataFrame) -> DataFrame:
    """Alerts with the columns of their address in a report table.

    Adds `threat_verdict` (Unknown without a report), `aggregate_confidence`,
    `abuseipdb_score`, `vt_malicious`, `country` and `enrichment_data` (JSON, NULL
    without a report).
    """
    plain = alerts.drop("threat_verdict", "enrichment_data", "country", "aggregate_confidence")
    joined = lookup_join(plain, table, ["source_ip"])
    return joined.withColumns({
        "threat_verdict": F.coalesce("_verdict", F.lit("Unknown")),
        "aggregate_confidence": F.coalesce("aggregate_confidence", F.lit(0.0)),
        "abuseipdb_score": F.coalesce("abuseipdb_score", F.lit(0)),
        "vt_malicious": F.coalesce("vt_malicious", F.lit(0)),
    }).drop("_verdict")


def enrich(alerts: DataFrame, abuse: DataFrame, scan: DataFrame, geo: DataFrame) -> DataFrame:
    """Alerts with the report of their source address; see attach(). The reports are
    worked out and stored when this is called."""
    return attach(alerts, report_table(alerts, abuse, scan, geo))


def enrichment_view(
    alerts: DataFrame, abuse: DataFrame, scan: DataFrame, geo: DataFrame,
    policy: str = "reference",
) -> DataFrame:
    """Per alert: its ids, the score summary and the fresh report (NULL if none)."""
    report = reports(alerts.select("source_ip").distinct(), abuse, scan, geo).select(
        "source_ip",
        F.struct(F.col("source_ip").alias("ip_address"), *REPORT_FIELDS)
        .alias("threat_intelligence"),
    )
    view = alerts.select(
        "id", "alert_id", "source_ip",
        scoring.score_summary(F.col("risk_score"), policy).alias("risk_info"),
    )
    return lookup_join(view, report, ["source_ip"])
