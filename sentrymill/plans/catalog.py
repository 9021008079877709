"""The registered queries: one or more per operator, each with its oracle SQL.

Every query runs an operator over whole sample tables. Times come out as text (UTC), arrays
as joined text and whole numbers as long, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill import domains as D
from sentrymill import schemas as S
from sentrymill.functions import network, scoring, spans, text
from sentrymill.operators import (
    actions, alerts, dashboard, enrich, intake, phi, rollup, timeline, tokens, usage_log,
)
from sentrymill.operators.token_store import TokenStore
from sentrymill.plans import oracle as O
from sentrymill.plans.ingest import ingest
from sentrymill.session import cut_lineage, run_dir
from sentrymill.sources import json_intake, sample_views as V, seed, tables
from sentrymill.sources.lookup import LookupTable
from sentrymill.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def show(df: DataFrame) -> DataFrame:
    """Plain columns: see the module text."""
    def plain(field: T.StructField):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.TimestampType):
            c = F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, "|")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def query(name: str, oracle: str | None = None):
    """Register a query; its result goes through show()."""
    def keep(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return show(build(spark, folder))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return keep


AS_OF = "2024-02-01 00:00:00Z"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _json_fields(column: str, fields: list[str]):
    """The fields that a JSON text has, as field=value, in the order given."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{f}="), F.get_json_object(column, f"$.{f}")) for f in fields])


# --- sources -------------------------------------------------------------------

@query("s1_alert_scan", O.sql(f"SELECT id, alert_id, alert_type, source_ip, severity, status, {O.t('created_at')} AS created_at FROM pa"))
def _(spark, d):
    return V.plain_alerts(spark, d).select(
        "id", "alert_id", "alert_type", "source_ip", "severity", "status", "created_at"
    )


def _json_lines(spark, d) -> str:
    """Raw alerts written as JSON lines, some of them cut short."""
    path = run_dir(spark, "json")
    line = F.to_json(F.struct(*S.RAW_ALERTS.fieldNames()), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    V.raw_alerts(spark, d).select(
        F.when(F.col("id") % 50 == 21, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line)
        .alias("value")
    ).write.text(path)
    return path


@query("s2_json_intake", O.sql(f"""
SELECT id, alert_type, source_ip, severity, status, description, {O.t('created_at')} AS created_at, false AS corrupt
FROM rw WHERE id % 50 <> 21
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM rw WHERE id % 50 = 21"""))
def _(spark, d):
    raw = json_intake.read_raw(spark, _json_lines(spark, d))
    bad = F.col("_corrupt_record").isNotNull()
    return raw.select(
        *[F.when(~bad, F.col(c)).alias(c) for c in S.RAW_ALERTS.fieldNames()], bad.alias("corrupt")
    )


@query("s3_seed_empty", O.sql("SELECT 10 AS rows, 10 AS ids, (SELECT count(*) FROM a WHERE false) AS kept"))
def _(spark, d):
    nobody = V.alerts(spark, d).where("id < 0")
    seeded = seed.seed_if_empty(nobody, seed.sample_alerts(spark, datetime(2024, 1, 1)))
    return seeded.agg(
        F.count("*").alias("rows"), F.count_distinct("alert_id").alias("ids"),
        F.count_if(F.col("description").startswith("event")).alias("kept"))


@query("s3_seed_if_empty", O.sql("SELECT id, alert_id, alert_type, severity, risk_score FROM a"))
def _(spark, d):
    stored = V.alerts(spark, d)
    return seed.seed_if_empty(stored, seed.sample_alerts(spark, datetime(2024, 1, 1))).select(
        "id", "alert_id", "alert_type", "severity", "risk_score"
    )


@query("s4_append_readback", O.sql("""
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS rows, sum(id)::BIGINT AS id_sum FROM pa GROUP BY 1"""))
def _(spark, d):
    path = run_dir(spark, "alerts")
    rows = V.light_alerts(spark, d)
    tables.append(rows.where("event_id % 2 = 0"), path, day_of="created_at")
    tables.append(rows.where("event_id % 2 = 1"), path, day_of="created_at")
    return tables.scan(spark, path).groupBy("day").agg(
        F.count("*").alias("rows"), F.sum("id").alias("id_sum")
    )


@query("s5_json_write", O.sql("""
SELECT id, alert_type, severity, severity IS NULL AS severity_kept FROM rw"""))
def _(spark, d):
    packed = tables.with_json(V.raw_alerts(spark, d), "payload", "alert_type", "severity")
    return packed.select(
        "id", F.get_json_object("payload", "$.alert_type").alias("alert_type"),
        F.get_json_object("payload", "$.severity").alias("severity"),
        F.col("payload").contains('"severity":null').alias("severity_kept"),
    )


@query("s6_json_read", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    parsed = tables.read_json_column(V.table(spark, d, "events"), "props", "k long", "parsed")
    return parsed.select("event_id", "parsed.k")


@query("s8_open_or_empty", O.sql("SELECT 'alerts' AS name, count(*) AS rows FROM pa UNION ALL SELECT 'timeline', 0"))
def _(spark, d):
    path = run_dir(spark, "alerts")
    shape = ["id", "alert_id", "severity"]
    tables.append(V.light_alerts(spark, d).select(*shape), path)
    there = tables.open_or_empty(spark, path, T.StructType([S.ALERTS[c] for c in shape]))
    absent = tables.open_or_empty(spark, run_dir(spark, "timeline"), S.TIMELINE)
    return there.agg(F.count("*").alias("rows")).select(F.lit("alerts").alias("name"), "rows").unionAll(
        absent.agg(F.count("*").alias("rows")).select(F.lit("timeline").alias("name"), "rows")
    )


# --- validation ------------------------------------------------------------------

@query("v1_ipv4", O.sql(f"""
SELECT id, {O.strip('source_ip')} AS source_ip, regexp_full_match({O.strip('source_ip')}, '{O.IPV4}') AS ok FROM rw"""))
def _(spark, d):
    ip = F.col("source_ip")
    return V.raw_alerts(spark, d).select("id", text.strip(ip).alias("source_ip"), network.is_ipv4(ip).alias("ok"))


@query("v2_severity", O.sql(f"SELECT id, {O.spelled('severity', D.SEVERITIES)} AS severity FROM rw"))
def _(spark, d):
    return V.raw_alerts(spark, d).select("id", intake.normal_severity(F.col("severity")).alias("severity"))


@query("v3_status", O.sql(f"SELECT id, {O.spelled('status', D.STATUSES)} AS status FROM rw"))
def _(spark, d):
    return V.raw_alerts(spark, d).select("id", intake.normal_status(F.col("status")).alias("status"))


@query("v4_lengths", O.sql("""
SELECT id, length(alert_type) BETWEEN 2 AND 100 AS type_ok, description IS NULL OR length(description) <= 500 AS text_ok FROM rw"""))
def _(spark, d):
    return V.raw_alerts(spark, d).select(
        "id", intake.type_length_ok(F.col("alert_type")).alias("type_ok"),
        intake.text_length_ok(F.col("description")).alias("text_ok"),
    )


@query("v5_required", O.sql("""
SELECT id, list_contains(reasons, 'alert_type: required') AS no_type, list_contains(reasons, 'source_ip: required') AS no_ip FROM chk"""))
def _(spark, d):
    checked = intake.validate(V.raw_alerts(spark, d))
    return checked.select(
        "id", F.array_contains("reasons", "alert_type: required").alias("no_type"),
        F.array_contains("reasons", "source_ip: required").alias("no_ip"),
    )


@query("v6_defaults", O.sql("SELECT id, severity, status FROM ok"))
def _(spark, d):
    return intake.accepted(intake.validate(V.raw_alerts(spark, d))).select("id", "severity", "status")


@query("v7_accept_reject", O.sql("""
SELECT id, len(reasons) = 0 AS accepted, array_to_string(reasons, '|') AS reasons FROM chk"""))
def _(spark, d):
    checked = intake.validate(V.raw_alerts(spark, d))
    return checked.select("id", (F.size("reasons") == 0).alias("accepted"), "reasons")


@query("v8_merge_patch", O.sql(f"""
SELECT pa.id, coalesce(p.alert_type, pa.alert_type) AS alert_type, coalesce(p.severity, pa.severity) AS severity,
  coalesce(p.status, pa.status) AS status, coalesce(p.description, pa.description) AS description,
  {O.t('coalesce(greatest(p.ts, pa.created_at), pa.created_at)')} AS updated_at
FROM pa LEFT JOIN (SELECT * FROM pat WHERE coalesce(alert_type, 'ok') <> 'X' AND coalesce(severity, 'ok') <> 'EXTREME') p USING (id)"""))
def _(spark, d):
    return intake.merge_patch(V.light_alerts(spark, d), V.patches(spark, d)).select(
        "id", "alert_type", "severity", "status", "description", "updated_at"
    )


_LAST = ", ".join(
    f"arg_max({f}, (ts, seq)) FILTER ({f} IS NOT NULL) AS {f}" for f in ("alert_type", "severity", "status", "description"))


@query("v8_many_patches", O.sql(f"""
SELECT pa.id, coalesce(p.alert_type, pa.alert_type) AS alert_type, coalesce(p.severity, pa.severity) AS severity,
  coalesce(p.status, pa.status) AS status, coalesce(p.description, pa.description) AS description,
  {O.t('coalesce(greatest(p.ts, pa.created_at), pa.created_at)')} AS updated_at
FROM pa LEFT JOIN (SELECT id, {_LAST}, max(ts) AS ts FROM mpat GROUP BY id) p USING (id)"""))
def _(spark, d):
    return intake.merge_patch(V.light_alerts(spark, d), V.many_patches(spark, d)).select(
        "id", "alert_type", "severity", "status", "description", "updated_at"
    )


@query("v8_bad_patches", O.sql("SELECT id FROM pat WHERE alert_type = 'X' OR severity = 'EXTREME'"))
def _(spark, d):
    return intake.bad_patches(V.patches(spark, d)).select("id")


def _keyed(spark, d):
    rows = V.plain_alerts(spark, d).select("source_ip", "created_at", "id")
    return rows, V.addresses(spark, d).where("u % 4 = 0").selectExpr("ip AS source_ip")


@query("v9_new_keys", O.sql(f"""
SELECT source_ip, {O.t('created_at')} AS created_at, id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY created_at, id) AS rn FROM pa)
WHERE rn = 1 AND source_ip NOT IN (SELECT ip FROM ips WHERE u % 4 = 0)"""))
def _(spark, d):
    rows, existing = _keyed(spark, d)
    return intake.new_keys_only(rows, existing, ["source_ip"], ["created_at", "id"])


@query("v9_key_clashes", O.sql("""
SELECT source_ip, id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY created_at, id) AS rn FROM pa)
WHERE rn > 1 OR source_ip IN (SELECT ip FROM ips WHERE u % 4 = 0)"""))
def _(spark, d):
    rows, existing = _keyed(spark, d)
    return intake.key_clashes(rows, existing, ["source_ip"], ["created_at", "id"]).select("source_ip", "id")


@query("v10_alert_id", "SELECT event_id + 1 AS id, format('ALERT-{:08X}', event_id + 1) AS alert_id FROM events")
def _(spark, d):
    return V.table(spark, d, "events").select(
        (F.col("event_id") + 1).alias("id"), intake.alert_name(F.col("event_id") + 1).alias("alert_id")
    )


@query("v11_page_bounds", O.sql("""
SELECT id, event_id % 151 - 20 AS value, event_id % 151 - 20 >= 0 AS skip_ok, event_id % 151 - 20 BETWEEN 1 AND 100 AS limit_ok FROM pa"""))
def _(spark, d):
    """Every distinct value is put to the bounds as a parameter would be; a refusal is a row."""
    values = V.table(spark, d, "events").select("event_id", (F.col("event_id") % 151 - 20).alias("value"))

    def accepted(name, value, low, high):
        try:
            return intake.check_range(name, value, low, high) == value
        except ValueError:
            return False

    asked = [r.value for r in values.select("value").distinct().collect()]      # 151 at most
    told = spark.createDataFrame(
        [(v, accepted("skip", v, 0, None), accepted("limit", v, 1, 100)) for v in asked],
        "value long, skip_ok boolean, limit_ok boolean")
    return values.join(told.hint("rebalance"), "value").select(
        (F.col("event_id") + 1).alias("id"), "value", "skip_ok", "limit_ok")


# --- threat intelligence ------------------------------------------------------------

@query("e1_abuse_lookup", O.sql("""
SELECT pa.id, abuse_confidence_score, country_code, isp, is_public, domain, total_reports,
  strftime(last_reported_at, '%Y-%m-%d %H:%M:%S.%f') AS last_reported_at, is_whitelisted, usage_type
FROM pa LEFT JOIN ti_abuse ON ip_address = source_ip"""))
def _(spark, d):
    feed, _, _ = V.repeated_feeds(spark, d)
    return enrich.lookup_abuse(V.plain_alerts(spark, d), feed).select(
        "id", "abuse.abuse_confidence_score", "abuse.country_code", "abuse.isp", "abuse.is_public",
        "abuse.domain", "abuse.total_reports", "abuse.last_reported_at", "abuse.is_whitelisted", "abuse.usage_type",
    )


@query("e2_scan_lookup", O.sql("""
SELECT pa.id, malicious_count, suspicious_count, harmless_count, undetected_count, total_engines, reputation, network, asn,
  as_owner, country, regional_internet_registry, last_analysis_date, tags FROM pa LEFT JOIN ti_scan ON ip_address = source_ip"""))
def _(spark, d):
    _, feed, _ = V.repeated_feeds(spark, d)
    return enrich.lookup_scan(V.plain_alerts(spark, d), feed).select(
        "id", "scan.malicious_count", "scan.suspicious_count", "scan.harmless_count", "scan.undetected_count",
        "scan.total_engines", "scan.reputation", "scan.network", "scan.asn", "scan.as_owner", "scan.country",
        "scan.regional_internet_registry", "scan.last_analysis_date", "scan.tags",
    )


@query("e3_geo_lookup", O.sql("""
SELECT pa.id, hostname, city, region, country, org, asn, timezone, loc FROM pa LEFT JOIN ti_geo ON ip = source_ip"""))
def _(spark, d):
    _, _, feed = V.repeated_feeds(spark, d)
    return enrich.lookup_geo(V.plain_alerts(spark, d), feed).select(
        "id", "geo.hostname", "geo.city", "geo.region", "geo.country", "geo.org", "geo.asn", "geo.timezone", "geo.loc"
    )


@query("e4_prefer_source", O.sql("""
SELECT ip_address, CASE WHEN u * 5 % 120 <= 60 THEN abuse_confidence_score ELSE 0 END AS abuse_confidence_score,
  CASE WHEN u * 5 % 120 <= 60 THEN 'live' ELSE 'stored' END AS source FROM ti_abuse"""))
def _(spark, d):
    feed = V.ti_abuse(spark, d)
    recent = enrich.recent_reports(feed, F.lit("2024-01-31 00:00:00Z").cast("timestamp"), 60)
    stored = feed.withColumn("abuse_confidence_score", F.lit(0).cast("long"))
    return enrich.prefer(recent, stored, "ip_address", "live", "stored").select(
        "ip_address", "abuse_confidence_score", "source"
    )


@query("e5_lookback", O.sql(f"""
SELECT ip_address, {O.t('last_reported_at')} AS last_reported_at FROM ti_abuse
WHERE last_reported_at >= TIMESTAMP '2024-02-01' - INTERVAL 90 DAY"""))
def _(spark, d):
    return enrich.recent_reports(V.ti_abuse(spark, d), _as_of()).select("ip_address", "last_reported_at")


_MOVED = """(SELECT * REPLACE (last_reported_at + to_days(o::INTEGER) AS last_reported_at, abuse_confidence_score + o AS abuse_confidence_score)
  FROM (SELECT *, unnest([0, -30, 400]) AS o FROM ti_abuse))"""


def _as_of_sql(feed: str) -> str:
    return f"""
FROM (SELECT pa.*, r.ip_address, r.last_reported_at, r.abuse_confidence_score, r.country_code, r.isp FROM pa
  ASOF LEFT JOIN {feed} r ON pa.source_ip = r.ip_address AND pa.created_at >= r.last_reported_at) x"""


_FRESH = "x.last_reported_at >= x.created_at - INTERVAL 90 DAY"


@query("e5_as_of", O.sql(f"""
SELECT id, CASE WHEN {_FRESH} THEN abuse_confidence_score END AS abuse_confidence_score,
  CASE WHEN {_FRESH} THEN {O.t('x.last_reported_at')} END AS last_reported_at
{_as_of_sql(_MOVED)}"""))
def _(spark, d):
    def moved(days: int):
        return V.ti_abuse(spark, d).withColumns({
            "abuse_confidence_score": F.col("abuse_confidence_score") + days,
            "last_reported_at": F.col("last_reported_at") + F.expr(f"INTERVAL {days} DAYS")})

    return enrich.abuse_as_of(V.plain_alerts(spark, d), moved(0).unionByName(moved(-30)).unionByName(moved(400))).select(
        "id", "abuse.abuse_confidence_score", "abuse.last_reported_at")


@query("e5_enrich_as_of", O.sql(f"""
SELECT x.id, coalesce(CASE WHEN {_FRESH} THEN x.abuse_confidence_score END, 0) AS abuseipdb_score,
  coalesce(s.malicious_count, 0) AS vt_malicious,
  CASE WHEN ({_FRESH}) OR s.ip_address IS NOT NULL OR g.ip IS NOT NULL THEN
    coalesce(g.country, CASE WHEN {_FRESH} THEN x.country_code END, '') END AS country
{_as_of_sql("ti_abuse")} LEFT JOIN ti_scan s ON s.ip_address = source_ip LEFT JOIN ti_geo g ON g.ip = source_ip"""))
def _(spark, d):
    abuse, scan, geo = V.feeds(spark, d)
    return enrich.enrich_as_of(V.plain_alerts(spark, d), abuse, scan, geo).select(
        "id", "abuseipdb_score", "vt_malicious", "country")


@query("e6_watchlist", O.sql("SELECT id, source_ip FROM pa WHERE source_ip IN (SELECT ip FROM ips WHERE bad OR u % 9 = 0)"))
def _(spark, d):
    listed = V.addresses(spark, d).where("bad or u % 9 = 0").selectExpr("ip AS ip_address")
    return enrich.on_watchlist(V.plain_alerts(spark, d), listed).select("id", "source_ip")


@query("e6_watchlist_flag", O.sql(f"SELECT id, source_ip IN {O._in(D.WATCHLIST)} AS watched FROM pa"))
def _(spark, d):
    return V.plain_alerts(spark, d).select("id", enrich.watchlist_flag(F.col("source_ip")).alias("watched"))


_FACE = "replace(source_ip, '198.18.', CASE WHEN user_id % 2 = 0 THEN '172.16.' ELSE '172.20.' END)"


@query("e7_public_flag", O.sql(f"""
SELECT id, NOT (ip LIKE '10.%' OR ip LIKE '192.168.%' OR ip LIKE '172.16.%') AS is_public,
  NOT (ip LIKE '10.%' OR ip LIKE '192.168.%' OR ip LIKE '172.16.%' OR ip LIKE '172.20.%') AS is_public_rfc1918
FROM (SELECT id, {_FACE} AS ip FROM pa)"""))
def _(spark, d):
    ip = F.expr(_FACE)
    return V.plain_alerts(spark, d).select(
        "id", network.is_public(ip).alias("is_public"),
        network.is_public(ip, rfc1918=True).alias("is_public_rfc1918"),
    )


@query("e8_network16", O.sql("""
SELECT id, split_part(source_ip, '.', 1) || '.' || split_part(source_ip, '.', 2) || '.0.0/16' AS network FROM pa"""))
def _(spark, d):
    return V.plain_alerts(spark, d).select("id", network.network16(F.col("source_ip")).alias("network"))


@query("e9_host_name", O.sql("SELECT id, 'host-' || replace(source_ip, '.', '-') || '.example.net' AS hostname FROM pa"))
def _(spark, d):
    return V.plain_alerts(spark, d).select("id", network.host_name(F.col("source_ip")).alias("hostname"))


@query("e10_asn", O.sql("SELECT ip, coalesce(split_part(org, ' ', 1), '') AS asn FROM ti_geo"))
def _(spark, d):
    return V.ti_geo(spark, d).select("ip", network.asn_of(F.col("org")).alias("asn"))


@query("e11_engine_total", O.sql("""
SELECT event_id, CASE WHEN user_id % 4 + event_id % 3 = 0 THEN 90 ELSE user_id % 4 + event_id % 3 END AS total FROM pa"""))
def _(spark, d):
    none = F.lit(None).cast("long")
    total = network.engine_total(F.col("user_id") % 4, F.col("event_id") % 3, F.lit(0), none)
    return V.plain_alerts(spark, d).select("event_id", total.alias("total"))


@query("e12_undetected", O.sql("""
SELECT ip_address, greatest(total_engines - malicious_count - suspicious_count - harmless_count, 0) AS undetected FROM ti_scan"""))
def _(spark, d):
    left = network.undetected(
        F.col("total_engines"), F.col("malicious_count"), F.col("suspicious_count"), F.col("harmless_count")
    )
    return V.ti_scan(spark, d).select("ip_address", left.alias("undetected"))


@query("e13_iso_time", O.sql(f"""
SELECT id, {O.iso('created_at')} AS created, {O.iso("date_trunc('second', created_at)")} AS whole,
  strftime(created_at::DATE - (user_id % 30)::INTEGER, '%Y-%m-%d') AS seen FROM pa"""))
def _(spark, d):
    at = F.col("created_at")
    return V.plain_alerts(spark, d).select(
        "id", text.iso_utc(at).alias("created"),
        text.iso_utc(F.timestamp_seconds(F.unix_seconds(at))).alias("whole"),
        F.date_sub(text.utc_date(at), (F.col("user_id") % 30).cast("int")).alias("seen"),
    )


def _reports(spark, d):
    ips = V.plain_alerts(spark, d).select("source_ip").distinct()
    return enrich.reports(ips, *V.feeds(spark, d))


@query("e14_confidence", O.sql("SELECT source_ip, conf AS aggregate_confidence FROM vd"))
def _(spark, d):
    return _reports(spark, d).select("source_ip", "aggregate_confidence")


@query("e15_verdict", O.sql("SELECT id, threat_verdict FROM en"))
def _(spark, d):
    return V.scored(spark, d).select("id", "threat_verdict")


@query("e16_report", O.sql("""
SELECT source_ip AS ip_address, abuse_confidence_score AS abuse, total_reports, usage_type, domain, suspicious_count, region,
  malicious_count AS malicious, city, country, asn, org,
  conf AS aggregate_confidence, verdict AS threat_verdict, malicious_count IS NULL AS no_scan FROM vd"""))
def _(spark, d):
    def of(path: str, kind: str = "string"):
        return F.get_json_object("report", f"$.{path}").cast(kind)

    packed = _reports(spark, d).select(enrich.report_json().alias("report"))
    return packed.select(
        of("ip_address").alias("ip_address"),
        of("abuseipdb.abuse_confidence_score", "long").alias("abuse"),
        of("abuseipdb.total_reports", "long").alias("total_reports"), of("abuseipdb.usage_type").alias("usage_type"),
        of("abuseipdb.domain").alias("domain"), of("ipinfo.region").alias("region"),
        of("virustotal.suspicious_count", "long").alias("suspicious_count"),
        of("virustotal.malicious_count", "long").alias("malicious"), of("ipinfo.city").alias("city"),
        of("country").alias("country"), of("asn").alias("asn"), of("org").alias("org"),
        of("aggregate_confidence", "double").alias("aggregate_confidence"),
        of("threat_verdict").alias("threat_verdict"),
        F.col("report").contains('"virustotal":null').alias("no_scan"),
    )


@query("e17_enrichment_view", O.sql("""
SELECT id, alert_id, source_ip, risk_score, risk_level, '51–75' AS high_band, conf AS aggregate_confidence, country FROM a"""))
def _(spark, d):
    view = enrich.enrichment_view(V.alerts(spark, d), *V.feeds(spark, d))
    return view.select(
        "id", "alert_id", "source_ip", "risk_info.risk_score", "risk_info.risk_level",
        F.col("risk_info.bands")["High"].alias("high_band"),
        "threat_intelligence.aggregate_confidence", "threat_intelligence.country",
    )


# --- risk -------------------------------------------------------------------------------

@query("r1_severity_points", O.sql(f"SELECT id, {O.SEVERITY_POINTS} AS points FROM rw"))
def _(spark, d):
    return V.raw_alerts(spark, d).select("id", scoring.severity_points(F.col("severity")).alias("points"))


@query("r2_type_points", O.sql(f"SELECT id, {O.TYPE_POINTS} AS points FROM rw"))
def _(spark, d):
    return V.raw_alerts(spark, d).select("id", scoring.type_points(F.col("alert_type")).alias("points"))


@query("r3_threat_points", O.sql("SELECT source_ip, round(conf / 100 * 20, 6) AS points FROM vd"))
def _(spark, d):
    points = scoring.threat_points(F.col("aggregate_confidence"))
    return _reports(spark, d).select("source_ip", F.round(points, 6).alias("points"))


@query("r4_off_hours", O.sql("""
SELECT id, CASE WHEN hour(created_at) < 6 THEN 10e0 ELSE 0e0 END AS points,
  CASE WHEN CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE hour(created_at) < 6 END THEN 10e0 ELSE 0e0 END
  AS forced FROM pa"""))
def _(spark, d):
    at = F.col("created_at")
    flag = F.expr("CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END")
    return V.plain_alerts(spark, d).select(
        "id", scoring.off_hours_points(at).alias("points"), scoring.off_hours_points(at, flag).alias("forced")
    )


@query("r5_risk_score", O.sql("SELECT id, risk_score FROM a"))
def _(spark, d):
    return V.scored(spark, d).select("id", "risk_score")


@query("r6_risk_level", O.sql(f"SELECT id, risk_level, {O.contiguous('risk_score')} AS contiguous FROM a"))
def _(spark, d):
    score = F.col("risk_score")
    return V.scored(spark, d).select(
        "id", scoring.risk_level(score).alias("risk_level"),
        scoring.risk_level(score, "contiguous").alias("contiguous"),
    )


@query("r7_score_summary", O.sql(f"SELECT id, v AS risk_score, {O.level('v')} AS risk_level, '26–50' AS medium_band FROM (SELECT id, value / 4 AS v FROM (SELECT event_id + 1 AS id, value FROM events))"))
def _(spark, d):
    summary = scoring.score_summary(F.col("value") / 4)
    return V.table(spark, d, "events").select((F.col("event_id") + 1).alias("id"), summary.alias("s")).select(
        "id", "s.risk_score", "s.risk_level", F.col("s.bands")["Medium"].alias("medium_band")
    )


@query("r8_rounding", O.sql("""
SELECT alert_type, round(avg(risk_score), 2) AS mean_score, round(avg(aggregate_confidence), 1) AS mean_confidence,
  round(count(*) FILTER (severity = 'High') * 100e0 / count(*), 1) AS high_pct FROM a GROUP BY 1"""))
def _(spark, d):
    return V.scored(spark, d).groupBy("alert_type").agg(
        F.round(F.avg("risk_score"), 2).alias("mean_score"),
        F.round(F.avg("aggregate_confidence"), 1).alias("mean_confidence"),
        F.round(F.count_if(F.col("severity") == "High") * 100.0 / F.count("*"), 1).alias("high_pct"),
    )


# --- alerts --------------------------------------------------------------------------------

def _ingested(spark, d):
    return ingest(V.raw_alerts(spark, d), *V.repeated_feeds(spark, d))


@query("a1_ingest_alerts", O.sql(f"""
SELECT id, alert_id, alert_type, source_ip, severity, status, description, risk_score, threat_verdict,
  {O.t('created_at')} AS created_at, CASE WHEN conf IS NULL THEN '' ELSE concat_ws('|', 'ip_address=' || source_ip, 'country=' || country,
    'asn=' || asn, 'org=' || org, 'aggregate_confidence=' || conf::VARCHAR, 'threat_verdict=' || verdict,
    'abuseipdb.total_reports=' || total_reports::VARCHAR) END AS enrichment FROM oka"""))
def _(spark, d):
    return _ingested(spark, d).alerts.select(
        "id", "alert_id", "alert_type", "source_ip", "severity", "status", "description", "risk_score",
        "threat_verdict", "created_at", _json_fields("enrichment_data", [
            "ip_address", "country", "asn", "org", "aggregate_confidence", "threat_verdict", "abuseipdb.total_reports",
        ]).alias("enrichment"),
    )


@query("a1_ingest_events", O.sql(f"""
SELECT id AS alert_db_id, 'RiskCalculated' AS event_type, risk_score, {O.level('risk_score')} AS risk_level,
  NULL::DOUBLE AS confidence, NULL::VARCHAR AS type_created FROM oka
UNION ALL SELECT id, 'AlertEnriched', NULL, NULL, aggregate_confidence, NULL FROM oka
UNION ALL SELECT id, 'AlertCreated', NULL, NULL, NULL, alert_type FROM oka"""))
def _(spark, d):
    def of(field: str, kind: str = "string"):
        return F.get_json_object("metadata_json", f"$.{field}").cast(kind)

    return _ingested(spark, d).events.select(
        "alert_db_id", "event_type", of("risk_score", "double").alias("risk_score"),
        of("risk_level").alias("risk_level"), of("aggregate_confidence", "double").alias("confidence"),
        of("alert_type").alias("type_created"),
    )


@query("a1_ingest_rejects", O.sql("SELECT id, array_to_string(reasons, '|') AS reasons FROM chk WHERE len(reasons) > 0"))
def _(spark, d):
    return _ingested(spark, d).rejects.select("id", "reasons")


@query("a2_filter", O.sql("SELECT id FROM pa WHERE severity = 'High' AND status = 'Open'"))
def _(spark, d):
    return alerts.matching(V.plain_alerts(spark, d), severity="High", status="Open").select("id")


@query("a3_type_substring", O.sql("SELECT id, alert_type FROM pa WHERE alert_type ILIKE '%FORCE%' OR alert_type ILIKE '%c_ %'"))
def _(spark, d):
    rows = V.plain_alerts(spark, d)
    wild = alerts.matching(rows, alert_type="c_ ").select("id", "alert_type")
    return alerts.matching(rows, alert_type="FORCE").select("id", "alert_type").unionAll(wild)


@query("a3_type_escaped", O.sql("SELECT id, alert_type FROM pa WHERE alert_type ILIKE '%Zero-Day%'"))
def _(spark, d):
    rows = V.plain_alerts(spark, d)
    none = alerts.matching(rows, alert_type="o%i", escape=True)
    return alerts.matching(rows, alert_type="zero-day", escape=True).unionAll(none).select("id", "alert_type")


@query("a4_page", O.sql(f"""
SELECT id, {O.t('created_at')} AS created_at FROM pa ORDER BY pa.created_at DESC, id DESC LIMIT 50 OFFSET 20"""))
def _(spark, d):
    return alerts.page(V.plain_alerts(spark, d), skip=20).select("id", "created_at")


@query("a4_keyset_page", O.sql(f"""
SELECT id, {O.t('created_at')} AS created_at FROM pa WHERE pa.created_at < TIMESTAMP '2024-01-15'
ORDER BY pa.created_at DESC, id DESC LIMIT 100"""))
def _(spark, d):
    return alerts.page(V.plain_alerts(spark, d), limit=100, after=("2024-01-15", 0)).select("id", "created_at")


@query("a4_deep_page", O.sql(f"""
SELECT id, {O.t('created_at')} AS created_at, severity FROM a ORDER BY a.created_at DESC, id DESC
LIMIT 100 OFFSET (SELECT (count(*) * 9 // 10)::BIGINT FROM a)"""))
def _(spark, d):
    rows = V.alerts(spark, d)
    return alerts.deep_page(rows, rows.count() * 9 // 10, 100).select("id", "created_at", "severity")


@query("a5_page_with_total", O.sql("""
SELECT (SELECT count(*) FROM pa) AS total, (SELECT count(*) FROM pa WHERE severity = 'Critical') AS total_matching, id
FROM (SELECT id FROM pa WHERE severity = 'Critical' ORDER BY created_at DESC, id DESC LIMIT 50)"""))
def _(spark, d):
    return alerts.page_with_total(V.plain_alerts(spark, d), severity="Critical").select(
        "total", "total_matching", "id"
    )


@query("a5_empty_page", O.sql("SELECT count(*) AS total, 0 AS total_matching, NULL::BIGINT AS id FROM pa"))
def _(spark, d):
    return alerts.page_with_total(V.plain_alerts(spark, d), alert_type="no such type").select(
        "total", "total_matching", "id"
    )


@query("a6_by_id", O.sql("SELECT id, alert_id, alert_type, source_ip FROM pa WHERE id = 42"))
def _(spark, d):
    return alerts.by_id(V.plain_alerts(spark, d), 42).select("id", "alert_id", "alert_type", "source_ip")


@query("a7_by_alert_id", O.sql("SELECT id, alert_id FROM pa WHERE alert_id IN (SELECT alert_id FROM req)"))
def _(spark, d):
    return alerts.by_alert_id(V.plain_alerts(spark, d), V.playbook_requests(spark, d)).select("id", "alert_id")


_ASKED = [1, 9, 42, 1_042, 3_000, 9_999_999]


def _alert_lookup(spark, d) -> LookupTable:
    """All alerts laid out for look-ups, in two batches."""
    rows = V.plain_alerts(spark, d).select("id", "alert_id", "alert_type", "source_ip", "created_at")
    held = LookupTable(spark, run_dir(spark, "lookup"), rows.schema, "id", "alert_id", ["created_at"], 16, 500)
    held.add(rows.where("id % 2 = 0"), 0)
    held.add(rows.where("id % 2 = 1"), 1)
    return held


@query("a6_stored_by_id", O.sql(f"SELECT id, alert_id, alert_type, source_ip FROM pa WHERE id IN ({', '.join(map(str, _ASKED))})"))
def _(spark, d):
    return _alert_lookup(spark, d).by_key(_ASKED).select("id", "alert_id", "alert_type", "source_ip")


_NAMED = [f"ALERT-{i:08d}" for i in _ASKED]


@query("a7_stored_by_alert_id", O.sql(f"SELECT id, alert_id FROM pa WHERE alert_id IN ({', '.join(map(repr, _NAMED))})"))
def _(spark, d):
    return _alert_lookup(spark, d).by_name(_NAMED).select("id", "alert_id")


def _changed(spark, d):
    return alerts.change_status(V.light_alerts(spark, d), V.status_changes(spark, d))


@query("a8_status_history", O.sql(f"SELECT id, alert_id, old_status, new_status, {O.t('ts')} AS ts, seq FROM hist"))
def _(spark, d):
    return _changed(spark, d).history


@query("a8_current_status", O.sql("SELECT id, alert_id, status FROM cur"))
def _(spark, d):
    return _changed(spark, d).alerts.select("id", "alert_id", "status")


@query("a9_unknown_ids", O.sql("""
SELECT id, seq, 'alert not found' AS reason FROM chg WHERE id NOT IN (SELECT id FROM pa)
UNION ALL SELECT event_id + 1, 3, 'status: unknown' FROM events WHERE event_id % 500 = 1"""))
def _(spark, d):
    return _changed(spark, d).rejects.select("id", "seq", "reason")


def _deleted(spark, d):
    return alerts.delete(
        _changed(spark, d).alerts, _events(spark, d), _runs(spark, d), V.delete_requests(spark, d)
    )


@query("a1_ingest_duplicates", O.sql("""
SELECT id, 'id: required' AS reason FROM (SELECT NULL::BIGINT AS id FROM rw WHERE id % 40 = 1)
UNION ALL SELECT id, 'id: already used' FROM (SELECT id FROM ok UNION ALL SELECT id FROM ok WHERE id % 100 < 5) WHERE id % 9 = 0
UNION ALL SELECT id, 'id: already used' FROM ok WHERE id % 100 < 5 AND id % 9 <> 0
UNION ALL SELECT id, unnest(reasons) FROM (SELECT id, reasons FROM chk UNION ALL SELECT id, reasons FROM chk WHERE id % 100 < 5)
  WHERE len(reasons) > 0"""))
def _(spark, d):
    raw = V.raw_alerts(spark, d)
    unnamed = V.plain_alerts(spark, d).where("id % 40 = 1").selectExpr(
        "CAST(NULL AS BIGINT) AS id", *[c for c in S.RAW_ALERTS.fieldNames() if c != "id"])
    sent = raw.unionByName(raw.where("id % 100 < 5")).unionByName(unnamed)
    stored = V.plain_alerts(spark, d).where("id % 9 = 0").select("id")
    refused = ingest(sent, *V.feeds(spark, d), existing=stored).rejects
    return refused.select("id", F.explode("reasons").alias("reason"))


@query("a10_delete_alerts", O.sql("SELECT id FROM pa WHERE id NOT IN (SELECT id FROM dels)"))
def _(spark, d):
    return _deleted(spark, d).alerts.select("id")


@query("a10_delete_timeline", O.sql("SELECT alert_db_id, event_type, seq FROM el WHERE alert_db_id NOT IN (SELECT id FROM dels)"))
def _(spark, d):
    return _deleted(spark, d).timeline.select("alert_db_id", "event_type", "seq")


@query("a10_delete_executions", O.sql("SELECT alert_db_id, seq FROM run WHERE alert_db_id NOT IN (SELECT id FROM dels)"))
def _(spark, d):
    return _deleted(spark, d).executions.select("alert_db_id", "seq")


@query("a10_delete_rejects", O.sql("SELECT id FROM dels WHERE id NOT IN (SELECT id FROM pa)"))
def _(spark, d):
    return _deleted(spark, d).rejects


def _by_day(spark, d) -> str:
    path = run_dir(spark, "days")
    tables.append(V.light_alerts(spark, d), path, day_of="created_at")
    return path


@query("a10_delete_days", O.sql("""
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS rows, sum(id)::BIGINT AS id_sum FROM pa
WHERE NOT (event_id % 3 = 0 AND day(created_at) IN (3, 17)) AND day(created_at) <> 9 GROUP BY 1"""))
def _(spark, d):
    """A third of two days goes, and all of another; other days are not written."""
    path, at = _by_day(spark, d), F.dayofmonth(F.to_utc_timestamp("created_at", F.current_timezone()))
    gone = V.light_alerts(spark, d).where(((F.col("event_id") % 3 == 0) & at.isin(3, 17)) | (at == 9)).select("id")
    tables.rewrite_days(spark, path, "id", gone)
    return tables.scan(spark, path).groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count("*").alias("rows"), F.sum("id").alias("id_sum"))


@query("a8_status_days", O.sql("""
SELECT id, CASE WHEN event_id % 50 = 7 AND day(created_at) <= 5 THEN 'Resolved' ELSE status END AS status FROM pa"""))
def _(spark, d):
    path, at = _by_day(spark, d), F.dayofmonth(F.to_utc_timestamp("created_at", F.current_timezone()))
    new = V.light_alerts(spark, d).where((F.col("event_id") % 50 == 7) & (at <= 5)).select(
        "id", F.lit("Resolved").alias("_status"))
    tables.rewrite_days(spark, path, "id", new, lambda rows: rows.withColumn("status", F.coalesce("_status", "status")))
    return tables.scan(spark, path).select("id", "status")


@query("a11_updated_at", O.sql(f"SELECT id, {O.t('updated_at')} AS updated_at FROM cur"))
def _(spark, d):
    return _changed(spark, d).alerts.select("id", "updated_at")


# --- timeline ---------------------------------------------------------------------------------

_EVENT = f"alert_db_id, alert_id, event_type, seq, description, meta, {O.t('occurred_at')} AS occurred_at"
_META = [
    "alert_type", "source_ip", "severity", "threat_verdict", "aggregate_confidence", "abuseipdb_score", "vt_malicious",
    "risk_score", "risk_level", "old_status", "new_status", "playbook", "target", "status", "action",
]


def _shown(events: DataFrame) -> DataFrame:
    return events.select("alert_db_id", "alert_id", "event_type", "seq", "description",
                         _json_fields("metadata_json", _META).alias("meta"), "occurred_at")


@query("t1_lifecycle_events", O.sql(f"SELECT {_EVENT} FROM tl"))
def _(spark, d):
    return _shown(timeline.lifecycle_events(V.scored(spark, d)))


@query("t2_status_events", O.sql(f"SELECT {_EVENT} FROM st"))
def _(spark, d):
    return _shown(timeline.status_events(_changed(spark, d).history))


def _runs(spark, d, reports=None):
    found = actions.resolve(V.playbook_requests(spark, d), V.alerts(spark, d, reports))
    return actions.executions(found.requests)


@query("t3_playbook_events", O.sql(f"SELECT {_EVENT} FROM pe"))
def _(spark, d):
    return _shown(timeline.playbook_events(_runs(spark, d)))


@query("t4_deletions", O.sql(f"""
SELECT pa.id AS alert_db_id, alert_id, 'AlertDeleted' AS event_type, alert_type, source_ip, {O.t('dels.ts')} AS occurred_at
FROM pa JOIN dels USING (id)"""))
def _(spark, d):
    gone = _deleted(spark, d).deletions
    return gone.select(
        "alert_db_id", "alert_id", "event_type",
        F.get_json_object("metadata_json", "$.alert_type").alias("alert_type"),
        F.get_json_object("metadata_json", "$.source_ip").alias("source_ip"), "occurred_at",
    )


def _events(spark, d, reports=None):
    reports = V.reports(spark, d) if reports is None else reports
    return timeline.event_log(
        timeline.lifecycle_events(V.scored(spark, d, reports)), timeline.status_events(_changed(spark, d).history),
        timeline.playbook_events(_runs(spark, d, reports)),
    )


@query("t5_event_log", O.sql(f"SELECT {_EVENT} FROM el"))
def _(spark, d):
    return _shown(_events(spark, d))


@query("t6_of_alert", O.sql(f"SELECT {_EVENT} FROM el WHERE alert_db_id = 1 ORDER BY el.occurred_at, seq, event_type"))
def _(spark, d):
    return _shown(timeline.of_alert(_events(spark, d), 1))


@query("t7_of_alert_name", O.sql(f"SELECT {_EVENT} FROM el WHERE alert_id = 'ALERT-00000009' ORDER BY el.occurred_at, seq, event_type"))
def _(spark, d):
    return _shown(timeline.of_alert_name(_events(spark, d), "ALERT-00000009"))


def _event_lookup(spark, d) -> LookupTable:
    """The whole event log laid out for look-ups by its alert."""
    log = _events(spark, d)
    held = LookupTable(
        spark, run_dir(spark, "events"), log.schema, "alert_db_id", "alert_id", ["occurred_at", "seq", "event_type"], 16, 2_000)
    held.add(log, 0)
    return held


@query("t6_stored_of_alert", O.sql(f"SELECT {_EVENT} FROM el WHERE alert_db_id IN ({', '.join(map(str, _ASKED))})"))
def _(spark, d):
    return _shown(_event_lookup(spark, d).by_key(_ASKED))


@query("t7_stored_of_alert_name", O.sql(f"SELECT {_EVENT} FROM el WHERE alert_id IN ({', '.join(map(repr, _NAMED))})"))
def _(spark, d):
    return _shown(_event_lookup(spark, d).by_name(_NAMED))


@query("t8_nested", O.sql(f"""
SELECT a.id, a.alert_id, severity, risk_score, threat_verdict, coalesce(chunk_no, 0) AS chunk_no, coalesce(n, 0) AS n, coalesce(kinds, '') AS kinds,
  coalesce(positions, '') AS positions, first_at FROM a LEFT JOIN (
  SELECT alert_db_id, (pos - 1) // 1000 AS chunk_no, count(*) AS n, string_agg(event_type || ' ' || description, '|' ORDER BY pos) AS kinds,
    string_agg(pos::VARCHAR, '|' ORDER BY pos) AS positions, {O.t('min(occurred_at)')} AS first_at
  FROM (SELECT *, row_number() OVER (PARTITION BY alert_db_id ORDER BY occurred_at, seq, event_type) AS pos
        FROM el) GROUP BY 1, 2) e ON alert_db_id = id"""))
def _(spark, d):
    reports = V.reports(spark, d)
    events = cut_lineage(_events(spark, d, reports))
    return timeline.nested(V.alerts(spark, d, reports), events).select(
        "id", "alert_id", "severity", "risk_score", "threat_verdict", "chunk_no", F.size("events").alias("n"),
        F.transform("events", lambda e: F.concat(e["event_type"], F.lit(" "), e["description"])).alias("kinds"),
        F.transform("events", lambda e: e["position"].cast("string")).alias("positions"),
        F.get("events", F.lit(0))["occurred_at"].alias("first_at"),
    )


# --- dashboard -----------------------------------------------------------------------------------

@query("d1_count", O.sql("SELECT count(*) AS total FROM pa"))
def _(spark, d):
    return dashboard.count_all(V.plain_alerts(spark, d))


def _domain_sql(column: str, values: list[str], table: str) -> str:
    names = ", ".join(f"('{v}')" for v in values)
    return O.sql(
        f"SELECT v.{column}, count(x.{column}) AS count FROM (VALUES {names}) v({column}) "
        f"LEFT JOIN {table} x ON x.{column} = v.{column} GROUP BY 1"
    )


@query("d2_by_status", _domain_sql("status", D.STATUSES, "pa"))
def _(spark, d):
    return dashboard.by_status(V.plain_alerts(spark, d))


@query("d3_by_severity", _domain_sql("severity", D.SEVERITIES, "pa"))
def _(spark, d):
    return dashboard.by_severity(V.plain_alerts(spark, d))


@query("d4_by_verdict", _domain_sql("threat_verdict", D.VERDICTS, "a"))
def _(spark, d):
    return dashboard.by_verdict(V.alerts(spark, d))


@query("d4_verdict_ips", O.sql(f"""
SELECT v.threat_verdict, count(DISTINCT source_ip) AS count FROM (VALUES {', '.join(f"('{v}')" for v in D.VERDICTS)}) v(threat_verdict)
LEFT JOIN a USING (threat_verdict) GROUP BY 1"""))
def _(spark, d):
    return dashboard.by_verdict(V.alerts(spark, d), distinct_ips=True)


@query("d5_mean_score", O.sql("SELECT round(avg(risk_score), 2) AS avg_risk_score FROM a"))
def _(spark, d):
    return dashboard.mean_score(V.alerts(spark, d))


def _blocked(spark, d):
    none = spark.createDataFrame([], S.BLOCKED_IPS)
    return actions.block_entries(_runs(spark, d), none)


@query("d6_summary", O.sql("""
SELECT count(*) AS total_alerts, count(*) FILTER (status = 'Open') AS open_alerts,
  count(*) FILTER (status = 'Investigating') AS investigating_alerts, count(*) FILTER (status = 'Resolved') AS resolved_alerts,
  count(*) FILTER (severity = 'Critical') AS critical_alerts, count(*) FILTER (severity = 'High') AS high_alerts,
  count(*) FILTER (severity = 'Medium') AS medium_alerts, count(*) FILTER (severity = 'Low') AS low_alerts,
  count(*) FILTER (threat_verdict = 'Malicious') AS malicious_ips, count(*) FILTER (threat_verdict = 'Suspicious') AS suspicious_ips,
  coalesce(round(avg(risk_score), 2), 0e0) AS avg_risk_score, (SELECT count(*) FROM blk) AS blocked_ips FROM a"""))
def _(spark, d):
    return dashboard.summary(V.alerts(spark, d), _blocked(spark, d))


def _histogram_sql(level: str) -> str:
    names = ", ".join(f"('{k}', '{v}')" for k, v in D.BAND_RANGE.items())
    return O.sql(f"""
SELECT v.label, v.range, count(x.l) AS count, round(count(x.l) * 100e0 / (SELECT count(*) FROM a), 1) AS pct,
  (SELECT count(*) FROM a) AS total
FROM (VALUES {names}) v(label, range) LEFT JOIN (SELECT {level} AS l FROM a) x ON x.l = v.label GROUP BY 1, 2""")


@query("d7_risk_distribution", _histogram_sql("risk_level"))
def _(spark, d):
    return dashboard.risk_distribution(V.alerts(spark, d))


@query("d7_contiguous", _histogram_sql(O.contiguous("risk_score")))
def _(spark, d):
    return dashboard.risk_distribution(V.alerts(spark, d), "contiguous")


@query("d8_recent", O.sql(f"SELECT id, {O.t('created_at')} AS created_at FROM pa ORDER BY pa.created_at DESC, id DESC LIMIT 10"))
def _(spark, d):
    return dashboard.recent(V.plain_alerts(spark, d)).select("id", "created_at")


@query("d9_trend", O.sql("""
SELECT strftime(day, '%Y-%m-%d') AS date, count(pa.id) AS count
FROM (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-02-03', INTERVAL 1 DAY)) AS day) c
LEFT JOIN pa ON pa.created_at::DATE = c.day::DATE GROUP BY 1"""))
def _(spark, d):
    return dashboard.trend(V.plain_alerts(spark, d), "2024-02-03", 30)


@query("d10_by_country", O.sql("""
SELECT country, count(*) AS count, sum(count(*)) OVER ()::BIGINT AS total FROM a WHERE country IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    return dashboard.by_country(V.scored(spark, d))


@query("d10_by_country_json", O.sql("""
SELECT country, count(*) AS count, (sum(count(*)) OVER ())::BIGINT AS total FROM a WHERE country IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    return dashboard.by_country(V.alerts(spark, d))


@query("d11_count_blocked", O.sql("SELECT count(*) AS blocked_ips FROM blk"))
def _(spark, d):
    return dashboard.count_blocked(_blocked(spark, d))


# --- actions --------------------------------------------------------------------------------------

_CATALOG = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in D.PLAYBOOKS)


def _partials(spark, d):
    """Partials of four batches, and of the changes of status after them."""
    rows, path = cut_lineage(V.alerts(spark, d)), run_dir(spark, "partials")
    for part in range(4):
        rollup.partials(rows.where(F.col("id") % 4 == part)).write.mode("append").parquet(path)
    history = alerts.change_status(rows, V.status_changes(spark, d)).history
    rollup.status_partials(rows, history).write.mode("append").parquet(path)
    return rollup.merged(spark.read.parquet(path))


_NOW = """
now AS (SELECT a.* REPLACE (coalesce(c.s, a.status) AS status) FROM a LEFT JOIN (
  SELECT id, arg_max(new_status, (ts, seq)) AS s FROM chg GROUP BY id) c USING (id))"""


@query("d6_summary_rollup", f"""WITH {O.VIEWS}, {_NOW} SELECT count(*) AS total_alerts,
  count(*) FILTER (status = 'Open') AS open_alerts, count(*) FILTER (status = 'Investigating') AS investigating_alerts,
  count(*) FILTER (status = 'Resolved') AS resolved_alerts, count(*) FILTER (severity = 'Critical') AS critical_alerts,
  count(*) FILTER (severity = 'High') AS high_alerts, count(*) FILTER (severity = 'Medium') AS medium_alerts,
  count(*) FILTER (severity = 'Low') AS low_alerts, count(*) FILTER (threat_verdict = 'Malicious') AS malicious_ips,
  count(*) FILTER (threat_verdict = 'Suspicious') AS suspicious_ips, round(avg(risk_score), 2) AS avg_risk_score,
  0 AS blocked_ips FROM now""")
def _(spark, d):
    return rollup.summary(_partials(spark, d), spark.createDataFrame([], S.BLOCKED_IPS))


@query("d7_rollup", O.sql("SELECT risk_level, count(*) AS count FROM a GROUP BY 1"))
def _(spark, d):
    return rollup.risk_distribution(_partials(spark, d)).where("count > 0")


@query("d9_days_rollup", O.sql("SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS count FROM a GROUP BY 1"))
def _(spark, d):
    return rollup.by_day(_partials(spark, d))


@query("d10_country_rollup", O.sql("""
SELECT r.country, count(*) AS count FROM a JOIN rep r USING (source_ip) GROUP BY 1"""))
def _(spark, d):
    return rollup.by_country(_partials(spark, d))


@query("d4_distinct_rollup", O.sql("SELECT threat_verdict, true AS close FROM a GROUP BY 1"))
def _(spark, d):
    """Whether the sketch is within 5 % of the exact number, three standard errors."""
    exact = V.alerts(spark, d).groupBy("threat_verdict").agg(F.count_distinct("source_ip").alias("n"))
    told = rollup.distinct_ips(_partials(spark, d)).join(exact, "threat_verdict")
    return told.select("threat_verdict", (F.abs(F.col("count") - F.col("n")) <= F.greatest(F.lit(1), F.col("n") * 0.05)).alias("close"))


@query("p1_catalog_use", O.sql(f"""
SELECT c.*, count(r.alert_id) AS requests FROM (VALUES {_CATALOG}) c(name, description, action, target_type)
LEFT JOIN req r ON r.playbook_name = c.name GROUP BY ALL"""))
def _(spark, d):
    used = V.playbook_requests(spark, d).groupBy("playbook_name").agg(F.count("*").alias("n"))
    listed = actions.catalog(spark)
    return listed.join(used, listed["name"] == used["playbook_name"], "left").select(
        "name", "description", "action", "target_type", F.coalesce("n", F.lit(0)).alias("requests")
    )


def _results(spark, d, playbook):
    found = actions.resolve(V.playbook_requests(spark, d), V.alerts(spark, d))
    return actions.run(found.requests, playbook)


_BASE = f"alert_id, seq, {O.iso('ts')} AS executed_at, requested_by AS executed_by"


@query("p2_block_ip", O.sql(f"""
SELECT {_BASE}, 'BLOCK-RULE-' || left(md5(target), 8) AS rule_id, coalesce(notes, 'Automated block via SOAR playbook') AS reason,
  'Firewall ACL rule created: DENY ' || target || '|WAF block rule added: IP=' || target || '|IDS/IPS signature triggered: ' || target AS actions_taken
FROM res WHERE playbook_name = 'block_ip'"""))
def _(spark, d):
    return _results(spark, d, "block_ip").select(
        "result.alert_id", "seq", "result.executed_at", "result.executed_by", "result.rule_id", "result.reason",
        "result.actions_taken",
    )


@query("p3_isolate_host", O.sql(f"""
SELECT {_BASE}, 'ISOLATE-' || left(md5(target || alert_id), 8) AS ticket_id,
  coalesce(notes, 'Automated isolation via SOAR playbook') AS reason,
  'EDR isolation command sent to agent on ' || target || '|Network VLAN changed: Quarantine VLAN activated|DNS blocked for host '
  || target || '|Active sessions terminated for ' || target AS actions_taken
FROM res WHERE playbook_name = 'isolate_host'"""))
def _(spark, d):
    return _results(spark, d, "isolate_host").select(
        "result.alert_id", "seq", "result.executed_at", "result.executed_by", "result.ticket_id", "result.reason",
        "result.actions_taken",
    )


@query("p4_notify_soc", O.sql(f"""
SELECT {_BASE}, 'NOTIF-' || left(md5(alert_id || {O.iso('ts')}), 8) AS notification_id,
  '🚨 SOAR Alert Notification' || chr(10) || 'Alert ID: ' || alert_id || chr(10) || 'Type: ' || alert_type || chr(10)
  || 'Severity: ' || severity || chr(10) || 'Target: ' || target || chr(10) || 'Time: ' || {O.iso('ts')} || chr(10)
  || 'Reason: ' || coalesce(notes, 'Automated SOC notification') || chr(10) || 'Triggered by: ' || requested_by AS notification_body,
  'Email: soc-team@company.com|Slack: #security-alerts|PagerDuty: SOC On-call' AS channels_notified
FROM res WHERE playbook_name = 'notify_soc'"""))
def _(spark, d):
    return _results(spark, d, "notify_soc").select(
        "result.alert_id", "seq", "result.executed_at", "result.executed_by", "result.notification_id",
        "result.notification_body", "result.channels_notified",
    )


@query("p5_escalate", O.sql(f"""
SELECT {_BASE}, 'SEC-' || k AS ticket_id, p AS priority, risk_score, {O.iso('ts')} AS sla_deadline,
  'ServiceNow ticket created: SEC-' || k || ' (Priority: ' || p || ')|Jira issue linked: SEC-PROJECT-SEC-' || k
  || '|Email sent to: security-management@company.com|On-call engineer notified via PagerDuty|War-room Slack channel #incident-sec-'
  || k || ' created' AS actions_taken
FROM (SELECT *, left(md5(alert_id), 8) AS k, CASE WHEN severity IN ('Critical', 'High') THEN 'P1' ELSE 'P2' END AS p
      FROM res WHERE playbook_name = 'escalate')"""))
def _(spark, d):
    return _results(spark, d, "escalate").select(
        "result.alert_id", "seq", "result.executed_at", "result.executed_by", "result.ticket_id", "result.priority",
        "result.risk_score", "result.sla_deadline", "result.actions_taken",
    )


@query("p6_resolve", O.sql("SELECT alert_id, seq, playbook_name, alert_db_id, target, requested_by FROM res"))
def _(spark, d):
    found = actions.resolve(V.playbook_requests(spark, d), V.alerts(spark, d))
    return found.requests.select("alert_id", "seq", "playbook_name", "alert_db_id", "target", "requested_by")


@query("p6_rejects", O.sql("""
SELECT alert_id, seq, CASE WHEN alert_id NOT IN (SELECT alert_id FROM pa) THEN 'alert not found' ELSE 'playbook not found' END AS reason
FROM req WHERE alert_id NOT IN (SELECT alert_id FROM pa) OR playbook_name = 'reboot'"""))
def _(spark, d):
    found = actions.resolve(V.playbook_requests(spark, d), V.alerts(spark, d))
    return found.rejects.select("alert_id", "seq", "reason")


@query("p7_executions", O.sql(f"""
SELECT alert_db_id, alert_id, seq, playbook_name, action, target, status, result_message, executed_by,
  {O.t('executed_at')} AS executed_at, result_message AS message_in_data,
  CASE WHEN error IS NOT NULL THEN 'error=' || error ELSE concat_ws('|', 'playbook=' || playbook_name, 'action=' || action,
    'target=' || target, 'alert_id=' || alert_id, 'executed_by=' || executed_by, 'status=' || status,
    CASE WHEN playbook_name = 'escalate' THEN 'priority=' || CASE WHEN severity IN ('Critical', 'High') THEN 'P1' ELSE 'P2' END END,
    CASE WHEN playbook_name = 'escalate' THEN 'risk_score=' || risk_score::VARCHAR END) END AS data FROM run"""))
def _(spark, d):
    return _runs(spark, d).select(
        "alert_db_id", "alert_id", "seq", "playbook_name", "action", "target", "status", "result_message",
        "executed_by", "executed_at",
        F.coalesce(F.get_json_object("result_data", "$.message"), F.lit("")).alias("message_in_data"),
        _json_fields("result_data", [
            "error", "playbook", "action", "target", "alert_id", "executed_by", "status", "priority", "risk_score",
        ]).alias("data"),
    )


@query("p8_list_executions", O.sql(f"""
SELECT alert_db_id, seq, {O.t('executed_at')} AS executed_at FROM run
ORDER BY run.executed_at DESC, alert_db_id DESC, seq DESC LIMIT 50"""))
def _(spark, d):
    return actions.list_executions(_runs(spark, d)).select("alert_db_id", "seq", "executed_at")


@query("p9_block_register", O.sql(f"""
SELECT ip_address, alert_id, reason, blocked_by, {O.t('blocked_at')} AS blocked_at FROM blk
WHERE ip_address NOT IN (SELECT ip FROM ips WHERE u % 2 = 0)"""))
def _(spark, d):
    known = V.addresses(spark, d).where("u % 2 = 0").selectExpr("ip AS ip_address")
    return actions.block_entries(_runs(spark, d), known).select(
        "ip_address", "alert_id", "reason", "blocked_by", "blocked_at"
    )


@query("p10_list_blocked", O.sql(f"""
SELECT ip_address, {O.t('blocked_at')} AS blocked_at FROM blk ORDER BY blk.blocked_at DESC, ip_address DESC LIMIT 100"""))
def _(spark, d):
    return actions.list_blocked(_blocked(spark, d)).select("ip_address", "blocked_at")


@query("p11_candidates", O.sql("""
SELECT id, 'block_ip' AS playbook_name FROM a WHERE threat_verdict = 'Malicious'
UNION ALL SELECT id, 'escalate' FROM a WHERE risk_level = 'Critical'
UNION ALL SELECT id, 'notify_soc' FROM a WHERE risk_level = 'High'"""))
def _(spark, d):
    return actions.candidates(V.alerts(spark, d)).select("id", "playbook_name")


def _rule_sql() -> str:
    def value(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    rows = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in V.RULES)
    return f"""
met AS (SELECT a.id, r.rule_id, r.priority, r.playbook_name FROM a JOIN (VALUES {rows}) r(rule_id, priority, min_score, max_score, verdict, level, playbook_name)
  ON (r.verdict IS NULL OR r.verdict = a.threat_verdict) AND (r.level IS NULL OR r.level = a.risk_level)
  AND (r.min_score IS NULL OR a.risk_score >= r.min_score::DOUBLE) AND (r.max_score IS NULL OR a.risk_score <= r.max_score::DOUBLE))"""


@query("p11_rule_matches", f"WITH {O.VIEWS}, {_rule_sql()} SELECT id, rule_id::BIGINT AS rule_id, priority::BIGINT AS priority, playbook_name FROM met")
def _(spark, d):
    return actions.rule_matches(V.alerts(spark, d), V.rules(spark)).drop("alert_id")


@query("p11_rule_candidates", f"""WITH {O.VIEWS}, {_rule_sql()}
SELECT id, playbook_name, min(priority)::BIGINT AS priority, arg_min(rule_id, (priority, rule_id))::BIGINT AS rule_id, count(*) AS rules_met
FROM met GROUP BY id, playbook_name""")
def _(spark, d):
    return actions.rule_candidates(V.alerts(spark, d), V.rules(spark)).drop("alert_id")


# --- personal data ------------------------------------------------------------------------------------

def _rule_query(number: int, rule: str) -> None:
    @query(f"h{number}_{rule}", O.rule_sql(rule))
    def _(spark, d):
        found = phi.find_rule(V.phi_docs(spark, d), rule)
        return found.select("session_id", "text_seq", spans.each("spans", "start", "end", "value"))


for _number, _rule in enumerate(phi.RULE_NAMES, 1):
    _rule_query(_number, _rule)


def _detected(spark, d):
    return phi.detect(V.phi_docs(spark, d))


_ENTITY = 's AS "start", e AS "end", entity_type, value, confidence'


@query("h12_resolve", O.phi_sql(f"SELECT session_id, text_seq, {_ENTITY} FROM ent"))
def _(spark, d):
    return phi.entity_rows(_detected(spark, d), "session_id", "text_seq").drop("priority")


@query("h12_resolve_pages", O.pages_sql(f"SELECT text_seq AS page_id, {_ENTITY} FROM ent"))
def _(spark, d):
    found = phi.detect(V.table(spark, d, "pages"), "html")
    return phi.entity_rows(found, "page_id").drop("priority")


@query("h13_summary", O.phi_sql("""
SELECT d.session_id, d.text_seq, count(e.s) > 0 AS has_phi, count(e.s) AS entity_count,
  coalesce(string_agg(DISTINCT e.entity_type, '|' ORDER BY e.entity_type), '') AS entity_types
FROM docs d LEFT JOIN ent e USING (session_id, text_seq) GROUP BY 1, 2"""))
def _(spark, d):
    return phi.summarise(_detected(spark, d)).select(
        "session_id", "text_seq", "has_phi", "entity_count", "entity_types"
    )


@query("h13_turns", O.turns_sql("""
SELECT d.session_id, d.text_seq AS turn, count(e.s) AS entity_count
FROM docs d LEFT JOIN ent e USING (session_id, text_seq) GROUP BY 1, 2"""))
def _(spark, d):
    turns = V.table(spark, d, "conversations").selectExpr("CAST(conv_id AS STRING) AS session_id", "turn", "text")
    return phi.summarise(phi.detect(turns)).select("session_id", "turn", "entity_count")


@query("h14_report", O.phi_sql("""
SELECT source, lang, entity_type, count(*) AS entities, count(DISTINCT e.text_seq) AS documents
FROM ent e JOIN docs d USING (session_id, text_seq) GROUP BY 1, 2, 3"""))
def _(spark, d):
    return phi.corpus_report(_detected(spark, d), "source", "lang")


@query("h15_assign", O.phi_sql("SELECT session_id, value, token, prefix, token_no FROM tok", tokens=True))
def _(spark, d):
    _, given = tokens.pseudonymize(_detected(spark, d), _as_of())
    return given.select("session_id", "value", "token", "prefix", "token_no")


@query("h15_continue", O.phi_sql(f"""
SELECT session_id, value, {O.token_text('prefix', 'token_no')} AS token
FROM (SELECT * FROM one UNION ALL SELECT * FROM two)""", more=f"""
one AS (SELECT session_id, value, prefix, row_number() OVER (PARTITION BY session_id, prefix ORDER BY text_seq, s DESC) AS token_no
  FROM (SELECT *, {O._PREFIX} AS prefix, row_number() OVER (PARTITION BY session_id, value ORDER BY text_seq, s DESC) AS rn
        FROM ent WHERE text_seq % 2 = 0) WHERE rn = 1),
two AS (SELECT session_id, value, prefix, row_number() OVER (PARTITION BY session_id, prefix ORDER BY text_seq, s DESC)
    + coalesce((SELECT max(token_no) FROM one o WHERE o.session_id = x.session_id AND o.prefix = x.prefix), 0) AS token_no
  FROM (SELECT *, {O._PREFIX} AS prefix, row_number() OVER (PARTITION BY session_id, value ORDER BY text_seq, s DESC) AS rn
        FROM ent WHERE text_seq % 2 = 1 AND (session_id, value) NOT IN (SELECT (session_id, value) FROM one)) x WHERE rn = 1)"""))
def _(spark, d):
    found = _detected(spark, d)
    _, first = tokens.pseudonymize(found.where("text_seq % 2 = 0"), _as_of())
    _, both = tokens.pseudonymize(found.where("text_seq % 2 = 1"), _as_of(), existing=first)
    return both.select("session_id", "value", "token")


@query("h16_replace", O.phi_sql("SELECT session_id, text_seq, new_text AS pseudonymized_text FROM swp", tokens=True))
def _(spark, d):
    swapped, _ = tokens.pseudonymize(_detected(spark, d), _as_of())
    return swapped.select("session_id", "text_seq", "pseudonymized_text")


@query("h17_result", O.phi_sql(
    "SELECT session_id, text_seq, length(new_text) AS new_length, entity_count, 3600 AS mapping_ttl FROM swp", tokens=True))
def _(spark, d):
    swapped, _ = tokens.pseudonymize(_detected(spark, d), _as_of())
    return swapped.select(
        "session_id", "text_seq", F.length("pseudonymized_text").alias("new_length"), "entity_count", "mapping_ttl"
    )


def _restored(spark, d, later: str):
    swapped, given = tokens.pseudonymize(_detected(spark, d), _as_of())
    texts = swapped.withColumnRenamed("pseudonymized_text", "text")
    return tokens.restore(texts, given, _as_of() + F.expr(f"INTERVAL {later}"))


@query("h18_restore", O.phi_sql(
    "SELECT session_id, text_seq, text AS restored_text, token_count AS restored_count FROM swp", tokens=True))
def _(spark, d):
    return _restored(spark, d, "10 MINUTES")


@query("h19_expired", O.phi_sql(
    "SELECT session_id, text_seq, new_text AS restored_text, 0 AS restored_count FROM swp", tokens=True))
def _(spark, d):
    return _restored(spark, d, "2 HOURS")


@query("h19_sessions", O.phi_sql("""
SELECT value, count(DISTINCT session_id) AS sessions, count(*) AS rows FROM tok GROUP BY 1""", tokens=True))
def _(spark, d):
    _, given = tokens.pseudonymize(_detected(spark, d), _as_of())
    # the map holds a value once per session, so rows are sessions
    return given.groupBy("value").agg(
        F.count_distinct("session_id").alias("sessions"), F.count("*").alias("rows")
    )


@query("s7_token_map", O.phi_sql("SELECT session_id, token, value FROM tok WHERE first_seq % 7200 > 600", tokens=True))
def _(spark, d):
    _, given = tokens.pseudonymize(_detected(spark, d), _as_of())
    path = run_dir(spark, "tokens")
    aged = given.withColumn("expires_at", _as_of() + F.make_interval(secs=F.col("first_seq") % 7200))
    aged.write.mode("append").parquet(path)
    stored = tables.open_or_empty(spark, path, S.TOKENS)
    return tokens.live(stored, _as_of() + F.expr("INTERVAL 10 MINUTES")).select("session_id", "token", "value")


@query("s7_token_store", O.phi_sql(f"""
SELECT session_id, value, token, CASE WHEN session_id LIKE 'ward-%' THEN '2024-02-01 01:40:00.000000'
  ELSE '2024-02-01 02:10:00.000000' END AS expires_at FROM tok t
WHERE token_no % 2 = 0 OR session_id LIKE 'ward-%' AND EXISTS (
  SELECT 1 FROM tok o WHERE o.session_id = t.session_id AND o.token_no % 2 = 0)""", tokens=True))
def _(spark, d):
    """Three saves of an hour's life: all odd numbers at once, after 40 minutes the even ones
    of the wards, after 70 those of all others, whose odd ones have gone by then."""
    _, given = tokens.pseudonymize(_detected(spark, d), _as_of())
    store, later = TokenStore(spark, run_dir(spark, "tokens"), 16), lambda n: _as_of() + F.expr(f"INTERVAL {n} MINUTES")
    wards = F.col("session_id").startswith("ward-")
    store.save(given.where("token_no % 2 = 1"), _as_of())
    store.save(given.where((F.col("token_no") % 2 == 0) & wards), later(40))
    store.save(given.where((F.col("token_no") % 2 == 0) & ~wards), later(70))
    return store.load(later(75)).select("session_id", "value", "token", "expires_at")


# --- usage log -----------------------------------------------------------------------------------------

@query("l1_log_rows", O.sql(f"""
SELECT id, session_id, task_type, provider, model, prompt_tokens, completion_tokens, total_tokens, latency_ms,
  phi_entities_count, has_phi_warning, success, error_message, {O.t('created_at')} AS created_at FROM calls"""))
def _(spark, d):
    return usage_log.log_rows(V.model_calls(spark, d))


@query("l2_usage", O.sql("""
SELECT provider, model, task_type, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens,
  sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens,
  round(avg(latency_ms), 2) AS mean_latency_ms, max(latency_ms) AS max_latency_ms,
  round(avg(CASE WHEN success THEN 0 ELSE 1 END), 4) AS failure_rate,
  round(avg(CASE WHEN has_phi_warning THEN 1 ELSE 0 END), 4) AS phi_rate FROM calls GROUP BY 1, 2, 3"""))
def _(spark, d):
    return usage_log.usage(usage_log.log_rows(V.model_calls(spark, d)))


# --- streams ----------------------------------------------------------------------------------------------

def _landed(df: DataFrame, name: str, by: str) -> str:
    """Rows written as files in time order, to be read as a stream."""
    path = run_dir(df.sparkSession, name)
    df.repartitionByRange(10, by).write.parquet(path)
    return path


def _in_turn(df: DataFrame, name: str, day, stream) -> None:
    """Rows landed week by week, by a day number from 1. After each week `stream` is run on the
    folder over the same checkpoint: a week is one micro-batch, of as many files as it has tasks."""
    stored, path = cut_lineage(df), run_dir(df.sparkSession, name)
    for week in range(5):
        stored.where(F.floor((day - 1) / 7) == week).write.mode("append").parquet(path)
        stream(path).awaitTermination()


def _streamed(spark, d) -> str:
    """The intake over several micro-batches: repeats come in later batches than what
    they repeat, up to a month late."""
    raw = V.raw_alerts(spark, d)
    path = run_dir(spark, "raw")
    raw.repartitionByRange(4, "created_at").write.parquet(path)
    raw.where("id % 100 < 5").repartitionByRange(2, F.desc("created_at")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(S.RAW_ALERTS).option("maxFilesPerTrigger", 2).parquet(path)
    out = run_dir(spark, "intake")
    jobs.intake(stream, lambda: V.repeated_feeds(spark, d), out, run_dir(spark, "state")).awaitTermination()
    return out


@query("w1_stream_intake", O.sql("SELECT id, source_ip, severity, status, risk_score, threat_verdict FROM oka"))
def _(spark, d):
    out = _streamed(spark, d)
    return jobs.read_batches(spark, f"{out}/alerts", S.ALERTS).select(
        "id", "source_ip", "severity", "status", "risk_score", "threat_verdict"
    )


@query("w1_stream_rejects", O.sql("""
SELECT id, unnest(reasons) AS reason FROM (SELECT id, reasons FROM chk UNION ALL SELECT id, reasons FROM chk WHERE id % 100 < 5)
WHERE len(reasons) > 0
UNION ALL SELECT id, 'id: already used' FROM ok WHERE id % 100 < 5"""))
def _(spark, d):
    out = _streamed(spark, d)
    held = jobs.read_batches(spark, f"{out}/rejects", T.StructType([*S.RAW_ALERTS.fields, T.StructField("reasons", T.ArrayType(T.StringType()))]))
    return held.select("id", F.explode("reasons").alias("reason"))


def _counted(spark, d, day, **options) -> str:
    out, state = run_dir(spark, "windows"), run_dir(spark, "state")
    _in_turn(V.alerts(spark, d), "alerts", day, lambda path: jobs.window_counts_job(
        spark.readStream.schema(S.ALERTS).parquet(path), out, state, **options))
    return out


def _windows(spark, d, **options):
    return jobs.read_window_counts(spark, _counted(spark, d, F.dayofmonth("created_at"), **options))


@query("w2_hourly_counts", O.sql(f"""
SELECT {O.t("date_trunc('hour', created_at)")} AS "start", {O.t("date_trunc('hour', created_at) + INTERVAL 1 HOUR")} AS "end",
  severity, risk_level, count(*) AS count FROM a GROUP BY ALL"""))
def _(spark, d):
    return _windows(spark, d)


@query("w2_sliding_counts", O.sql(f"""
SELECT {O.t('s')} AS "start", {O.t('s + INTERVAL 1 HOUR')} AS "end", severity, risk_level, count(*) AS count
FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, created_at), time_bucket(INTERVAL 30 MINUTE, created_at) - INTERVAL 30 MINUTE]) AS s
      FROM a) GROUP BY ALL"""))
def _(spark, d):
    return _windows(spark, d, slide="30 minutes")


@query("w2_late_counts", O.sql(f"""
SELECT {O.t("date_trunc('hour', created_at)")} AS "start", severity, risk_level, count(*) AS rows FROM a GROUP BY ALL"""))
def _(spark, d):
    """Days in reverse order: nearly every row is late, and each is counted on one side."""
    out = _counted(spark, d, 31 - F.dayofmonth("created_at"))
    jobs.compact_windows(spark, out, 1)
    both = jobs.read_window_counts(spark, out).unionByName(
        jobs.read_late_counts(spark, out).withColumnRenamed("late", "count"))
    return both.groupBy("start", "severity", "risk_level").agg(F.sum("count").alias("rows"))


@query("w3_block_register", O.sql(f"""
SELECT ip_address, alert_id, reason, blocked_by, {O.t('blocked_at')} AS blocked_at FROM blk"""))
def _(spark, d):
    runs = _runs(spark, d)
    register, state = run_dir(spark, "register"), run_dir(spark, "state")
    _in_turn(runs, "runs", F.dayofmonth("executed_at"), lambda path: jobs.block_register(
        spark.readStream.schema(runs.schema).parquet(path), register, state))
    return jobs.read_batches(spark, register, S.BLOCKED_IPS).select(
        "ip_address", "alert_id", "reason", "blocked_by", "blocked_at"
    )


@query("w4_current_status", O.sql(f"""
SELECT id, arg_max(new_status, (ts, seq)) AS new_status, {O.t('max(ts)')} AS ts FROM chg GROUP BY id"""))
def _(spark, d):
    path = _landed(V.status_changes(spark, d), "changes", "ts")
    table = run_dir(spark, "status")
    stream = spark.readStream.schema(S.STATUS_CHANGES).option("maxFilesPerTrigger", 4).parquet(path)
    jobs.status_table(stream, table, run_dir(spark, "state")).awaitTermination()
    return jobs.read_status(spark, table)
