"""Alert, feed, request and note tables derived from the sample parquet tables.

The sample data has no alert table. These views make one, and everything around it,
from `events`, `customer`, `documents` and `conversations` by integer arithmetic, so
the same rows can be stated in other engines and grow with the sample data. Every one
is a projection of a scan, or one aggregate of it. Changes, deletions, patches and
requests concern some of the alerts by their nature; the operators that apply them run
over all alerts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrymill import domains as D
from sentrymill import schemas as S
from sentrymill.functions.text import quoted
from sentrymill.operators.enrich import report_table
from sentrymill.plans.ingest import scored_alerts

# The columns used here, so that no scan starts with a schema inference job.
COLUMNS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
              "props string",
    "customer": "c_custkey long",
    "documents": "doc_id long, text string, lang string, source string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def _pick(values: list[str | None], n: str) -> str:
    """SQL for the n-th of some values, counted from 0."""
    return f"get(array({', '.join(quoted(v) for v in values)}), CAST({n} AS INT))"


# the 18 rated types and two that are not
_TYPES = _pick([*D.TYPE_POINTS, "Policy Violation", "brute force"], "(event_id * 7 + user_id) % 20")
_STATUS = _pick(D.STATUSES, "event_id % 3")
_WATCHED = _pick(D.WATCHLIST, "user_id div 30 % 5")
_BLOCK = _pick(["10.0.", "192.168.", "198.18."], "user_id % 3")
_SEVERITY = (
    "CASE WHEN value < 15 THEN 'Low' WHEN value < 35 THEN 'Medium' WHEN value < 70 THEN 'High' "
    "ELSE 'Critical' END"
)
# The sample times have no zone and are UTC, whatever the session's zone is.
_TIME = "from_utc_timestamp(CAST(ts AS TIMESTAMP), current_timezone())"
# Made-up feed contents.
NETS = ["Alder Net", "Birch Net", "Cedar Net"]
CITIES = ["Bergen", "Basel", "Napier", "Salto"]
LANDS, OTHER_LANDS = ["NO", "CH", "NZ", "UY"], ["AQ", "BV", "TF"]
DOMAINS = ["alder.test", None, "birch.test", "cedar.test"]
REGISTRIES = ["north", "south", "west"]
ZONES = ["Europe/Oslo", "Europe/Zurich", "Pacific/Auckland"]


def plain_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted alerts before enrichment, plus event_id and user_id for other views."""
    return table(spark, folder, "events").selectExpr(
        "event_id + 1 AS id", "format_string('ALERT-%08X', event_id + 1) AS alert_id",
        f"{_TYPES} AS alert_type",
        f"CASE WHEN user_id % 30 = 0 THEN {_WATCHED} "
        f"ELSE {_BLOCK} || (user_id div 256 % 256) || '.' || (user_id % 256) END AS source_ip",
        f"{_SEVERITY} AS severity", f"{_STATUS} AS status", "'event ' || event_type AS description",
        f"{_TIME} AS created_at", "event_id", "user_id",
    )


def raw_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw alerts of which some break a rule and some need normalising."""
    return plain_alerts(spark, folder).selectExpr(
        "id",
        "CASE event_id % 50 WHEN 4 THEN 'X' WHEN 5 THEN NULL ELSE alert_type END AS alert_type",
        r"CASE event_id % 50 WHEN 0 THEN 'not-an-ip' WHEN 1 THEN '192.168.1' "
        r"WHEN 2 THEN '2001:db8::1' WHEN 11 THEN '10.0.0.01' WHEN 12 THEN '256.1.1.1' "
        r"WHEN 13 THEN ' \t' || source_ip || '\n' WHEN 14 THEN NULL ELSE source_ip END AS source_ip",
        r"CASE event_id % 50 WHEN 3 THEN 'EXTREME' WHEN 6 THEN lower(severity) "
        r"WHEN 7 THEN '  ' || upper(severity) || '\t' WHEN 8 THEN NULL ELSE severity END AS severity",
        "CASE event_id % 50 WHEN 15 THEN 'CLOSED' WHEN 16 THEN lower(status) WHEN 9 THEN NULL "
        "ELSE status END AS status",
        "CASE event_id % 50 WHEN 10 THEN repeat('x', 501) WHEN 17 THEN repeat('x', 500) "
        "ELSE description END AS description",
        "created_at",
    )


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that the feeds know: u is the least user id, bad the watchlist flag."""
    watched = ", ".join(quoted(ip) for ip in D.WATCHLIST)
    return plain_alerts(spark, folder).groupBy("source_ip").agg({"user_id": "min"}).selectExpr(
        "source_ip AS ip", "`min(user_id)` AS u", f"source_ip IN ({watched}) AS bad"
    ).where("u % 17 <> 5")


def ti_abuse(spark: SparkSession, folder: str) -> DataFrame:
    return addresses(spark, folder).selectExpr(
        "ip AS ip_address",
        "bad OR NOT (ip LIKE '10.%' OR ip LIKE '192.168.%' OR ip LIKE '172.16.%') AS is_public",
        "if(bad, 30 + u * 11 % 67, u * 11 % 17) AS abuse_confidence_score",
        f"if(bad, {_pick(OTHER_LANDS, 'u % 3')}, {_pick(LANDS, 'u % 4')}) AS country_code",
        f"{_pick(NETS, 'u % 3')} AS isp", f"{_pick(DOMAINS, 'u % 4')} AS domain",
        "u * 3 % 240 AS total_reports",
        "timestamp_seconds(1706659200 - u * 5 % 120 * 86400) AS last_reported_at",
        "u % 23 = 0 AS is_whitelisted", "if(u % 2 = 0, 'rack', 'office') AS usage_type",
        "'reputation rows' AS source",
    )


def ti_scan(spark: SparkSession, folder: str) -> DataFrame:
    return addresses(spark, folder).where("u % 11 <> 4").selectExpr(
        "*", "if(bad, 24 + u * 5 % 19, u % 2) AS malicious_count"
    ).selectExpr(
        "ip AS ip_address", "malicious_count", "u % 5 AS suspicious_count",
        "40 + u % 13 AS harmless_count",
        "greatest(72 - malicious_count - u % 5 - (40 + u % 13), 0) AS undetected_count",
        "72L AS total_engines", "if(bad, -7, 7) * (u % 9) AS reputation",
        "substring_index(ip, '.', 2) || '.0.0/16' AS network", "64500 + u AS asn",
        f"{_pick(NETS, 'u % 3')} AS as_owner", f"{_pick(LANDS, 'u % 4')} AS country",
        f"{_pick(REGISTRIES, 'u % 3')} AS regional_internet_registry",
        "'2024-01-' || lpad(30 - u % 9, 2, '0') || 'T06:00:00+00:00' AS last_analysis_date",
        "if(bad, array('probe', 'spam'), CAST(array() AS ARRAY<STRING>)) AS tags",
        "'scan rows' AS source",
    )


def ti_geo(spark: SparkSession, folder: str) -> DataFrame:
    return addresses(spark, folder).selectExpr(
        "ip", "'host-' || replace(ip, '.', '-') || '.example.net' AS hostname",
        f"{_pick(CITIES, 'u % 4')} AS city", "'region ' || (u % 6) AS region",
        f"if(u % 7 = 3, NULL, {_pick([*LANDS, *OTHER_LANDS], 'u % 7')}) AS country",
        f"if(u % 13 <> 6, 'AS' || (64500 + u) || ' ' || {_pick(NETS, 'u % 3')}, NULL) AS org",
        "if(u % 13 <> 6, 'AS' || (64500 + u), '') AS asn", f"{_pick(ZONES, 'u % 3')} AS timezone",
        "(u % 60) || '.5,' || (u % 90) || '.5' AS loc", "'place rows' AS source",
    )


def with_repeats(feed: DataFrame, changed: dict[str, str]) -> DataFrame:
    """A feed in which every row also comes a second time with other values in some
    columns: an older report of the same address."""
    plain = ", ".join(f"'{c}', `{c}`" for c in feed.columns)
    older = ", ".join(f"'{c}', {changed.get(c, f'`{c}`')}" for c in feed.columns)
    return feed.selectExpr(f"inline(array(named_struct({older}), named_struct({plain})))")


def repeated_feeds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The feeds with an older row beside each; rows of the place feed have no time and
    come twice as they are."""
    return (
        with_repeats(ti_abuse(spark, folder), {
            "abuse_confidence_score": "99L", "last_reported_at": "last_reported_at - INTERVAL 1 DAY"}),
        with_repeats(ti_scan(spark, folder), {
            "malicious_count": "70L", "last_analysis_date": "'2023-12-01T06:00:00+00:00'"}),
        with_repeats(ti_geo(spark, folder), {}),
    )


def feeds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return ti_abuse(spark, folder), ti_scan(spark, folder), ti_geo(spark, folder)


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """The report table of all alerts, for queries that score them more than once."""
    return report_table(plain_alerts(spark, folder), *feeds(spark, folder))


def scored(spark: SparkSession, folder: str, reports: DataFrame | None = None) -> DataFrame:
    """Enriched and scored alerts with the working columns of the intake."""
    return scored_alerts(plain_alerts(spark, folder), *feeds(spark, folder), reports=reports)


def alerts(spark: SparkSession, folder: str, reports: DataFrame | None = None) -> DataFrame:
    return scored(spark, folder, reports).select(*S.ALERTS.fieldNames())


def light_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The stored alert columns that need no feed, for operators that read only those."""
    return plain_alerts(spark, folder).selectExpr("*", "created_at AS updated_at")


def status_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Two thirds of the alerts change once, one third twice; a third of all events also
    hit alert 1, so one key holds a large share. Some ids and statuses are unknown."""
    def change(when: str, key: str, status: str, hours: int, seq: str) -> str:
        return (
            f"if({when}, named_struct('id', {key}, 'new_status', {status}, 'ts', "
            f"{_TIME} + INTERVAL {hours} HOURS, 'seq', CAST({seq} AS BIGINT)), NULL)"
        )

    rows = ", ".join([
        change("event_id % 3 >= 1", "event_id + 1", "'Investigating'", 1, "1"),
        change("event_id % 3 = 2", "event_id + 1", "' resolved '", 3, "2"),
        change("event_id % 3 = 0", "1L", _pick(D.STATUSES, "event_id div 3 % 3"), 0, "event_id + 100"),
        change("event_id % 1000 = 0", "event_id + 1000000000000", "'Open'", 0, "1"),
        change("event_id % 500 = 1", "event_id + 1", "'CLOSED'", 2, "3"),
    ])
    return table(spark, folder, "events").selectExpr(f"inline(array_compact(array({rows})))")


def delete_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where(
        "event_id % 97 = 0 or event_id % 1000 = 7"
    ).selectExpr(
        "if(event_id % 1000 = 7, event_id + 1000000000000, event_id + 1) AS id",
        f"{_TIME} + INTERVAL 40 DAYS AS ts",
    )


def playbook_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request for each alert of a watchlist address and each seventh other alert."""
    names = ["block_ip", "isolate_host", "notify_soc", "escalate", "reboot"]
    return plain_alerts(spark, folder).where("user_id % 30 = 0 or event_id % 7 = 0").selectExpr(
        "if(event_id % 211 = 0, 'GONE-' || event_id, alert_id) AS alert_id",
        f"{_pick(names, 'event_id % 5')} AS playbook_name",
        "CASE event_id % 3 WHEN 1 THEN '' WHEN 2 THEN 'host-' || (event_id % 50) END AS target",
        "CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'note ' || (event_id % 9) END AS notes",
        "if(event_id % 6 <> 0, 'analyst' || (event_id % 6), NULL) AS requested_by",
        "created_at + INTERVAL 2 HOURS AS ts", "event_id AS seq",
        "if(event_id % 10 = 3, 'device unreachable', NULL) AS error",
    )


def patches(spark: SparkSession, folder: str) -> DataFrame:
    """Partial updates, one for each fifth alert; some break a rule."""
    return table(spark, folder, "events").where("event_id % 5 = 0").selectExpr(
        "event_id + 1 AS id",
        "CASE WHEN event_id % 15 = 0 THEN 'Port Scan' WHEN event_id % 35 = 0 THEN 'X' END AS alert_type",
        "CASE WHEN event_id % 10 = 0 THEN ' high ' WHEN event_id % 55 = 0 THEN 'EXTREME' END AS severity",
        "if(event_id % 25 = 0, 'resolved', NULL) AS status",
        "if(event_id % 20 = 0, 'patched', NULL) AS description",
        f"{_TIME} + INTERVAL 5 HOURS AS ts",
    )


def many_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Partial updates of which an alert gets several, some at the same time; a third of all
    events patch alert 1, so one key holds a large share. Some break a rule."""
    def patch(when: str, key: str, alert_type: str, severity: str, status: str, text: str, hours: int, seq: str) -> str:
        fields = {"id": key, "alert_type": alert_type, "severity": severity, "status": status, "description": text}
        inner = ", ".join(f"'{k}', CAST({v} AS {'BIGINT' if k == 'id' else 'STRING'})" for k, v in fields.items())
        return (f"if({when}, named_struct({inner}, 'ts', {_TIME} + INTERVAL {hours} HOURS, "
                f"'seq', CAST({seq} AS BIGINT)), NULL)")

    rows = ", ".join([
        patch("event_id % 5 = 0", "event_id + 1", "if(event_id % 15 = 0, 'Port Scan', NULL)", "' high '", "NULL", "'first'", 5, "1"),
        patch("event_id % 4 = 0", "event_id + 1", "NULL", "if(event_id % 8 = 0, 'LOW', NULL)", "'investigating'", "NULL", 5, "2"),
        patch("event_id % 3 = 0", "1L", "if(event_id % 2 = 0, 'Brute Force', 'DDoS')",
              f"if(event_id % 9 = 0, NULL, {_pick(D.SEVERITIES, 'event_id % 4')})", "NULL",
              "if(event_id % 7 = 0, 'note ' || event_id, NULL)", 0, "event_id + 100"),
        patch("event_id % 10 = 0", "event_id + 1", "'X'", "'Critical'", "'Resolved'", "'refused'", 9, "3"),
    ])
    return table(spark, folder, "events").selectExpr(f"inline(array_compact(array({rows})))")


# Twenty rules that overlap: (rule_id, priority, min_score, max_score, verdict, level, playbook_name).
RULES = [
    (i, i * 7 % 10, None if i % 7 == 0 else float(i * 4 % 60), None if i % 5 == 4 else float(i * 4 % 60 + 20 + i % 3 * 10) + 0.5,
     [None, *D.VERDICTS][i % 5], [None, None, *D.LEVELS][i % 6], ["block_ip", "isolate_host", "notify_soc", "escalate"][i % 4])
    for i in range(1, 21)
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, S.RULES)


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Ward notes with every kind of personal data, one per customer. Ward 0 holds more
    than a third of them. A few MB of keys make millions of texts, so the keys are dealt out
    first: a task that reads them would otherwise search the texts of its whole file."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, folder, "customer").selectExpr("c_custkey AS n").repartition(tasks).selectExpr(
        "'ward-' || if(n % 3 = 0, 0, n % 12) AS session_id", "n AS text_seq",
        """CASE n % 6
             WHEN 0 THEN 'Seen by Dr. Mary Jones on 2024-01-' || lpad(n % 28 + 1, 2, '0')
                      || '. MRN#' || (n + 100000) || ', SSN ' || (n % 900 + 100) || '-45-'
                      || lpad(n * 7 % 10000, 4, '0') || '.'
             WHEN 1 THEN 'DOB: 03/04/' || (n % 50 + 1950) || '; call (555) 123-'
                      || lpad(n % 10000, 4, '0') || ' or 555-987-' || lpad(n * 3 % 10000, 4, '0') || '.'
             WHEN 2 THEN 'Mail a' || (n % 40) || '@x.com then b' || (n % 7) || '@x.com then a'
                      || (n % 40) || '@x.com.'
             WHEN 3 THEN 'Patient John Smith emailed john' || (n % 11) || '@x.com'
             WHEN 4 THEN 'patient was admitted today with Blood Pressure high'
             ELSE 'Lives at ' || (n % 99 + 1)
                  || ' Oak Tree Street. Treated in Mercy General Hospital.' END AS text""",
        "'en' AS lang", "'notes' AS source",
    )


def phi_docs(spark: SparkSession, folder: str) -> DataFrame:
    """All documents and all notes; a document's session is its source."""
    return table(spark, folder, "documents").selectExpr(
        "source AS session_id", "doc_id AS text_seq", "text", "lang", "source"
    ).unionByName(notes(spark, folder))


def model_calls(spark: SparkSession, folder: str) -> DataFrame:
    """One logged call per assistant turn."""
    tasks = ["summarize", "diagnosis", "treatment", "explanation", "process"]
    return table(spark, folder, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id * 1000 + turn AS id", "CAST(conv_id AS STRING) AS session_id",
        f"{_pick(tasks, 'turn % 5')} AS task_type",
        "if(conv_id % 2 = 0, 'openai', 'ollama') AS provider",
        f"{_pick(['model-a', 'model-b', 'model-c'], 'conv_id % 3')} AS model",
        "CAST(length(text) div 8 AS BIGINT) AS prompt_tokens",
        "CAST(length(text) div 4 AS BIGINT) AS completion_tokens",
        "CAST((conv_id * 31 + turn * 7) % 900 + 50 AS DOUBLE) AS latency_ms",
        "(conv_id + turn) % 4 AS phi_entities_count", "(conv_id + turn) % 13 <> 0 AS success",
        "if((conv_id + turn) % 13 = 0, 'timeout', NULL) AS error_message",
        "timestamp_seconds(1704067200 + conv_id * 60 + turn) AS created_at", "text",
    )
