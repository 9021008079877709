"""Reference SQL for the query catalog, for DuckDB on the same parquet tables.

Written apart from the operators: the sample views, the scoring and the span rules are
stated again here in plain SQL.
"""

from __future__ import annotations

from sentrymill import domains as D
from sentrymill.operators.phi import RULE_NAMES
from sentrymill.sources.sample_views import CITIES, DOMAINS, LANDS, NETS, OTHER_LANDS, REGISTRIES, ZONES


def t(column: str) -> str:
    """A time column as text, the way the catalog shows it."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def iso(column: str) -> str:
    return (
        f"(CASE WHEN epoch_us({column}) % 1000000 = 0 THEN strftime({column}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00')"
    )


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"


def _at(values, n: str) -> str:
    return f"{_list(values)}[{n} + 1]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def points(column: str, table: dict[str, float], default: float) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in table.items())
    return f"CASE {column} {cases} ELSE {default}e0 END"


def level(score: str) -> str:
    return (
        f"CASE WHEN {score} BETWEEN 0 AND 25 THEN 'Low' WHEN {score} BETWEEN 26 AND 50 THEN 'Medium' "
        f"WHEN {score} BETWEEN 51 AND 75 THEN 'High' ELSE 'Critical' END"
    )


def contiguous(score: str) -> str:
    return (
        f"CASE WHEN {score} <= 25 THEN 'Low' WHEN {score} <= 50 THEN 'Medium' "
        f"WHEN {score} <= 75 THEN 'High' ELSE 'Critical' END"
    )


def spelled(column: str, allowed: list[str]) -> str:
    cases = " ".join(f"WHEN '{v.lower()}' THEN '{v}'" for v in allowed)
    return f"CASE lower({strip(column)}) {cases} END"


def strip(column: str) -> str:
    return f"trim({column}, ' ' || chr(9) || chr(10) || chr(13) || chr(12))"


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
TYPES = [*D.TYPE_POINTS, "Policy Violation", "brute force"]
SEVERITY_POINTS = points("severity", D.SEVERITY_POINTS, D.UNKNOWN_SEVERITY_POINTS)
TYPE_POINTS = points("alert_type", D.TYPE_POINTS, D.UNKNOWN_TYPE_POINTS)
SCORE = (
    f"round(least(greatest({SEVERITY_POINTS} + {TYPE_POINTS} + aggregate_confidence / 100 * 20 "
    "+ CASE WHEN hour(created_at) < 6 THEN 10e0 ELSE 0e0 END, 0), 100), 2)"
)

VIEWS = f"""
pa AS (SELECT event_id + 1 AS id, format('ALERT-{{:08X}}', event_id + 1) AS alert_id,
  {_at(TYPES, '(event_id * 7 + user_id) % 20')} AS alert_type,
  CASE WHEN user_id % 30 = 0 THEN {_at(D.WATCHLIST, 'user_id // 30 % 5')}
       ELSE {_at(['10.0.', '192.168.', '198.18.'], 'user_id % 3')}
            || (user_id // 256 % 256)::VARCHAR || '.' || (user_id % 256)::VARCHAR END AS source_ip,
  CASE WHEN value < 15 THEN 'Low' WHEN value < 35 THEN 'Medium' WHEN value < 70 THEN 'High'
       ELSE 'Critical' END AS severity,
  {_at(D.STATUSES, 'event_id % 3')} AS status, 'event ' || event_type AS description,
  ts AS created_at, event_id, user_id FROM events),
rw AS (SELECT id,
  CASE event_id % 50 WHEN 4 THEN 'X' WHEN 5 THEN NULL ELSE alert_type END AS alert_type,
  CASE event_id % 50 WHEN 0 THEN 'not-an-ip' WHEN 1 THEN '192.168.1' WHEN 2 THEN '2001:db8::1'
    WHEN 11 THEN '10.0.0.01' WHEN 12 THEN '256.1.1.1' WHEN 13 THEN ' ' || chr(9) || source_ip || chr(10)
    WHEN 14 THEN NULL ELSE source_ip END AS source_ip,
  CASE event_id % 50 WHEN 3 THEN 'EXTREME' WHEN 6 THEN lower(severity)
    WHEN 7 THEN '  ' || upper(severity) || chr(9) WHEN 8 THEN NULL ELSE severity END AS severity,
  CASE event_id % 50 WHEN 15 THEN 'CLOSED' WHEN 16 THEN lower(status) WHEN 9 THEN NULL
    ELSE status END AS status,
  CASE event_id % 50 WHEN 10 THEN repeat('x', 501) WHEN 17 THEN repeat('x', 500)
    ELSE description END AS description,
  created_at, event_id, alert_id FROM pa),
chk AS (SELECT *, list_filter([
    CASE WHEN id IS NULL THEN 'id: required' END,
    CASE WHEN alert_type IS NULL THEN 'alert_type: required' END,
    CASE WHEN length(alert_type) NOT BETWEEN 2 AND 100 THEN 'alert_type: length must be 2 to 100' END,
    CASE WHEN source_ip IS NULL THEN 'source_ip: required' END,
    CASE WHEN NOT regexp_full_match({strip('source_ip')}, '{IPV4}') THEN 'source_ip: not an IPv4 address' END,
    CASE WHEN severity IS NOT NULL AND {spelled('severity', D.SEVERITIES)} IS NULL THEN 'severity: unknown' END,
    CASE WHEN status IS NOT NULL AND {spelled('status', D.STATUSES)} IS NULL THEN 'status: unknown' END,
    CASE WHEN length(description) > 500 THEN 'description: longer than 500' END
  ], lambda x: x IS NOT NULL) AS reasons FROM rw),
ok AS (SELECT id, alert_id, alert_type, {strip('source_ip')} AS source_ip,
  coalesce({spelled('severity', D.SEVERITIES)}, 'Medium') AS severity,
  coalesce({spelled('status', D.STATUSES)}, 'Open') AS status, description, created_at
  FROM chk WHERE len(reasons) = 0),
ips AS (SELECT source_ip AS ip, min(user_id) AS u, source_ip IN {_in(D.WATCHLIST)} AS bad
  FROM pa GROUP BY source_ip HAVING min(user_id) % 17 <> 5),
ti_abuse AS (SELECT ip AS ip_address,
  bad OR NOT (ip LIKE '10.%' OR ip LIKE '192.168.%' OR ip LIKE '172.16.%') AS is_public,
  CASE WHEN bad THEN 30 + u * 11 % 67 ELSE u * 11 % 17 END AS abuse_confidence_score,
  CASE WHEN bad THEN {_at(OTHER_LANDS, 'u % 3')} ELSE {_at(LANDS, 'u % 4')} END AS country_code,
  {_at(NETS, 'u % 3')} AS isp, {_at(DOMAINS, 'u % 4')} AS domain, u * 3 % 240 AS total_reports,
  u % 23 = 0 AS is_whitelisted, CASE WHEN u % 2 = 0 THEN 'rack' ELSE 'office' END AS usage_type,
  TIMESTAMP '2024-01-31' - to_days((u * 5 % 120)::INTEGER) AS last_reported_at, u, bad FROM ips),
ti_scan AS (SELECT ip AS ip_address, CASE WHEN bad THEN 24 + u * 5 % 19 ELSE u % 2 END AS malicious_count,
  u % 5 AS suspicious_count, 40 + u % 13 AS harmless_count, 72 AS total_engines,
  greatest(72 - CASE WHEN bad THEN 24 + u * 5 % 19 ELSE u % 2 END - u % 5 - (40 + u % 13), 0) AS undetected_count,
  CASE WHEN bad THEN -7 ELSE 7 END * (u % 9) AS reputation, regexp_extract(ip, '^[0-9]+[.][0-9]+') || '.0.0/16' AS network,
  {_at(NETS, 'u % 3')} AS as_owner, {_at(REGISTRIES, 'u % 3')} AS regional_internet_registry,
  '2024-01-' || lpad((30 - u % 9)::VARCHAR, 2, '0') || 'T06:00:00+00:00' AS last_analysis_date,
  CASE WHEN bad THEN 'probe|spam' ELSE '' END AS tags,
  64500 + u AS asn, {_at(LANDS, 'u % 4')} AS country, bad, u FROM ips WHERE u % 11 <> 4),
ti_geo AS (SELECT ip, {_at(CITIES, 'u % 4')} AS city, 'region ' || (u % 6)::VARCHAR AS region,
  CASE WHEN u % 7 <> 3 THEN {_at([*LANDS, *OTHER_LANDS], 'u % 7')} END AS country,
  CASE WHEN u % 13 <> 6 THEN 'AS' || (64500 + u)::VARCHAR || ' ' || {_at(NETS, 'u % 3')} END AS org,
  CASE WHEN u % 13 <> 6 THEN 'AS' || (64500 + u)::VARCHAR ELSE '' END AS asn,
  'host-' || replace(ip, '.', '-') || '.example.net' AS hostname, {_at(ZONES, 'u % 3')} AS timezone,
  (u % 60)::VARCHAR || '.5,' || (u % 90)::VARCHAR || '.5' AS loc, u FROM ips),
rep AS (SELECT a.ip_address AS source_ip, a.abuse_confidence_score, a.total_reports, a.usage_type, a.domain,
  s.suspicious_count, g.region, s.malicious_count, s.total_engines,
  s.country AS scan_country, g.city, coalesce(g.country, a.country_code, '') AS country,
  coalesce(g.asn, '') AS asn, coalesce(g.org, a.isp, '') AS org,
  round(a.abuse_confidence_score * 0.6e0
        + coalesce(s.malicious_count, 0) / coalesce(s.total_engines, 90)::DOUBLE * 100 * 0.4e0, 2) AS conf
  FROM ti_abuse a LEFT JOIN ti_scan s USING (ip_address) LEFT JOIN ti_geo g ON g.ip = a.ip_address),
vd AS (SELECT *, CASE WHEN conf >= 60 THEN 'Malicious' WHEN conf >= 25 THEN 'Suspicious' ELSE 'Clean' END
  AS verdict FROM rep),
en AS (SELECT pa.*, coalesce(conf, 0e0) AS aggregate_confidence, coalesce(verdict, 'Unknown') AS threat_verdict,
  coalesce(abuse_confidence_score, 0) AS abuseipdb_score, coalesce(malicious_count, 0) AS vt_malicious,
  country, asn, org, conf FROM pa LEFT JOIN vd USING (source_ip)),
sc AS (SELECT *, {SCORE} AS risk_score FROM en),
a AS (SELECT *, {level('risk_score')} AS risk_level FROM sc),
oken AS (SELECT ok.*, coalesce(conf, 0e0) AS aggregate_confidence, coalesce(verdict, 'Unknown') AS threat_verdict,
  coalesce(abuse_confidence_score, 0) AS abuseipdb_score, coalesce(malicious_count, 0) AS vt_malicious,
  conf, verdict, country, asn, org, total_reports FROM ok LEFT JOIN vd USING (source_ip)),
oka AS (SELECT *, {SCORE} AS risk_score FROM oken),
chg AS (
  SELECT event_id + 1 AS id, 'Investigating' AS new_status, ts + INTERVAL 1 HOUR AS ts, 1 AS seq
    FROM events WHERE event_id % 3 >= 1
  UNION ALL SELECT event_id + 1, 'Resolved', ts + INTERVAL 3 HOUR, 2 FROM events WHERE event_id % 3 = 2
  UNION ALL SELECT 1, {_at(D.STATUSES, 'event_id // 3 % 3')}, ts, event_id + 100 FROM events
    WHERE event_id % 3 = 0
  UNION ALL SELECT event_id + 1000000000000, 'Open', ts, 1 FROM events WHERE event_id % 1000 = 0),
hist AS (SELECT c.id, pa.alert_id,
  coalesce(lag(new_status) OVER (PARTITION BY c.id ORDER BY c.ts, c.seq), pa.status) AS old_status,
  c.new_status, c.ts, c.seq FROM chg c JOIN pa ON pa.id = c.id),
cur AS (SELECT pa.id, pa.alert_id, coalesce(l.new_status, pa.status) AS status,
  greatest(pa.created_at, coalesce(l.ts, pa.created_at)) AS updated_at
  FROM pa LEFT JOIN (SELECT id, arg_max(new_status, (ts, seq)) AS new_status, max(ts) AS ts
                     FROM chg GROUP BY id) l USING (id)),
dels AS (SELECT CASE WHEN event_id % 1000 = 7 THEN event_id + 1000000000000 ELSE event_id + 1 END AS id,
  ts + INTERVAL 40 DAY AS ts FROM events WHERE event_id % 97 = 0 OR event_id % 1000 = 7),
req AS (SELECT CASE WHEN event_id % 211 = 0 THEN 'GONE-' || event_id::VARCHAR ELSE alert_id END AS alert_id,
  {_at(['block_ip', 'isolate_host', 'notify_soc', 'escalate', 'reboot'], 'event_id % 5')} AS playbook_name,
  CASE event_id % 3 WHEN 1 THEN '' WHEN 2 THEN 'host-' || (event_id % 50)::VARCHAR END AS target,
  CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'note ' || (event_id % 9)::VARCHAR END AS notes,
  CASE WHEN event_id % 6 <> 0 THEN 'analyst' || (event_id % 6)::VARCHAR END AS requested_by,
  created_at + INTERVAL 2 HOUR AS ts, event_id AS seq,
  CASE WHEN event_id % 10 = 3 THEN 'device unreachable' END AS error
  FROM pa WHERE user_id % 30 = 0 OR event_id % 7 = 0),
res AS (SELECT r.alert_id, r.playbook_name, coalesce(nullif(r.target, ''), a.source_ip) AS target,
  nullif(r.notes, '') AS notes, coalesce(r.requested_by, 'system') AS requested_by, r.ts, r.seq, r.error,
  a.id AS alert_db_id, a.alert_type, a.severity, a.risk_score
  FROM req r JOIN a ON a.alert_id = r.alert_id WHERE r.playbook_name <> 'reboot'),
run AS (SELECT alert_db_id, alert_id, seq, playbook_name,
  CASE WHEN error IS NOT NULL THEN upper(playbook_name) WHEN playbook_name = 'block_ip' THEN 'IP_BLOCKED'
    WHEN playbook_name = 'isolate_host' THEN 'HOST_ISOLATED'
    WHEN playbook_name = 'notify_soc' THEN 'SOC_NOTIFIED' ELSE 'INCIDENT_ESCALATED' END AS action,
  target, CASE WHEN error IS NOT NULL THEN 'Failed' ELSE 'Success' END AS status,
  CASE WHEN error IS NOT NULL THEN ''
    WHEN playbook_name = 'block_ip' THEN 'IP ' || target || ' successfully blocked. Rule ID: BLOCK-RULE-'
      || left(md5(target), 8)
    WHEN playbook_name = 'isolate_host' THEN 'Host ''' || target || ''' successfully isolated. Ticket: ISOLATE-'
      || left(md5(target || alert_id), 8)
    WHEN playbook_name = 'notify_soc' THEN 'SOC notified successfully. Notification ID: NOTIF-'
      || left(md5(alert_id || {iso('ts')}), 8)
    ELSE 'Incident escalated. Security ticket SEC-' || left(md5(alert_id), 8) || ' created with priority '
      || CASE WHEN severity IN ('Critical', 'High') THEN 'P1' ELSE 'P2' END || '.' END AS result_message,
  requested_by AS executed_by, ts AS executed_at, notes, error, alert_type, severity, risk_score FROM res),
blk AS (SELECT ip_address, alert_id, reason, blocked_by, blocked_at FROM (
  SELECT target AS ip_address, alert_id, coalesce(notes, '{D.DEFAULT_BLOCK_REASON}') AS reason,
    executed_by AS blocked_by, executed_at AS blocked_at,
    row_number() OVER (PARTITION BY target ORDER BY executed_at, alert_id, seq) AS rn
  FROM run WHERE playbook_name = 'block_ip' AND status = 'Success') WHERE rn = 1),
tl AS (
  SELECT id AS alert_db_id, alert_id, 'AlertCreated' AS event_type, 1 AS seq,
    'Alert ingested | type=' || alert_type || ' ip=' || source_ip || ' severity=' || severity AS description,
    created_at AS occurred_at,
    concat_ws('|', 'alert_type=' || alert_type, 'source_ip=' || source_ip, 'severity=' || severity) AS meta FROM a
  UNION ALL SELECT id, alert_id, 'AlertEnriched', 2, 'TI enrichment complete | verdict=' || threat_verdict
    || ' confidence=' || round(aggregate_confidence, 1)::VARCHAR, created_at,
    concat_ws('|', 'threat_verdict=' || threat_verdict, 'aggregate_confidence=' || round(aggregate_confidence, 2)::VARCHAR,
      'abuseipdb_score=' || abuseipdb_score::VARCHAR, 'vt_malicious=' || vt_malicious::VARCHAR) FROM a
  UNION ALL SELECT id, alert_id, 'RiskCalculated', 3, 'Risk score computed | score=' || risk_score::VARCHAR
    || ' level=' || risk_level, created_at, 'risk_score=' || risk_score::VARCHAR || '|risk_level=' || risk_level FROM a),
st AS (SELECT id AS alert_db_id, alert_id, 'StatusUpdated' AS event_type, seq + 10 AS seq,
  'Status changed: ' || old_status || ' -> ' || new_status AS description, ts AS occurred_at,
  'old_status=' || old_status || '|new_status=' || new_status AS meta FROM hist),
pe AS (SELECT alert_db_id, alert_id, 'PlaybookExecuted' AS event_type, seq + 10 AS seq,
  'Playbook ''' || playbook_name || ''' executed | target=' || target || ' status=' || status AS description,
  executed_at AS occurred_at, concat_ws('|', 'playbook=' || playbook_name, 'target=' || target, 'status=' || status,
    CASE WHEN status <> 'Failed' THEN 'action=' || action END) AS meta FROM run),
el AS (SELECT * FROM tl UNION ALL SELECT * FROM st UNION ALL SELECT * FROM pe),
pat AS (SELECT event_id + 1 AS id,
  CASE WHEN event_id % 15 = 0 THEN 'Port Scan' WHEN event_id % 35 = 0 THEN 'X' END AS alert_type,
  CASE WHEN event_id % 10 = 0 THEN 'High' WHEN event_id % 55 = 0 THEN 'EXTREME' END AS severity,
  CASE WHEN event_id % 25 = 0 THEN 'Resolved' END AS status,
  CASE WHEN event_id % 20 = 0 THEN 'patched' END AS description,
  ts + INTERVAL 5 HOUR AS ts FROM events WHERE event_id % 5 = 0),
mpat AS (
  SELECT event_id + 1 AS id, CASE WHEN event_id % 15 = 0 THEN 'Port Scan' END AS alert_type, 'High' AS severity,
    NULL::VARCHAR AS status, 'first' AS description, ts + INTERVAL 5 HOUR AS ts, 1 AS seq FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id + 1, NULL, CASE WHEN event_id % 8 = 0 THEN 'Low' END, 'Investigating', NULL, ts + INTERVAL 5 HOUR, 2
    FROM events WHERE event_id % 4 = 0
  UNION ALL SELECT 1, CASE WHEN event_id % 2 = 0 THEN 'Brute Force' ELSE 'DDoS' END,
    CASE WHEN event_id % 9 <> 0 THEN {_at(D.SEVERITIES, 'event_id % 4')} END, NULL,
    CASE WHEN event_id % 7 = 0 THEN 'note ' || event_id END, ts, event_id + 100 FROM events WHERE event_id % 3 = 0),
calls AS (SELECT conv_id * 1000 + turn AS id, conv_id::VARCHAR AS session_id,
  {_at(['summarize', 'diagnosis', 'treatment', 'explanation', 'process'], 'turn % 5')} AS task_type,
  CASE WHEN conv_id % 2 = 0 THEN 'openai' ELSE 'ollama' END AS provider,
  {_at(['model-a', 'model-b', 'model-c'], 'conv_id % 3')} AS model,
  length(text) // 8 AS prompt_tokens, length(text) // 4 AS completion_tokens,
  length(text) // 8 + length(text) // 4 AS total_tokens,
  ((conv_id * 31 + turn * 7) % 900 + 50)::DOUBLE AS latency_ms, (conv_id + turn) % 4 AS phi_entities_count,
  (conv_id + turn) % 4 > 0 AS has_phi_warning, (conv_id + turn) % 13 <> 0 AS success,
  CASE WHEN (conv_id + turn) % 13 = 0 THEN 'timeout' END AS error_message,
  make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000) AS created_at
  FROM conversations WHERE role = 'assistant')
"""

NOTES = """
docs AS MATERIALIZED (
  SELECT source AS session_id, doc_id AS text_seq, text, lang, source FROM documents
  UNION ALL
  SELECT 'ward-' || (CASE WHEN n % 3 = 0 THEN 0 ELSE n % 12 END)::VARCHAR, n,
    CASE n % 6
      WHEN 0 THEN 'Seen by Dr. Mary Jones on 2024-01-' || lpad((n % 28 + 1)::VARCHAR, 2, '0')
        || '. MRN#' || (n + 100000)::VARCHAR || ', SSN ' || (n % 900 + 100)::VARCHAR || '-45-'
        || lpad((n * 7 % 10000)::VARCHAR, 4, '0') || '.'
      WHEN 1 THEN 'DOB: 03/04/' || (n % 50 + 1950)::VARCHAR || '; call (555) 123-'
        || lpad((n % 10000)::VARCHAR, 4, '0') || ' or 555-987-' || lpad((n * 3 % 10000)::VARCHAR, 4, '0') || '.'
      WHEN 2 THEN 'Mail a' || (n % 40)::VARCHAR || '@x.com then b' || (n % 7)::VARCHAR || '@x.com then a'
        || (n % 40)::VARCHAR || '@x.com.'
      WHEN 3 THEN 'Patient John Smith emailed john' || (n % 11)::VARCHAR || '@x.com'
      WHEN 4 THEN 'patient was admitted today with Blood Pressure high'
      ELSE 'Lives at ' || (n % 99 + 1)::VARCHAR || ' Oak Tree Street. Treated in Mercy General Hospital.'
    END, 'en', 'notes'
  FROM (SELECT c_custkey AS n FROM customer))
"""


def _span_cte(name: str, texts: str = "docs") -> str:
    """All matches of one rule. RE2 knows ASCII words only, so accented letters become
    underscores, one for one, before the search; no rule but the e-mail one can match
    an underscore, and that rule searches the text as it is."""
    _, entity, confidence, ignore_case, lead, body = D.PHI_RULES[RULE_NAMES.index(name)]
    pattern = ("(?i)" if ignore_case else "") + lead + "(" + body + ")"
    pattern = pattern.replace("'", "''")
    words = "text" if name == "email" else "regexp_replace(text, '[À-ɏ]', '_', 'g')"
    extra = ""
    if name == "phone":
        extra = f"WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) >= {D.PHONE_DIGITS}"
    if name == "name_pair":
        extra = f"WHERE value NOT IN {_in(D.NOT_NAMES)}"
    return f"""
sp_{name} AS MATERIALIZED (
  SELECT session_id, text_seq, s, e, '{entity}' AS entity_type, value, {confidence}e0 AS confidence FROM (
    SELECT session_id, text_seq, s, s + length(g) AS e, trim(substring(text, s + 1, length(g))) AS value FROM (
      SELECT session_id, text_seq, text, gs[i] AS g,
        (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
         + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)
         + length(ms[i]) - length(gs[i]))::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT session_id, text_seq, text, regexp_extract_all(w, '{pattern}') AS ms,
          regexp_extract_all(w, '{pattern}', 1) AS gs, string_split_regex(w, '{pattern}') AS gaps
        FROM (SELECT session_id, text_seq, text, {words} AS w FROM {texts}))
        WHERE len(ms) > 0))) {extra})"""


def _resolved(texts: str = "docs") -> str:
    """Rule by rule, drop what overlaps a span that is already kept."""
    parts = [_span_cte(name, texts) for name in RULE_NAMES]
    kept = f"sp_{RULE_NAMES[0]}"
    for name in RULE_NAMES[1:]:
        parts.append(f"""
ac_{name} AS MATERIALIZED (SELECT * FROM {kept} UNION ALL SELECT * FROM sp_{name} c WHERE NOT EXISTS (
  SELECT 1 FROM {kept} k WHERE k.session_id = c.session_id AND k.text_seq = c.text_seq
    AND k.s < c.e AND c.s < k.e))""")
        kept = f"ac_{name}"
    parts.append(f"\nent AS MATERIALIZED (SELECT * FROM {kept})")
    return ",".join(parts)


_PREFIX = "CASE entity_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in D.TOKEN_PREFIX.items()
) + " END"


def token_text(prefix: str, number: str) -> str:
    return (
        f"{prefix} || '_' || CASE WHEN {number} < 1000 THEN lpad({number}::VARCHAR, 3, '0') "
        f"ELSE {number}::VARCHAR END"
    )


TOKENS = f"""
fst AS (SELECT session_id, value, prefix, text_seq AS first_seq, s AS first_start FROM (
  SELECT *, {_PREFIX} AS prefix, row_number() OVER (PARTITION BY session_id, value ORDER BY text_seq, s DESC) AS rn
  FROM ent) WHERE rn = 1),
num AS (SELECT *, row_number() OVER (PARTITION BY session_id, prefix ORDER BY first_seq, first_start DESC) AS token_no
  FROM fst),
tok AS MATERIALIZED (SELECT *, {token_text('prefix', 'token_no')} AS token FROM num),
pieces AS (SELECT e.session_id, e.text_seq, e.s, e.e, t.token,
  coalesce(lag(e.e) OVER (PARTITION BY e.session_id, e.text_seq ORDER BY e.s), 0) AS prev_e
  FROM ent e JOIN tok t USING (session_id, value)),
swp AS MATERIALIZED (SELECT d.session_id, d.text_seq, d.text, coalesce(p.n, 0) AS entity_count,
  coalesce(p.tokens, 0) AS token_count,
  CASE WHEN p.n IS NULL THEN d.text ELSE p.head || substring(d.text, p.last_e + 1) END AS new_text
  FROM docs d LEFT JOIN (
    SELECT session_id, text_seq, count(*) AS n, count(DISTINCT token) AS tokens, max(e) AS last_e,
      string_agg(substring(d2.text, prev_e + 1, s - prev_e) || token, '' ORDER BY s) AS head
    FROM pieces JOIN docs d2 USING (session_id, text_seq) GROUP BY session_id, text_seq
  ) p USING (session_id, text_seq))
"""


def sql(body: str) -> str:
    return f"WITH {VIEWS} {body}"


def rule_sql(name: str) -> str:
    return (
        f"WITH {NOTES}, {_span_cte(name)} SELECT session_id, text_seq, s AS \"start\", e AS \"end\", "
        f"value FROM sp_{name}"
    )


def phi_sql(body: str, tokens: bool = False, more: str = "") -> str:
    parts = [NOTES, _resolved(), *([TOKENS] if tokens else []), *([more] if more else [])]
    return f"WITH {', '.join(parts)} {body}"


def pages_sql(body: str) -> str:
    docs = "docs AS MATERIALIZED (SELECT 'pages' AS session_id, page_id AS text_seq, html AS text FROM pages)"
    return f"WITH {docs}, {_resolved()} {body}"


def turns_sql(body: str) -> str:
    docs = (
        "docs AS MATERIALIZED (SELECT conv_id::VARCHAR AS session_id, turn AS text_seq, role, text "
        "FROM conversations)"
    )
    return f"WITH {docs}, {_resolved()} {body}"
