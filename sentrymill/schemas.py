"""Column types of the stored tables."""

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_long, _text, _double = T.LongType(), T.StringType(), T.DoubleType()
_time, _flag = T.TimestampType(), T.BooleanType()

RAW_ALERTS = _table(
    id=_long, alert_type=_text, source_ip=_text, severity=_text, status=_text,
    description=_text, created_at=_time,
)
ALERTS = _table(
    id=_long, alert_id=_text, alert_type=_text, source_ip=_text, severity=_text, status=_text,
    description=_text, risk_score=_double, threat_verdict=_text, enrichment_data=_text,
    created_at=_time, updated_at=_time,
)
TIMELINE = _table(
    alert_db_id=_long, alert_id=_text, event_type=_text, seq=_long, description=_text,
    metadata_json=_text, occurred_at=_time,
)
EXECUTIONS = _table(
    alert_db_id=_long, alert_id=_text, seq=_long, playbook_name=_text, action=_text, target=_text,
    status=_text, result_message=_text, result_data=_text, executed_by=_text, executed_at=_time,
)
BLOCKED_IPS = _table(
    ip_address=_text, alert_id=_text, reason=_text, blocked_by=_text, notes=_text, blocked_at=_time,
)
USAGE_LOG = _table(
    id=_long, session_id=_text, task_type=_text, provider=_text, model=_text, prompt_tokens=_long,
    completion_tokens=_long, total_tokens=_long, latency_ms=_double, phi_entities_count=_long,
    has_phi_warning=_flag, success=_flag, error_message=_text, created_at=_time,
)
TI_ABUSE = _table(
    ip_address=_text, is_public=_flag, abuse_confidence_score=_long, country_code=_text, isp=_text,
    domain=_text, total_reports=_long, last_reported_at=_time, is_whitelisted=_flag,
    usage_type=_text, source=_text,
)
TI_SCAN = _table(
    ip_address=_text, malicious_count=_long, suspicious_count=_long, harmless_count=_long,
    undetected_count=_long, total_engines=_long, reputation=_long, network=_text, asn=_long,
    as_owner=_text, country=_text, regional_internet_registry=_text, last_analysis_date=_text,
    tags=T.ArrayType(_text), source=_text,
)
TI_GEO = _table(
    ip=_text, hostname=_text, city=_text, region=_text, country=_text, org=_text, asn=_text,
    timezone=_text, loc=_text, source=_text,
)
STATUS_CHANGES = _table(id=_long, new_status=_text, ts=_time, seq=_long)
PLAYBOOK_REQUESTS = _table(
    alert_id=_text, playbook_name=_text, target=_text, notes=_text, requested_by=_text,
    ts=_time, seq=_long,
)
TOKENS = _table(
    session_id=_text, value=_text, token=_text, prefix=_text, token_no=_long, first_seq=_long,
    first_start=_long, expires_at=_time,
)
RULES = _table(
    rule_id=_long, priority=_long, min_score=_double, max_score=_double, verdict=_text, level=_text,
    playbook_name=_text,
)
