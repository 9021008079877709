"""Containment actions: requests to run a playbook become action records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill import schemas as S
from sentrymill.functions.scoring import risk_level
from sentrymill.functions.text import as_json, fill, iso_utc, present
from sentrymill.operators.intake import check_range, new_keys_only
from sentrymill.operators.skew import lookup_join


def catalog(spark: SparkSession) -> DataFrame:
    """The playbooks on offer."""
    return spark.createDataFrame(
        D.PLAYBOOKS, "name string, description string, action string, target_type string"
    )


class Resolved(NamedTuple):
    requests: DataFrame   # with the alert's columns and the effective target
    rejects: DataFrame    # with a reason


def resolve(requests: DataFrame, alerts: DataFrame) -> Resolved:
    """Find each request's alert and target; an empty target means the source address.
    The alert is checked before the playbook name."""
    needed = alerts.select(
        "alert_id", F.col("id").alias("alert_db_id"), "alert_type", "source_ip", "severity",
        "risk_score",
    )
    seen = lookup_join(requests, needed, ["alert_id"])
    names = [p[0] for p in D.PLAYBOOKS]
    reason = F.when(F.col("alert_db_id").isNull(), "alert not found").when(
        F.col("playbook_name").isNull() | ~F.col("playbook_name").isin(names), "playbook not found"
    )
    checked = seen.withColumn("reason", reason)
    return Resolved(
        checked.where("reason is null").drop("reason")
        .withColumns({
            "target": F.coalesce(present(F.col("target")), "source_ip"),
            "requested_by": F.coalesce("requested_by", F.lit("system")),
        }),
        checked.where("reason is not null").select(*requests.columns, "reason"),
    )


def _id(playbook: str, *key: Column) -> Column:
    """Stable id: the prefix and the first 8 hex digits of the key's MD5."""
    return F.concat(F.lit(D.ACTION_ID[playbook]), F.substring(F.md5(F.concat(*key)), 1, 8))


def _reason(playbook: str) -> Column:
    return F.coalesce(present(F.col("notes")), F.lit(D.DEFAULT_REASON[playbook]))


def _result(
    playbook: str, id_name: str, key: Column, lines_name: str, before: tuple = (), after: tuple = (),
    more: tuple = (), **words: Column,
) -> Column:
    """The result struct of a playbook. `before` and `after` go around the reason, `more`
    comes last; `words` fill the texts besides the id."""
    action = next(p[2] for p in D.PLAYBOOKS if p[0] == playbook)
    words = {"id": key, "small_id": F.lower(key), **words}
    return F.struct(
        F.lit(playbook).alias("playbook"), F.lit(action).alias("action"), F.col("target"),
        F.col("alert_id"), key.alias(id_name), *before, _reason(playbook).alias("reason"), *after,
        F.col("requested_by").alias("executed_by"), iso_utc(F.col("ts")).alias("executed_at"),
        F.lit("Success").alias("status"), fill(D.ACTION_MESSAGE[playbook], **words).alias("message"),
        F.lit(True).alias("simulated"),
        F.array(*[fill(line, **words) for line in D.ACTION_LINES[playbook]]).alias(lines_name), *more,
    )


def block_ip() -> Column:
    """Result of blocking the target, as a struct."""
    return _result("block_ip", "rule_id", _id("block_ip", F.col("target")), "actions_taken")


def isolate_host() -> Column:
    key = _id("isolate_host", F.col("target"), F.col("alert_id"))
    return _result("isolate_host", "ticket_id", key, "actions_taken")


def notify_soc() -> Column:
    at = iso_utc(F.col("ts"))
    body = fill(D.NOTIFICATION, at=at, reason=_reason("notify_soc"))
    return _result(
        "notify_soc", "notification_id", _id("notify_soc", F.col("alert_id"), at), "channels_notified",
        more=(body.alias("notification_body"),),
    )


def escalate() -> Column:
    priority = F.when(F.col("severity").isin("Critical", "High"), "P1").otherwise("P2")
    return _result(
        "escalate", "ticket_id", _id("escalate", F.col("alert_id")), "actions_taken",
        before=(priority.alias("priority"),), after=(F.col("risk_score"),),
        more=(iso_utc(F.col("ts")).alias("sla_deadline"),), priority=priority,
    )


RESULTS = {
    "block_ip": block_ip, "isolate_host": isolate_host, "notify_soc": notify_soc,
    "escalate": escalate,
}


def run(resolved: DataFrame, playbook: str) -> DataFrame:
    """Requests for one playbook with its result struct in `result`."""
    return resolved.where(F.col("playbook_name") == playbook).withColumn(
        "result", RESULTS[playbook]()
    )


def executions(resolved: DataFrame) -> DataFrame:
    """One execution record per resolved request, all playbooks in one pass.

    A non-null `error` column marks a failed run: status Failed, the upper-case name
    as action, no message.
    """
    name = F.col("playbook_name")
    error = F.col("error") if "error" in resolved.columns else F.lit(None).cast("string")
    failed = error.isNotNull()
    action, message, data = F.upper(name), F.lit(""), as_json(error.alias("error"))
    for playbook, result in RESULTS.items():
        mine = ~failed & (name == playbook)
        done = result()
        action = F.when(mine, F.lit(dict((p[0], p[2]) for p in D.PLAYBOOKS)[playbook])).otherwise(action)
        message = F.when(mine, done["message"]).otherwise(message)
        data = F.when(mine, F.to_json(done, {"ignoreNullFields": "false"})).otherwise(data)
    return resolved.select(
        "alert_db_id", "alert_id", "seq", "playbook_name", action.alias("action"), "target",
        F.when(failed, "Failed").otherwise("Success").alias("status"),
        message.alias("result_message"), data.alias("result_data"),
        F.col("requested_by").alias("executed_by"), F.col("ts").alias("executed_at"), "notes",
    )


def list_executions(
    runs: DataFrame, alert_id: str | None = None, limit: int = D.EXECUTION_PAGE[0]
) -> DataFrame:
    check_range("limit", limit, 1, D.EXECUTION_PAGE[1])
    rows = runs.where(F.col("alert_id") == alert_id) if alert_id else runs
    return rows.orderBy(F.desc("executed_at"), F.desc("alert_db_id"), F.desc("seq")).limit(limit)


def block_entries(runs: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append to the block register: the earliest successful block of each
    address that is not yet on it."""
    rows = runs.where("playbook_name = 'block_ip' and status = 'Success'").select(
        F.col("target").alias("ip_address"), "alert_id",
        F.coalesce(present(F.col("notes")), F.lit(D.DEFAULT_BLOCK_REASON)).alias("reason"),
        F.col("executed_by").alias("blocked_by"), F.lit(None).cast("string").alias("notes"),
        F.col("executed_at").alias("blocked_at"), F.col("seq").alias("_seq"),
    )
    return new_keys_only(rows, existing, ["ip_address"], ["blocked_at", "alert_id", "_seq"]).drop("_seq")


def list_blocked(blocked: DataFrame, limit: int = D.BLOCKED_PAGE) -> DataFrame:
    return blocked.orderBy(F.desc("blocked_at"), F.desc("ip_address")).limit(limit)


def candidates(alerts: DataFrame, policy: str = "reference") -> DataFrame:
    """Playbooks the default rules call for: a Malicious verdict is blocked, a Critical
    level escalated, a High level notified. One row per alert and rule met."""
    level = risk_level(F.coalesce("risk_score", F.lit(0.0)), policy)
    met = F.array_compact(F.array(
        F.when(F.col("threat_verdict") == "Malicious", "block_ip"),
        F.when(level == "Critical", "escalate"),
        F.when(level == "High", "notify_soc"),
    ))
    return alerts.select(
        "id", "alert_id", "source_ip", "threat_verdict", "risk_score",
        level.alias("risk_level"), F.explode(met).alias("playbook_name"),
    )


SCORE_BIN = 5      # width of the score ranges that alerts and rules are joined by
_ANY_OTHER = "*"   # an alert whose verdict is none of the known ones


def default_rules(spark: SparkSession) -> DataFrame:
    """The rules of candidates() as a rule table."""
    return spark.createDataFrame(
        [(1, 1, None, None, "Malicious", None, "block_ip"), (2, 2, None, None, None, "Critical", "escalate"),
         (3, 3, None, None, None, "High", "notify_soc")], S.RULES)


def _bin(score: Column) -> Column:
    """The range a score falls in; what lies outside 0 to 100 has a range on either side."""
    return F.floor(F.least(F.greatest(score, F.lit(-1.0)), F.lit(101.0)) / SCORE_BIN).cast("int")


def rule_matches(alerts: DataFrame, rules: DataFrame, policy: str = "reference") -> DataFrame:
    """One row per alert and rule it meets: `id`, `alert_id`, `rule_id`, `priority`,
    `playbook_name`.

    A rule (rule_id, priority, min_score, max_score, verdict, level, playbook_name) is met
    by alerts whose score lies within its bounds, both included, and which have its verdict
    and level; a NULL asks for nothing. A missing score counts as 0. Rules are laid out by
    verdict and score range, so that alerts meet them in an equi-join; a rule table grows
    to at most (verdicts + 1) * 23 rows for each rule, alerts do not grow.
    """
    score = F.coalesce("risk_score", F.lit(0.0))
    known = F.col("threat_verdict").isin(D.VERDICTS)
    facts = alerts.select(
        "id", "alert_id", score.alias("_score"), risk_level(score, policy).alias("_level"),
        F.when(known, F.col("threat_verdict")).otherwise(_ANY_OTHER).alias("_verdict"), _bin(score).alias("_bin"))
    wide = rules.select(
        "rule_id", "priority", "playbook_name", "min_score", "max_score", "level",
        F.explode(F.when(F.col("verdict").isNull(), F.array(*map(F.lit, [*D.VERDICTS, _ANY_OTHER])))
                  .otherwise(F.array("verdict"))).alias("_verdict"),
        _bin(F.coalesce("min_score", F.lit(-1.0))).alias("_low"), _bin(F.coalesce("max_score", F.lit(101.0))).alias("_high"),
    ).where("_low <= _high").withColumn("_bin", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    met = (
        (F.col("level").isNull() | (F.col("level") == F.col("_level")))
        & F.coalesce(F.col("_score") >= F.col("min_score"), F.lit(True))
        & F.coalesce(F.col("_score") <= F.col("max_score"), F.lit(True))
    )
    return facts.join(wide.hint("rebalance"), ["_verdict", "_bin"]).where(met).select(
        "id", "alert_id", "rule_id", "priority", "playbook_name")


def rule_candidates(alerts: DataFrame, rules: DataFrame, policy: str = "reference") -> DataFrame:
    """Playbooks the rules call for: one row per alert and playbook, with the rule of the
    least priority that asks for it (equal ones: the least rule_id) and how many do."""
    met = rule_matches(alerts, rules, policy)
    return met.groupBy("id", "alert_id", "playbook_name").agg(
        F.min(F.struct("priority", "rule_id")).alias("_r"), F.count("*").alias("rules_met"),
    ).select("id", "alert_id", "playbook_name", "_r.priority", "_r.rule_id", "rules_met")
