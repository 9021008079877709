"""The model-call audit log and its usage roll-up. Raw text is never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill import schemas as S


def log_rows(calls: DataFrame) -> DataFrame:
    """Calls in the stored shape: known columns only, so text cannot slip in, with
    their defaults."""
    filled = calls
    for field in S.USAGE_LOG.fields:
        if field.name not in calls.columns:
            filled = filled.withColumn(field.name, F.lit(None).cast(field.dataType))
    zero = ["prompt_tokens", "completion_tokens", "phi_entities_count"]
    filled = filled.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    return filled.withColumns({
        "total_tokens": F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")),
        "latency_ms": F.coalesce("latency_ms", F.lit(0.0)),
        "has_phi_warning": F.coalesce("has_phi_warning", F.col("phi_entities_count") > 0),
        "success": F.coalesce("success", F.lit(True)),
    }).select(*[F.col(f.name).cast(f.dataType) for f in S.USAGE_LOG.fields])


def usage(log: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens, latency, failure and PHI rates per provider, model and task."""
    by = by or ("provider", "model", "task_type")
    return log.groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.round(F.avg((~F.col("success")).cast("int")), 4).alias("failure_rate"),
        F.round(F.avg(F.col("has_phi_warning").cast("int")), 4).alias("phi_rate"),
    )
