"""Raw alerts as JSON lines, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sentrymill import schemas as S

RAW_WITH_CORRUPT = T.StructType(
    [*S.RAW_ALERTS.fields, T.StructField("_corrupt_record", T.StringType(), True)]
)
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw alerts; a line that is not valid JSON keeps its text in _corrupt_record."""
    return spark.read.schema(RAW_WITH_CORRUPT).options(**_OPTIONS).json(path)


def stream_raw(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_WITH_CORRUPT).options(**_OPTIONS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)
