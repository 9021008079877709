"""Stored tables: scan, append, snapshot, JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from sentrymill.functions.text import utc_date
from sentrymill.session import cut_lineage


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet table; filters and column lists on it reach the files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def scan_jdbc(
    spark: SparkSession, url: str, table: str, key: str = "id", low: int = 0, high: int = 1,
    parts: int = 1, **options: str,
) -> DataFrame:
    """A table of an existing database, read in `parts` ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if parts > 1:
        reader = reader.options(
            partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)
        )
    return reader.load()


def open_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at `path`, or no rows in its shape when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append(rows: DataFrame, path: str, day_of: str | None = None) -> None:
    """Append to a table; `day_of` names the time column whose UTC day it is laid out by.

    Rows are first brought together by day and a hash, so a task writes few files while a
    day that holds most rows still has many writers.
    """
    if day_of is None:
        rows.write.mode("append").parquet(path)
        return
    # The rebalance hint lets adaptive execution split big days and merge small ones.
    (
        rows.withColumn("day", utc_date(F.col(day_of))).hint("rebalance", "day")
        .write.mode("append").partitionBy("day").parquet(path)
    )


def rewrite_days(spark: SparkSession, path: str, key: str, ids: DataFrame, changed=None) -> list[str]:
    """Delete the rows of a table by day (see append) whose `key` is among `ids` (column id),
    or change them: `changed` is given the rows of the touched days joined with `ids` on
    `key`, and gives what they become. Gives the days that were touched.

    Days are found from the key column alone, and only their folders are written anew; files
    of other days stay as they are. The new rows are written aside first, so a failure
    leaves the old ones or can be repeated.
    """
    table = spark.read.parquet(path)
    wanted = ids.withColumnRenamed("id", key)
    hits = table.select(key, "day").join(wanted.select(key).distinct().hint("rebalance"), key, "left_semi")
    days = sorted(str(r.day) for r in hits.select("day").distinct().collect())     # one for each day
    if not days:
        return days
    there = table.where(F.col("day").cast("string").isin(days))
    if changed is None:
        kept = there.join(wanted.select(key).distinct().hint("rebalance"), key, "left_anti").select(*table.columns)
    else:
        kept = changed(there.join(wanted.hint("rebalance"), key, "left")).select(*table.columns)
    kept = cut_lineage(kept)
    kept.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "day").parquet(path)
    left = {str(r.day) for r in kept.select("day").distinct().collect()}
    for day in set(days) - left:        # a day without rows is not overwritten
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return days


def with_json(rows: DataFrame, name: str, *fields: Column | str) -> DataFrame:
    """Pack fields into a JSON text column; null members are kept."""
    return rows.withColumn(name, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def read_json_column(rows: DataFrame, name: str, schema: str | T.DataType, into: str) -> DataFrame:
    """Parse a JSON text column."""
    return rows.withColumn(into, F.from_json(name, schema))
