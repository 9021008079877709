"""A table laid out for look-ups by a whole-number key and by a name.

Rows lie in folders by range of the key, sorted inside; a key with very many rows is cut
over several folders by further columns of order. Beside them are the zones, one row for
each folder with its least and largest key, and a list of names by hash bucket that says
in which folders a name occurs. A look-up asks the zones or one bucket of names, then
reads only the folders that can hold its rows, and of these only the row groups whose
bounds pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.sources.tables import open_or_empty

ROWS_PER_PART = 1_000_000
BUCKETS = 64
MOST_ASKED = 1_000      # keys or names of one look-up; a longer list is a join, not a look-up

_ZONES = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("low", T.LongType()),
    T.StructField("high", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("at", T.LongType())])
_NAMES = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("part", T.IntegerType()),
    T.StructField("at", T.LongType()), T.StructField("bucket", T.IntegerType())])


def _asked(values: list) -> list:
    wanted = sorted({v for v in values if v is not None})
    if len(wanted) > MOST_ASKED:
        raise ValueError(f"at most {MOST_ASKED} values in one look-up; join the table for more")
    return wanted


class LookupTable:
    """Rows of one schema with a long `key` and a text `name`, added batch by batch.

    A batch that is written again replaces itself. Rows without a key or a name are kept and
    found by the other; a null is never asked for. `order` are columns in which the rows of
    a key are sorted and, where they are many, cut.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, name: str,
                 order: list[str], buckets: int = BUCKETS, rows_per_part: int = ROWS_PER_PART):
        taken = {"at", "part"} & {f.name.lower() for f in schema.fields}
        if taken:
            raise ValueError(f"the layout has its own columns {sorted(taken)}")
        self.spark, self.path, self.schema = spark, path, schema
        self.key, self.name, self.order = key, name, order
        self.buckets, self.rows_per_part = buckets, rows_per_part

    def _bucket(self, name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Store a batch. `rows` is read three times: to count, to find the ranges, to write."""
        own = rows.select(*self.schema.fieldNames())
        parts = max(1, -(-own.count() // self.rows_per_part))
        place = [self.key, *self.order]
        files = f"{self.path}/rows/at={batch}"
        own.repartitionByRange(parts, *place).withColumn("part", F.spark_partition_id()).sortWithinPartitions(
            *place).write.mode("overwrite").partitionBy("part").parquet(files)
        stored = self.spark.read.schema(T.StructType([*self.schema.fields, _ZONES["part"]])).parquet(files)
        names = stored.where(F.col(self.name).isNotNull()).select(F.col(self.name).alias("name"), "part").distinct()
        names.withColumn("bucket", self._bucket(F.col("name"))).repartitionByRange("bucket", "name").sortWithinPartitions(
            "bucket", "name").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/names/at={batch}")
        stored.groupBy("part").agg(
            F.min(self.key).cast("long").alias("low"), F.max(self.key).cast("long").alias("high"), F.count("*").alias("rows")
        ).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/zones/at={batch}")

    def _read(self, folders: DataFrame) -> DataFrame:
        """The rows of some folders (at, part). Their list comes to the driver, which plans
        the files of a scan in any case."""
        paths = [f"{self.path}/rows/at={r['at']}/part={r.part}" for r in folders.select("at", "part").distinct().collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(paths))

    def zones(self) -> DataFrame:
        return open_or_empty(self.spark, f"{self.path}/zones", _ZONES)

    def by_key(self, keys: list[int]) -> DataFrame:
        """The rows of some keys, in no order. Starts a job over the zones when called."""
        wanted = _asked(keys)
        near = F.exists(F.array(*map(F.lit, wanted)).cast("array<long>"), lambda k: k.between(F.col("low"), F.col("high")))
        return self._read(self.zones().where(near)).where(F.col(self.key).isin(wanted))

    def by_name(self, names: list[str]) -> DataFrame:
        """The rows of some names, in no order. Starts a job over their buckets when called."""
        wanted = _asked(names)
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        buckets = self.spark.range(1).select(F.array(*[self._bucket(F.lit(n)) for n in wanted])).first()[0]
        listed = open_or_empty(self.spark, f"{self.path}/names", _NAMES)
        found = listed.where(F.col("bucket").isin(sorted(set(buckets))) & F.col("name").isin(wanted))
        return self._read(found).where(F.col(self.name).isin(wanted))
