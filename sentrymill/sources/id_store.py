"""A stored set of ids, asked by each micro-batch which of its own are already there.

Ids lie in files by hash bucket and, within a bucket, by range, sorted. Beside them is a
table of zones: for each file the pages of a Bloom filter, with the least and largest id
that each page stands for. A question is put to the bounds first; ids that no file's bounds
hold, as new ids of a counter are, end there. The rest is put to the one page of each file
that would know them, and only files that pass both are read. So a batch costs its own ids,
the bounds and the files it really meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.sources.tables import open_or_empty

BUCKETS = 16
BITS = 12         # of the filter for each id; with HASHES of them set about one stranger in 150 passes
HASHES = 4
PAGE = 32768      # bits of a page, as bitmap_construct_agg() makes them


def _table(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_IDS = _table(id=T.LongType(), bucket=T.IntegerType(), part=T.IntegerType())
_ZONES = _table(
    bucket=T.IntegerType(), part=T.IntegerType(), pages=T.LongType(), page=T.LongType(), low=T.LongType(),
    high=T.LongType(), bits=T.BinaryType(), at=T.LongType())


def _page(pages: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(HASHES)), pages)


def _places() -> Column:
    """The bits of an id in its page."""
    return F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(PAGE).cast("long")) for i in range(HASHES)])


def _passes(bits: Column) -> Column:
    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(8)).cast("int"))) != 0

    return F.forall(_places(), is_set)


class IdStore:
    """Ids by batch, and settled into snapshots. A batch that is written again replaces
    itself; a snapshot can be made while the stream goes on."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _write(self, ids: DataFrame, kind: str, number: int) -> None:
        files = f"{self.path}/{kind}/at={number}"
        own = ids.where("id is not null").select("id")
        per_bucket = -(-own.count() // self.buckets)
        # the range exchange sizes its parts itself; a part holds few buckets, sorted by id
        own.withColumn("bucket", self._bucket()).repartitionByRange("bucket", "id").withColumn(
            "part", F.spark_partition_id()).sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy(
            "bucket", "part").parquet(files)
        pages = F.lit(max(1, -(-per_bucket * BITS // PAGE))).cast("long")
        # a page combines on the map side, so it is gathered from bitmaps, not from its ids
        self.spark.read.schema(_IDS).parquet(files).select(
            "bucket", "part", pages.alias("pages"), _page(pages).alias("page"), "id", F.explode(_places()).alias("place")
        ).groupBy("bucket", "part", "pages", "page").agg(
            F.min("id").alias("low"), F.max("id").alias("high"), F.bitmap_construct_agg("place").alias("bits")
        ).write.mode("overwrite").parquet(f"{self.path}/{kind}-zones/at={number}")

    def add(self, ids: DataFrame, batch: int) -> None:
        """Store the ids (column id, none twice) of a batch. `ids` is read twice."""
        self._write(ids, "batch", batch)

    def _zones(self, before: int) -> DataFrame:
        """Zone rows that count for a batch: those of the newest snapshot and of the batches
        after it; with `at`, `kind` names the folder of their files."""
        batches = open_or_empty(self.spark, f"{self.path}/batch-zones", _ZONES).where(F.col("at") < before)
        settled = open_or_empty(self.spark, f"{self.path}/snapshot-zones", _ZONES).where(F.col("at") < before)
        newest = settled.agg(F.max("at")).first()[0]
        if newest is None:
            return batches.withColumn("kind", F.lit("batch"))
        return settled.where(F.col("at") == newest).withColumn("kind", F.lit("snapshot")).unionByName(
            batches.where(F.col("at") > newest).withColumn("kind", F.lit("batch")))

    def files(self, asked: DataFrame, before: int) -> list[str]:
        """Folders of the files that may hold an id of `asked`: bounds first, then filters. The
        lists that come here are of files, which compact() keeps few, and never of ids."""
        file = ["kind", "at", "bucket", "part"]
        keyed = asked.where("id is not null").select("id", self._bucket().alias("bucket"))
        zones = self._zones(before)
        bounds = zones.groupBy(*file, "pages").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        near = keyed.join(bounds.hint("rebalance"), "bucket").where("id between low and high")
        met = near.select(*file).distinct().collect()
        if not met:
            return []
        # of the filters only those of batches and buckets that were met are read
        of_met = F.col("at").isin([r["at"] for r in met]) & F.col("bucket").isin([r.bucket for r in met])
        filters = zones.where(of_met).select(*file, "page", "bits")
        hits = near.withColumn("page", _page(F.col("pages"))).join(filters, [*file, "page"]).where(_passes(F.col("bits")))
        return [f"{self.path}/{r.kind}/at={r['at']}/bucket={r.bucket}/part={r.part}"
                for r in hits.select(*file).distinct().collect()]

    def known(self, asked: DataFrame, before: int) -> DataFrame:
        """The ids of `asked` (read several times) that batches before `before` have stored,
        each once. Starts jobs when called."""
        files = self.files(asked, before)
        if not files:
            return asked.select("id").limit(0)
        return self.spark.read.schema("id long").parquet(*files).join(asked.select("id"), "id", "left_semi").distinct()

    def compact(self, upto: int) -> None:
        """Settle the ids of batches 0 to `upto` into a snapshot with few files, whose bounds
        do not overlap within a bucket. Folders of what it replaces may then be removed."""
        live = self._zones(upto + 1).select("kind", "at").distinct().collect()
        if any(r.kind == "batch" for r in live):
            folders = [f"{self.path}/{r.kind}/at={r['at']}" for r in live]
            rows = self.spark.read.option("recursiveFileLookup", "true").schema("id long").parquet(*folders)
            self._write(rows.distinct(), "snapshot", max(r["at"] for r in live))
