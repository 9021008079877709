"""Where token maps live between calls: saved by session, renewed, expired, read by version.

Rows lie in buckets by session. A save writes the buckets of its sessions anew under the
next version and then a manifest that says which version holds each bucket; all other
buckets stay as they are. Readers go by a manifest, so they see one version whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill import schemas as S
from sentrymill.operators.skew import lookup_join
from sentrymill.operators.tokens import live
from sentrymill.sources.tables import open_or_empty

BUCKETS = 64
_MANIFEST = "bucket int, held long, version long"


class TokenStore:
    """One writer at a time; readers may come at any time and may ask for an old version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> DataFrame:
        schema = self.spark.createDataFrame([], _MANIFEST).schema
        return open_or_empty(self.spark, f"{self.path}/manifest", schema)

    def version(self) -> int:
        """The newest version; 0 before the first save."""
        return self._manifests().agg(F.max("version")).first()[0] or 0

    def held(self, version: int | None = None) -> dict[int, int]:
        """Bucket: version whose folder holds it. At most one entry for each bucket."""
        at = self.version() if version is None else version
        return {r.bucket: r.held for r in self._manifests().where(F.col("version") == at).collect() if r.bucket >= 0}

    def _read(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], S.TOKENS)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(S.TOKENS).parquet(*paths)

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.where("session_id is not null").select(self._bucket()).distinct().collect()]

    def load(self, as_of: Column, sessions: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """The token map as it is alive at `as_of`. With `sessions` (column session_id) only
        theirs, and only their buckets are read."""
        held = self.held(version)
        if sessions is None:
            return live(self._read(held), as_of)
        asked = set(self._buckets_of(sessions))
        rows = live(self._read({b: v for b, v in held.items() if b in asked}), as_of)
        return lookup_join(rows, sessions.select("session_id").distinct(), ["session_id"], "left_semi")

    def save(self, tokens: DataFrame, as_of: Column, ttl: int = D.TOKEN_TTL_SECONDS) -> int:
        """Add the rows of a token map and renew the whole map of every session in it, until
        `ttl` seconds after `as_of`; gives the new version.

        A value that a session already has keeps its token. Expired rows of the buckets that
        are rewritten go. Rows without a session are left out. No rows leave the version as
        it is. A bucket in which one session holds most rows is written by many tasks.
        """
        asked = self._buckets_of(tokens)
        if not asked:
            return self.version()
        held, number = self.held(), self.version() + 1
        old = live(self._read({b: v for b, v in held.items() if b in asked}), as_of)
        new = tokens.where("session_id is not null").select(*S.TOKENS.fieldNames())
        saved = new.select("session_id").distinct().withColumn("_saved", F.lit(True))
        rest = [c for c in S.TOKENS.fieldNames() if c not in ("session_id", "value")]
        merged = (
            old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            .groupBy("session_id", "value").agg(F.min(F.struct("_new", *[c for c in rest if c != "expires_at"], "expires_at")).alias("_r"))
            .select("session_id", "value", *[f"_r.{c}" for c in rest])
        )
        until = as_of + F.make_interval(secs=F.lit(ttl))
        kept = lookup_join(merged, saved, ["session_id"]).withColumn(
            "expires_at", F.when(F.col("_saved"), until).otherwise(F.col("expires_at")))
        data = f"{self.path}/data/version={number}"
        kept.select(*S.TOKENS.fieldNames(), self._bucket().alias("bucket")).hint("rebalance", "bucket").write.mode(
            "overwrite").partitionBy("bucket").parquet(data)
        written = self.spark.read.schema("bucket int").parquet(data).distinct().collect()
        now = {b: v for b, v in held.items() if b not in asked} | {r.bucket: number for r in written}
        # one file, so that a version is there as a whole or not at all
        self.spark.createDataFrame([(b, v) for b, v in now.items()] or [(-1, number)], "bucket int, held long").coalesce(
            1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={number}")
        return number
