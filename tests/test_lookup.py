"""Tables laid out for look-ups: what they give, and how few files they read."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.sources.lookup import MOST_ASKED, LookupTable

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()),
                       T.StructField("seq", T.LongType())])


def numbered(spark, first, last):
    return spark.range(first, last).select(
        "id", F.format_string("N-%05d", F.col("id")).alias("label"), F.lit(0).cast("long").alias("seq"))


def table(spark, tmp_path, per_part=100):
    return LookupTable(spark, str(tmp_path / "t"), SCHEMA, "id", "label", ["seq"], 8, per_part)


def values(df):
    return sorted((r.id, r.label, r.seq) for r in df.collect())


def test_a_look_up_reads_few_files(spark, tmp_path):
    held = table(spark, tmp_path)
    assert held.by_key([1]).count() == 0 and held.by_name(["N-00001"]).count() == 0     # nothing written yet
    held.add(numbered(spark, 0, 1000), 0)
    held.add(numbered(spark, 1000, 2000), 1)
    assert held.zones().count() == 20
    one = held.by_key([1234])
    assert values(one) == [(1234, "N-01234", 0)] and len(one.inputFiles()) == 1
    named = held.by_name(["N-00007", "N-01999", "none"])
    assert values(named) == [(7, "N-00007", 0), (1999, "N-01999", 0)] and len(named.inputFiles()) == 2
    assert "PushedFilters: [In(id, " in one._jdf.queryExecution().toString() or "EqualTo(id,1234)" in one._jdf.queryExecution().toString()
    assert held.by_key([5000, None]).inputFiles() == [] and held.by_key([]).count() == 0 and held.by_name([None]).count() == 0
    with pytest.raises(ValueError):
        held.by_key(list(range(MOST_ASKED + 1)))


def test_a_heavy_key_is_cut_and_nulls_stay(spark, tmp_path):
    held = table(spark, tmp_path)
    heavy = spark.range(900).select(F.lit(7).cast("long").alias("id"), F.lit("hot").alias("label"), F.col("id").alias("seq"))
    other = spark.createDataFrame([(None, "no key", 1), (8, None, 2), (None, None, 3), (9, "hot", 4), (9, "hot", 4)], SCHEMA)
    held.add(heavy.unionByName(numbered(spark, 100, 700)).unionByName(other), 0)
    most = held.zones().agg(F.max("rows"), F.sum("rows")).first()
    assert most[0] < 300 and most[1] == 1505              # no folder holds the heavy key whole, no row is lost
    assert held.by_key([7]).count() == 900 and held.by_name(["hot"]).count() == 902      # repeated rows stay
    assert values(held.by_name(["no key"])) == [(None, "no key", 1)]
    assert values(held.by_key([8])) == [(8, None, 2)]


def test_a_batch_replaces_itself(spark, tmp_path):
    held = table(spark, tmp_path)
    held.add(numbered(spark, 0, 300), 0)
    held.add(numbered(spark, 300, 400), 1)
    held.add(numbered(spark, 200, 250), 0)
    assert held.by_key([10, 210, 350]).count() == 2 and held.by_name(["N-00010"]).count() == 0
    held.add(numbered(spark, 0, 0), 1)                    # an empty batch
    assert held.by_key([350]).count() == 0


def test_own_columns_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        LookupTable(spark, str(tmp_path / "u"), T.StructType([T.StructField("id", T.LongType()), T.StructField("part", T.LongType())]), "id", "part", [])
