import zlib

from pyspark.sql import functions as F

from sentrymill.llm import quality


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    scored = quality.score(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and scored.count() == docs.count()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    for r in scored.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_held_out_labels_and_other_columns_do_not_matter(sample):
    docs, labels = sample("documents"), sample("labels")
    turned = labels.withColumn("quality", F.when(quality.fold() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("?")).withColumn("source", F.lit(None).cast("string"))
    one = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    two = {r.doc_id: r.score for r in quality.score(other, turned).collect()}
    assert one == two


def test_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame(
        [(4, 1, 0), (4, 0, 0), (7, 1, 0), (10, 0, 0), (None, 1, 0), (5, None, 0), (9, 1, 1)],
        "doc_id long, quality int, toxic int")
    rows = quality.score(make_docs(odd_rows), labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out is False for r in rows if r.doc_id is None)
    none = quality.score(make_docs(odd_rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert quality.score(make_docs([]), labels).count() == 0


def test_the_sample_is_bounded(sample):
    model = quality.train(quality.features(sample("documents"), quality.context_vectors(sample("documents"))), sample("labels"), 10)
    assert model is not None


def test_rejected_documents_go(spark, sample):
    docs, labels = sample("documents"), sample("labels")
    bad = {r.doc_id for r in quality.score(docs, labels).where("predicted = 0").collect()}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
