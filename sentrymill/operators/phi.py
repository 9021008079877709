"""Personal data in a corpus: spans per document, summaries, reports.

Documents are (session_id, text_seq, text) rows plus whatever columns they carry; every
operator up to the report is row-local, so it scales with the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill.functions import spans as X

RULE_NAMES = [rule[0] for rule in D.PHI_RULES]


def _looked(docs: DataFrame, text: str) -> tuple[DataFrame, dict]:
    """`docs` with the columns of prepared(), which must not be worked out rule by rule."""
    ready = X.prepared(F.col(text))
    return docs.withColumns(ready), {name: F.col(name) for name in ready}


def find_rule(docs: DataFrame, rule: str, text: str = "text", strict: bool = False) -> DataFrame:
    """All matches of one rule, before overlaps are settled, in `spans`."""
    looked, ready = _looked(docs, text)
    return looked.withColumn("spans", X.candidates(ready, [rule], strict)).drop(*ready)


def detect(docs: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """Documents with `entities`: non-overlapping spans by rule priority, in text order."""
    looked, ready = _looked(docs, text)
    return looked.withColumn("entities", X.resolve(X.candidates(ready, strict=strict))).drop(*ready)


def summarise(detected: DataFrame) -> DataFrame:
    """Adds has_phi, entity_count and the distinct entity_types (sorted)."""
    return detected.withColumns({
        "has_phi": F.size("entities") > 0,
        "entity_count": F.size("entities").cast("long"),
        "entity_types": F.array_sort(F.array_distinct(F.col("entities.entity_type"))),
    })


def entity_rows(detected: DataFrame, *carry: str) -> DataFrame:
    """One row per entity with the columns named in `carry`."""
    return detected.select(*carry, X.each("entities"))


def corpus_report(detected: DataFrame, *by: str) -> DataFrame:
    """Entities and documents per type and the columns in `by`. Each document counts its
    types itself, so no distinct over documents is needed. Documents without entities
    give no rows by themselves; a filter on them would search every text twice."""
    kinds = F.array_distinct(F.col("entities.entity_type"))
    per_doc = F.transform(kinds, lambda k: F.struct(
        k.alias("entity_type"),
        F.size(F.filter("entities", lambda e: e["entity_type"] == k)).alias("n"),
    ))
    return (
        detected.select(*by, F.inline(per_doc))
        .groupBy(*by, "entity_type")
        .agg(F.sum("n").alias("entities"), F.count("*").alias("documents"))
    )
