"""Reversible pseudonyms per session: assigning tokens, swapping them in, restoring.

The token map is a table (session_id, value, token, prefix, token_no, first_seq,
first_start, expires_at). Sessions share nothing: the session is part of every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill.functions.spans import _let, each, replace_spans
from sentrymill.functions.text import text_map
from sentrymill.operators.skew import lookup_join, sliced_row_number
from sentrymill.session import cut_lineage

_PREFIXES = sorted(set(D.TOKEN_PREFIX.values()))
# A token anywhere in a text, also inside a longer word or number.
TOKEN_TEXT = "(?:" + "|".join(_PREFIXES) + r")_[0-9]{3,}"
# A whole run of the characters that tokens consist of, with a token somewhere in it.
TOKEN_RUN = rf"(?<![A-Z0-9_])(?=[A-Z0-9_]*?{TOKEN_TEXT})[A-Z0-9_]++"


def live(tokens: DataFrame, as_of: Column) -> DataFrame:
    """The part of a token map that has not expired."""
    return tokens.where(F.col("expires_at") > as_of)


def renew(tokens: DataFrame, sessions: DataFrame, as_of: Column, ttl: int = D.TOKEN_TTL_SECONDS) -> DataFrame:
    """Extend the life of the maps of the listed sessions, as each save does."""
    listed = sessions.select("session_id").distinct().withColumn("_saved", F.lit(True))
    until = as_of + F.make_interval(secs=F.lit(ttl))
    return lookup_join(tokens, listed, ["session_id"]).withColumn(
        "expires_at", F.when(F.col("_saved"), until).otherwise(F.col("expires_at"))
    ).select(*tokens.columns)


def _prefix_of(entity_type: Column) -> Column:
    return text_map(D.TOKEN_PREFIX)[entity_type]


def assign(
    entities: DataFrame, as_of: Column, existing: DataFrame | None = None,
    ttl: int = D.TOKEN_TTL_SECONDS,
) -> DataFrame:
    """New token map rows for the values of `entities` (session_id, text_seq, start,
    value, entity_type) that a session does not know yet.

    Texts count in text_seq order, and within a text from its end backwards. The first
    type that brings a value names it. Numbers go on from the existing map. `entities`
    is read more than once; pseudonymize() writes it out first.
    """
    # Copies of a value shrink on the map side before the shuffle.
    first = entities.groupBy("session_id", "value").agg(
        F.min(F.struct("text_seq", (-F.col("start")).alias("back"), "entity_type")).alias("f")
    ).select(
        "session_id", "value", F.col("f.text_seq").alias("first_seq"),
        (-F.col("f.back")).cast("long").alias("first_start"),
        _prefix_of(F.col("f.entity_type")).alias("prefix"),
    )
    if existing is not None:
        first = first.join(existing.select("session_id", "value"), ["session_id", "value"], "left_anti")
    first = cut_lineage(first)
    numbered = sliced_row_number(
        first, ["session_id", "prefix"], ["first_seq", F.desc("first_start")], "first_seq", "token_no"
    )
    if existing is not None:
        used = existing.groupBy("session_id", "prefix").agg(F.max("token_no").alias("_used"))
        numbered = lookup_join(
            numbered, used, ["session_id", "prefix"]
        ).withColumn("token_no", F.col("token_no") + F.coalesce("_used", F.lit(0)))
    number = F.when(F.col("token_no") < 1000, F.lpad(F.col("token_no").cast("string"), 3, "0")).otherwise(
        F.col("token_no").cast("string")
    )
    return numbered.select(
        "session_id", "value", F.concat("prefix", F.lit("_"), number).alias("token"), "prefix",
        "token_no", "first_seq", "first_start",
        (as_of + F.make_interval(secs=F.lit(ttl))).alias("expires_at"),
    )


def _with_rows(detected: DataFrame) -> DataFrame:
    """A session of its own for a text that has none, and `_row`, which tells texts with
    one session and number apart; texts alike in all three are swapped alike."""
    own = F.concat(F.lit("new-"), F.md5(F.concat_ws("\x01", F.col("text_seq").cast("string"), "text")))
    return detected.withColumn("session_id", F.coalesce("session_id", own)).withColumn(
        "_row", F.xxhash64("text_seq", "text"))


def _swapped(docs: DataFrame, entities: DataFrame, tokens: DataFrame, ttl: int) -> DataFrame:
    """Texts of `docs` (as from _with_rows) with their `entities` (session_id, _row, start,
    end, value) swapped for tokens."""
    named = lookup_join(
        entities, tokens.select("session_id", "value", "token"), ["session_id", "value"], "inner"
    )
    per_doc = named.groupBy("session_id", "_row").agg(
        F.array_sort(F.collect_set(F.struct("start", "end", "token"))).alias("_spans")
    )
    held = F.col("_spans").isNotNull()
    return docs.join(per_doc, ["session_id", "_row"], "left").select(
        "session_id", "text_seq",
        F.when(held, replace_spans(F.col("text"), F.col("_spans"))).otherwise(F.col("text")).alias("pseudonymized_text"),
        F.when(held, F.size("_spans")).otherwise(0).cast("long").alias("entity_count"),
        F.lit(ttl).cast("long").alias("mapping_ttl"),
    )


def substitute(detected: DataFrame, tokens: DataFrame, ttl: int = D.TOKEN_TTL_SECONDS) -> DataFrame:
    """Swap the entities of each document for the session's tokens.

    Gives session_id, text_seq, pseudonymized_text, entity_count, mapping_ttl. Spans go
    to the token map as rows of their own, so a value that fills the corpus is spread
    like any heavy key, and come back per document, bounded by its length. Every text
    comes out once, also one without a session (see pseudonymize) and several with the
    same session and number.
    """
    docs = _with_rows(detected)
    entities = docs.select("session_id", "_row", each("entities", "start", "end", "value"))
    return _swapped(docs.select("session_id", "text_seq", "text", "_row"), entities, tokens, ttl)


def pseudonymize(
    detected: DataFrame, as_of: Column, existing: DataFrame | None = None,
    ttl: int = D.TOKEN_TTL_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """(results, token map): results as in substitute(), the map with old and new rows.

    `detected` needs session_id, text_seq, text and entities. A text without a session gets
    one of its own, named after its content. The spans found are written out once when
    this is called, so the patterns run once per text; texts stay where they are.
    """
    detected = detected.select("session_id", "text_seq", "text", "entities")
    known = live(existing, as_of) if existing is not None else None
    docs = _with_rows(detected)
    entities = cut_lineage(docs.select(
        "session_id", "_row", "text_seq", each("entities", "start", "end", "entity_type", "value")))
    tokens = cut_lineage(assign(entities, as_of, known, ttl))
    if known is not None:
        tokens = renew(known, _with_rows(detected).select("session_id"), as_of, ttl).unionByName(tokens)
    spans = entities.select("session_id", "_row", "start", "end", "value")
    return _swapped(docs.select("session_id", "text_seq", "text", "_row"), spans, tokens, ttl), tokens


def _tokens_in(text: Column) -> Column:
    """Every string in `text` that could be a token: each match and, since a known
    token may be the beginning of a longer number, its shorter forms."""
    found = F.regexp_extract_all(text, F.lit(f"({TOKEN_TEXT})"), F.lit(1))

    def shorter(match: Column) -> Column:
        least = F.instr(match, "_") + 3
        return F.transform(
            F.sequence(least, F.length(match)), lambda n: F.substring(match, F.lit(1), n)
        )

    return F.array_distinct(F.flatten(F.transform(found, shorter)))


def _met(text: Column) -> Column:
    """_tokens_in(text), without a search for it in most texts."""
    return F.when(text.rlike(TOKEN_TEXT), _tokens_in(text)).otherwise(F.array().cast("array<string>"))


def _put_back(cell: Column, given: Column) -> Column:
    """(text, used, met) of one run: the tokens of `given` replaced one after another in the
    text as it then is, the tokens that were there, and all token text met on the way."""
    def step(done: Column, t: Column) -> Column:
        def hit(text: Column) -> Column:
            return F.struct(
                text.alias("text"), F.concat(done["used"], F.array(t["token"])).alias("used"),
                F.concat(done["met"], _met(text)).alias("met"))

        return F.when(
            done["text"].contains(t["token"]), _let(F.replace(done["text"], t["token"], t["value"]), hit)
        ).otherwise(done)

    none = F.array().cast("array<string>")
    return F.aggregate(given, F.struct(cell.alias("text"), none.alias("used"), none.alias("met")), step)


def restore(docs: DataFrame, tokens: DataFrame, as_of: Column) -> DataFrame:
    """Put the original values back: session_id, text_seq, restored_text, restored_count.

    One rule for texts of any size: the tokens of the session are replaced one after another
    in the text as it then is, the longest first, those of equal length in the order they were
    given. A value that holds token text, and token text that only arises where a value meets
    its neighbours, is replaced like any other if its turn is still to come. The count is of
    distinct tokens found.

    A token has only capitals, digits and `_`, so whatever else a text holds stays and parts
    it into runs that do not touch each other. The different runs of a session are restored
    once, however often they occur, and put back by position; the work goes with the text, but
    within one run with its tokens times its length. Tokens met on the way are looked up in
    further rounds, for the runs that meet a new one only: as many rounds as values are
    nested in each other. Starts a job for each when called. The texts are written out once
    with their runs, as they are read several times and may come from a costly plan.
    """
    known = live(tokens, as_of).select("session_id", "token", "value", "first_seq", "first_start")
    runs = F.regexp_extract_all("text", F.lit(f"({TOKEN_RUN})"), F.lit(1))
    docs = cut_lineage(docs.select(
        "session_id", "text_seq", "text", F.xxhash64("text_seq", "text").alias("_row"),
        F.when(F.col("text").rlike(TOKEN_TEXT), runs).alias("_runs")))
    holds = F.col("_runs").isNotNull()
    marked = docs.where(holds).drop("_runs")
    places = docs.where(holds).select("session_id", "_row", F.posexplode("_runs").alias("pos", "cell"))
    cells = places.where("session_id is not null").select("session_id", "cell").distinct()
    columns = ["session_id", "cell", "token", "value", "first_seq", "first_start"]
    wanted = cells.select("session_id", "cell", F.explode(_tokens_in(F.col("cell"))).alias("token"))
    found = cut_lineage(lookup_join(wanted, known, ["session_id", "token"], "inner").select(*columns))
    order = F.struct(
        (-F.length("token")).alias("size"), "first_seq", (-F.col("first_start")).alias("back"), "token", "value")
    while True:
        done = found.groupBy("session_id", "cell").agg(F.array_sort(F.collect_set(order)).alias("_given")).select(
            "session_id", "cell", _put_back(F.col("cell"), F.col("_given")).alias("_done"))
        more = done.where("size(_done.met) > 0").select(
            "session_id", "cell", F.explode(F.array_distinct("_done.met")).alias("token"))
        new = cut_lineage(
            lookup_join(more, known, ["session_id", "token"], "inner").select(*columns)
            .join(found, ["session_id", "cell", "token"], "left_anti").select(*columns))
        if new.isEmpty():
            break
        found = cut_lineage(found.unionByName(new))
    back = lookup_join(places, done, ["session_id", "cell"])
    piece = F.struct("pos", F.coalesce("_done.text", "cell").alias("text"), F.col("_done.used").alias("used"))
    per_doc = back.groupBy("session_id", "_row").agg(F.array_sort(F.collect_set(piece)).alias("_pieces"))
    joined = F.array_join(F.zip_with(
        F.split("text", TOKEN_RUN), F.transform("_pieces", lambda p: p["text"]),
        lambda gap, p: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(p, F.lit("")))), "")
    used = F.array_distinct(F.flatten(F.filter(F.transform("_pieces", lambda p: p["used"]), lambda u: u.isNotNull())))
    there = F.col("_pieces").isNotNull()
    restored = marked.join(per_doc, ["session_id", "_row"], "left").select(
        "session_id", "text_seq",
        F.when(there, joined).otherwise(F.col("text")).alias("restored_text"),
        F.when(there, F.size(used)).otherwise(0).cast("long").alias("restored_count"),
    )
    # Texts without anything like a token stay out of the shuffle.
    return restored.unionAll(docs.where(~holds).select(
        "session_id", "text_seq", F.col("text").alias("restored_text"),
        F.lit(0).cast("long").alias("restored_count"),
    ))
