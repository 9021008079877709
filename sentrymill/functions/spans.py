"""Finding pattern matches with their offsets inside Spark expressions.

A match is marked on both sides in one regexp_replace pass and the marked text is
split at the marks, which leaves gaps and matches in turn. Running lengths of the
pieces are the offsets. All of it is one row-local expression, so a corpus is
searched without a shuffle and without leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill.functions.text import strip

SPAN = "struct<start:int,end:int,entity_type:string,value:string,confidence:double,priority:int>"
SPANS = f"array<{SPAN}>"
_MARK = "\x01"


def no_spans() -> Column:
    return F.array().cast(SPANS)


FIELDS = [field.split(":")[0] for field in SPAN[len("struct<"):-1].split(",")]


def each(name: str, *fields: str) -> Column:
    """One row per span of the column `name`, with all or some of its fields. Of a bare column
    the optimizer would test the size below the search that fills it, which then ran twice."""
    return F.inline(F.transform(name, lambda s: F.struct(*[s[f].alias(f) for f in fields or FIELDS])))


def java_pattern(pattern: str, ignore_case: bool) -> str:
    """Java spelling with Unicode classes, as Python patterns on text have them."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


# Every match of these rules holds one of these words in some case.
_HAS_WORD = {
    "dob": ("dob", "birth", "born"), "mrn": ("mrn",),
    "patient": ("patient", "client", "subject", "admitted", "referred"),
}
# Every match of these rules holds one of these words as it stands.
_HOLDS = {
    "email": ("@",), "doctor": ("Dr",),
    "hospital": ("Hospital", "Medical", "Clinic", "Health", "Infirmary"),
}
_NEEDS_DIGIT = {"dob", "ssn", "mrn", "phone", "address", "date"}
# What a match of these rules begins with. Looked at first, it spares most positions the
# word boundary, which is dear with Unicode classes.
_BEGINS = {"ssn": r"\d", "mrn": "M", "hospital": "[A-Z]", "doctor": "D", "address": r"\d", "name_pair": "[A-Z]"}


def prepared(text: Column) -> dict[str, Column]:
    """What all rules need of a text, so that it is worked out once: `_clean`, the text
    without marks of its own (no pattern can match a mark or its stand-in, and neither
    counts as a word or a blank), `_lower` and `_digits`."""
    # the long s is an s to a pattern that ignores case, but has no other lower case
    plain = F.when(text.contains("\u017f"), F.translate(text, "\u017f", "s")).otherwise(text)
    return {
        "_clean": F.when(text.contains(_MARK), F.translate(text, _MARK, "\x02")).otherwise(text),
        "_lower": F.lower(plain), "_digits": text.rlike(r"(?U)\d"),
    }


def _worth_a_look(name: str, ready: dict[str, Column]) -> Column | None:
    """A cheap test that every match of the rule passes. It lets the expression skip
    the pattern on texts that cannot match."""
    tests = [ready["_digits"]] if name in _NEEDS_DIGIT else []
    for words, text in ((_HAS_WORD, "_lower"), (_HOLDS, "_clean")):
        if name in words:
            tests.append(reduce(or_, [ready[text].contains(word) for word in words[name]]))
    return reduce(and_, tests) if tests else None


_BLOCK = 128


def _let(value: Column, body) -> Column:
    """`body` of `value`, with `value` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _block(b: Column, n: Column) -> Column:
    """The item numbers of block b."""
    return F.sequence(b * _BLOCK, F.least(b * _BLOCK + _BLOCK, n) - 1)


def _running(n: Column, part, combine, visit) -> Column:
    """Flat array of what `visit(numbers, before)` gives for each block of n items, where
    `before` combines the `part(numbers)` of all blocks ahead.

    Adding to an array copies it, so one fold that collects over a whole text would cost
    the square of its matches. Collecting per block keeps long texts linear.
    """
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))
    parts = F.transform(blocks, lambda b: part(_block(b, n)))
    befores = F.aggregate(
        parts, F.expr("named_struct('at', 0, 'all', CAST(array() AS array<int>))"),
        lambda acc, one: F.named_struct(
            F.lit("at"), combine(acc["at"], one), F.lit("all"), F.concat(acc["all"], F.array(acc["at"]))
        ),
        lambda acc: acc["all"],
    )
    return F.flatten(F.transform(befores, lambda before, b: visit(_block(b, n), before)))


def _look(rule: tuple, priority: int, ready: dict[str, Column], strict: bool) -> Column:
    """A rule with the pieces `cut` its matches leave of a text: odd pieces are the matches,
    each less its lead-in. Null without a match."""
    name, entity, confidence, ignore_case, lead, body = rule
    clean = ready["_clean"]
    inner = f"(?-i:{body})" if lead and strict else body
    ahead = f"(?={_BEGINS[name]})" if name in _BEGINS else ""
    # The search itself needs no group, which is faster; only a lead-in has to be kept
    # apart from its span when marking.
    regex = java_pattern(ahead + lead + inner, ignore_case)
    if lead:
        marker, marked = java_pattern(f"{ahead}({lead})({inner})", ignore_case), f"$1{_MARK}$2{_MARK}"
    else:
        marker, marked = regex, f"{_MARK}$0{_MARK}"
    # Most texts hold no match; for them one search is all that runs.
    gate = _worth_a_look(name, ready)
    found = clean.rlike(regex) if gate is None else gate & clean.rlike(regex)
    return F.struct(
        F.when(found, F.split(F.regexp_replace(clean, F.lit(marker), F.lit(marked)), _MARK)).alias("cut"),
        F.lit(entity).alias("entity_type"), F.lit(confidence).alias("confidence"), F.lit(priority).alias("priority"),
    )


def _located(look: Column) -> Column:
    """Spans of one look in text order."""
    def size(i: Column) -> Column:
        return F.length(F.get(look["cut"], i))

    # seen.at is the offset of the piece
    def step(seen: Column, i: Column) -> Column:
        here = F.struct(
            seen["at"].alias("start"), (seen["at"] + size(i)).alias("end"), look["entity_type"].alias("entity_type"),
            strip(F.get(look["cut"], i)).alias("value"), look["confidence"].alias("confidence"),
            look["priority"].alias("priority"),
        )
        return F.named_struct(
            F.lit("at"), seen["at"] + size(i),
            F.lit("found"), F.when(i % 2 == 1, F.concat(seen["found"], F.array(here)))
            .otherwise(seen["found"]).cast(SPANS),
        )

    return _running(
        F.size(look["cut"]),
        lambda numbers: F.aggregate(numbers, F.lit(0), lambda total, i: total + size(i)),
        lambda a, b: a + b,
        lambda numbers, before: F.aggregate(
            numbers, F.named_struct(F.lit("at"), before, F.lit("found"), no_spans()), step,
            lambda seen: seen["found"],
        ),
    )


def _real(span: Column) -> Column:
    """Whether a match is more than its pattern's look: digits enough, or no known heading."""
    digits = F.length(F.regexp_replace(span["value"], r"(?U)\D", ""))
    return F.when(span["priority"] == _PRIORITY["phone"], digits >= D.PHONE_DIGITS).when(
        span["priority"] == _PRIORITY["name_pair"], ~span["value"].isin(D.NOT_NAMES)).otherwise(True)


_PRIORITY = {rule[0]: i + 1 for i, rule in enumerate(D.PHI_RULES)}


def candidates(ready: dict[str, Column], rules: list[str] | None = None, strict: bool = False) -> Column:
    """The spans of all rules, or of the named ones, in order of rule and place. `ready` is
    prepared(), best as columns. `strict` keeps ignore-case to the lead-in, so a name needs
    its capitals.
    """
    looks = F.array(*[
        _look(rule, _PRIORITY[rule[0]], ready, strict) for rule in D.PHI_RULES if rules is None or rule[0] in rules
    ])
    found = F.filter(looks, lambda look: look["cut"].isNotNull())
    return F.filter(F.flatten(F.transform(found, _located)), _real)


def _settle(cluster: Column) -> Column:
    """Keep a span of a few when no kept span of an earlier rule overlaps it."""
    by_rule = F.array_sort(cluster, lambda a, b: a["priority"] - b["priority"])
    kept = F.aggregate(by_rule, no_spans(), lambda kept, s: F.when(
        F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept
    ).otherwise(F.concat(kept, F.array(s))))
    return F.when(F.size(cluster) < 2, cluster).otherwise(F.array_sort(kept))


def resolve(found: Column) -> Column:
    """Keep a span when no span of an earlier rule overlaps it; sort by start.

    In order of start the spans fall into clusters that do not touch each other: one
    begins where a span starts at or past the end of all before it. Each is settled by
    itself, so a long text costs no more per span than a short one. Spans of one rule
    never overlap.
    """
    def of(spans: Column) -> Column:
        def step(seen: Column, i: Column) -> Column:
            return F.named_struct(
                F.lit("reach"), F.greatest(seen["reach"], F.get(spans, i)["end"]),
                F.lit("firsts"), F.when(
                    F.get(spans, i)["start"] >= seen["reach"], F.concat(seen["firsts"], F.array(i))
                ).otherwise(seen["firsts"]),
            )

        firsts = _running(
            F.size(spans),
            lambda numbers: F.aggregate(
                numbers, F.lit(0), lambda most, i: F.greatest(most, F.get(spans, i)["end"])
            ),
            F.greatest,
            lambda numbers, before: F.aggregate(
                numbers, F.named_struct(
                    F.lit("reach"), before, F.lit("firsts"), F.array().cast("array<int>")
                ), step, lambda seen: seen["firsts"],
            ),
        )

        def clusters(starts: Column) -> Column:
            return F.flatten(F.transform(starts, lambda first, j: _let(
                F.transform(
                    F.sequence(first, F.coalesce(F.get(starts, j + 1), F.size(spans)) - 1),
                    lambda k: F.get(spans, k),
                ), _settle,
            )))

        return F.when(F.size(spans) < 2, spans).otherwise(_let(firsts, clusters))

    return F.coalesce(_let(F.array_sort(found), of), no_spans())


FEW_SPANS = 16   # up to here a substring of the whole text for each span is cheaper


def replace_spans(text: Column, spans: Column) -> Column:
    """`text` with each span (start, end, token), sorted by start, swapped for its token.

    A substring is counted off from the beginning of its text, so with many spans the text
    is split into characters once and the pieces are slices of that.
    """
    def pieces(cut: Callable[[Column, Column], Column]) -> Column:
        def piece(span: Column, i: Column) -> Column:
            at = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
            return F.concat(cut(at, span["start"] - at), span["token"])

        last = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(last, F.length(text)))

    many = _let(F.split(text, ""), lambda letters: pieces(
        lambda at, n: F.array_join(F.slice(letters, at + 1, n), "")))
    few = pieces(lambda at, n: F.substring(text, at + 1, n))
    return F.when(F.size(spans) > FEW_SPANS, many).otherwise(few)
