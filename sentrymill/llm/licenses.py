"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, each brought to a plain form and looked up in a table of
known licence sentences. The identifiers found, in order of place, are matched against
ordered rules: a licence is stated where the identifiers of its rule follow each other,
others between them allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.functions.spans import _let

# Known sentences in plain form (a-z, 0-9, single spaces) with their identifiers.
# The wording of notices is set by the licences themselves.
SENTENCES = {
    "mit_release": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_grant_and_notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_licensed": "licensed under the apache license version 2 0",
    "apache_the_license": "licensed under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl3_licensed": "licensed under the gnu general public license version 3",
    "gpl_redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_no_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_4": "licensed under cc by 4 0",
    "cc_by_sa_4": "licensed under cc by sa 4 0",
    "gpl2_redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl21_redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl_no_warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3_redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd_neither": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2_subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "spdx_mit": "spdx license identifier mit",
    "spdx_apache": "spdx license identifier apache 2 0",
    "spdx_gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx_bsd2": "spdx license identifier bsd 2 clause",
    "spdx_bsd3": "spdx license identifier bsd 3 clause",
    "spdx_mpl2": "spdx license identifier mpl 2 0",
    "spdx_isc": "spdx license identifier isc",
}
# Two sentences that directly follow each other and count as one in the rules.
TOGETHER = {("bsd_binary", "bsd_neither"): "bsd_binary_and_neither"}
# Names in plain form that follow the opening of a notice, and the licences they stand for.
NAMES = {
    "mit license": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu general public license v3": "GPL-3.0",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license v2": "GPL-2.0",
    "gnu lesser general public license version 2 1": "LGPL-2.1",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "isc license": "ISC",
    "unlicense": "Unlicense",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
}
# (licence, sentence identifiers in order).
RULES = (
    ("MIT", ("mit_release",)),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant_and_notice", "as_is")),
    ("MIT", ("spdx_mit",)),
    ("Apache-2.0", ("apache_licensed",)),
    ("Apache-2.0", ("apache_the_license", "apache_comply", "apache_as_is", "apache_see")),
    ("Apache-2.0", ("spdx_apache",)),
    ("GPL-3.0", ("gpl3_work",)),
    ("GPL-3.0", ("gpl3_licensed",)),
    ("GPL-3.0", ("gpl_redistribute", "gpl_no_warranty")),
    ("GPL-3.0", ("spdx_gpl3",)),
    ("GPL-2.0", ("gpl2_redistribute", "gpl_no_warranty")),
    ("LGPL-2.1", ("lgpl21_redistribute", "lgpl_no_warranty")),
    ("LGPL-3.0", ("lgpl3_redistribute", "gpl_no_warranty")),
    ("AGPL-3.0", ("agpl3_redistribute", "gpl_no_warranty")),
    ("MPL-2.0", ("mpl2_subject",)),
    ("MPL-2.0", ("spdx_mpl2",)),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("ISC", ("spdx_isc",)),
    ("Unlicense", ("unlicense_free",)),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-2-Clause", ("spdx_bsd2",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary_and_neither")),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",)),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4",)),
) + tuple((licence, (f"notice {name}",)) for name, licence in NAMES.items())
# A notice: an opening and a name, whatever the sentence goes on with.
NOTICE = (r"^(this [a-z0-9]+ is )?(licensed|released|distributed|provided|made available|available) under (the )?"
          r"(terms of the )?(" + "|".join(sorted(NAMES, key=len, reverse=True)) + ")( |$)")
NAME_GROUP = 5
# Every known sentence holds one of these, so a text without any holds no known sentence.
STEMS = ("licens", "permission", "redistribut", "warrant", "unencumbered", "cc by", "cc-by")
BREAK = r"([.!?;:])[\x20\x09-\x0D]+"
_MOST_WORDS = max(len(s.split()) for s in SENTENCES.values())
_MOST_CHARS = max(map(len, SENTENCES.values()))
# A piece that a known sentence can begin with: its first word, alone or with its second;
# or a notice.
_BEGINNINGS = [s.split()[:2] for s in SENTENCES.values()] + [
    [w, "under"] for w in ("licensed", "released", "distributed", "provided", "available")] + [["made", "available"]]
_OPENING = r"^(this( [a-z0-9]+( is( |$)|$)|$)|" + "|".join(sorted({f"{a}( {b}( |$)|$)" for a, b in _BEGINNINGS})) + ")"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _has_stem(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER).rlike("|".join(STEMS))


def plain(c: Column) -> Column:
    """Lower-case a-z and digits, anything else one space."""
    return F.trim(F.regexp_replace(F.translate(c, UPPER, LOWER), "[^a-z0-9]+", " "))


def _found(pieces: Column, first: Column) -> Column:
    """The known sentences that begin with piece `first` (its place) and end with it or a
    later one, however many pieces that takes; where there is none, a notice.

    A piece has one word at least, so as many pieces as the longest sentence has words are
    enough. A piece longer than every sentence ends in none: its head stands for it.
    """
    near = F.transform(F.slice(pieces, first + 1, F.lit(_MOST_WORDS)), lambda p: F.substring(p, 1, _MOST_CHARS + 1))

    def begun(marked: Column) -> Column:
        flat = F.translate(marked, "\n", " ")
        known = F.array_compact(F.array(*[
            F.when(F.startswith(flat, F.lit(s + " ")) & (F.substring(marked, len(s) + 1, 1) == "\n"),
                   F.struct(first.alias("pos"), F.lit(i).alias("id")))
            for i, s in SENTENCES.items()]))
        name = F.concat(F.lit("notice "), F.regexp_extract(flat, NOTICE, NAME_GROUP))
        return _let(known, lambda k: F.when((F.size(k) == 0) & flat.rlike(NOTICE), F.array(
            F.struct(first.alias("pos"), name.alias("id")))).otherwise(k))

    return _let(F.concat(F.array_join(near, "\n"), F.lit("\n")), begun)


def sentences(docs: DataFrame) -> DataFrame:
    """Rows with known sentences: `doc_id` and `known`, their places and identifiers.

    A text is cut at line feeds and after `. ! ? ; :` before a space. A full stop inside
    a version number is no end, as no space follows it. Pieces that are one known sentence
    only together (a notice wrapped over lines) count joined, however many they are. A
    notice ("This file is released under the MIT License, see ...") need only open a sentence.
    """
    cut = F.split(F.regexp_replace("text", BREAK, "$1\n"), "\n")
    pieces = F.filter(F.transform(cut, plain), lambda p: p != "")

    def known(held: Column) -> Column:
        at = F.transform(held, lambda p, i: F.when(p.rlike(_OPENING), i))
        return F.flatten(F.transform(F.array_compact(at), lambda i: _found(held, i)))

    # A filter on the result is moved ahead of the projection with all that it names, so
    # the pieces are bound to a variable: else they would be cut anew for every piece.
    return docs.where(_has_stem(F.col("text"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), _let(pieces, known).alias("known"))


def recognise(docs: DataFrame) -> DataFrame:
    """One row for each document and licence stated in it: `doc_id`, `licence`,
    `n_sentences` (known sentences in the text), `first_pos` (place of the first known
    sentence among the text's), `sequence` (their identifiers in order).

    Null and empty texts state nothing. Repeated rows give repeated rows; texts with one
    doc_id are recognised each by itself; a null doc_id is kept. Extra columns are
    ignored. Several licences in one text give a row each. Nothing runs when called.
    """
    rules = F.array(*[
        F.struct(F.lit(name).alias("licence"),
                 F.lit("(^|.*,)" + ",(.*,)?".join(wanted) + "(,.*|$)").alias("pattern"))
        for name, wanted in RULES])
    ordered = sentences(docs).withColumn("known", F.array_sort("known"))
    found = ordered.select(
        "doc_id", F.size("known").cast("long").alias("n_sentences"),
        F.get("known", F.lit(0))["pos"].cast("long").alias("first_pos"),
        F.array_join(F.transform("known", lambda s: s["id"]), ",").alias("sequence"))
    joined = F.col("sequence")
    for two, one in TOGETHER.items():
        joined = F.replace(joined, F.lit(",".join(two)), F.lit(one))
    stated = _let(joined, lambda held: F.array_distinct(F.transform(
        F.filter(rules, lambda r: F.rlike(held, r["pattern"])), lambda r: r["licence"])))
    return found.select("doc_id", F.explode(stated).alias("licence"), "n_sentences", "first_pos", "sequence")
