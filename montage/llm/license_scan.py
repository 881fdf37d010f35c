"""License scans: base phrases by word place, and an exact set-similarity join of text blocks with license templates.

Words are runs of digits, ASCII letters (A-Z in lower case) and all non-ASCII characters. Each template belongs to the
smallest length class that holds its words; the blocks of class L are the windows of 2 * L words that start at every
L-th word of a text, across its lines, so that any passage of up to L + 1 words stands whole in one of them. A template
is found in every block of its class that holds at least `threshold` of the template's distinct words; the names of
licenses, a few common words each, are found only where these stand one after the other (`exact`). What is found is
reported; telling phrases, the words that set a template apart from its relatives, choose between the templates of one
block: those whose phrases all stand there give the labels, and where none's do, those that the block holds most of. The
join is exact:

1. one pass over each text counts its words and keeps the template words that it holds; only texts that hold enough
   words of some template keep the places of these words (length filter);
2. template words get a global order by the documents that hold them, rarest first (a count over all documents);
3. a template of n words that needs m of them must share one of its n - m + 1 rarest with a block (prefix filter);
4. a block must hold m template words, and at a shared word at place j of its own ordered words at least m must remain
   in both (length and positional filters);
5. pairs that are left are verified by the size of the intersection, those of names by their phrase too.

Built-in functions only. The template index is broadcast: its size is that of the list of templates. What the first pass
finds is written once, without texts; matches are aggregated per document before they join it.

Defined cases: null text is empty (no words, no labels, score 0); rows equal in id and text get equal results; a text of
any length is cut into blocks of bounded size; other columns do no harm, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, as_text, ascii_lower, quoted, settle

#: A word of a text in its own case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
THRESHOLD = 0.85
#: Words of the longest template of each length class.
CLASSES = (8, 16, 32, 64)


@dataclass(frozen=True)
class Template:
    """`telling` phrases tell it from its relatives, not counting places where one of `unless` continues them; `exact` needs them."""

    text: str
    label: str
    telling: tuple[str, ...]
    unless: tuple[str, ...] = ()
    exact: bool = False


def name(text: str, label: str, *unless: str) -> Template:
    """The name of a license: found where its words stand one after the other."""
    return Template(text, label, (text,), unless, True)


# Usual wordings of license notices and grants, names and identifiers, and whole texts.
TEMPLATES = (
    Template("released under the mit license", "mit", ("mit license",)),
    Template("licensed under the mit license", "mit", ("mit license",)),
    Template(
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "mit", ("permission is hereby granted", "free of charge"),
    ),
    Template("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", ("with or without fee is hereby granted",)),
    Template("licensed under the apache license version 2 0", "apache-2", ("apache license version 2 0",)),
    Template("licensed under the apache license version 1 1", "apache-1.1", ("apache license version 1 1",)),
    Template(
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "apache-2", ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template("licensed under cc by 4 0", "cc-by", ("cc by",), ("nc", "sa", "nd")),
    Template("licensed under cc by sa 4 0", "cc-by-sa", ("cc by sa",)),
    Template("licensed under cc by nd 4 0", "cc-by-nd", ("cc by nd",)),
    Template("licensed under cc by nc 4 0", "cc-by-nc", ("cc by nc",), ("sa", "nd")),
    Template("licensed under cc by nc sa 4 0", "cc-by-nc-sa", ("cc by nc sa",)),
    Template("licensed under cc by nc nd 4 0", "cc-by-nc-nd", ("cc by nc nd",)),
    Template("this work is licensed under the gnu general public license version 2", "gpl-2", ("gnu general public license version 2",)),
    Template("this work is licensed under the gnu general public license version 3", "gpl-3", ("gnu general public license version 3",)),
    Template("gnu general public license version 3", "gpl-3", ("gnu general public license version 3",)),
    Template("gnu lesser general public license version 2 1", "lgpl-2.1", ("gnu lesser general public license version 2 1",)),
    Template("gnu lesser general public license version 3", "lgpl-3", ("gnu lesser general public license version 3",)),
    Template("gnu affero general public license version 3", "agpl-3", ("gnu affero general public license version 3",)),
    Template(
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "gpl", ("gnu general public license as published by the free software foundation",),
    ),
    Template(
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "bsd", ("redistribution and use in source and binary forms",),
    ),
    Template("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", ("mozilla public license v 2 0",)),
    Template("this is free and unencumbered software released into the public domain", "unlicense", ("unencumbered software released into the public domain",)),
    # names
    name("the mit license", "mit"), name("mit license", "mit"), name("apache license 2 0", "apache-2"), name("apache license version 2 0", "apache-2"),
    name("gnu general public license v2 0", "gpl-2"), name("gnu general public license v3 0", "gpl-3"), name("gnu general public license v3", "gpl-3"),
    name("gnu lesser general public license v2 1", "lgpl-2.1"), name("gnu lesser general public license v3 0", "lgpl-3"), name("gnu affero general public license v3 0", "agpl-3"),
    name("cc0 1 0", "cc0"), name("creative commons zero v1 0", "cc0"), name("creative commons attribution 4 0", "cc-by"), name("creative commons attribution sharealike 4 0", "cc-by-sa"),
    name("creative commons attribution noderivatives 4 0", "cc-by-nd"), name("creative commons attribution noncommercial 4 0", "cc-by-nc"),
    name("creative commons attribution noncommercial sharealike 4 0", "cc-by-nc-sa"), name("creative commons attribution noncommercial noderivatives 4 0", "cc-by-nc-nd"),
    name("mozilla public license 2 0", "mpl-2"), name("bsd 2 clause license", "bsd"), name("bsd 3 clause license", "bsd"), name("isc license", "isc"), name("the unlicense", "unlicense"),
    # identifiers
    name("spdx license identifier mit", "mit"), name("spdx license identifier apache 2 0", "apache-2"), name("spdx license identifier gpl 2 0", "gpl-2"), name("spdx license identifier gpl 3 0", "gpl-3"),
    name("spdx license identifier lgpl 2 1", "lgpl-2.1"), name("spdx license identifier lgpl 3 0", "lgpl-3"), name("spdx license identifier agpl 3 0", "agpl-3"),
    name("spdx license identifier bsd 2 clause", "bsd"), name("spdx license identifier bsd 3 clause", "bsd"), name("spdx license identifier isc", "isc"), name("spdx license identifier mpl 2 0", "mpl-2"),
    name("spdx license identifier cc0 1 0", "cc0"), name("spdx license identifier unlicense", "unlicense"), name("spdx license identifier cc by 4 0", "cc-by"),
    name("spdx license identifier cc by sa 4 0", "cc-by-sa"), name("spdx license identifier cc by nc 4 0", "cc-by-nc"),
    # whole texts
    Template(
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no "
        "event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software",
        "mit", ("permission is hereby granted", "free of charge"),
    ),
    Template(
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in "
        "no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
        "contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc", ("with or without fee is hereby granted",),
    ),
    Template(
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the "
        "above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd", ("redistribution and use in source and binary forms",),
    ),
    Template(
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as "
        "a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense", ("unencumbered software released into the public domain",),
    ),
    Template(
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
        "licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2", ("apache license version 2 0", "except in compliance with the license"),
    ),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _places_of(v: Column, w: list[str], label: str) -> Column:
    where = F.when(F.size(v) >= len(w), F.sequence(F.lit(0), F.size(v) - len(w))).otherwise(F.array().cast("array<int>"))
    found = F.filter(where, lambda i: _all([F.get(v, i + k) == x for k, x in enumerate(w)]))
    return F.transform(found, lambda i: F.struct(i.alias("place"), F.lit(label).alias("label")))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def needed(n: int, threshold: float) -> int:
    """Template words that a block must hold."""
    return max(1, math.ceil(threshold * n - 1e-9))


def class_of(n: int) -> int:
    """The length class of a template of n words."""
    length = next((c for c in CLASSES if c >= n), CLASSES[-1])
    while length < n:
        length *= 2
    return length


@dataclass(frozen=True)
class _Form:
    """A template made ready: its distinct words, how many of them a block needs, its length class."""

    label: str
    words: tuple[str, ...]
    m: int
    length: int
    telling: tuple[str, ...]
    unless: str
    exact: bool


def forms(templates: Sequence[Template], threshold: float) -> list[_Form]:
    low = str.maketrans(UPPER, LOWER)
    out = []
    for t in templates:
        every = t.text.translate(low).split()
        if every:
            unless = "|".join(f" {p} {u} " for p in t.telling for u in t.unless)
            distinct = tuple(sorted(set(every)))
            out.append(_Form(t.label, distinct, needed(len(distinct), threshold), class_of(len(every)), tuple(f" {p} " for p in t.telling), unless, t.exact))
    return out


def _scanned(docs: DataFrame, phrases: Sequence[tuple[str, str]], made: list[_Form], id_col: str, text_col: str) -> DataFrame:
    """id, key (hash of the text), n_words, places of phrases, held (template words), spots (their places; null if too few)."""
    text = as_text(text_col)
    vocabulary = sorted({w for f in made for w in f.words})
    split = [(p.split(), label) for p, label in phrases]
    hint = "(?i)" + "|".join(NOT_WORD.join(w) for w, _ in split)
    known = F.array(*map(F.lit, vocabulary)).cast("array<string>")

    def enough(held: Column) -> Column:
        out = F.lit(False)
        for ws, m in {(f.words, f.m) for f in made}:
            out = out | (F.size(F.array_intersect(held, F.array(*map(F.lit, ws)))) >= m)
        return out

    def all_of(v: Column) -> Column:
        places = F.when(text.rlike(hint), F.concat(*(_places_of(v, w, label) for w, label in split)))
        return F.struct(F.size(v).cast("long").alias("n_words"), places.alias("places"), F.array_intersect(v, known).alias("held"), v.alias("v"))

    def spots(s: Column) -> Column:
        at = F.filter(F.transform(s["v"], lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains(known, x["w"]))
        return F.struct(s["n_words"].alias("n_words"), s["places"].alias("places"), s["held"].alias("held"), F.when(enough(s["held"]), at).alias("spots"))

    once = F.get(F.transform(F.transform(F.array(words(ascii_lower(text))), all_of), spots), F.lit(0))
    return docs.select(quoted(id_col).alias("id"), F.xxhash64(text).alias("key"), once.alias("s")).select("id", "key", "s.*")


def word_order(scanned: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Rank of each template word by the number of documents that hold it, rarest first, ties by the word.

    Every document counts. At most one row per template word reaches the driver.
    """
    seen = {r["w"]: r["n"] for r in scanned.select(F.explode("held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}


def template_blocks(scanned: DataFrame, made: list[_Form]) -> DataFrame:
    """Every (block, template) pair that is found: id, key, length (class), block, template, label, containment, told (its phrases stand)."""
    vocabulary = sorted({w for f in made for w in f.words})
    rank = word_order(scanned, vocabulary)
    index, full = [], []
    for t, f in enumerate(made):
        full.append((t, f.length, f.label, list(f.words), f.m, list(f.telling), f.unless, f.exact))
        index += [(w, f.length, t, p) for p, w in enumerate(sorted(f.words, key=rank.__getitem__)[: len(f.words) - f.m + 1])]
    spark = scanned.sparkSession
    prefix = F.broadcast(spark.createDataFrame(index, "word string, length int, template int, place int"))
    known = F.broadcast(spark.createDataFrame(full, "template int, of int, label string, template_words array<string>, m int, telling array<string>, unless string, exact boolean"))
    ranks = F.create_map(*(F.lit(x) for w, r in rank.items() for x in (w, r)))

    rows = scanned.filter(F.col("spots").isNotNull()).select("id", "key", "spots").dropDuplicates(["id", "key"])
    spots = rows.select("id", "key", F.explode("spots").alias("s")).select("id", "key", "s.i", "s.w", F.explode(F.array(*map(F.lit, sorted({f.length for f in made})))).alias("length"))
    own = F.floor(F.col("i") / F.col("length")).cast("int")
    spots = spots.withColumn("block", F.explode(F.when(own > 0, F.array(own, own - 1)).otherwise(F.array(own))))
    blocks = spots.groupBy("id", "key", "length", "block").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("s"))
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(F.transform("s", lambda x: x["w"])), lambda w: F.struct(F.element_at(ranks, w).alias("r"), w.alias("w")))), lambda x: x["w"])
    # the words in their own order; a bar where others stand between
    line = F.array_join(F.transform("s", lambda x, j: F.concat(F.when((j > 0) & (x["i"] != F.get(F.col("s"), j - 1)["i"] + 1), "| ").otherwise(""), x["w"])), " ")
    blocks = blocks.select("id", "key", "length", "block", ordered.alias("block_words"), F.concat(F.lit(" "), line, F.lit(" ")).alias("line"))
    shared = blocks.select("*", F.posexplode("block_words").alias("at", "word")).join(prefix, ["word", "length"]).join(known, "template")
    left = F.least(F.size("block_words") - F.col("at"), F.size("template_words") - F.col("place"))
    pairs = shared.filter((F.size("block_words") >= F.col("m")) & (left >= F.col("m")))
    # a pair is verified once, at its first shared word, where the positional filter holds for every true pair
    first = F.get(F.array_intersect("block_words", "template_words"), F.lit(0)) == F.col("word")
    overlap = F.size(F.array_intersect("block_words", "template_words"))
    plain = F.when(F.col("unless") == "", F.col("line")).otherwise(F.regexp_replace("line", F.col("unless"), F.lit(" | ")))
    tells = F.forall("telling", lambda p: F.contains(plain, p))
    found = pairs.filter(first & (overlap >= F.col("m"))).withColumn("told", tells).filter(F.col("told") | ~F.col("exact"))
    return found.select("id", "key", "length", "block", "template", "label", (overlap / F.size("template_words")).alias("containment"), "told")


def block_labels(found: DataFrame) -> DataFrame:
    """id, key, length, block, label, containment: of the templates found in a block those that name it.

    Those whose telling phrases stand there, or where there are none such, those with the largest containment.
    """
    rank = F.when(F.col("told"), 2.0).otherwise(F.col("containment"))
    best = found.groupBy("id", "key", "length", "block").agg(F.max(rank).alias("best"), F.collect_set(F.struct(rank.alias("rank"), "label", "containment")).alias("s"))
    return best.select("id", "key", "length", "block", F.explode(F.filter("s", lambda x: x["rank"] == F.col("best"))).alias("s")).select("id", "key", "length", "block", "s.label", "s.containment")


def license_scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[Template] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    n_base counts the phrase places, first_word and last_word are their smallest and largest word number. labels are
    those of phrases and blocks, distinct, sorted, joined by commas. score is 1 with a phrase, else the best
    containment of a template that names a block, else 0. n_blocks counts the blocks with a template.
    """
    made = forms(templates, threshold)
    scanned = settle(_scanned(docs, phrases, made, id_col, text_col))
    per = block_labels(template_blocks(scanned, made)).groupBy(F.col("id").alias("found_id"), F.col("key").alias("found_key")).agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"), F.count_distinct("length", "block").alias("n_blocks")
    )
    both = scanned.join(per, (F.col("key") == F.col("found_key")) & F.col("id").eqNullSafe(F.col("found_id")), "left")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    places = F.coalesce("places", F.array().cast("array<struct<place:int,label:string>>"))
    names = F.transform(places, lambda p: p["label"])
    spots = F.transform(places, lambda p: p["place"].cast("long"))
    return both.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(spots).alias("first_word"),
        F.array_max(spots).alias("last_word"),
        joined(names).alias("base_labels"),
        joined(F.concat(names, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )
