"""Line dedup over overlapping three-line windows, with built-in functions only.

A line is a unit; one of many words is cut into several: from its LEAST-th word on a unit ends at the first word that ends
in one of CLOSERS, and after MOST words at the latest. The words decide, so that two texts with a passage in common soon
cut it alike wherever it begins. Units are compared trimmed, with white space collapsed and A-Z in lower case; blank
lines are passed over and always kept. Every run of three units is hashed (two hashes of the units' own, 96 bits together). Windows found
more than once have a first occurrence, the smallest (doc_id, text hash, unit); every later one covers its three units,
overlapping covers merge, and covered units go, a line with its last unit. Each removed unit has an equal one earlier in
that order, so no content is lost.

Shuffles: the hashes of the units are written once, a sixth of the text's size; first the 64-bit hashes of windows alone, counted with map-side combining, which gives the repeated ones; a blocked Bloom
filter of these (bloom.py) then lets few other windows through to the exact comparison, and the texts are shuffled once.
A window that a third of the documents share is combined before its shuffle, and its join is one Spark can split.

A repeated passage is found as far as it holds three whole units: cuts in two texts agree from the first closing word at
which both cut, so some words at either end may stay, and so may a short passage whose cuts meet too late.

Defined cases: null text stays null and empty text stays empty; a text of under three units has no window and is left
alone; rows equal in doc_id and text count as one occurrence and are treated alike; row order is not kept; other columns
are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import build
from .common import ascii_lower, as_text, free, quoted, settle

WINDOW = 3
#: Words that a unit holds before a closing word may end it, and at most.
LEAST, MOST = 6, 15
#: Last characters of closing words: punctuation and two frequent last letters, so that the cut after MOST words is rare.
CLOSERS = ".!?,;:enEN"
#: White space inside a line.
_GAP = r"[\x20\x09\x0B-\x0D]"
#: White space that is not one plain blank.
_UNEVEN = rf"[\x09\x0B-\x0D]{_GAP}*|\x20{_GAP}+"
_WORD = r"[^\x20\x09-\x0D]"
#: A unit with the white space about it; a blank line matches as a whole.
UNIT = rf"{_GAP}*(?:{_WORD}+{_GAP}+){{0,{LEAST - 1}}}(?:{_WORD}*[^\x20\x09-\x0D{CLOSERS}]{_GAP}+){{0,{MOST - LEAST}}}{_WORD}+{_GAP}*"
_ANY = rf"{UNIT}|^{_GAP}*$"
#: The same units over a whole text with even gaps; group 1 is the unit trimmed. Words are never given back in part.
_TRIMMED = rf"{_GAP}*+((?:{_WORD}++{_GAP}++){{0,{LEAST - 1}}}(?:{_WORD}++(?<![{CLOSERS}]){_GAP}++){{0,{MOST - LEAST}}}{_WORD}++)"


def _filled(text: Column) -> Column:
    """Array of the hashes of the units that have a word."""
    plain = F.regexp_replace(ascii_lower(text), _UNEVEN, " ")
    return F.transform(F.regexp_extract_all(plain, F.lit(_TRIMMED), F.lit(1)), lambda u: F.xxhash64(u))


def _windows(filled: Column, made) -> Column:
    """made(window, k) for each window of three, k being the place of its first unit among the filled ones."""
    some = lambda v: F.when(F.size(v) >= WINDOW, F.sequence(F.lit(0), F.size(v) - WINDOW))
    # transform over a one-element array binds the units once for all windows
    cut = F.get(F.transform(F.array(filled), lambda v: F.transform(some(v), lambda k: F.slice(v, k + 1, WINDOW))), F.lit(0))
    return F.transform(cut, made)


def _mark(window: Column, k: Column) -> Column:
    return F.xxhash64(window)


def _spot(window: Column, k: Column) -> Column:
    return F.struct(F.xxhash64(window).alias("w1"), F.hash(window).alias("w2"), k.alias("k"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """`docs` with later occurrences of repeated three-unit windows removed from the text.

    Same columns and rows; with `counts`, also n_lines and n_removed (units; both long).
    """
    key, gone, gone_id, row_id = free(docs, "key", "gone", "gone_id", "row_id")
    text = as_text(text_col)
    row_key = F.xxhash64(text)
    # written, so that every text is cut once; some 8 bytes a unit
    units = settle(docs.select(quoted(id_col).alias("id"), row_key.alias("key"), _filled(text).alias("filled")))
    marks = units.select(F.explode(_windows(F.col("filled"), _mark)).alias("w1")).groupBy("w1").agg(F.count(F.lit(1)).alias("n"))
    often = settle(marks.filter("n > 1").select("w1"))
    spots = units.select("id", "key", F.explode(_windows(F.col("filled"), _spot)).alias("w"))
    spots = build(often, "w1", often.count()).maybe(spots.select("id", "key", "w.w1", "w.w2", "w.k"), F.col("w1"), "maybe").filter("maybe").drop("maybe")
    at = F.struct("id", "key", "k")
    spots = settle(spots)
    repeated = spots.groupBy("w1", "w2").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter(F.col("first") != F.col("last"))
    # written, so that a window in very many texts is a large partition of a plain join, which Spark splits
    later = (
        spots.join(settle(repeated.select("w1", "w2", "first")), ["w1", "w2"])
        .filter(at != F.col("first"))
        .select("id", "key", F.explode(F.sequence("k", F.col("k") + WINDOW - 1)).alias("unit"))
    )
    covered = later.groupBy(F.col("id").alias(gone_id), F.col("key").alias(gone)).agg(F.collect_set("unit").alias(f"{gone}l"))

    joined = docs.withColumns({row_id: quoted(id_col), key: row_key})
    joined = joined.join(covered, (F.col(key) == F.col(gone)) & F.col(row_id).eqNullSafe(F.col(gone_id)), "left")
    cut = F.when(F.col(gone).isNull(), quoted(text_col)).otherwise(_without(text, F.col(f"{gone}l")))
    out = [cut.alias(text_col) if c == text_col else quoted(c) for c in docs.columns]
    if counts:
        lost = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(f"{gone}l"))
        out += [F.size(F.split(text, "\n")).cast("long").alias("n_lines"), lost.cast("long").alias("n_removed")]
    return joined.select(*out)


def _without(text: Column, gone: Column) -> Column:
    """The text without the filled units at the places `gone`; a hash-based difference of places keeps this linear."""
    placed = F.flatten(F.transform(F.split(text, "\n"), lambda line, i: F.transform(F.regexp_extract_all(line, F.lit(_ANY), F.lit(0)), lambda u: F.struct(u.alias("u"), i.alias("line")))))

    def joined(v: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(v) - 1)
        filled = F.transform(F.array(F.filter(every, lambda i: F.get(v, i)["u"].rlike(_WORD))), lambda f: F.transform(gone, lambda k: F.get(f, k)))
        left = F.array_except(every, F.get(filled, F.lit(0)))
        pieces = F.transform(F.array(left), lambda k: F.transform(k, lambda i, n: F.concat(F.when((n > 0) & (F.get(v, i)["line"] != F.get(v, F.get(k, n - 1))["line"]), "\n").otherwise(""), F.get(v, i)["u"])))
        return F.array_join(F.get(pieces, F.lit(0)), "")

    return F.get(F.transform(F.array(placed), joined), F.lit(0))
