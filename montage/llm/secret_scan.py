"""Secret scans: three base patterns, and a randomness test battery under length-aware false-discovery control.

Long runs of key-like characters with a digit and a letter are candidates. The encoding inferred from its characters
gives a candidate's alphabet; three tests ask whether it could be drawn evenly from that alphabet: chi-squared
uniformity, the runs test about the middle of the alphabet, and lag-one serial correlation. Fisher's method combines
their p-values; a small p says "not random". Candidates are split into classes of length; in each a Benjamini-Hochberg
step-up at the class's own rate rejects randomness, over all candidates of the corpus. What is not rejected is a span of
kind `random`. The step-up works on p rounded to a fixed grid of BINS steps in log p: counts per class and step, a few
thousand rows, are all that is gathered.

Places of matches come from running sums of the lengths of the matches and of the pieces between them. No match crosses a
line end. Candidates are written once with their tests, since the cut-offs and the spans both need them. All
expressions are built in; texts are not shuffled. Offsets are code points, ends exclusive.

Defined cases: null text is empty; equal rows get equal results; no candidates at all leave the base spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, quoted, settle

# The base patterns. Group 2 of an assignment has 12 characters at least.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
#: Greedy runs over one class: dropping short runs afterwards or asking for the length here is the same.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Alphabets of encodings, smallest first.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("upper_hex", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper_base36", r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[0-9A-Za-z+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[0-9A-Za-z_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
BINS, STEP = 4096, 0.01


@dataclass(frozen=True)
class LengthClass:
    """Candidates of `least` characters or more, up to the next class, share one step-up at false-discovery `rate`."""

    least: int
    rate: float


#: Short strings give the tests little power, so randomness is given up there more readily.
CLASSES = (LengthClass(20, 0.3), LengthClass(28, 0.15), LengthClass(40, 0.05), LengthClass(64, 0.05))


def running_sums(numbers: Column) -> Column:
    """Running sums of an array of int, by runs of some RUN numbers: inside each, and over their totals.

    A fold that lengthens an array copies it at each step; runs keep what is copied small.
    """
    run = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers))).cast("int"))
    none = F.array().cast("array<int>")

    def summed(v: Column) -> Column:
        return F.aggregate(v, F.struct(F.lit(0).alias("s"), none.alias("out")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"] + x)).alias("out")), lambda a: a["out"])

    def shifted(v: Column) -> Column:
        inside = F.transform(F.sequence(F.lit(0), F.floor((F.size(v["n"]) - 1) / v["run"]).cast("int")), lambda k: summed(F.slice(v["n"], k * v["run"] + 1, v["run"])))

        def add(r: Column) -> Column:
            totals = F.transform(F.array(summed(F.transform(r, lambda x: F.element_at(x, -1)))), lambda t: F.transform(r, lambda x, k: F.transform(x, lambda y: y + F.when(k > 0, F.get(t, k - 1)).otherwise(0))))
            return F.flatten(F.get(totals, F.lit(0)))

        return F.get(F.transform(F.array(inside), add), F.lit(0))

    bound = F.transform(F.array(F.struct(numbers.alias("n"), run.alias("run"))), shifted)
    return F.when(F.size(numbers) > 0, F.get(bound, F.lit(0))).otherwise(none)


def matches(text: Column, pattern: str, kind: int, guard: str | None = None) -> Column:
    """Array of (start, kind, end, piece) of the leftmost non-overlapping matches; texts without `guard` stop at once."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,piece:string>>")

    def places(v: Column) -> Column:
        ends = running_sums(F.zip_with(F.slice(v["gaps"], 1, F.size(v["found"])), v["found"], lambda g, m: F.length(g) + F.length(m)))
        return F.zip_with(v["found"], ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("piece")))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(guard or pattern), F.get(F.transform(F.array(pair), places), F.lit(0))).otherwise(none)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, kind, end) of the three base kinds."""
    assign = F.filter(matches(text, ASSIGN, 0), lambda m: F.length(F.regexp_extract(m["piece"], ASSIGN, 2)) >= ASSIGN_LEAST)
    every = F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2))
    return F.array_sort(F.transform(every, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic curve (within 2e-4)."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-300.0), F.least(F.lit(300.0), 1.5976 * z + 0.070565988 * z * z * z))))


def battery(pieces: DataFrame) -> DataFrame:
    """Adds encoding, chi2_p, runs_p, serial_p and p (Fisher's combination, 12 digits) for the string column `piece`."""
    name, alphabet = F.lit("mixed"), F.lit("-_+/=0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    for n, pattern, letters in reversed(ENCODINGS):
        fits = F.col("piece").rlike(pattern)
        name, alphabet = F.when(fits, n).otherwise(name), F.when(fits, letters).otherwise(alphabet)
    bare = F.when(F.col("encoding") == "mixed", F.col("piece")).otherwise(F.rtrim(F.col("piece"), F.lit("=")))
    df = pieces.withColumns({"encoding": name, "alphabet": alphabet}).withColumn("bare", bare)
    code = F.transform(F.sequence(F.lit(1), F.length("bare")), lambda i: (F.call_function("instr", F.col("alphabet"), F.substring(F.col("bare"), i, F.lit(1))) - 1).cast("double"))
    df = df.withColumns({"v": code, "n": F.length("bare").cast("double"), "a": F.length("alphabet").cast("double")})
    zero = F.lit(0.0)
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    square = total(F.transform(F.sequence(F.lit(1), F.length("alphabet")), lambda i: F.pow(F.length("bare") - F.length(F.replace(F.col("bare"), F.substring(F.col("alphabet"), i, F.lit(1)), F.lit(""))), F.lit(2.0))))
    high = total(F.transform("v", lambda x: F.when(x >= F.col("a") / 2, 1.0).otherwise(0.0)))
    turns = total(F.transform("v", lambda x, i: F.when((i > 0) & ((x >= F.col("a") / 2) != (F.get("v", i - 1) >= F.col("a") / 2)), 1.0).otherwise(0.0)))
    df = df.withColumns({"squares": square, "high": high, "runs": turns + 1, "mean": total(F.col("v")) / F.col("n")})
    spread = total(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean"))))
    lagged = total(F.transform("v", lambda x, i: F.when(i > 0, (x - F.col("mean")) * (F.get("v", i - 1) - F.col("mean"))).otherwise(0.0)))
    df = df.withColumns({"spread": spread, "lagged": lagged})

    n, a, k = F.col("n"), F.col("a"), F.col("a") - 1
    chi2 = F.greatest(zero, a / n * F.col("squares") - n)
    z1 = (F.pow(chi2 / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    both = 2 * F.col("high") * (n - F.col("high"))
    variance = both * (both - n) / (n * n * (n - 1))
    z2 = F.when(variance > 0, F.abs(F.col("runs") - both / n - 1) / F.sqrt(variance)).otherwise(9.0)
    z3 = F.when(F.col("spread") > 0, F.abs(F.col("lagged") / F.col("spread")) * F.sqrt(n)).otherwise(9.0)
    df = df.withColumns({"chi2_p": _tail(z1), "runs_p": F.least(F.lit(1.0), 2 * _tail(z2)), "serial_p": F.least(F.lit(1.0), 2 * _tail(z3))})
    half = -(F.ln(F.greatest("chi2_p", F.lit(1e-15))) + F.ln(F.greatest("runs_p", F.lit(1e-15))) + F.ln(F.greatest("serial_p", F.lit(1e-15))))
    p = F.round(F.exp(-half) * (1 + half + half * half / 2), 12)
    return df.withColumn("p", p).drop("alphabet", "bare", "v", "n", "a", "squares", "high", "runs", "mean", "spread", "lagged")


def _class() -> Column:
    out = F.lit(-1)
    for i, c in enumerate(CLASSES):
        out = F.when(F.length("piece") >= c.least, F.lit(i)).otherwise(out)
    return out


def _bin() -> Column:
    return F.least(F.lit(BINS - 1), F.floor(-F.ln(F.greatest("p", F.lit(1e-18))) / STEP)).cast("int")


def cut_offs(tested: DataFrame) -> dict[int, int]:
    """Per length class the smallest bin of -ln p at which randomness is rejected; missing where none is.

    Counts all rows of `tested` into at most BINS bins per class; one row per class reaches the driver.
    """
    counts = tested.groupBy(_class().alias("c"), _bin().alias("b")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("c").orderBy(F.col("b").desc())
    steps = counts.withColumns({"below": F.sum("n").over(down), "m": F.sum("n").over(Window.partitionBy("c"))})
    rate = F.element_at(F.array(*(F.lit(c.rate) for c in CLASSES)), F.col("c") + 1)
    met = steps.filter(F.exp(-F.col("b") * STEP) <= rate * F.col("below") / F.col("m"))
    return {r["c"]: r["b"] for r in met.groupBy("c").agg(F.min("b").alias("b")).collect()}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (hash of the text), start, end, piece and the battery's results of every candidate."""
    text = as_text(text_col)
    spots = docs.select(quoted(id_col).alias("id"), F.xxhash64(text).alias("key"), F.explode(matches(text, CANDIDATE, 3)).alias("m"))
    spots = spots.select("id", "key", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.piece").alias("piece"))
    return battery(spots.filter(F.col("piece").rlike("[0-9]") & F.col("piece").rlike("[A-Za-z]")))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, n_random (long), base_spans and spans.

    Spans are arrays of (start, kind, end) sorted by start, then kind in the order of KINDS; base_spans leave out
    `random`.
    """
    text = as_text(text_col)
    tested = settle(candidates(docs, id_col, text_col))
    limits = cut_offs(tested)
    cut = F.lit(BINS)
    for c, b in limits.items():
        cut = F.when(_class() == c, F.lit(b)).otherwise(cut)
    random = tested.filter(_bin() < cut).groupBy(F.col("id").alias("random_id"), F.col("key").alias("random_key"))
    random = random.agg(F.collect_set(F.struct("start", F.lit(3).alias("kind"), "end")).alias("random"))
    base = docs.select(quoted(id_col).alias("id"), F.xxhash64(text).alias("key"), base_spans(text).alias("base_spans"))
    both = base.join(random, (F.col("key") == F.col("random_key")) & F.col("id").eqNullSafe(F.col("random_id")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    more = F.coalesce("random", none)
    number = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return both.select(
        F.col("id").alias(id_col), number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.size(more).cast("long").alias("n_random"),
        "base_spans", F.array_sort(F.concat("base_spans", more)).alias("spans"),
    )


def spans_text(spans: str | Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
