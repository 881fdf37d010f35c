"""Mixing sources to target weights by Pfair scheduling, with built-in functions only.

Time is a row of slots, each for one block of documents. A source whose weight is w gets block i (from 0) no earlier than
slot floor(i / w) and before slot ceil((i + 1) / w); of the released blocks the one with the earliest deadline runs. This
keeps every source within less than one block of its share w * t at any slot t. Documents are numbered inside their source
from counts of salted buckets, so no source, however large, is ranked in one task.

Weights are fractions of whole numbers (`weight_parts`): exact where they are decimals of up to six places, and else
multiples of 2^-40, so that release times and deadlines do not drift from the weights over a table. Where a weight is zero or
under 1 / LONGEST of all, all are multiples of 1 / LONGEST. Which of these holds follows from the weights alone, whatever
the table's size. The schedule runs as far as the table's blocks need, or for one period of the weights, after which every
source has had exactly its parts and the schedule repeats.

The schedule is a fold over slots whose state is the next block of each source, made in stretches that start by themselves. At
any slot a source has had the floor or the ceiling of w * t blocks. Whichever sources are ahead, provided that they are those
of the earliest deadlines, all deadlines can still be met, and as soon as the blocks that were released before the start are
past their deadlines, the state is that of a schedule from slot 0: of the released blocks up to any one in the order of
deadlines, there are none left by its deadline, and how many there are afterwards follows from the releases. So a stretch
starts one longest window (1 / least weight) early and drops what it gives until its first slot.

When a source has no blocks left its slots stay empty and the others keep theirs: all rows are kept.

Defined cases: an empty table gives no rows and takes any weights; null is a source like any other; a source in the table
that has no part, or a weight of zero or less, gets one part, since its rows are kept; sources that are not in the table
take no part; rows equal in id stand in any order among themselves; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, quoted

#: Resolution of weights one of which is below it, or zero.
LONGEST = 1 << 18
#: Least slots of a stretch; it has as many at least as are dropped before it.
STRETCH = 1 << 13
#: Resolution of weights that are no decimals of PLACES places.
FINE, PLACES = 1 << 40, 6
#: Slots of a run of the fold.
RUN = 1024
#: Documents of a block.
BLOCK = 16
#: Rows that a bucket of the ranking holds on average.
BUCKET_ROWS = 2048


def _names(sources) -> list:
    return sorted(sources, key=lambda s: (s is None, str(s)))


def whole_parts(weights: Mapping[str | None, float], frame: int = LONGEST) -> dict[str | None, int]:
    """Weights as whole parts of `frame` by largest remainder; one part at least each, on top of the frame if need be.

    No positive weight at all means equal weights.
    """
    names = _names(weights)
    value = {s: max(float(weights[s]), 0.0) for s in names}
    total = sum(value.values())
    if not total > 0:
        return dict.fromkeys(names, 1)
    ideal = {s: value[s] / total * frame for s in names}
    parts = {s: int(ideal[s] + 1e-9) for s in names}
    for s in sorted(names, key=lambda s: (parts[s] - ideal[s], names.index(s)))[: max(0, frame - sum(parts.values()))]:
        parts[s] += 1
    return {s: max(1, p) for s, p in parts.items()}


def weight_parts(weights: Mapping[str | None, float], blocks: Mapping[str | None, int]) -> tuple[dict[str | None, int], int]:
    """(weights as whole parts of their sum, slots to schedule) for sources of so many blocks."""

    value = [max(float(w), 0.0) for w in weights.values()]
    total = sum(value)
    # by the weights alone: a rule that looked at `blocks` would give larger tables other shares
    frame = FINE if total > 0 and min(value) * LONGEST >= total else LONGEST
    for some in (10**k for k in range(PLACES + 1)):
        if total > 0 and all(abs(w / total * some - round(w / total * some)) < 1e-9 * some for w in value) and all(w > 0 for w in value):
            frame = some
            break
    parts = whole_parts(weights, frame)
    common = gcd(*parts.values()) if parts else 1
    parts = {s: p // common for s, p in parts.items()}
    size = sum(parts.values())
    # the deadline of each source's last block, or a whole period
    return parts, min(size, max((-(-blocks.get(s, 0) * size // p) for s, p in parts.items()), default=0))


def _divided(i: Column, a: Column | int, b: Column | int) -> tuple[Column, Column]:
    """i * a div b, and whether there is a remainder; products pass a long."""
    wide = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("decimal(19,0)")
    product = wide(i) * wide(a)
    return F.call_function("div", product, wide(b)), product % wide(b) > 0


def _places(spark: SparkSession, parts: Mapping[str | None, int], slots: int) -> DataFrame:
    """n (place of the source in `parts`), turn, place (all long) of each of the first `slots` slots."""
    size, count = sum(parts.values()), len(parts)
    p = F.array(*(F.lit(x).cast("long") for x in parts.values()))
    early = -(-size // min(parts.values()))
    stretch = max(STRETCH, early)
    long = lambda x: F.lit(x).cast("long")

    def once(value: Column, use) -> Column:
        """`use` of a value that is computed once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    # a source's next block i: its release r, and the quotient q and remainder m of (i + 1) * size by its parts
    def block(i: Column, r: Column, q: Column, m: Column) -> Column:
        return F.struct(i.alias("i"), r.alias("r"), q.alias("q"), m.alias("m"))

    def due(b: Column) -> Column:
        return b["q"] + (b["m"] > 0).cast("long")

    def following(b: Column, n: Column) -> Column:
        x = F.get(p, n)
        m, whole = b["m"] + long(size) % x, F.call_function("div", long(size), x)
        return block(b["i"] + 1, b["q"], b["q"] + whole + (m >= x).cast("long"), F.when(m >= x, m - x).otherwise(m))

    def begun(t: Column) -> Column:
        """The next blocks at slot t, where of the sources within a block those of the earliest deadlines are ahead."""

        def at(x: Column) -> Column:
            had, within = _divided(t, x, size)
            after, rest = _divided(had + 1, long(size), x)
            m = ((had + 1).cast("decimal(19,0)") * long(size).cast("decimal(19,0)") % x.cast("decimal(19,0)")).cast("long")
            return F.struct(had.alias("had"), within.alias("within"), block(had, _divided(had, long(size), x)[0], after, m).alias("b"))

        def ahead(all_: Column) -> Column:
            waiting = F.filter(F.transform(all_, lambda s, n: F.struct(s["within"].alias("w"), due(s["b"]).alias("d"), n.alias("n"))), lambda s: s["w"])
            many = (t - F.aggregate(all_, long(0), lambda z, s: z + s["had"])).cast("int")
            return once(F.transform(F.slice(F.sort_array(waiting), 1, many), lambda s: s["n"]), lambda done: F.transform(
                all_, lambda s, n: F.when(F.array_contains(done, n), following(s["b"], n)).otherwise(s["b"])))

        return once(F.transform(p, at), ahead)

    def step(state: Column, t: Column) -> Column:
        # the next block of each source; of those released the one with the earliest deadline
        ready = F.transform(state["next"], lambda b, n: F.when(b["r"] <= t, F.struct(due(b).alias("d"), n.alias("n"))))

        def taken(n: Column) -> Column:
            moved = F.transform(state["next"], lambda b, k: F.when(k == n, following(b, k)).otherwise(b))
            had = F.get(state["next"], n)["i"] * count + n
            return F.struct(moved.alias("next"), F.concat(state["order"], F.array(had)).alias("order"))

        return once(F.array_min(ready)["n"], taken)

    def run(state: Column, first: Column, until: Column) -> Column:
        start = F.struct(state["next"].alias("next"), F.array().cast("array<bigint>").alias("order"))
        done = F.aggregate(F.sequence(first, F.least(first + RUN, until) - 1), start, step)
        return once(done, lambda d: F.struct(d["next"].alias("next"), F.concat(state["order"], F.array(d["order"])).alias("order")))

    many = -(-slots // stretch)
    # a task per stretch, whose work its bytes do not tell
    rows = spark.range(0, many, 1, max(1, many)).select((F.col("id") * stretch).alias("first"))
    rows = rows.withColumns({"begin": F.greatest(long(0), F.col("first") - early), "until": F.least(F.col("first") + stretch, long(slots))})
    start = F.struct(begun(F.col("begin")).alias("next"), F.array().cast("array<array<bigint>>").alias("order"))
    runs = F.sequence(F.col("begin"), F.col("until") - 1, long(RUN))
    order = F.flatten(F.aggregate(runs, start, lambda state, at: run(state, at, F.col("until")), lambda s: s["order"]))
    placed = rows.select("first", "begin", F.posexplode(order).alias("at", "had"))
    placed = placed.withColumn("place", F.col("begin") + F.col("at")).filter(F.col("place") >= F.col("first"))
    return placed.select((F.col("had") % count).alias("n"), F.call_function("div", F.col("had"), long(count)).alias("turn"), "place")


def frame_table(spark: SparkSession, parts: Mapping[str | None, int], slots: int | None = None) -> DataFrame:
    """The schedule of the first `slots` slots (by default a period): source, turn (from 0), parts, release, deadline, place.

    Earliest deadline first over the released blocks; ties go to the earlier name.
    """
    if not parts:
        return spark.createDataFrame([], "source string, turn long, parts long, release long, deadline long, place long")
    size = sum(parts.values())
    rows = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(parts.items())], "n long, source string, p long")
    out = _places(spark, parts, size if slots is None else slots).join(F.broadcast(rows), "n")
    release, _ = _divided(F.col("turn"), size, F.col("p"))
    whole, rest = _divided(F.col("turn") + 1, size, F.col("p"))
    return out.select("source", "turn", F.col("p").alias("parts"), release.alias("release"), (whole + rest.cast("long")).alias("deadline"), "place")


def source_counts(docs: DataFrame, source_col: str = "source") -> dict[str | None, int]:
    """Rows of each source. One row per source reaches the driver."""
    return {r[0]: r[1] for r in docs.groupBy(quoted(source_col)).count().collect()}


def tempered_weights(docs: DataFrame, source_col: str = "source", power: float = 0.7) -> dict[str | None, float]:
    """Target weights in proportion to the power of each source's rows."""
    return {s: float(n) ** power for s, n in source_counts(docs, source_col).items()}


def ranked_weights(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> dict[str | None, float]:
    """Target weights that fall with the power of a source's rank by rows, the most rows first, ties by name."""
    sizes = source_counts(docs, source_col)
    order = sorted(_names(sizes), key=lambda s: -sizes[s])
    return {s: (k + 1) ** -power for k, s in enumerate(order)}


def mix_sources(
    docs: DataFrame, weights: Mapping[str | None, float], id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, frame: int | None = None
) -> DataFrame:
    """`docs` plus mix_turn (the row's number in its source), mix_block, mix_slot and mix_at, all long.

    `weights` are taken as weight_parts takes them, or rounded to whole parts of `frame`. mix_slot is the block's slot on the common time line and
    mix_at = mix_slot * block + place in the block is unique; sorting by it gives the mixture. Within a source rows are
    ordered by a hash of the id, then the id. Columns of the result names are replaced.
    """
    spark = docs.sparkSession
    made = ["mix_turn", "mix_block", "mix_slot", "mix_at"]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in made))
    bucket, mixed, local, src, o_src, o_bucket, before, taken = free(docs, "bucket", "mixed", "local", "src", "other_src", "other_bucket", "before", "taken")
    sizes = source_counts(docs, source_col)
    if not sizes:
        return docs.withColumns({c: F.lit(None).cast("long") for c in made})
    named = {s: weights.get(s, 0.0) for s in sizes}
    parts, slots = weight_parts(named, {s: -(-n // block) for s, n in sizes.items()}) if frame is None else (whole_parts(named, frame), None)
    size = sum(parts.values())
    slots = size if slots is None else slots

    # a source's place in `parts`, which unlike its name is never null
    order = list(parts)
    known = [x for n, s in enumerate(order) if s is not None for x in (F.lit(s), F.lit(n).cast("long"))]
    number = F.element_at(F.create_map(*known), quoted(source_col)) if known else F.lit(None).cast("long")
    if None in parts:
        number = F.when(quoted(source_col).isNull(), F.lit(order.index(None)).cast("long")).otherwise(number)
    # buckets: the top bits of the hash, so that bucket order is hash order; as many as the rows call for
    buckets = max(1, -(-sum(sizes.values()) // BUCKET_ROWS))
    hashed = F.xxhash64(quoted(id_col))
    place = F.floor((F.shiftrightunsigned(hashed, 32)) * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    rows = docs.withColumns({mixed: F.shiftrightunsigned(hashed, 1), bucket: place, src: number})
    counts = rows.groupBy(src, bucket).agg(F.count(F.lit(1)).alias("n"))
    # a row per source and BUCKET_ROWS rows: sums of sums, first inside runs of 1024 buckets, then over the runs
    run = F.floor(F.col(bucket) / 1024)
    inner = Window.partitionBy(src, run).orderBy(bucket)
    counts = counts.withColumn("inside", F.sum("n").over(inner) - F.col("n"))
    runs = counts.groupBy(F.col(src).alias("rs"), run.alias("run")).agg(F.sum("n").alias("rn"))
    runs = runs.withColumn("before", F.sum("rn").over(Window.partitionBy("rs").orderBy("run")) - F.col("rn"))
    offset = counts.join(runs, (F.col(src) == F.col("rs")) & (run == F.col("run"))).select(
        F.col(src).alias(o_src), F.col(bucket).alias(o_bucket), (F.col("inside") + F.col("before")).alias(before), F.col("n").alias("rows")
    )

    # the blocks of each bucket meet their slots, so that rows meet them by bucket and are not shuffled once more
    div = lambda x, y: F.call_function("div", x, y if isinstance(y, Column) else F.lit(y))
    own = F.get(F.array(*(F.lit(x).cast("long") for x in parts.values())), F.col(o_src).cast("int"))
    touched = F.explode(F.sequence(div(F.col(before), block), div(F.col(before) + F.col("rows") - 1, block))).alias("whole")
    wanted = offset.select(o_src, o_bucket, before, touched, own.alias("own"))
    plan = _places(spark, parts, slots)
    if slots == size:  # a period, whose length the weights bound; its slots may repeat many times
        plan = F.broadcast(plan)
    met = wanted.join(plan, (F.col(o_src) == F.col("n")) & (F.col("whole") % F.col("own") == F.col("turn")))
    slot = div(F.col("whole"), F.col("own")) * size + F.col("place")
    # a source's slots rise with its blocks
    met = met.groupBy(o_src, o_bucket).agg(F.min(before).alias(before), F.sort_array(F.collect_list(slot)).alias(taken))

    within = Window.partitionBy(src, bucket).orderBy(mixed, quoted(id_col))
    ranked = rows.withColumn(local, F.row_number().over(within).cast("long") - 1)
    timed = ranked.join(met, (F.col(src) == F.col(o_src)) & (F.col(bucket) == F.col(o_bucket))).withColumn("mix_turn", F.col(local) + F.col(before))
    timed = timed.withColumn("mix_block", div(F.col("mix_turn"), block))
    timed = timed.withColumn("mix_slot", F.get(taken, (F.col("mix_block") - div(F.col(before), block)).cast("int")))
    at = F.col("mix_slot") * block + F.col("mix_turn") % block
    return timed.withColumn("mix_at", at.cast("long")).select(*(quoted(c) for c in docs.columns), *made)
