"""Exact dedup of arrivals against history, by a minimal perfect hash over the digests of historical texts.

A text's digest is the SHA-256 of its normalised form (blanks deleted). The distinct digests of history are dealt to
buckets by their first bytes. Every bucket gets a minimal perfect hash: levels of bit arrays, in which a digest rests at
the first level where no other digest of its bucket shares its place; its slot is the rank of that bit. Slots hold the
full digest, the number of rows with that text and a locator of the winner: the row to be kept.

Arrivals are first grouped by digest, with map-side combination, so that each distinct digest is looked up once. Any
digest finds some slot, so the slot's digest is compared byte for byte: members repeat historical texts and join their
slot, whose winner they may replace; nonmembers form groups of their own. Buckets hold some BUCKET_KEYS digests each,
whatever the number of copies. Groups meet their rows again by join_groups, so a text with very many copies is not dealt
to one task.

Of equal texts that with the most code points stays, then the one with the smallest id (null last), then one of them.
Defined cases: null text is empty, and empty texts equal each other; repeated rows are copies; with no history every
row is an arrival; empty tables give no rows; other columns are not read. Equal digests count as equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, join_groups, quoted, settle, ship

#: The six characters that do not count when texts are compared.
BLANKS = " \t\n\v\f\r"
#: Digests of a bucket, on average.
BUCKET_KEYS = 1 << 14
DIGEST = 32
#: Bits of a level per digest that has no place yet.
ROOM = 2
#: Levels of a hash; digests left over after them have the last slots and are searched.
LEVELS = 48
_U = np.uint64


def normalised(text: Column) -> Column:
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (binary), chars (code points of the original text), row (a number of its own) of every row; settled."""
    text = as_text(text_col)
    rows = docs.select(quoted(id_col).alias("id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.char_length(text).cast("long").alias("chars"))
    return settle(rows.withColumn("row", F.monotonically_increasing_id()))


def grouped(rows: DataFrame) -> DataFrame:
    """digest, n and the winner (lack, no_id, id, row) of rows made by `keyed`; lack is minus the code points."""
    best = F.min(F.struct((-F.col("chars")).alias("lack"), F.col("id").isNull().alias("no_id"), "id", "row"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).select("digest", "n", "best.*")


# ---- the hash of a bucket -------------------------------------------------------------------------------------------


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each digest (four 64-bit words) for a level; all words count."""
    h = np.full(len(words), (0x9E3779B97F4A7C15 * (level + 1)) % 2**64, _U)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * _U(0xFF51AFD7ED558CCD)
        h ^= h >> _U(32)
    return h


@dataclass(frozen=True)
class Levels:
    """Bit arrays of the levels, one after the other, and their sizes."""

    sizes: np.ndarray
    bits: np.ndarray

    def places(self, words: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 where it rests at no level. Of digests that are not members any slot may come out."""
        rank = np.cumsum(self.bits) - 1
        out, start, left = np.full(len(words), -1), 0, np.arange(len(words))
        for level, size in enumerate(self.sizes.tolist()):
            at = start + (_mixed(words[left], level) % _U(size)).astype(np.int64)
            found = self.bits[at] == 1
            out[left[found]] = rank[at[found]]
            left, start = left[~found], start + size
        return out


def build_levels(words: np.ndarray) -> tuple[Levels, np.ndarray]:
    """The hash of distinct digests and the digests' order by slot; those that rest nowhere come last."""
    sizes, bits, order, left = [], [], [], np.arange(len(words))
    while len(left) and len(sizes) < LEVELS:
        size = ROOM * len(left)
        at = (_mixed(words[left], len(sizes)) % _U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        rests = alone[at]
        order.append(left[rests][np.argsort(at[rests])])
        sizes.append(size)
        bits.append(alone.astype(np.uint8))
        left = left[~rests]
    return Levels(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint8)), np.concatenate([*order, left]).astype(np.int64)


def _bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Digests as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIGEST)


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8").reshape(len(digests), DIGEST // 8)


# ---- index and lookup -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class DigestIndex:
    """`table` has a row per bucket: sizes, bits, digests by slot, and lists of n, lack, no_id, id, row by slot."""

    table: DataFrame
    buckets: int

    def write(self, path: str) -> None:
        """Keep the index for later runs; `row` numbers of an earlier run are turned negative when it is read."""
        self.table.withColumn("buckets", F.lit(self.buckets)).write.parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> DigestIndex:
        table = spark.read.parquet(path)
        first = table.select("buckets").first()
        past = F.transform("row", lambda r: F.when(r < 0, r).otherwise(-1 - r))
        return DigestIndex(table.drop("buckets").withColumn("row", past), first["buckets"] if first else 1)


def _bucket(buckets: int) -> Column:
    """The digest's bucket, from its first seven bytes."""
    return (F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long") % buckets).cast("int")


LISTS = ("n", "lack", "no_id", "id", "row")


def index_of(groups: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DigestIndex:
    """The index of distinct digests, as `grouped` gives them. `groups` is read twice, so it should be settled."""
    buckets = max(1, -(-groups.count() // bucket_keys))
    id_type = groups.schema["id"].dataType
    kinds = {"n": T.LongType(), "lack": T.LongType(), "no_id": T.BooleanType(), "id": id_type, "row": T.LongType()}
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType()), T.StructField("digests", T.BinaryType())])
    for name in LISTS:
        schema.add(name, T.ArrayType(kinds[name]))

    def build(key: tuple, part: pa.Table) -> pa.Table:
        digests = _bytes(part["digest"])
        levels, order = build_levels(_words(digests))
        part = part.take(pa.array(order))
        row = {"bucket": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([levels.sizes]), "bits": [np.packbits(levels.bits).tobytes()], "digests": [digests[order].tobytes()]}
        lists = {name: pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), part[name].combine_chunks()) for name in LISTS}
        return pa.table(row | lists)

    ship(groups.sparkSession)
    return DigestIndex(groups.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, schema), buckets)


def looked_up(arrivals: DataFrame, index: DigestIndex) -> DataFrame:
    """The groups of history and arrivals together: digest, n, lack, no_id, id, row and member.

    `arrivals` are groups, one row per digest. member is true for slots that an arrival hit, false for groups of
    nonmembers, null for slots that none hit. A slot's winner gives way to a better one.
    """
    schema = T.StructType([*(arrivals.schema[c] for c in ("digest", *LISTS)), T.StructField("member", T.BooleanType())])

    def merge(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
        new = new.select(["digest", *LISTS]).combine_chunks()
        slots, hit, at = None, np.zeros(len(new), bool), np.zeros(len(new), np.int64)
        if len(old):
            row = old.slice(0, 1)
            digests = np.frombuffer(row["digests"][0].as_py(), np.uint8).reshape(-1, DIGEST)
            sizes = np.array(row["sizes"][0].as_py(), np.int64)
            levels = Levels(sizes, np.unpackbits(np.frombuffer(row["bits"][0].as_py(), np.uint8), count=int(sizes.sum())))
            held = pa.array([d.tobytes() for d in digests], pa.binary())
            slots = pa.table([held, *(row[name].combine_chunks().flatten().cast(new[name].type) for name in LISTS)], names=["digest", *LISTS])
            hit, at = member_slots(_bytes(new["digest"]), levels, digests)
        out = [new.filter(pa.array(~hit)).append_column("member", pa.array(np.zeros((~hit).sum(), bool)))]
        if slots is not None:
            out.append(_overtaken(slots, new.filter(pa.array(hit)), at[hit]))
        return pa.concat_tables([t.cast(pa.schema([(f.name, g.type) for f, g in zip(t.schema, out[0].schema, strict=True)])) for t in out])

    ship(arrivals.sparkSession)
    new = arrivals.withColumn("bucket", _bucket(index.buckets))
    return new.groupBy("bucket").cogroup(index.table.groupBy("bucket")).applyInArrow(merge, schema)


def member_slots(asked: np.ndarray, levels: Levels, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is a member, its slot) of each digest: its place by the hash, if the slot there holds the same bytes."""
    at = levels.places(_words(asked))
    rests = int(levels.bits.sum())
    spare = {d.tobytes(): rests + i for i, d in enumerate(digests[rests:])}
    if spare:
        for i in np.flatnonzero(at < 0):
            at[i] = spare.get(asked[i].tobytes(), -1)
    hit = at >= 0
    hit[hit] = (digests[at[hit]] == asked[hit]).all(axis=1)
    return hit, np.where(hit, at, 0)


def _overtaken(slots: pa.Table, new: pa.Table, at: np.ndarray) -> pa.Table:
    """Slots after the members among the arrivals: their rows added, the better winner kept, `member` true where one hit."""
    n = np.array(slots["n"], dtype=np.int64).copy()
    n[at] += np.array(new["n"], dtype=np.int64)
    take = np.arange(len(slots))
    order = [(np.array(t["lack"], dtype=np.int64), t["no_id"].to_pylist(), t["id"].to_pylist(), np.array(t["row"], dtype=np.int64)) for t in (slots, new)]
    for i, s in enumerate(at.tolist()):
        (a, b) = ((o[0][j], o[1][j], () if o[1][j] else (o[2][j],), o[3][j]) for o, j in zip(order, (s, i), strict=True))
        if b < a:
            take[s] = len(slots) + i
    every = pa.concat_tables([slots, new.cast(slots.schema)])
    best = every.take(pa.array(take))
    member: list[bool | None] = [None] * len(slots)
    for s in at.tolist():
        member[s] = True
    return best.set_column(0, "digest", slots["digest"]).set_column(1, "n", pa.array(n)).append_column("member", pa.array(member, pa.bool_()))


def _per_row(rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    won = groups.select("digest", F.col("n").alias("group_size"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.coalesce("member", F.lit(False)).alias("in_history"))
    met = join_groups(rows, won, "digest", "group_size")
    return met.select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history"
    )


def dedup_against(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DigestIndex]:
    """(the rows of `docs` judged, the index with them taken in).

    Columns: id, keep_id, group_size (history included), kept, text_sha256, in_history (an earlier run had that text).
    `index` is one read from disk or built of other rows, whose winners are none of `docs`.
    """
    rows = keyed(docs, id_col, text_col)
    after = settle(looked_up(settle(grouped(rows)), index))
    return _per_row(rows, after.filter(F.col("member").isNotNull()), id_col), index_of(after.drop("member"))


def exact_dedup(docs: DataFrame, historical: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` judged, with the rows where `historical` (a condition on the id) is true as history.

    Columns: id, keep_id, group_size, kept, text_sha256, in_history (history and arrivals both have the text).
    """
    rows = keyed(docs, id_col, text_col)
    past = F.coalesce(historical, F.lit(False)) if historical is not None else F.lit(False)
    history, arrivals = settle(grouped(rows.filter(past))), settle(grouped(rows.filter(~past)))
    return _per_row(rows, settle(looked_up(arrivals, index_of(history))), id_col)


def earlier_half(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """True for ids up to the middle of their range: the part of a table that was there first. Null ids are arrivals."""
    ends = docs.agg(F.min(quoted(id_col)).alias("a"), F.max(quoted(id_col)).alias("b")).first()
    return F.col("id") <= F.lit((ends["a"] + ends["b"]) // 2) if ends["a"] is not None else F.lit(False)
