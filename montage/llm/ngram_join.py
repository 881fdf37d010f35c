"""Exact Jaccard join of texts on word shingles, over a matrix of tokens and groups of similar texts.

A text's set holds the hashes of its distinct shingles; texts with equal sets are one class, represented by the smallest
id. Two classes link when 100 * |A n B| >= 75 * |A u B|. The work is on classes, and the result is their components:

1. Profile. One pass gives each text its set's size and digest, a few minimum hashes, a parity bitmap, and the counts of
   the tokens in the first part of the set (a set whose tokens are in any fixed order must share one of its first
   n - ceil(0.75 n) + 1 tokens with every text it links to).
2. Groups. Classes are ordered by how common their minimum hashes are. Among the classes with a minimum hash in common the
   first is their lead; a class points to the leads it shares AGREE of them with. Following the pointers some steps gives
   its group. Pointers that are likely links are verified on whole texts, and following the verified ones gives a root:
   classes with one root are joined already and are not compared again, however many they are.
3. Matrix. Tokens get one global order: by hash, those that many texts share last. A row per token, group and band of set
   sizes stands for the union of the first tokens of the group's members.
4. Bound. Counting a text's first tokens in a group's row set bounds its overlap with every member; only groups that can
   still reach the threshold, and that hold a larger root, are opened: of two roots the smaller one's texts ask.
5. Opened groups are compared in blocks: sizes and the parity bitmaps (their Hamming distance never exceeds the size of
   the symmetric difference) leave few pairs. These are verified on whole sets: the best of each text and root first, the
   rest only where that did not join them. Components of the roots follow.

No link that joins two components is lost: the order may be any, the bounds are exact, and a pair is left out only if its
ends are joined already. Sets are compared by 64-bit hashes of shingles and digests.

The tokens put last are those that count over `COMMON` texts in step 1, at most `MOST_COMMON` of them (the most frequent)
so that their broadcast is bounded; beyond it the result stays exact and only the matrix grows. Token lists travel as
packed arrays in buckets whose number follows the input; common tokens, which may be in a third of all texts, travel in
separate, salted buckets. Blocks bound what a task holds of a group of any size.

Defined cases: null text or no words give an empty set, linked with nothing; rows without an id get no component; equal
ids with other texts are separate texts whose component is named by the id; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import build
from .common import as_text, quoted, settle, ship
from .components import components
from .textbytes import mix, shingles, spans, utf8, words

WIDTH = 5
#: Minimum hashes of a text, how many must agree for one text to point to another, and for the pair to be verified.
MINIMA, AGREE, LIKELY = 12, 2, 6
#: Steps along the pointers to leads.
STEPS = 3
#: Bits of the parity map of a set.
PARITY = 2048
#: Members and queries that a task compares at once.
MEMBERS, ASKING = 1024, 4096
#: Texts above which a token is put last, and the most tokens so treated.
COMMON, MOST_COMMON = 20, 250_000
#: Packed tokens that a task gathers before it hands them on.
HELD = 1 << 20
#: Top bit of the order: common tokens come last.
LAST = np.int64(1 << 62)
#: Low bits of a digest tell the band of the set's size; sets that link lie at most REACH bands apart.
BAND_BITS, BAND_BASE, REACH = 7, 1.15, 3
_SALTS = mix(np.arange(1, MINIMA + 3, dtype=np.uint64))


def first_part(n: int) -> int:
    """Tokens of a set of n that a link must touch."""
    return n - (3 * n + 3) // 4 + 1


def linked(both: int, n: int, m: int) -> bool:
    return 100 * both >= 75 * (n + m - both)


def token_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text: ascending 62-bit hashes."""
    data, offsets = utf8(column)
    for i, j in spans(offsets):
        h, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for s in shingles(h, at, WIDTH):
            yield (s >> np.uint64(2)).astype(np.int64)


def digest(s: np.ndarray) -> int:
    """57 bits of hash over the band of the size."""
    h = mix(s.astype(np.uint64) + _SALTS[-1]).sum(dtype=np.uint64, keepdims=True)
    h = mix((h * np.uint64(3)) ^ np.uint64(len(s))).astype(np.int64)
    band = min(2**BAND_BITS - 1, int(math.log(max(len(s), 1)) / math.log(BAND_BASE)))
    return int(h[0]) >> BAND_BITS << BAND_BITS | band


def minima(s: np.ndarray) -> list[int]:
    u = s.astype(np.uint64)
    return [int((mix(u ^ _SALTS[k]).min() >> np.uint64(1)).astype(np.int64)) for k in range(MINIMA)]


def parity(s: np.ndarray) -> bytes:
    """Bit k tells whether an odd number of the set's tokens falls on k."""
    place = (mix(s.astype(np.uint64) ^ _SALTS[MINIMA]) & np.uint64(PARITY - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=PARITY) & 1).astype(np.uint8)).tobytes()


_PROFILE = "id long, seal long, n long, digest long, minima array<long>, bits binary, bucket int, tokens binary, counts binary"


def _profiles(buckets: int):
    schema = pa.schema([("id", pa.int64()), ("seal", pa.int64()), ("n", pa.int64()), ("digest", pa.int64()), ("minima", pa.list_(pa.int64())), ("bits", pa.binary()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        rows = []
        for b, (t, c) in _dealt(tokens, counts.astype("<i4"), buckets):
            rows.append((None, None, None, None, None, None, b, t.astype("<i8").tobytes(), c.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for b in batches:
            n, marks, least, bits = [], [], [], []
            for s in token_sets(b.column(1)):
                n.append(len(s))
                marks.append(digest(s))
                least.append(minima(s) if len(s) else None)
                bits.append(parity(s))
                if len(s) and marks[-1] not in seen:
                    seen.add(marks[-1])
                    held.append(s[: first_part(len(s))])
                    size += len(held[-1])
                    if size >= HELD:
                        yield counted(held)
                        held, size, seen = [], 0, set()
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(marks, pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array(bits, pa.binary()), *none], schema=schema)
        if held:
            yield counted(held)

    return run


def _dealt(tokens: np.ndarray, other: np.ndarray, buckets: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows of each bucket, which is the token's remainder."""
    home = (tokens % buckets).astype(np.int32)
    order = np.argsort(home, kind="stable")
    ends = np.searchsorted(home[order], np.arange(buckets + 1))
    for b in range(buckets):
        if ends[b] < ends[b + 1]:
            own = order[ends[b] : ends[b + 1]]
            yield b, (tokens[own], other[own])


def common_tokens(profile: DataFrame) -> np.ndarray:
    """Ascending tokens that the first parts of over COMMON texts hold; the MOST_COMMON most frequent at most."""

    def total(table: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(table["tokens"].to_pylist()), "<i8")
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), "<i4")
        distinct, place = np.unique(tokens, return_inverse=True)
        sums = np.bincount(place, weights=counts).astype(np.int64)
        return pa.table({"token": distinct[sums > COMMON], "n": sums[sums > COMMON]})

    packed = profile.filter(F.col("bucket").isNotNull()).select("bucket", "tokens", "counts")
    found = packed.groupBy("bucket").applyInArrow(total, "token long, n long")
    return np.sort(np.array([r["token"] for r in found.orderBy(F.col("n").desc(), "token").limit(MOST_COMMON).select("token").collect()], dtype=np.int64))


def _matrix_tokens(common: np.ndarray, buckets: int):
    """(text) to packed first parts in the global order; negative buckets hold common tokens, salted by text."""
    schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("digests", pa.binary())])

    def packed(held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        tokens = np.concatenate([t for t, _ in held])
        marks = np.repeat(np.array([m for _, m in held], np.int64), [len(t) for t, _ in held])
        late = tokens >= LAST
        rows = [(b, t.astype("<i8").tobytes(), m.astype("<i8").tobytes()) for b, (t, m) in _dealt(tokens[~late], marks[~late], buckets)]
        rows += [(-1 - b, t.astype("<i8").tobytes(), m.astype("<i8").tobytes()) for b, (m, t) in _dealt(marks[late], tokens[late], buckets)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for b in batches:
            for s in token_sets(b.column(0)):
                if not len(s) or (mark := digest(s)) in seen:
                    continue
                seen.add(mark)
                part = s[: first_part(len(s))]
                if len(common) and _among(part, common).any():
                    late = _among(s, common)
                    part = np.concatenate((s[~late], s[late] | LAST))[: len(part)]
                held.append((part, mark))
                size += len(part)
                if size >= HELD:
                    yield packed(held)
                    held, size, seen = [], 0, set()
        if held:
            yield packed(held)

    return run


def _among(s: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, s)
    at[at == len(ordered)] = 0
    return ordered[at] == s


def _shared(table: pa.Table) -> pa.Table:
    """Rows (token, digest) of tokens that another digest holds whose size allows a link; common tokens are passed on."""
    if not table.num_rows:
        return pa.table({"token": pa.array([], pa.int64()), "digest": pa.array([], pa.int64())})
    t = np.frombuffer(b"".join(table["tokens"].to_pylist()), "<i8")
    m = np.frombuffer(b"".join(table["digests"].to_pylist()), "<i8")
    band = m & (2**BAND_BITS - 1)
    order = np.lexsort((m, band, t))
    t, m, band = t[order], m[order], band[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (m[1:] != m[:-1])
    t, m, band = t[new], m[new], band[new]
    if table["bucket"][0].as_py() < 0:
        return pa.table({"token": t, "digest": m})
    same = np.zeros(len(t), bool)
    same[1:] = (t[1:] == t[:-1]) & (band[1:] - band[:-1] <= REACH)
    same[:-1] |= same[1:]
    return pa.table({"token": t[same], "digest": m[same]})


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b), sorted by a, to the pairs (a, b) that link."""
    last_text, last_set = None, None
    for batch in batches:
        ok = []
        for i, other in enumerate(token_sets(batch.column(3))):
            text = batch.column(2)[i].as_py()
            if text != last_text:
                last_text, last_set = text, next(token_sets(batch.column(2).slice(i, 1)))
            ok.append(linked(int(_among(other, last_set).sum()) if len(last_set) else 0, len(last_set), len(other)))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def verify(pairs: DataFrame, source: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b: digests; at_a, at_b: id and seal of a text of each) whose whole sets link, settled.

    Only texts that a pair may name are shuffled, once each; `most` bounds the texts that are named.
    """
    bloom = build(pairs.select(F.explode(F.array("at_a.id", "at_b.id")).alias("id")), "id", most)
    some = bloom.maybe(source, F.col("id"), "maybe").filter("maybe")
    texts = some.groupBy("id", "seal").agg(F.first("text").alias("text"))
    b = texts.select(F.col("id").alias("id_b"), F.col("seal").alias("seal_b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("id").alias("id_a"), F.col("seal").alias("seal_a"), F.col("text").alias("text_a"))
    flat = pairs.select("a", "b", *(F.col(f"at_{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("id", "seal")))
    full = flat.join(b, ["id_b", "seal_b"]).join(a, ["id_a", "seal_a"]).select("a", "b", "text_a", "text_b")
    return settle(full.mapInArrow(_verified, "a long, b long"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles (long), component_id (smallest id reachable by links, itself included)."""
    ship(docs.sparkSession)
    source = docs.select(quoted(id_col).cast("long").alias("id"), as_text(text_col).alias("text")).withColumn("seal", F.xxhash64("text"))
    buckets = max(16, 2 * source.rdd.getNumPartitions())
    profile = settle(source.mapInArrow(_profiles(buckets), _PROFILE))
    rows = profile.filter(F.col("bucket").isNull()).select("id", "seal", "n", "digest", "minima", "bits")
    some = rows.filter((F.col("n") > 0) & F.col("id").isNotNull())
    at = F.min(F.struct("id", "seal")).alias("at")
    classes = settle(some.groupBy("digest").agg(at, *(F.first(c).alias(c) for c in ("n", "minima", "bits"))))
    most = classes.count()

    near = settle(_nearest(classes))
    likely = verify(near.filter(F.col("agree") >= LIKELY).select(F.col("lead").alias("a"), F.col("digest").alias("b"), F.col("lead_at").alias("at_a"), F.col("at").alias("at_b")), source, most)
    info = settle(_placed(classes, near, likely))
    packed = source.select("text").mapInArrow(_matrix_tokens(common_tokens(profile), buckets), "bucket int, tokens binary, digests binary")
    matrix = packed.groupBy("bucket").applyInArrow(_shared, "token long, digest long")
    pairs = settle(_opened(_bounded(matrix, info), info))

    root = info.select("digest", "root")
    links = _rooted(likely, root).union(_found(pairs, source, root, most)).filter("u <> v")
    joined = components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("vertex").alias("root"), "component")
    named = info.join(joined, "root", "left").select("digest", F.col("at.id").alias("rep"), F.coalesce("component", "root").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.join(least, "component").select("digest", "component_id")
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")))
    out = rows.select("id", "n", "digest").join(labels, "digest", "left")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _nearest(classes: DataFrame) -> DataFrame:
    """(digest, at, lead, lead_at, rank, agree) of classes that share AGREE minimum hashes with the lead of one of them.

    The order of leads is by falling sum of the logarithms of their minimum hashes' counts, then by digest: a text that
    others were made from comes before them. rank is the lead's place in it.
    """
    keys = classes.select("digest", "at", F.explode("minima").alias("m"))
    many = keys.groupBy("m").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    fame = F.sum(F.floor(16 * F.log2("many")))
    shared = keys.join(many, "m").groupBy("digest").agg((-fame).alias("rank"), F.first("at").alias("at"), F.collect_list("m").alias("ms"))
    shared = shared.select("digest", "at", "rank", F.explode("ms").alias("m"))
    first = shared.groupBy("m").agg(F.min(F.struct("rank", "digest", "at")).alias("first"))
    met = shared.drop("rank").join(first, "m").filter(F.col("digest") != F.col("first.digest"))
    met = met.select("digest", "at", F.col("first.digest").alias("lead"), F.col("first.at").alias("lead_at"), F.col("first.rank").alias("rank"))
    both = met.groupBy("digest", "lead").agg(F.first("at").alias("at"), F.first("lead_at").alias("lead_at"), F.first("rank").alias("rank"), F.count(F.lit(1)).alias("agree"))
    return both.filter(F.col("agree") >= AGREE)


def _placed(classes: DataFrame, near: DataFrame, likely: DataFrame) -> DataFrame:
    """(digest, at, n, bits, band, group, root) of every class.

    A root is named by the digest it ends at below the logarithm of its size, so that larger roots have larger names.
    """
    known = near.join(likely.distinct(), (F.col("digest") == F.col("b")) & (F.col("lead") == F.col("a")), "left")
    way = F.struct("rank", "lead")
    to = settle(known.groupBy("digest").agg(F.min(way)["lead"].alias("group"), F.min(F.when(F.col("a").isNotNull(), way))["lead"].alias("root")))
    placed = to
    for _ in range(STEPS - 1):
        for c in ("group", "root"):
            onward = to.select(F.col("digest").alias("from"), F.col(c).alias("onward"))
            placed = placed.join(onward, F.col(c) == F.col("from"), "left").withColumn(c, F.coalesce("onward", c)).drop("from", "onward")
    placed = settle(classes.select("digest", "at", "n", "bits").join(placed, "digest", "left").withColumns({c: F.coalesce(c, "digest") for c in ("group", "root")}))
    sizes = placed.groupBy("root").agg(F.floor(F.log2(F.count(F.lit(1)))).cast("long").alias("size"))
    name = F.call_function("shiftleft", F.col("size"), F.lit(57)).bitwiseOR(F.shiftrightunsigned("root", BAND_BITS))
    return placed.join(sizes, "root").select("digest", "at", "n", "bits", F.col("digest").bitwiseAND(F.lit(2**BAND_BITS - 1)).alias("band"), "group", name.alias("root"))


def _rest(n: str):
    """Tokens of a set of n that are not in its first part."""
    return F.floor((3 * F.col(n) + 3) / 4) - 1


def _bounded(matrix: DataFrame, info: DataFrame) -> DataFrame:
    """(q: digest, group, band) whose bound reaches the threshold."""
    cells = matrix.join(info.select("digest", "n", "group", "root", "band"), "digest")
    apart = cells.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("top")).filter("low < top").select("token", "top")
    cells = settle(cells.join(apart, "token"))
    union = cells.groupBy("token", "group", "band").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("root").alias("largest"))
    q = cells.filter("root < top").select("token", F.col("digest").alias("q"), F.col("n").alias("q_n"), F.col("root").alias("q_root"))
    met = q.join(union, "token").filter((F.col("largest") > F.col("q_root")) & (4 * F.col("most") >= 3 * F.col("q_n")) & (3 * F.col("least") <= 4 * F.col("q_n")))
    held = met.groupBy("q", "group", "band").agg(
        F.count(F.lit(1)).alias("s"), F.first("q_n").alias("q_n"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    reach = F.col("s") + F.greatest(_rest("q_n"), _rest("most"))
    return held.filter(7 * reach >= 3 * (F.col("q_n") + F.col("least"))).select("q", "group", "band")


def _opened(bounded: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs of opened groups that sizes and bitmaps leave: a and b (digests), at_a, at_b, u and v (their roots, u < v), and
    turn: the place of b among those of its root that a was met with, by rising Hamming distance.

    Members are dealt into blocks of MEMBERS and queries into blocks of ASKING on average, by hashes; each pair of
    blocks is one piece of work.
    """
    cell = ["group", "band"]
    asked = settle(bounded)
    many = asked.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("qs")).join(info.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("ms")), cell)
    own = ["digest", "at", "n", "bits", "root"]
    hashed = F.xxhash64("digest")
    members = info.join(many, cell).select(
        *cell, F.pmod(hashed, "ms").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)).alias("j"), *own
    )
    asking = asked.join(many, cell).join(info.select(*own), F.col("q") == F.col("digest")).select(
        *cell, F.explode(F.sequence(F.lit(0).cast("long"), F.col("ms") - 1)).alias("i"), F.pmod(hashed, "qs").alias("j"), *own
    )
    flat = [*cell, "i", "j", F.col("at.id").alias("id"), F.col("at.seal").alias("seal"), "digest", "n", "bits", "root"]
    keys = [*cell, "i", "j"]
    pairs = asking.select(*flat).groupBy(*keys).cogroup(members.select(*flat).groupBy(*keys)).applyInArrow(_compared, _COMPARED)
    # several groups may have met a pair
    pairs = pairs.groupBy("a", "b").agg(*(F.first(c).alias(c) for c in ("u", "v", "id_a", "seal_a", "id_b", "seal_b", "apart")))
    turn = F.row_number().over(Window.partitionBy("a", "v").orderBy("apart", "b"))
    at = {f"at_{x}": F.struct(F.col(f"id_{x}").alias("id"), F.col(f"seal_{x}").alias("seal")) for x in "ab"}
    return pairs.withColumns({"turn": turn, **at}).select("a", "b", "at_a", "at_b", "u", "v", "turn")


_COMPARED = "a long, b long, u long, v long, id_a long, seal_a long, id_b long, seal_b long, apart int"


def _compared(asking: pa.Table, members: pa.Table) -> pa.Table:
    def columns(t: pa.Table) -> list[np.ndarray]:
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(-1, PARITY // 64)
        return [*(t[c].to_numpy() for c in ("digest", "n", "root", "id", "seal")), bits]

    d, n, root, ids, seals, bits = columns(members)
    out = []
    for q, m, own, q_id, q_seal, mine in zip(*columns(asking), strict=True):
        fit = np.flatnonzero((root > own) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)))
        if len(fit):
            far = np.bitwise_count(bits[fit] ^ mine).sum(axis=1).astype(np.int64)
            # overlap <= (n + m - far) / 2, and 7 * overlap >= 3 * (n + m) is asked
            ok = 7 * (n[fit] + m - far) >= 6 * (n[fit] + m)
            fit, far = fit[ok], far[ok]
            same = np.ones(len(fit), np.int64)
            out.append((q * same, d[fit], own * same, root[fit], q_id * same, q_seal * same, ids[fit], seals[fit], far.astype(np.int32)))
    kinds = {c.split()[0]: np.int32 if c.endswith(" int") else np.int64 for c in _COMPARED.split(", ")}
    return pa.table({c: np.concatenate([o[i] for o in out] or [np.zeros(0, kind)]) for i, (c, kind) in enumerate(kinds.items())})


def _rooted(links: DataFrame, root: DataFrame) -> DataFrame:
    """(u, v): the roots of links (a, b)."""
    for x, r in (("a", "u"), ("b", "v")):
        links = links.join(root.select(F.col("digest").alias(x), F.col("root").alias(r)), x)
    return links.select("u", "v")


def _found(pairs: DataFrame, source: DataFrame, root: DataFrame, most: int) -> DataFrame:
    """(u, v) of the links among `pairs`: first the best of each text and root, then what these did not join."""
    best = _rooted(verify(pairs.filter("turn = 1"), source, 2 * most), root).distinct()
    if pairs.filter("turn > 1").isEmpty():
        return best
    best = settle(best)
    # a root points to the largest one it was joined with; two steps along the pointers show most of what is joined
    to = best.groupBy("u").agg(F.max("v").alias("next"))
    rest = pairs.filter("turn > 1")
    for c, end in (("u", "end_u"), ("v", "end_v")):
        for k in range(2):
            rest = rest.withColumn(end, F.col(c)) if k == 0 else rest
            step = to.select(F.col("u").alias("from"), "next")
            rest = rest.join(step, F.col(end) == F.col("from"), "left").withColumn(end, F.coalesce("next", end)).drop("from", "next")
    rest = settle(rest.filter("end_u <> end_v").select("a", "b", "at_a", "at_b"))
    return best if rest.isEmpty() else best.union(_rooted(verify(rest, source, 2 * most), root))
