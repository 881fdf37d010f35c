"""Vector code compression: a codebook per part of the vectors, learned by Lloyd rounds that filter with kd-trees.

Components become floor(4096 * x). Vectors are cut into PARTS equal consecutive parts, padded with zeros where their
length is no multiple of that. Every task packs the vectors of its partition into blocks and builds, per part, a kd-tree
over the block, level by level: nodes have their bounding box, the sum of their points and their number cached. The trees
are written once and serve every round.

A round walks a tree from the root with all entries as candidates. At a node the entry nearest to the box's middle is
kept; another one goes if no corner of the box is nearer to it, ties going to the lower index. A node with one candidate
left gives its whole subtree to that entry by its cached sum and number; at the leaves the rest is compared point by
point. So every part goes to its nearest entry, just as in a plain round. Tasks send sums and numbers per part and entry,
which are added up in whole numbers; new codebooks (PARTS x ENTRIES rows) pass through the driver.

Defined cases: vectors that are null or hold null or non-finite components are dropped; with fewer rows than ENTRIES the
codebooks have as many entries as rows; repeated rows are rows, null ids come last in the order of ids, and rows of one
id are ordered by their components; vectors of another length have codebooks of their own, per length; empty vectors have
parts of one zero; no vectors give no rows; other columns are not read. Components too large for exact 64-bit distances
are computed as whole numbers of any size; components, errors and sums beyond the range of long count as its ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import join_groups, quoted, settle, ship
from .topk_search import scaled

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block at most, and points of a leaf at most.
BLOCK_ROWS, LEAF = 4096, 16
#: Components below this give exact distances of parts of up to 2^10 components in 64-bit integers.
EXACT = 1 << 24
LONG = np.iinfo(np.int64)


def cut(vectors: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(part, row, component) of whole vectors, padded with zeros to equal parts."""
    rows, length = vectors.shape
    width = max(1, -(-length // parts))
    whole = np.zeros((rows, parts * width), vectors.dtype)
    whole[:, :length] = vectors
    return whole.reshape(rows, parts, width).transpose(1, 0, 2)


class Tree:
    """A kd-tree over the points of one part: points in leaf order, and per level the boxes, sums and numbers of its nodes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        self.order = np.arange(n)
        depth = 0
        while n >> depth > leaf:
            depth += 1
        #: Where each level's nodes start: a node has two children on the next level.
        self.starts = [np.zeros(1, np.int64)]
        for _ in range(depth):
            now = points[self.order]
            start = self.starts[-1]
            size = np.diff(np.append(start, n))
            low, high = np.minimum.reduceat(now, start), np.maximum.reduceat(now, start)
            widest = np.argmax(high - low, axis=1)
            node = np.repeat(np.arange(len(start)), size)
            along = now[np.arange(n), widest[node]]
            by_value = np.argsort(along, kind="stable")
            self.order = self.order[by_value[np.argsort(node[by_value], kind="stable")]]
            self.starts.append(np.stack((start, start + size // 2), axis=1).ravel())
        self.points = points[self.order]
        self.low = [np.minimum.reduceat(self.points, s) for s in self.starts]
        self.high = [np.maximum.reduceat(self.points, s) for s in self.starts]
        self.sums = [np.add.reduceat(self.points, s) for s in self.starts]
        self.sizes = [np.diff(np.append(s, n)) for s in self.starts]

    def walk(self, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, nodes, entry of each) of the subtrees that go to one entry as a whole; level -1 stands for single points."""
        node, asked = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        index = np.arange(len(entries))
        for level in range(len(self.starts)):
            low, high = self.low[level][node][:, None, :], self.high[level][node][:, None, :]
            best = np.where(asked, _square(2 * entries[None] - (low + high)), _infinite(self.points))
            best = best.argmin(axis=1)
            nearest = entries[best][:, None, :]
            corner = np.where(entries[None] > nearest, high, low)
            gain = _square(entries[None] - corner) - _square(nearest - corner)
            out = (gain > 0) | ((gain == 0) & (index[None] > best[:, None]))
            asked &= ~out
            whole = asked.sum(axis=1) == 1
            if whole.any():
                yield level, node[whole], best[whole]
            node, asked = node[~whole], asked[~whole]
            if level + 1 < len(self.starts):
                node = np.stack((2 * node, 2 * node + 1), axis=1).ravel()
                asked = np.repeat(asked, 2, axis=0)
        if len(node):
            start, size = self.starts[-1][node], self.sizes[-1][node]
            at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            yield -1, at, _square(self.points[at][:, None, :] - entries[None]).argmin(axis=1)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the points of each entry."""
        sums, counts = np.zeros((len(entries), self.points.shape[1]), self.points.dtype), np.zeros(len(entries), np.int64)
        for level, node, entry in self.walk(entries):
            np.add.at(sums, entry, self.points[node] if level < 0 else self.sums[level][node])
            np.add.at(counts, entry, 1 if level < 0 else self.sizes[level][node])
        return sums, counts

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The entry of each point, in the order in which the points were given."""
        out = np.zeros(len(self.points), np.int64)
        for level, node, entry in self.walk(entries):
            if level < 0:
                out[self.order[node]] = entry
                continue
            size = self.sizes[level][node]
            at = np.repeat(self.starts[level][node] - np.cumsum(size) + size, size) + np.arange(size.sum())
            out[self.order[at]] = np.repeat(entry, size)
        return out


def _square(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1)


def _infinite(points: np.ndarray) -> object:
    return float("inf") if points.dtype == object else LONG.max


def _kept(tree: Tree) -> dict[str, bytes]:
    """What the table of trees holds of one: points in leaf order, their order, boxes and sums by level (none for large numbers)."""
    points, order = ("<i8", b"") if tree.points.dtype == object else ("<i4", None)
    boxes, sums = ((order, order) if order is not None else (
        b"".join(a.astype("<i4").tobytes() for level in zip(tree.low, tree.high, strict=True) for a in level), b"".join(a.astype("<i8").tobytes() for a in tree.sums)
    ))
    return {"points": tree.points.astype(points).tobytes(), "order": tree.order.astype("<i4").tobytes(), "boxes": boxes, "sums": sums}


def read_tree(kept: dict[str, bytes], width: int, small: bool) -> Tree:
    """The tree as it was cached; one of large numbers, or for large entries (not `small`), is built anew in whole numbers of any size."""
    whole = np.frombuffer(kept["points"], "<i4" if kept["sums"] else "<i8").reshape(-1, width).astype(np.int64)
    order = np.frombuffer(kept["order"], "<i4").astype(np.int64)
    if not (kept["sums"] and small):
        back = np.empty(len(whole), np.int64)
        back[order] = np.arange(len(whole))
        return Tree(whole[back].astype(object))
    tree, n = Tree.__new__(Tree), len(whole)
    tree.points, tree.order, tree.starts, tree.low, tree.high, tree.sums = whole, order, [], [], [], []
    boxes, sums = np.frombuffer(kept["boxes"], "<i4").reshape(-1, width).astype(np.int64), np.frombuffer(kept["sums"], "<i8").reshape(-1, width)
    start, at = np.zeros(1, np.int64), 0
    while at < len(sums):
        m = len(start)
        tree.starts.append(start)
        tree.low.append(boxes[2 * at : 2 * at + m])
        tree.high.append(boxes[2 * at + m : 2 * (at + m)])
        tree.sums.append(sums[at : at + m])
        start, at = np.stack((start, start + np.diff(np.append(start, n)) // 2), axis=1).ravel(), at + m
    tree.sizes = [np.diff(np.append(s, n)) for s in tree.starts]
    return tree


KEPT = ("points", "order", "boxes", "sums")


def _trees(rows: DataFrame, parts: int, block_rows: int) -> DataFrame:
    """A row per block: length, ids, labels, width and lists of the parts' points, orders and nodes. Blocks do not leave their partition."""
    schema = T.StructType([
        T.StructField("length", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
        T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), *(T.StructField(c, T.ArrayType(T.BinaryType())) for c in KEPT),
    ])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def block(length: int, taken: list[tuple]) -> pa.RecordBatch:
        vectors = np.array([v for _, _, v in taken], np.int64).reshape(len(taken), length)
        fits = -EXACT < int(vectors.min(initial=0)) and int(vectors.max(initial=0)) < EXACT and length < parts << 10
        trees = [_kept(Tree(p)) for p in cut(vectors if fits else vectors.astype(object), parts)]
        width = max(1, -(-length // parts))
        values = ([length], [width], [[t[0] for t in taken]], [[t[1] for t in taken]], *([[t[c] for t in trees]] for c in KEPT))
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], schema.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[tuple]] = {}
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = open_.setdefault(len(row[2]), [])
                own.append(row)
                if len(own) == block_rows:
                    yield block(len(row[2]), open_.pop(len(row[2])))
        for length, taken in open_.items():
            yield block(length, taken)

    return settle(rows.mapInArrow(build, schema))


def _first_books(rows: DataFrame, parts: int, entries: int) -> dict[int, np.ndarray]:
    """Per length the parts of its first vectors: (part, entry, component), whole numbers of any size."""
    some = {}
    for (length,) in rows.select(F.size("v").alias("length")).distinct().collect():
        first = rows.filter(F.size("v") == length).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        some[length] = cut(np.array([r["v"] for r in first], object).reshape(len(first), length), parts)
    return some


def _blocks_of(b: pa.RecordBatch, books: dict[int, np.ndarray]) -> Iterator[tuple[int, list, list, list[Tree], list[np.ndarray]]]:
    """(length, ids, labels, trees, entries per part) of blocks, trees and entries of one kind of number."""
    for row in b.to_pylist():
        book = books[row["length"]]
        small = bool((abs(book) < EXACT).all())
        trees = [read_tree(dict(zip(KEPT, t, strict=True)), row["width"], small) for t in zip(*(row[c] for c in KEPT), strict=True)]
        yield row["length"], row["ids"], row["labels"], trees, [e.astype(t.points.dtype) for e, t in zip(book, trees, strict=True)]


def _next_books(trees: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """One round. A task sends a row per length, part and entry, so tasks x parts x entries rows are shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for b in batches:
            for length, _, _, parts, book in _blocks_of(b, books):
                for p, tree in enumerate(parts):
                    sums, counts = tree.totals(book[p])
                    for e in np.flatnonzero(counts).tolist():
                        for i, x in enumerate(sums[e].tolist()):
                            own = total.setdefault((length, p, e, i), [0, 0])
                            own[0], own[1] = own[0] + int(x), own[1] + int(counts[e])
        keys = list(zip(*total, strict=True)) if total else [[]] * 4
        sums = pa.array([Decimal(s) for s, _ in total.values()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), sums, pa.array([c for _, c in total.values()], pa.int64())], ["length", "part", "entry", "i", "s", "n"])

    per_task = trees.mapInArrow(add, "length int, part int, entry int, i int, s decimal(38,0), n long")
    out = {length: book.copy() for length, book in books.items()}
    for r in per_task.groupBy("length", "part", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        out[r["length"]][r["part"], r["entry"], r["i"]] = int(r["s"]) // r["n"]
    return out


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in book.ravel()).encode()).hexdigest()


def learn(kept: DataFrame, parts: int, entries: int, rounds: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(the table of trees, per length of vectors the codebooks: part, entry, component) of rows id, label, v (array of long)."""
    trees = _trees(kept, parts, BLOCK_ROWS)
    books = _first_books(kept, parts, entries)
    for _ in range(rounds):
        books = _next_books(trees, books)
    return trees, books


def prepared(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int = SCALE) -> DataFrame:
    """id, label, v of the rows that take part."""
    label = F.lit(None).cast("int") if label_col is None else quoted(label_col)
    return rows.select(quoted(id_col).alias("id"), label.alias("label"), scaled(quoted(vector_col), scale).alias("v")).filter(F.col("v").isNotNull())


def vector_codes(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """id, code (an entry's index per part, two hex digits each, so 256 entries at most), error, label_error, codebooks_sha256.

    label_error is the sum of error over rows of the same label, nulls together. `entries` and `parts` bound what passes
    through the driver. The distinct lengths of vectors are taken to be few.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    ship(rows.sparkSession)
    kept = prepared(rows, id_col, vector_col, label_col, scale)
    trees, books = learn(kept, parts, entries, rounds)
    coded = settle(encoded(trees, kept, books))
    sums = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG.max).cast("decimal(38,0)")).cast("long")
    per_label = coded.groupBy("label").agg(sums.alias("label_error"), F.count(F.lit(1)).alias("label_rows"))
    named = F.lit(None).cast("string")
    for length, book in books.items():
        named = F.when(F.col("length") == length, digest(book)).otherwise(named)
    met = join_groups(coded, settle(per_label), "label", "label_rows")
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", named.alias("codebooks_sha256"))


def encoded(trees: DataFrame, kept: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """id, label, length, code, error of every vector in the table of trees."""
    schema = T.StructType([kept.schema["id"], kept.schema["label"], T.StructField("length", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, ids, labels, parts, book in _blocks_of(b, books):
                codes, error = np.zeros((len(ids), len(parts)), np.uint8), np.zeros(len(ids), parts[0].points.dtype)
                for p, tree in enumerate(parts):
                    own = tree.codes(book[p])
                    codes[:, p] = own
                    error[tree.order] += _square(tree.points - book[p][own[tree.order]])
                digits = codes.tobytes().hex()
                code = [digits[i : i + 2 * len(parts)] for i in range(0, len(digits), 2 * len(parts))]
                cols = (ids, labels, [length] * len(ids), code, [min(int(e), LONG.max) for e in error.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema.names)

    return trees.mapInArrow(encode, schema)


def decoded(code: Column, book: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code stands for, as an array column; `book` is the codebook (part, entry, component) of its length."""
    parts = [F.array(*(F.array(*(F.lit(int(x) / scale) for x in e)) for e in p)) for p in book]
    at = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(book))]
    return F.concat(*(F.get(p, i) for p, i in zip(parts, at, strict=True)))
