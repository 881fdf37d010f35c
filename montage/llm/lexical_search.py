"""Ranked lexical search over a two-level quantised index.

Documents are packed into blocks of bounded size, each an inverted index of its own: a dictionary of term hashes and, per
term, the documents that hold it. Level one keeps a byte per posting, the term's impact on the document rounded up to a
multiple of STEP. Level two keeps the whole numbers that scores are made of: how often the term occurs and how long the
document is. A term's weight depends on the query's side only and multiplies the impact.

A search reads the dictionaries for the number of documents per asked term, then scores each block from the bytes alone:
the sum of weight times byte is an upper bound of a document's score, the sum of weight times the least impact a byte
stands for a lower one. Per query a task keeps the k-th largest lower bound among all documents it has seen; every
document whose upper bound reaches that is scored exactly, in 64-bit integers, from level two. A task's k best per query
are ranked once more over all tasks. Nothing that could be among the k best is passed over.

Queries are handled in blocks of at most MOST_TERMS distinct terms (one longer query is alone), whose terms pass through
the driver; documents, postings and scores of all documents never do.

Defined cases: null or empty texts and texts without terms count in nothing and are never found; queries without terms
give no rows; every row is a document and every query row is a query, whatever its id; ties go to the smaller id, null
last; an empty table gives no rows. Terms are told apart by 64-bit hashes; two terms of one hash would count as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_text, checkpoint_dir, quoted, settle, ship
from .textbytes import separators, spans, utf8, words

#: Characters of terms besides all that are not ASCII.
SEPARATOR = separators("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Documents and bytes of text of a block (one longer text is a block of its own).
BLOCK_DOCS, BLOCK_BYTES = 1024, 1 << 21
#: Distinct terms of the queries that are handled together.
MOST_TERMS = 50_000
# The score's scale and its two constants in percent.
SCALE, SOFT, FLAT = 1_000_000_000, 8, 75
#: Impacts are below SCALE / 1000; 255 steps reach beyond.
STEP = -(-SCALE // 1000 // 255) + 1


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The whole number that a term's weight is multiplied with."""
    return (SCALE * tf) // (1000 * tf + SOFT * m)


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Relative length of each document in percent, softened."""
    n = n.astype(np.int64)
    if len(n) and FLAT * int(n.max()) * documents >= 2**63:
        return np.array([100 - FLAT + FLAT * x * documents // terms for x in n.tolist()], np.int64)
    return 100 - FLAT + (FLAT * n * documents) // max(terms, 1)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def term_counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hash of every term, offsets) of runs of texts whose bytes are handled at once."""
    data, offsets = utf8(texts)
    for i, j in spans(offsets):
        h, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], blank=SEPARATOR)
        yield i, j, h, at


@dataclass(frozen=True)
class LexicalIndex:
    """`table` has a row per block; documents and terms are the totals that impacts depend on."""

    table: DataFrame
    documents: int
    terms: int

    @staticmethod
    def read(spark: SparkSession, path: str) -> LexicalIndex:
        totals = spark.read.parquet(f"{path}/totals").first()
        return LexicalIndex(spark.read.parquet(f"{path}/blocks"), totals["documents"], totals["terms"])


def _block_type(id_type: T.DataType) -> T.StructType:
    level_one = [T.StructField(c, T.BinaryType()) for c in ("dictionary", "starts", "docs", "impacts")]
    level_two = [T.StructField("counts", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type))]
    return T.StructType([*level_one, *level_two])


class _Block:
    """Documents of a block as they come."""

    def __init__(self) -> None:
        self.ids: list = []
        self.n: list[np.ndarray] = []
        self.terms: list[np.ndarray] = []
        self.size = self.docs = 0

    def add(self, ids: list, h: np.ndarray, at: np.ndarray) -> None:
        self.ids += ids
        self.n.append(np.diff(at))
        self.terms.append(h)
        self.size += len(h)
        self.docs += len(ids)

    def postings(self) -> tuple[np.ndarray, ...]:
        """(dictionary, where each term's postings start, document and count of each posting, length of each document)."""
        n, h = np.concatenate(self.n), np.concatenate(self.terms)
        dictionary, term = np.unique(h, return_inverse=True)
        pair = term.astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n)
        pair, counts = np.unique(pair, return_counts=True)
        of, doc = np.divmod(pair, max(len(n), 1))
        return dictionary, np.searchsorted(of, np.arange(len(dictionary) + 1)), doc, counts, n


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """The index of all documents, written to `path` (by default a new folder in the shared checkpoint folder)."""
    spark = docs.sparkSession
    ship(spark)
    path = path or f"{checkpoint_dir(spark)}/lexical-{uuid4().hex}"
    rows = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for b in batches:
            for _, _, _, at in term_counts(b.column(0)):
                documents, terms = documents + int((np.diff(at) > 0).sum()), terms + int(at[-1])
        yield pa.RecordBatch.from_pydict({"documents": [documents], "terms": [terms]})

    zero = F.lit(0).cast("long")
    totals = rows.select("text").mapInArrow(count, "documents long, terms long").agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("documents", "terms")))
    totals.write.parquet(f"{path}/totals")
    documents, terms = spark.read.parquet(f"{path}/totals").first()
    kind = _block_type(rows.schema["id"].dataType)
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def pack(block: _Block) -> pa.RecordBatch:
        dictionary, starts, doc, counts, n = block.postings()
        ceil = -(-impact(counts.astype(np.int64), lengths(n, documents, terms)[doc]) // STEP)
        parts = (dictionary.astype("<u8"), starts.astype("<i4"), doc.astype("<u2"), ceil.astype("u1"), counts.astype("<u4"), n.astype("<i8"))
        return pa.RecordBatch.from_arrays([*(pa.array([p.tobytes()]) for p in parts), pa.array([block.ids], pa.list_(id_type))], kind.names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for b in batches:
            for i, j, h, at in term_counts(b.column(1)):
                ids = b.column(0).slice(i, j - i).to_pylist()
                for a in range(0, j - i, BLOCK_DOCS // 4):
                    z = min(a + BLOCK_DOCS // 4, j - i)
                    if block.docs and (block.docs + z - a > BLOCK_DOCS or 8 * block.size > BLOCK_BYTES):
                        yield pack(block)
                        block = _Block()
                    block.add(ids[a:z], h[at[a] : at[z]], at[a : z + 1])
        if block.docs:
            yield pack(block)

    rows.mapInArrow(index, kind).write.parquet(f"{path}/blocks")
    return LexicalIndex(spark.read.schema(kind).parquet(f"{path}/blocks"), documents, terms)


@dataclass(frozen=True)
class _Queries:
    """A block of queries: per query the places of its terms in `vocabulary` and how often it holds them."""

    vocabulary: np.ndarray
    rows: list[tuple[int, np.ndarray, np.ndarray]]


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """asked (a number of its own), query id, and lists of its terms' hashes (as long) and their numbers; settled."""
    ship(queries.sparkSession)
    id_type = queries.schema[id_col].dataType
    schema = T.StructType([T.StructField("asked", T.LongType()), T.StructField("id", id_type), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, times = [], []
            for i, j, h, at in term_counts(b.column(2)):
                for k in range(j - i):
                    u, n = np.unique(h[at[k] : at[k + 1]], return_counts=True)
                    terms.append(u.view(np.int64))
                    times.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], schema.names)

    rows = queries.select(quoted(id_col).alias("id"), as_text(text_col).alias("text")).withColumn("asked", F.monotonically_increasing_id())
    return settle(rows.select("asked", "id", "text").mapInArrow(cut, schema).filter(F.size("terms") > 0))


def _collected(rows: DataFrame) -> _Queries:
    got = [(r["asked"], np.array(r["terms"], np.int64).view(np.uint64), np.array(r["times"], np.int64)) for r in rows.select("asked", "terms", "times").toLocalIterator()]
    vocabulary = np.unique(np.concatenate([t for _, t, _ in got])) if got else np.zeros(0, np.uint64)
    return _Queries(vocabulary, [(a, np.searchsorted(vocabulary, t), n) for a, t, n in got])


def _known(dictionary: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the dictionary, places in the vocabulary) of the terms that both hold."""
    at = np.minimum(np.searchsorted(dictionary, vocabulary), max(len(dictionary) - 1, 0))
    both = np.flatnonzero(dictionary[at] == vocabulary) if len(dictionary) else np.zeros(0, np.int64)
    return at[both], both


def _document_counts(index: LexicalIndex, asked: _Queries) -> np.ndarray:
    """Documents that hold each term of the vocabulary; one task's counts are added up before they are shuffled."""
    vocabulary = asked.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for d, s in zip(b.column(0), b.column(1), strict=True):
                here, there = _known(np.frombuffer(d.as_buffer(), "<u8"), vocabulary)
                df[there] += np.diff(np.frombuffer(s.as_buffer(), "<i4"))[here]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "df": pa.array(df[some])})

    out = np.zeros(len(vocabulary), np.int64)
    per_task = index.table.select("dictionary", "starts").mapInArrow(count, "term int, df long")
    for r in per_task.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


class _Best:
    """The k best of one query in a task, and its k largest lower bounds."""

    __slots__ = ("k", "lower", "found")

    def __init__(self, k: int):
        self.k, self.lower, self.found = k, np.zeros(0, np.int64), []

    def bound(self, lower: np.ndarray) -> int:
        self.lower = -np.sort(-np.concatenate((self.lower, lower)))[: self.k]
        return int(self.lower[-1]) if len(self.lower) == self.k else 0

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.found += [(-s, i is None, i, s) for s, i in zip(scores.tolist(), ids, strict=True) if s > 0]
        self.found = sorted(self.found, key=lambda f: f[:2] if f[1] else f[:3])[: self.k]


def score_block(row: dict[str, np.ndarray], ids: list, asked: _Queries, weights: np.ndarray, documents: int, terms: int, best: list[_Best]) -> int:
    """Takes a block's documents into `best`, a query each; returns how many were scored exactly."""
    here, there = _known(row["dictionary"], asked.vocabulary)
    n, starts = row["lengths"], row["starts"]
    # postings of the asked terms, as a table of terms by documents
    held = np.concatenate([np.arange(starts[t], starts[t + 1]) for t in here]) if len(here) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(here)), starts[here + 1] - starts[here])
    doc = row["docs"][held].astype(np.int64)
    level_one = np.zeros((len(here), len(n)), np.uint8)
    level_one[of, doc] = row["impacts"][held]
    line = np.full(len(asked.vocabulary), -1)
    line[there] = np.arange(len(here))
    picked = []
    for (_, places, times), top in zip(asked.rows, best, strict=True):
        lines = line[places]
        some = (lines >= 0) & (weights[places] > 0)
        w, lines = (weights[places] * times)[some], lines[some]
        if not len(lines):
            continue
        upper = _sums(w, level_one, lines) * STEP
        first = np.argpartition(-upper, min(top.k, len(upper)) - 1)[: top.k]
        bytes_of = level_one[np.ix_(lines, first)].astype(np.int64)
        lower = (w[:, None] * np.where(bytes_of > 0, (bytes_of - 1) * STEP + 1, 0)).sum(axis=0)
        reach = np.flatnonzero(upper >= max(1, top.bound(lower[lower > 0])))
        if len(reach):
            picked.append((top, w, lines, reach))
    if not picked:
        return 0
    # level two, for the documents picked
    docs = np.unique(np.concatenate([p[3] for p in picked]))
    column = np.full(len(n), -1)
    column[docs] = np.arange(len(docs))
    of_picked = column[doc] >= 0
    counts = np.zeros((len(here), len(docs)), np.int64)
    counts[of[of_picked], column[doc[of_picked]]] = row["counts"][held[of_picked]]
    exact = impact(counts, lengths(n[docs], documents, terms)[None, :])
    for top, w, lines, reach in picked:
        scores = (w[:, None] * exact[np.ix_(lines, column[reach])]).sum(axis=0)
        top.add(scores, [ids[d] for d in reach])
    return sum(len(p[3]) for p in picked)


def _sums(w: np.ndarray, table: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Sum of w times the lines of a table of bytes; floats where they are exact."""
    kind = np.float64 if int(w.sum()) * 255 < 2**53 else np.int64
    out = np.zeros(table.shape[1], kind)
    for a in range(0, len(lines), 1024):
        out += w[a : a + 1024].astype(kind) @ table[lines[a : a + 1024]].astype(kind)
    return out.astype(np.int64)


def search(index: LexicalIndex, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """query id, rank (from 1), doc_id, score of the k best documents with a score above 0 of each query."""
    terms = _query_terms(queries, id_col, text_col)
    total = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // MOST_TERMS))
    found = None
    for i in range(blocks):
        some = terms.filter(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == i) if blocks > 1 else terms
        part = _search_block(index, _collected(some), k)
        found = part if found is None else found.unionByName(part)
    # a task's k best of a query meet those of some tasks, then of all
    for share in (F.pmod(F.xxhash64("task"), F.lit(64)), F.lit(0)):
        order = Window.partitionBy("asked", share).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = terms.select("asked", F.col("id").alias(id_col))
    return found.join(names, "asked").select(id_col, "rank", "doc_id", "score")


def _search_block(index: LexicalIndex, asked: _Queries, k: int) -> DataFrame:
    """asked, task, doc_id, score of the k best of every task."""
    df = _document_counts(index, asked)
    documents, terms = index.documents, index.terms
    weights = np.array([weight(documents, d) for d in df.tolist()], np.int64)
    doc_type = index.table.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("asked", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
    kinds = {"dictionary": "<u8", "starts": "<i4", "docs": "<u2", "impacts": "u1", "counts": "<u4", "lengths": "<i8"}
    out_type = to_arrow_type(doc_type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = [_Best(k) for _ in asked.rows]
        for b in batches:
            for i in range(b.num_rows):
                row = {c: np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in kinds.items()}
                score_block(row, b.column("ids")[i].as_py(), asked, weights, documents, terms, best)
        rows = [(a, f[2], f[3]) for (a, _, _), top in zip(asked.rows, best, strict=True) for f in top.found]
        task = TaskContext.get().partitionId()
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([task] * len(rows), pa.int32()), pa.array([r[1] for r in rows], out_type), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, schema.names)

    return index.table.mapInArrow(scan, schema)
