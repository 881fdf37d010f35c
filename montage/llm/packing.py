"""Packing along a space-filling curve.

Each document's hashed word vector is projected to three dimensions and quantised; the Hilbert key of that cell orders
the documents so that neighbours are alike. Documents are range-partitioned and sorted by (key, id), and every partition
fills sequences one after the other along the curve, cutting documents where a sequence ends. The rest of a partition is
cut into sequences of powers of two, so nothing is padded. With a column of runs, the runs come in their order and the
curve orders the documents inside each run only.

Texts are tokenised in the tasks that pack them, one sequence held at a time. Ids are those of the byte-level BPE
vocabulary given by its path, special tokens not added; id 0 closes each document. The strings of `added` tokens get
their own ids wherever a text holds them, and the parts between are encoded alone; without `added` they are ordinary text.

Defined cases: null text is empty and packs the closing id alone; equal documents lie side by side; the id of a
document may be null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, partitions, quoted, ship
from .textbytes import segment_sums, spans, utf8, words

LENGTH = 1024
CLOSING = 0
#: Cells per dimension are 2^BITS; the key has 3 * BITS bits.
DIMS, BITS = 3, 10
HASHED = 4096
_PROJECTION = np.random.Generator(np.random.PCG64(11)).normal(size=(HASHED, DIMS))
#: Bytes of text that become Python strings at once (one longer text is alone).
TEXT = 1 << 22


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of whole coordinates below 2^bits."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(flip, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Hilbert key of each text's projected hashed word vector."""
    data, offsets = utf8(texts)
    out = np.empty(len(offsets) - 1, np.int64)
    for i, j in spans(offsets):
        h, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        total = segment_sums(_PROJECTION[(h & np.uint64(HASHED - 1)).astype(np.int64)], at)
        mean = total / np.maximum(np.diff(at), 1)[:, None]
        out[i:j] = hilbert_key(np.floor((np.tanh(1.5 * mean) + 1) / 2 * ((1 << BITS) - 1)))
    return out


class TokenIds:
    """Ids of whole texts, straight from the encoder as arrays."""

    def __init__(self, ranks_path: str, added: Mapping[str, int]):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(added))
        self.encode = partial(encoding.encode_to_numpy, allowed_special=set(added), disallowed_special=())

    def ids(self, text: str) -> np.ndarray:
        """The text's ids and the closing id."""
        return np.append(self.encode(text), np.uint32(CLOSING))


class _Filler:
    """Pieces of one partition; `out` gets them as each sequence closes."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.used = length, first, 0
        self.open: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(self.length - self.used, len(ids) - at)
            self.open.append((doc_id, at, ids[at : at + n], len(ids)))
            at, self.used = at + n, self.used + n
            if self.used == self.length:
                self.close(self.open)

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, self.sequence, at))
            at += len(ids)
        self.sequence, self.used, self.open = self.sequence + 1, 0, []

    def finish(self) -> None:
        """The rest becomes sequences of falling powers of two."""
        rest, left = self.open, self.used
        while left:
            size = 1 << (left.bit_length() - 1)
            part, got = [], 0
            while got < size:
                doc_id, start, ids, total = rest.pop(0)
                n = min(size - got, len(ids))
                part.append((doc_id, start, ids[:n], total))
                got += n
                if n < len(ids):
                    rest.insert(0, (doc_id, start + n, ids[n:], total))
            self.close(part)
            left -= size


_known: dict[tuple, TokenIds] = {}


def token_ids(ranks_path: str, added: Mapping[str, int]) -> TokenIds:
    """One per worker process, kept from task to task."""
    name = (ranks_path, *sorted(added.items()))
    if name not in _known:
        _known[name] = TokenIds(ranks_path, added)
    return _known[name]


def pack_documents(
    docs: DataFrame, ranks_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", added: Mapping[str, int] | None = None, run_col: str | None = None
) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    start counts the document's ids before the piece, offset the sequence's. sequence_id is unique; it grows with the runs
    (long, not null) of `run_col`, if given, and along the curve.
    """
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[id_col].dataType
    keyed = T.StructType([T.StructField("id", id_type), T.StructField("text", T.StringType()), T.StructField("run", T.LongType()), T.StructField("key", T.LongType())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(curve_keys(b.column(1)))], ["id", "text", "run", "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, filler = token_ids(ranks_path, added or {}), _Filler(length, TaskContext.get().partitionId() << 33)
        schema = pa.schema([("id", out_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def rows() -> pa.RecordBatch:
            done, filler.out = filler.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            _, offsets = utf8(b.column(1))
            for i, j in spans(offsets, TEXT):
                doc_ids = b.column(0).slice(i, j - i).to_pylist()
                for doc_id, text in zip(doc_ids, b.column(1).slice(i, j - i).to_pylist(), strict=True):
                    filler.add(doc_id, known.ids(text))
                if len(filler.out) >= 1000:
                    yield rows()
        filler.finish()
        if filler.out:
            yield rows()

    out_type = _arrow_type(id_type)
    # twice the input's splits: their bytes bound a partition's, whatever the shuffle's setting
    pieces_of_work = max(partitions(spark), 2 * docs.rdd.getNumPartitions())
    run = F.lit(0) if run_col is None else quoted(run_col)
    along = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text"), run.cast("long").alias("run")).mapInArrow(keys, keyed)
    along = along.repartitionByRange(pieces_of_work, "run", "key", "id").sortWithinPartitions("run", "key", "id", F.xxhash64("text")).select("id", "text")
    pieces = T.StructType([
        T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    return along.mapInArrow(pack, pieces).withColumnRenamed("id", id_col)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
