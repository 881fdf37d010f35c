"""Quality classifier: supervised subword embeddings.

Every word of a text and every run of 3 or 4 characters of a word, its beginning and end marked, is hashed to a row of a
learned table; a document is the average of its rows, and a softmax layer over that average gives the label's
probabilities. Training is stochastic gradient descent in numpy (mini-batches, step sizes per parameter by the squared
gradients so far) on a bounded sample of labelled documents: at most
`most_labelled`, those with the smallest hash of their id, whole texts, and of these as many as have features of
`most_bytes` at most. Only hashed counts of the sample reach the driver.

Since averaging and the layer are linear, a trained model is one weight per hashed row and one bias, and scoring a
document is the mean of its rows' weights. Scoring runs in Arrow batches without shuffles; the model, of fixed size,
travels in the function.

Defined cases: null and empty texts have no rows and get the bias alone; labels that are null or not 0 or 1 are left
out, of several labels of a document the smallest counts; repeated rows of a sampled document are learned from once, and
of several texts under its id the one with the smallest hash; without labels of both kinds every score is the smoothed share
of label 1. Equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, free, quoted, settle, ship
from .textbytes import characters, grams, segment_sums, spans, utf8, words

WORD_ROWS = 1 << 15
GRAM_ROWS = 1 << 15
GRAMS = (3, 4)
ROWS = WORD_ROWS + GRAM_ROWS * len(GRAMS)
THRESHOLD = 0.3


@dataclass(frozen=True)
class Training:
    """most_labelled and most_bytes (of features, one text at least) bound the sample; the rest are the settings of the descent."""

    most_labelled: int = 3000
    most_bytes: int = 512 << 20
    dim: int = 4
    epochs: int = 12
    batch: int = 32
    rate: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offsets = utf8(texts)
        out = np.empty(len(offsets) - 1)
        for i, j in spans(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            total, count = np.zeros(j - i), np.zeros(j - i)
            for rows, ends in hashed_rows(part, at):
                total += segment_sums(self.weights[rows], ends)
                count += np.diff(ends)
            out[i:j] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


def hashed_rows(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, offsets by text) of words, then of each kind of gram."""
    h, ends = words(data, at, lower=False)
    yield (h & np.uint64(WORD_ROWS - 1)).astype(np.int64), ends
    points, at = characters(data, at)
    for k, n in enumerate(GRAMS):
        g, ends = grams(points, at, n)
        yield (g & np.uint32(GRAM_ROWS - 1)).astype(np.int64) + (WORD_ROWS + k * GRAM_ROWS), ends


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, distinct rows, their shares), packed as bytes."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        found = []
        for i in range(len(offsets) - 1):
            part = data[offsets[i] : offsets[i + 1]]
            rows = np.concatenate([r for r, _ in hashed_rows(part, np.array([0, len(part)]))])
            distinct, n = np.unique(rows, return_counts=True)
            found.append((distinct.astype("<i4").tobytes(), (n / max(len(rows), 1)).astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["label", "rows", "shares"])


def most_bytes_of(chars: int) -> int:
    """What the features of a text of so many characters take at most: a row and a share for each of its words and grams."""
    return 8 * min(ROWS, (1 + len(GRAMS)) * chars + 1)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns `label_col` of `labels` (rows where `learn_from`, over the id, holds) from the texts of `docs`."""
    ship(docs.sparkSession)
    known = labels.filter(quoted(label_col).isin(0, 1) & quoted(id_col).isNotNull() & learn_from)
    known = known.groupBy(quoted(id_col).alias("id")).agg(F.min(quoted(label_col)).cast("int").alias("label"))
    sample = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(how.most_labelled))
    rows = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text")).join(sample, "id")
    # one text an id, so that repeated rows of a sampled id do not lift the bound
    rows = settle(rows.withColumn("seal", F.xxhash64("text")).groupBy("id").agg(F.min(F.struct("seal", "label", "text")).alias("r")).select("id", "r.label", "r.text"))
    # what reaches the driver is bounded in bytes too: texts in the order of the sample, as far as they fit
    sizes = rows.select(F.xxhash64("id").alias("h"), "id", F.char_length("text")).collect()
    fits, total = [], 0
    for h, _, chars in sorted(sizes, key=lambda r: (r[0], str(r[1]))):
        total += most_bytes_of(chars)
        if total > how.most_bytes and fits:
            break
        fits.append(h)
    rows = rows.filter(F.xxhash64("id").isin(fits)) if len(fits) < len(sizes) else rows
    rows = rows.select("label", "text")
    found = sorted(map(tuple, rows.mapInArrow(_features, "label int, rows binary, shares binary").collect()))
    label = [int(r[0]) for r in found]
    which, shares = [np.frombuffer(r[1], "<i4") for r in found], [np.frombuffer(r[2], "<f4") for r in found]
    del found
    return fit(label, which, shares, how)


def fit(label: list[int], rows: list[np.ndarray], shares: list[np.ndarray], how: Training) -> Model:
    """Gradient descent on softmax cross-entropy; returns the folded model."""
    y, n = np.array(label), len(label)
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (n + 2)
        return Model(np.zeros(ROWS), float(np.log(share / (1 - share))))
    rng = np.random.Generator(np.random.PCG64(how.seed))
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    every, weight = np.concatenate(rows), np.concatenate(shares)
    rows.clear()
    shares.clear()
    used = np.flatnonzero(np.bincount(every, minlength=ROWS))
    place = np.zeros(ROWS, np.int32)
    place[used] = np.arange(len(used))
    flat = place[every]
    table = rng.normal(0, 0.1, (len(used), how.dim))
    layer, bias = rng.normal(0, 0.5, (how.dim, 2)), np.log(np.bincount(y, minlength=2) / n)
    seen = [np.full_like(a, 1e-8) for a in (table, layer, bias)]
    for epoch in range(how.epochs):
        rate = how.rate * (1 - epoch / how.epochs)
        order = rng.permutation(n)
        for i in range(0, n, how.batch):
            ids = order[i : i + how.batch]
            sizes = at[ids + 1] - at[ids]
            if not sizes.sum():
                continue
            ends = np.concatenate(([0], np.cumsum(sizes)))
            pick = np.repeat(at[ids] - ends[:-1], sizes) + np.arange(ends[-1])
            r, w = flat[pick], weight[pick]
            doc = np.repeat(np.arange(len(ids)), sizes)
            average = segment_sums(table[r] * w[:, None], ends)
            z = average @ layer + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(ids)), y[ids]] -= 1
            z /= len(ids)
            to_average = z @ layer.T
            touched, inverse = np.unique(r, return_inverse=True)
            step = np.stack([np.bincount(inverse, weights=w * to_average[doc, d], minlength=len(touched)) for d in range(how.dim)], axis=1)
            seen[0][touched] += step**2
            table[touched] -= rate * step / np.sqrt(seen[0][touched])
            for k, (value, grad) in enumerate(((layer, average.T @ z), (bias, z.sum(axis=0))), 1):
                seen[k] += grad**2
                value -= 0.1 * rate * grad / np.sqrt(seen[k])
    folded = np.zeros(ROWS)
    folded[used] = table @ (layer[:, 1] - layer[:, 0])
    return Model(folded, float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with `score_col`: the probability of label 1, from the whole text alone. A column of that name is replaced."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() != score_col.lower() or c == text_col]
    (text,) = free(docs, "text")
    names, place = keep, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:place], pa.array(model.scores(b.column(place)), pa.float64())], [*names, score_col])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(score_col, T.DoubleType())])
    return docs.select(*map(quoted, keep), as_text(text_col).alias(text)).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that is never learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted (1 from THRESHOLD on). Learns from ids outside the held-out fifth."""
    model = train(docs, labels, ~held_out(quoted(id_col)), how, id_col, text_col)
    scored = score(docs.select(quoted(id_col), quoted(text_col)), model, text_col)
    return scored.select(
        quoted(id_col), F.coalesce(held_out(quoted(id_col)), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
