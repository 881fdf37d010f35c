"""Exact top-k search by inner product with pivot-table elimination.

Components are floor(1024 * x). Distances to a fixed number of pivots are computed once per vector and kept with it. For
a query q and a candidate x the largest |d(q, p) - d(x, p)| over the pivots is a lower bound of their distance, hence
(|q|^2 + |x|^2 - bound^2) / 2 an upper bound of their inner product. Candidates are evaluated in the order of that bound
until the k-th best score so far exceeds it: nothing that could enter the result is passed over.

Rows equal in id and vector are counted once and stand in a block once, with their number. Vectors are packed into blocks
of bounded size by their nearest pivot (of as many pivots as there are full blocks), large cells by a hash too, so that a block covers little of the space; each block
knows the least and largest distance of its rows to every pivot and their largest length. A first pass scores each block of
queries against one block of its own cell, which gives every query a score that its k-th best will reach. Pairs of blocks
whose bound is below that of all their queries are dropped before any vector is copied; each other pair of a query block
and a candidate block is one task-sized piece of work, and gives k rows per query at most. Those are ranked per query by a
window that Spark limits before its shuffle.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of another length than
the query's are no candidates, and empty ones are for empty queries, with score 0; fewer than k candidates are all
returned; ties go to the smaller id; all rows that share the query's id count as its own; repeated candidates are
candidates each; repeated rows of a query ask once, and other vectors under its id ask too, with ranks of their own.
Scores are exact: blocks whose products may pass 2^53 are multiplied in whole numbers of any size. Components and scores
beyond the range of long count as its ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, settle, ship

#: Rows of a candidate block and of a query block, on average.
BLOCK_ROWS, QUERY_ROWS = 4096, 256
PIVOTS = 48
SCALE = 1024


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null for vectors that take no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")))


def _distances(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * v @ p.T, 0)) if len(p) else np.zeros((len(v), 0))


def _celled(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """`rows` (id, v, asks, times, dim) with the number of the nearest of `pivots` as `cell`."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["cell"] = 0
            for dim, part in pdf.groupby("dim"):
                v = np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), int(dim))
                pdf.loc[part.index, "cell"] = _distances(v, pivots[int(dim)]).argmin(axis=1)
            yield pdf

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(near, f"{kind}, cell int")


def _blocked(rows: DataFrame, sizes: dict[tuple[int, int], int], size: int) -> tuple[DataFrame, dict[int, int]]:
    """(`rows` with their block, blocks per length): the blocks of a length are numbered on from cell to cell."""
    first, parts, count = {}, {}, {}
    for (dim, cell), n in sorted(sizes.items()):
        first[dim, cell] = count.get(dim, 0)
        parts[dim, cell] = max(1, -(-n // size))
        count[dim] = first[dim, cell] + parts[dim, cell]
    key = F.col("dim") * PIVOTS + F.col("cell")
    of = lambda table: F.element_at(F.create_map(*(F.lit(x) for (d, c), n in table.items() for x in (d * PIVOTS + c, n))), key)
    return (rows.withColumn("block", (of(first) + F.pmod(F.xxhash64("id", "v"), of(parts))).cast("int")) if sizes else rows.withColumn("block", F.lit(0))), count


BLOCK = "dim int, block int, cell int, ids binary, times binary, vectors binary, table binary, low array<double>, high array<double>, longest double"


def _packed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """One row per block: ids, vectors and the pivot table as bytes, and the ends of its distances and lengths; settled."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        whole = np.array(pdf["v"].tolist(), dtype=np.int64).reshape(len(pdf), int(key[0]))
        v = whole.astype(np.float64)
        far = _distances(v, pivots[int(key[0])])
        ends = {"low": [far.min(axis=0).tolist()], "high": [far.max(axis=0).tolist()], "longest": [float((v**2).sum(1).max())]}
        data = {"ids": [pdf["id"].to_numpy("<i8").tobytes()], "times": [pdf["times"].to_numpy("<i8").tobytes()], "vectors": [whole.tobytes()], "table": [far.tobytes()]}
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "cell": [int(pdf["cell"].iloc[0])]} | data | ends)

    return settle(rows.groupBy("dim", "block").applyInPandas(pack, BLOCK))


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole rows with q, exact; beyond the range of long its ends."""
    if v.size == 0 or len(q) * max(1.0, np.abs(v.astype(float)).max()) * max(1.0, np.abs(q.astype(float)).max()) < 2**53:
        return np.rint(v.astype(float) @ q.astype(float)).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.array([min(max(sum(x * y for x, y in zip(row, q.tolist(), strict=True)), ends.min), ends.max) for row in v.tolist()], dtype=np.int64)


def best_of_block(
    whole_q: np.ndarray, q_far: np.ndarray, q_id: int, whole: np.ndarray, far: np.ndarray, ids: np.ndarray, k: int, reached: float = -np.inf
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ids, scores, places in the block, evaluated) of the k best of one block for one query, best first.

    Rows that cannot come up to `reached` need not be among them.
    """
    q, v = whole_q.astype(float), whole.astype(float)
    own = (q**2).sum() + (v**2).sum(1)
    low = np.abs(far - q_far).max(axis=1) if far.shape[1] else np.zeros(len(v))
    most = (own - low**2) / 2 + 1e-9 * own + 1
    order = np.argsort(-most, kind="stable")
    order = order[ids[order] != q_id]
    best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done, step = 0, max(64, k)
    while done < len(order) and most[order[done]] >= reached and not (len(best) == k and best[-1] > most[order[done]]):
        part = order[done : done + step]
        best_at, best = np.concatenate((best_at, part)), np.concatenate((best, products(whole[part], whole_q)))
        keep = np.lexsort((ids[best_at], ~best))[:k]
        best_at, best = best_at[keep], best[keep]
        done, step = done + len(part), 2 * step
    return ids[best_at], best, best_at, done


def _opened(r, p: str, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, pivot table) of the block whose columns begin with `p`."""
    ids = np.frombuffer(getattr(r, f"{p}ids"), "<i8")
    return ids, np.frombuffer(getattr(r, f"{p}vectors"), np.int64).reshape(len(ids), r.dim), np.frombuffer(getattr(r, f"{p}table")).reshape(len(ids), count)


def _asking(asks: DataFrame) -> DataFrame:
    """Blocks of queries under names of their own."""
    return asks.select("dim", *(F.col(c).alias(f"q_{c}") for c in asks.columns if c != "dim"))


def reached_scores(base: DataFrame, asks: DataFrame, pivots: dict[int, np.ndarray], k: int) -> DataFrame:
    """dim, q_block, reached (a score per query that its k-th best reaches, -inf if unknown), least (of them), from one block each."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                count = len(pivots[r.dim])
                (ids, v, far), (q_ids, q, q_far) = _opened(r, "", count), _opened(r, "q_", count)
                best = [best_of_block(q[j], q_far[j], i, v, far, ids, k)[1] for j, i in enumerate(q_ids.tolist())]
                reached = [float(b[-1]) if len(b) == k else -np.inf for b in best]
                yield pd.DataFrame({"dim": [r.dim], "q_block": [r.q_block], "reached": [reached], "least": [min(reached)]})

    # the blocks of a cell follow each other: a query block takes one of them
    cells = base.groupBy("dim", "cell").agg(F.min("block").alias("from"), F.count(F.lit(1)).alias("blocks"))
    own = _asking(asks).withColumnRenamed("q_cell", "cell").join(cells, ["dim", "cell"]).withColumn("block", (F.col("from") + F.pmod(F.col("q_block"), F.col("blocks"))).cast("int"))
    pairs = own.drop("cell", "from", "blocks").join(base.select("dim", "block", "ids", "vectors", "table"), ["dim", "block"])
    return settle(pairs.mapInPandas(score, "dim int, q_block int, reached array<double>, least double"))


def open_pairs(base: DataFrame, asks: DataFrame, reached: DataFrame, count: dict[int, int]) -> DataFrame:
    """dim, block, q_block of the pairs of blocks that may hold a result. Only the blocks' ends are compared, no vectors copied."""
    ends = _asking(asks.select("dim", "block", "low", "high", "longest")).join(reached.select("dim", "q_block", "least"), ["dim", "q_block"])
    blocks = F.element_at(F.create_map(*(F.lit(x) for pair in count.items() for x in pair)), F.col("dim"))
    spread = ends.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = spread.join(base.select("dim", "block", "low", "high", "longest"), ["dim", "block"])
    gaps = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("q_low", "q_high"), lambda c, q: F.greatest(c["low"] - q["q_high"], q["q_low"] - c["high"]))
    apart = F.greatest(F.lit(0.0), F.coalesce(F.array_max(gaps), F.lit(0.0)))
    own = F.col("longest") + F.col("q_longest")
    return met.filter((own - apart * apart) / 2 + 1e-9 * own + 1 >= F.col("least")).select("dim", "block", "q_block")


def prepared_blocks(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, dict[int, np.ndarray], dict[int, int]]:
    """(candidate blocks, query blocks, pivots per length, candidate blocks per length)."""
    rows = vectors.select(quoted(id_col).alias("id"), scaled(quoted(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    rows = settle(rows.groupBy("id", "v").agg(F.max("asks").alias("asks"), F.count(F.lit(1)).alias("times")).withColumn("dim", F.size("v")))
    # PIVOTS rows per length of vector: those with the smallest hash of their id
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", F.xxhash64("v"))))
    of: dict[int, list] = {}
    for r in ranked.filter(F.col("r") <= PIVOTS).select("dim", "v").collect():
        of.setdefault(r["dim"], []).append(r["v"])
    pivots = {d: np.array(v, dtype=np.float64).reshape(len(v), d) for d, v in of.items()}
    # no more cells than full blocks: small blocks cost more than they drop
    full = {r["dim"]: -(-r["n"] // BLOCK_ROWS) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    celled = settle(_celled(rows, {d: p[: full[d]] for d, p in pivots.items()}))
    sizes = celled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).collect()
    base, count = _blocked(celled, {(r["dim"], r["cell"]): r["n"] for r in sizes}, BLOCK_ROWS)
    asks, _ = _blocked(celled.filter("asks"), {(r["dim"], r["cell"]): r["q"] for r in sizes}, QUERY_ROWS)
    return _packed(base, pivots), _packed(asks, pivots), pivots, count


def topk_search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest inner products of each query row with all other rows: query_id, rank, id_col, score (long)."""
    ship(vectors.sparkSession)
    base, asks, pivots, count = prepared_blocks(vectors, is_query, id_col, vector_col)
    known = reached_scores(base, asks, pivots, k)
    pairs = open_pairs(base, asks, known, count) if count else base.select("dim", "block", F.lit(0).alias("q_block"))
    names = ("ids", "times", "vectors", "table")
    q = _asking(asks.select("dim", "block", *names)).join(known.select("dim", "q_block", "reached"), ["dim", "q_block"])
    pairs = pairs.join(q, ["dim", "q_block"]).join(base.select("dim", "block", *names), ["dim", "block"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                many = len(pivots[r.dim])
                (ids, v, far), (q_ids, q, q_far) = _opened(r, "", many), _opened(r, "q_", many)
                times = np.minimum(np.frombuffer(r.times, "<i8"), k)
                for j, i in enumerate(q_ids.tolist()):
                    near, score, at, _ = best_of_block(q[j], q_far[j], i, v, far, ids, k, r.reached[j])
                    seal = int.from_bytes(hashlib.blake2b(q[j].tobytes(), digest_size=8).digest(), "little", signed=True)
                    yield pd.DataFrame({"query_id": i, "seal": seal, "id": np.repeat(near, times[at]), "score": np.repeat(score, times[at])})

    found = pairs.mapInPandas(search, "query_id long, seal long, id long, score long")
    order = Window.partitionBy("query_id", "seal").orderBy(F.col("score").desc(), F.col("id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
