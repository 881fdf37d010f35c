"""A training-data pipeline: five stages over `documents`, each calling one operator of montage.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Defined cases, in every stage: an empty table gives no rows; null texts count as empty; extra columns are kept, whatever
their names, but for the last stage. quality judges repeated and empty texts as any other; line_dedup keeps every row but
those of whose words none is left, mix every row; near_duplicates keeps rows without an id and empty texts, and one of rows equal in id and text; pack gives every row
at least one piece, its closing id.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from montage.llm import line_dedup as lines
from montage.llm import mixing, ngram_join, quality_classifier
from montage.llm.common import BLANK, as_text, checkpoint_dir, free, partitions, quoted
from montage.llm.queries import pieces, read

#: Documents of the mixture that are packed along the curve together: the mixture holds from run to run.
RUN = 16 * mixing.BLOCK


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Learns from labelled documents outside the held-out fifth."""
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"), ~quality_classifier.held_out(F.col("doc_id")))
    (score,) = free(docs, "score")
    return quality_classifier.score(docs, model, score_col=score).filter(F.col(score) >= quality_classifier.THRESHOLD).select(*map(quoted, docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows; those of which nothing is left go.

    Texts that had no words to begin with stay.
    """
    (full,) = free(docs, "full")
    has_words = as_text("text").rlike(f"[^{BLANK}]")
    cut = lines.line_dedup(docs.withColumn(full, has_words))
    return cut.filter(has_words | ~F.col(full)).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Rows without an id stay. Of rows equal in id and text one stays.
    """
    groups = ngram_join.ngram_components(docs)
    first, key = free(docs, "first", "key")
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(first)).distinct()
    named = docs.join(kept, F.col("doc_id") == F.col(first), "left_semi").withColumn(key, F.xxhash64("text"))
    named = named.dropDuplicates(["doc_id", key]).drop(key)
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes their sources to tempered weights."""
    mixed = mixing.mix_sources(docs, mixing.tempered_weights(docs))
    # twice the input's splits: their bytes bound a partition's, whatever the shuffle's setting
    parts = max(partitions(spark), 2 * docs.rdd.getNumPartitions())
    return mixed.repartitionByRange(parts, "mix_at").sortWithinPartitions("mix_at").select(*map(quoted, docs.columns))


def part_number(path: str) -> tuple[int, str]:
    """What orders part files: their number, which may have more digits than the five that names are filled to."""
    name = path.rsplit("/", 1)[-1]
    found = re.match(r"part-(\d+)", name)
    return (int(found[1]) if found else -1, path)


def written_place(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """`docs` plus `name`, each row's number (long, from 0) in the order in which its files were written.

    Part files are numbered in the order of the partitions that wrote them. One row per file reaches the driver. Rows that
    were not read from files have no such order: they get the places that `mix` would give them.
    """
    file, row, at, before = free(docs, "file", "row", "at", "before")
    try:
        placed = docs.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    except AnalysisException:
        mixed = mixing.mix_sources(docs, mixing.tempered_weights(docs))
        return mixed.select(*map(quoted, docs.columns), F.col("mix_at").alias(name))
    starts, n = [], 0
    for path, last in sorted(map(tuple, placed.groupBy(file).agg(F.max(row)).collect()), key=lambda r: part_number(r[0])):
        starts.append((path, n))
        n += last + 1
    files = spark.createDataFrame(starts, f"{at} string, {before} long")
    placed = placed.join(F.broadcast(files), F.col(file) == F.col(at))
    return placed.select(*map(quoted, docs.columns), (F.col(before) + F.col(row)).alias(name))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens: runs of RUN documents in the mixture's order, each along the curve."""
    place, run = free(docs, "place", "run")
    placed = written_place(spark, docs, place)
    return pieces(placed.withColumn(run, F.floor(F.col(place) / RUN)), run)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: The classifier, the hashed joins and the packing can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared checkpoint folder and read again."""
    docs, folder = read(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
