"""Reading back what runs have written: listings, folder sizes, metadata, reports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"
KEYFRAMES = "keyframes array<struct<shot_id: long, confidence: double>>"
# The lines of a log that carry a figure, and the figure in them.
LOG = {
    "keyframes": (("成功提取", "关键帧"), r"(\d+)\s*个.*关键帧"),
    "shots": (("覆盖镜头数",), r"(\d+)"),
    "confidence": (("平均置信度",), r"(\d+\.\d+)"),
}


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length of the files below `path`; contents are not read."""
    files = spark.read.schema(FILES).format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length")


def run_of(path: str | Column) -> Column:
    """The folder that a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def folder_sizes(files: DataFrame) -> DataFrame:
    """run, files, megabytes of each folder."""
    return files.groupBy(run_of("path").alias("run")).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("length") / 1048576, 2).alias("megabytes"))


def tree_sizes(files: DataFrame, root: str) -> DataFrame:
    """folder (path below `root`, "" for itself), files, bytes of each folder with all that lies below it, however deep."""
    below = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    parts = files.select("length", F.slice(below, F.lit(1), F.size(below) - 1).alias("parts"))
    folders = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/"))
    each = parts.select("length", F.explode(folders).alias("folder"))
    return each.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """run, shots_covered, avg_confidence of each run folder below `path`.

    From metadata.json; from keyframes.csv where that gives no shots, and its confidence where that gives none. Broken
    files count as missing ones. A run with neither gives no row.
    """
    meta = spark.read.schema(KEYFRAMES).option("multiLine", True).option("pathGlobFilter", "metadata.json").option("recursiveFileLookup", True).json(path)
    meta = meta.select(run_of(F.input_file_name()).alias("run"), F.explode_outer("keyframes").alias("k"))
    meta = meta.groupBy("run").agg(F.count_distinct(F.coalesce("k.shot_id", F.when(F.col("k").isNotNull(), 0))).alias("shots"), F.avg(F.when(F.col("k").isNotNull(), F.coalesce("k.confidence", F.lit(0.0)))).alias("mean"))
    rows = spark.read.option("header", True).option("pathGlobFilter", "keyframes.csv").option("recursiveFileLookup", True).csv(path)
    for name in ("shot_id", "confidence"):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("string"))
    rows = rows.select(run_of(F.input_file_name()).alias("run"), F.coalesce("shot_id", F.lit("0")).alias("shot_id"), F.expr("try_cast(confidence AS double)").alias("confidence"))
    rows = rows.groupBy("run").agg(F.count_distinct("shot_id").alias("csv_shots"), F.avg("confidence").alias("csv_mean"))
    both = meta.join(rows, "run", "full")
    seen = lambda c: F.nullif(F.col(c), F.lit(0))
    mean = F.when(F.coalesce(seen("shots"), F.lit(0)) > 0, F.col("mean")).otherwise(F.coalesce(seen("mean"), "csv_mean"))
    return both.select("run", F.coalesce(seen("shots"), "csv_shots", F.lit(0)).alias("shots_covered"), F.round(F.coalesce(mean, F.lit(0.0)), 3).alias("avg_confidence"))


def log_figures(line: Column) -> dict[str, Column]:
    """The figures of a log line by name, null where the line has none. The first kind that fits a line counts."""
    out, before = {}, F.lit(False)
    for name, (marks, pattern) in LOG.items():
        fits = F.lit(True)
        for mark in marks:
            fits = fits & line.contains(mark)
        found = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
        out[name] = F.when(fits & ~before, found).cast("double" if name == "confidence" else "long")
        before = before | fits
    return out


def logs(spark: SparkSession, path: str) -> DataFrame:
    """run (file), keyframes, shots, confidence of each log: the largest figure of a kind, 0 without any."""
    lines = spark.read.text(path).select(F.input_file_name().alias("run"), "value")
    figures = log_figures(F.col("value"))
    return lines.groupBy("run").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(name) for name, c in figures.items()))
