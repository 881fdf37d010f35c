"""SRT subtitles as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from montage.functions.scalars import clean_text, timecode


# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gbk", "gb2312")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    def text(data: bytes) -> str:
        for name in ENCODINGS:
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue
        raise ValueError("the subtitles are in no known encoding")

    return content.map(text)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """media (path), seg_index, start, end, text of every cue with text. A byte-order mark is dropped.

    Files are UTF-8 or, where they are not, in the first of ENCODINGS that reads them; a file in none is an error.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("media"), F.regexp_replace(decoded("content"), "﻿|\r", "").alias("value"))
    cues = files.select("media", F.explode(F.split("value", r"\n\s*\n")).alias("cue"))
    pattern = r"(?s)^\s*(\d+)\s*\n\s*([\d:,.]+)\s*-->\s*([\d:,.]+)[^\n]*\n(.*)$"
    part = lambda i: F.regexp_extract("cue", pattern, i)
    rows = cues.filter(F.col("cue").rlike(pattern)).select("media", part(1).cast("int").alias("seg_index"), timecode(part(2)).alias("start"), timecode(part(3)).alias("end"), clean_text(part(4)).alias("text"))
    return rows.filter(F.col("text") != "")
