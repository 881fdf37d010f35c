"""The dialogue plan: segments with audio and a voice vector, their speakers, and the rows to export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from montage.functions.scalars import clean_text
from montage.operators import clusters, speakers
from montage.plans.checkpoints import settled

#: Seconds of audio under which a segment has no voice to tell.
SHORTEST = 0.5


def voiced(segments: DataFrame, voices: DataFrame) -> DataFrame:
    """Segments with text and at least SHORTEST seconds whose voice vector is there, with it.

    segments: media_id, seg_index, start, end, text; voices: media_id, seg_index, vector (may be null).
    """
    rows = segments.withColumn("text", clean_text(F.col("text"))).filter((F.col("text") != "") & (F.col("end") - F.col("start") >= SHORTEST))
    known = voices.filter(F.col("vector").isNotNull()).select("media_id", "seg_index", "vector")
    return rows.join(known, ["media_id", "seg_index"])


def dialogue(segments: DataFrame, voices: DataFrame, k: int | None = None) -> DataFrame:
    """media_id, speaker, seg_index, start, end, text of every voiced segment; speakers by average linkage per media."""
    some = settled(voiced(segments.select("media_id", "seg_index", "start", "end", "text"), voices))
    found = clusters.speaker_clusters(some.select("media_id", F.col("seg_index").cast("long").alias("frame_idx"), F.col("vector").alias("clip")), k)
    labels = found.select("media_id", F.col("frame_idx").alias("seg_index"), F.col("speaker_id").alias("speaker"))
    return settled(some.join(labels, ["media_id", "seg_index"]).select("media_id", "speaker", "seg_index", "start", "end", "text"))


def exports(segments: DataFrame, voices: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of speakers.exported with start and text: what the sinks write, a speaker after the other by start."""
    rows = dialogue(segments, voices, k)
    return speakers.exported(rows).join(rows.select("media_id", "seg_index", "start", "text"), ["media_id", "seg_index"])
