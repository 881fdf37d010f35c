"""Streams in media time: rows carry the time of their frame, watermarks say which times are over, state waits for them.

State is kept by `transformWithState` processors, which need the RocksDB state store; `with_store` sets it.
A row counts if it comes before the watermark passes its time, in any order; later rows are dropped by Spark. What a
window or a place decides is sent once the watermark has passed it, so results are those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from montage.operators.shots import MIN_GAP

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """The state store that these operators need, for streams started later in this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


#: Where media begin: a day after the epoch, at which a watermark stands before it has seen any row.
START_MS = 86_400_000


def media_time(frame: Column, fps: Column) -> Column:
    """The time of a frame from the start of its media, as a timestamp of the day after the epoch."""
    return F.timestamp_millis(F.floor(frame * 1000 / fps).cast("long") + START_MS)


def second_of(frame: Column, fps: Column) -> Column:
    """The second whose frames, from floor(second * fps) on, hold this one."""
    return (F.ceil((frame + 1) / fps) - 1).cast("long")


class _Places(StatefulProcessor):
    """Places above the threshold wait in a list until their time is over; then they are kept or passed over in order."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "idx long")
        self.waiting = handle.getListState("waiting", "idx long, ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(i), int(ms)) for part in rows for i, ms in zip(part["idx"], part["ms"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(ms for _, ms in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs()
        places = sorted(tuple(p) for p in self.waiting.get())
        due, rest = [p for p in places if p[1] <= over], [p for p in places if p[1] > over]
        last, kept = self.last.get()[0] if self.last.exists() else 0, []
        for idx, _ in due:
            if idx - last > self.gap:
                kept.append(idx)
                last = idx
        self.last.update((last,))
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][1])
        if kept:
            yield pd.DataFrame({"media_id": [key[0]] * len(kept), "boundary": kept}).astype("int64")

    def close(self) -> None:
        pass


def late_boundaries(diffs: DataFrame, delay: str, gap: int = MIN_GAP) -> DataFrame:
    """media_id, boundary of a stream of change scores (media_id long, idx long, diff, threshold, at timestamp).

    Rows may be `delay` behind the newest of all media. A place is sent when the watermark has passed it: those above
    their threshold that are more than `gap` after the last one kept, in the order of places, from place 0 on.
    """
    above = diffs.withWatermark("at", delay).filter(F.col("diff") > F.col("threshold")).select("media_id", "idx", F.unix_millis("at").alias("ms"), "at")
    return above.groupBy("media_id").transformWithStateInPandas(_Places(gap), "media_id long, boundary long", "Append", "EventTime")


class _Best(StatefulProcessor):
    """The k rows of a window that come first by their draw; sent, and the state dropped, when the window is over."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", "draw string, idx long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(b) for b in self.best.get()]
        end = None
        for part in rows:
            end = int(part["over"].iloc[0])
            held = sorted({*held, *zip(part["draw"], (int(i) for i in part["frame_idx"]), strict=True)})[: self.k]
        self.best.put(held)
        if end is not None:
            self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = [int(i) for _, i in self.best.get()]
        self.best.clear()
        if held:
            yield pd.DataFrame({"media_id": [key[0]] * len(held), "second": [key[1]] * len(held), "frame_idx": held}).astype("int64")

    def close(self) -> None:
        pass


def draw(media: Column, frame: Column) -> Column:
    """What random frames are ordered by: a digest of media and frame."""
    return F.md5(F.concat_ws(":", media.cast("string"), frame.cast("string")))


def random_frame_stream(frames: DataFrame, k: int, delay: str) -> DataFrame:
    """media_id, second, frame_idx: k frames of each whole second of a stream of frames (media_id long, frame_idx long, fps, total).

    A tumbling window per media and second; its state is k rows. Frames of a last second that is not whole, and of media
    without a rate, are left out, and do not move the watermark. A frame that comes twice counts once.
    """
    rate = F.col("fps")
    timed = frames.filter(rate > 0).withColumns({"at": media_time(F.col("frame_idx"), rate), "second": second_of(F.col("frame_idx"), rate)}).withWatermark("at", delay)
    over = (F.col("second") + 1) * 1000 + START_MS
    whole = timed.filter(F.col("second") < F.floor(F.col("total") / rate))
    rows = whole.select("media_id", "second", "frame_idx", draw(F.col("media_id"), F.col("frame_idx")).alias("draw"), over.alias("over"), "at")
    return rows.groupBy("media_id", "second").transformWithStateInPandas(_Best(k), "media_id long, second long, frame_idx long", "Append", "EventTime")


def drained(writer: DataStreamWriter, seconds: int = 3600) -> None:
    """Run a stream over all that is there, until it ends; an error of the stream is raised."""
    query = writer.trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream did not end in {seconds} s")
