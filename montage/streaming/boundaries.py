"""Shot boundaries of a stream of change scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from montage.operators.shots import MIN_GAP


def boundary_stream(diffs: DataFrame, threshold: float, gap: int = MIN_GAP) -> DataFrame:
    """media_id, boundary of scores (media_id long, idx long, diff) above `threshold`, over `gap` after the last one kept.

    The state of a media is the last place kept, 0 at first (0 itself is not sent). Rows may come in any order inside a
    micro-batch; a row that comes after a later place was kept is not taken up.
    """

    def step(key: tuple[int], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        kept = []
        for idx in sorted(i for part in parts for i in part["idx"]):
            if idx - last > gap:
                kept.append(idx)
                last = idx
        state.update((int(last),))
        yield pd.DataFrame({"media_id": [key[0]] * len(kept), "boundary": kept}).astype("int64")

    above = diffs.filter(diffs["diff"] > threshold).select("media_id", "idx")
    return above.groupBy("media_id").applyInPandasWithState(step, "media_id long, boundary long", "last long", "append", GroupStateTimeout.NoTimeout)
