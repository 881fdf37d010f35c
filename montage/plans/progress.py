"""Progress of plans and streams: rows per stage, seen by observed metrics while the work is done."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from montage.plans.checkpoints import settled

SCHEMA = "step long, stage string, rows long, percent long, seconds double"


@dataclass(frozen=True)
class Step:
    step: int
    stage: str
    rows: int
    percent: int
    seconds: float


@dataclass
class Progress:
    """The stages of a plan as they end. `told` is called with each Step while the plan goes on; an error it raises ends the plan.

    A plan calls `settle` once per stage; a stage's rows are counted by an observed metric in the very job that writes
    them. Stages beyond the announced `steps` stay at 100 percent.
    """

    steps: int
    told: Callable[[Step], None] | None = None
    log: list[Step] = field(default_factory=list)

    def settle(self, stage: str, df: DataFrame) -> DataFrame:
        seen, start = Observation(), time.monotonic()
        out = settled(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        step = len(self.log) + 1
        done = Step(step, stage, seen.get["rows"], min(100, 100 * step // self.steps), round(time.monotonic() - start, 3))
        self.log.append(done)
        if self.told:
            self.told(done)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """step, stage, rows, percent, seconds of the stages that are done."""
        return spark.createDataFrame([tuple(asdict(s).values()) for s in self.log], SCHEMA)


def settle(progress: Progress | None, stage: str, df: DataFrame) -> DataFrame:
    return settled(df) if progress is None else progress.settle(stage, df)


class StreamProgress(StreamingQueryListener):
    """Steps of streams as their micro-batches end: the stage is the stream's name, rows are those that came in.

    `of` limits it to streams of these names. percent is that of `expected` rows, 0 where it is not given. Metrics that the
    stream observes are kept in `observed`, by batch. Add it with spark.streams.addListener.
    """

    def __init__(self, *of: str, expected: int | None = None, told: Callable[[Step], None] | None = None):
        self.of, self.expected, self.told = of, expected, told
        self.log: list[Step] = []
        self.observed: list[dict] = []

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        if self.of and p.name not in self.of:
            return
        before = sum(s.rows for s in self.log if s.stage == p.name)
        percent = min(100, 100 * (before + p.numInputRows) // self.expected) if self.expected else 0
        done = Step(p.batchId, p.name or str(p.id), p.numInputRows, percent, p.batchDuration / 1000)
        self.log.append(done)
        self.observed.append({k: v.asDict() for k, v in p.observedMetrics.items()})
        if self.told:
            self.told(done)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass
