"""Keyed state that leaves: the promotion gate and the cool-down on live events.

Each key has one small row of state and one timer in event time. A key that is not promoted leaves once the watermark has passed
its last event by the time to live; a promoted one stays, whatever the pressure, since it names something that is already stored. A
text leaves the cool-down when the next one like it would be taken anyway, so forgetting it changes nothing.

Both need a state store that Spark's transformWithState supports; rocks() names one. Events that are later than the watermark
are dropped, so `late` bounds the disorder that is corrected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.ingest import COOLDOWN_NS, DWELL_NS, OCCURRENCES, TRACKED_TTL_NS

MS = 1_000_000


def rocks(spark: SparkSession) -> None:
    """Chooses the state store for streams that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch; the trigger bounds how many."""
    return pd.concat(list(rows)).sort_values(by)


class Timed(StatefulProcessor):
    """One row of state and at most one timer for each key."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", self.schema)

    def leave_at(self, t_ns: int) -> None:
        """The key's timer, at the first millisecond after t_ns."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(t_ns // MS + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Gate(Timed):
    schema = "seen long, dwell long, last_ns long"

    def __init__(self, occurrences: int, dwell_ns: int, idle_ns: int):
        self.occurrences, self.dwell_ns, self.idle_ns = occurrences, dwell_ns, idle_ns

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, dwell, last = self.state.get() if self.state.exists() else (0, 0, 0)
        own = in_order(rows, ["seq"])
        n, total = seen + own.occurrence.astype("int64").cumsum(), dwell + own.span.cumsum()
        promoted = (n >= self.occurrences) | (total > self.dwell_ns)
        last = max(last, int(own.t_ns.max()))
        self.state.update((int(n.iloc[-1]), int(total.iloc[-1]), last))
        if not promoted.iloc[-1]:
            self.leave_at(last + self.idle_ns)
        else:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        yield pd.DataFrame({"seq": own.seq, "app_id": key[0], "promoted": promoted})


class CoolDown(Timed):
    schema = "last_ns long"

    def __init__(self, gap_ns: int):
        self.gap_ns = gap_ns

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, taken = self.state.get()[0] if self.state.exists() else None, []
        for t in in_order(rows, ["t_ns"]).t_ns.tolist():
            if last is None or t - last > self.gap_ns:
                last = t
                taken.append(t)
        if taken:
            self.state.update((last,))
            self.leave_at(last + self.gap_ns)
            yield pd.DataFrame({"text": pd.Series([key[0]] * len(taken), dtype=object), "t_ns": taken})


def timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("at", F.timestamp_micros(F.floor(F.col("t_ns") / 1000))).withWatermark("at", late)


def gated(touches: DataFrame, occurrences: int = OCCURRENCES, dwell_ns: int = DWELL_NS, idle_ns: int = TRACKED_TTL_NS, late: str = "10 seconds") -> DataFrame:
    """(seq, app_id, promoted) of a stream of touches (seq, t_ns, app_id, occurrence, t_start_ns, t_end_ns), as operators.ingest.gated
    has them, until a key that is not promoted has been idle for more than idle_ns of event time: it then begins anew."""
    span = F.greatest(F.coalesce(F.col("t_end_ns") - F.col("t_start_ns"), F.lit(0)), F.lit(0))
    rows = timed(touches.select("seq", "t_ns", "app_id", "occurrence", span.alias("span")), late)
    return rows.groupBy("app_id").transformWithStateInPandas(Gate(occurrences, dwell_ns, idle_ns), "seq long, app_id string, promoted boolean", "Append", "EventTime")


def cooled(rows: DataFrame, gap_ns: int = COOLDOWN_NS, late: str = "10 seconds") -> DataFrame:
    """(text, t_ns) of a stream of (text, t_ns) that operators.ingest.cooled keeps: a text is taken only if more than gap_ns after
    the last time that it was."""
    known = timed(rows.where("t_ns IS NOT NULL").select("text", F.col("t_ns").cast("long").alias("t_ns")), late)
    return known.groupBy("text").transformWithStateInPandas(CoolDown(gap_ns), "text string, t_ns long", "Append", "EventTime")
