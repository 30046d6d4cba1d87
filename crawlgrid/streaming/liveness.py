"""Node liveness from heartbeat streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crawlgrid.streaming.runner import EVENT_TIME, Waiting, event_time, millis, timed_state


def node_liveness_stream(beats: DataFrame, gap: str = "60 seconds", delay: str = "1 hour") -> DataFrame:
    """Heartbeats → online periods per node (session windows): a period
    ends ``gap`` after its last beat, and a silence of exactly ``gap`` opens a
    new period. Append mode: a period is emitted once the watermark passes
    its end, so only closed periods appear."""
    b = event_time(beats, "ts", delay)
    return (b.groupBy(F.session_window(EVENT_TIME, gap).alias("w"), "node_id")
            .agg(F.count(F.lit(1)).alias("beats"))
            .select("node_id", F.col("w.start").cast("timestamp_ntz").alias("online_from"),
                    F.col("w.end").cast("timestamp_ntz").alias("offline_at"), "beats"))


STATE_OUT = "node_id long, event string, at timestamp"


class NodeStates(StatefulProcessor):
    """Beats wait until the watermark has passed them; all that it has passed are
    taken at once. The node's own state is its last beat, if it is online, the
    time of its timer, the next at which there is something to do, and where
    its beats wait."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beats = Waiting(handle)
        self.node = handle.getValueState("node", "last long, timer long, entries array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted({ms for frame in rows for ms in millis(frame[EVENT_TIME]).tolist()})
        last, timer, entries = self.node.get() or (None, None, [])
        if timer is None or times[0] + 1 < timer:
            timer = times[0] + 1
            self.handle.registerTimer(timer)
        self.node.update((last, timer, self.beats.put(entries, times)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, timer, entries = self.node.get() or (None, None, [])
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return  # an earlier one took its place
        mark = max(timer, timerValues.getCurrentWatermarkInMs())
        due, entries = self.beats.take(entries, mark)
        events = []
        for at in due:
            if last is not None and at >= last + self.gap_ms:
                events.append(("offline", last + self.gap_ms))
                last = None
            if last is None:
                events.append(("online", at))
            last = at
        if last is not None and last + self.gap_ms < mark:
            events.append(("offline", last + self.gap_ms))
            last = None
        waits = [*entries, *([] if last is None else [last + self.gap_ms])]
        if waits:  # at the mark or later, so due in a later batch
            self.handle.registerTimer(min(waits) + 1)
            self.node.update((last, min(waits) + 1, entries))
        else:
            self.node.clear()
        if events:
            yield pd.DataFrame({"node_id": [key[0]] * len(events), "event": [e for e, _ in events], "at": pd.to_datetime([t for _, t in events], unit="ms")})

    def close(self) -> None:
        pass


def node_state_stream(beats: DataFrame, gap_seconds: int = 60, delay: str = "1 hour") -> DataFrame:
    """Online / offline transition events per node.

    Beats are taken in order of time once the watermark has passed them (no
    earlier one can arrive then), so the result doesn't depend on how the feed
    is cut into micro-batches. A node goes offline at last beat + gap; a beat
    at that very time or later opens a new period."""
    b = event_time(beats, "ts", delay).select("node_id", EVENT_TIME)
    return (timed_state(b, "node_id", NodeStates(gap_seconds * 1000), STATE_OUT)
            .select("node_id", "event", F.col("at").cast("timestamp_ntz").alias("at")))
