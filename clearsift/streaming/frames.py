"""Which frame a capture takes, decided as frames arrive: state and timers for slots of captures."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clearsift.streaming.listing import ROCKS

CAPTURES = "capture_id long, ts timestamp, frame_id long"
CHOSEN = "capture_id long, frame_id long, at_ms long, n_frames int, is_fallback boolean"
SLOTS = 1024
_PACKED = "slot long, ts timestamp, captures array<long>, ms array<long>, frames array<long>"


@dataclass(frozen=True)
class FrameRules:
    """Milliseconds after the request: frames count from `delay` on, are waited for until `limit`, and `extra` longer once."""

    delay: int
    limit: int
    extra: int

    @property
    def end(self) -> int:
        return self.limit + self.extra


class FrameChoice(StatefulProcessor):
    """Until the delay the latest frame is kept, and taken when the delay is over; else the first frame after it is taken, if need be a forced one.

    A key is a slot of captures: each call of the state costs a round trip, so that a slot's undecided captures are read and written together, as
    one value, and have one timer, for the first of them that is due. Rows come in packs of a slot. A decided capture is dropped. By event
    time, out-of-order frames count until the watermark passes the time a capture is due, and rows from before the watermark of the slot's
    last decisions are late; by processing time, a frame's own clock is the time it arrives at.
    """

    def __init__(self, rules: FrameRules, by_event_time: bool):
        self.rules, self.by_event_time = rules, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "captures string, settled long")

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()

    def _read(self) -> tuple[dict[int, list], int | None]:
        """Of each undecided capture: time of the request, kept frame and its time, next frame and its time, number of frames. Until when rows are late."""
        captures, settled = self.open.get() or ("[]", None)
        return {capture: state for capture, *state in json.loads(captures)}, settled

    def _due(self, state: list) -> int:
        """The check at which the capture is decided, if no more frames come: at the delay, at the limit or at the end."""
        asked, _, kept_at, _, next_at, _ = state
        if next_at is not None and not self.by_event_time:  # a frame after the delay is taken at once
            return asked
        if kept_at is not None or (next_at is not None and next_at <= self.rules.delay):
            return asked + self.rules.delay
        return asked + (self.rules.limit if next_at is not None and next_at <= self.rules.limit else self.rules.end)

    def _first_due(self, captures: dict[int, list]) -> int | None:
        return min(map(self._due, captures.values()), default=None)

    def _add(self, state: list, ms: int, frame_id: int) -> None:
        at = ms - state[0]
        if not 0 <= at <= self.rules.end:
            return
        state[5] += 1
        if at < self.rules.delay:
            if state[2] is None or (at, frame_id) >= (state[2], state[1]):
                state[1], state[2] = frame_id, at
        elif state[4] is None or (at, frame_id) < (state[4], state[3]):
            state[3], state[4] = frame_id, at

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        (captures, settled), now = self._read(), self._now(timerValues)
        timer, asked, early = self._first_due(captures), {}, {}
        for capture, ms, frame_id in (r for pack in rows for r in zip(pack.captures, pack.ms, pack.frames)):
            if not self.by_event_time:
                ms = now
            elif settled is not None and ms <= settled:
                continue
            if frame_id is None:
                asked[capture] = min(ms, asked.get(capture, ms))
            elif capture in captures:
                self._add(captures[capture], ms, frame_id)
            else:  # its request may follow in this batch; else it is not asked for, or decided already
                early.setdefault(capture, array("q")).extend((ms, frame_id))
        for capture in asked.keys() - captures.keys():
            state = captures[capture] = [asked[capture], None, None, None, None, 0]
            times = iter(early.get(capture, ()))
            for ms, frame_id in zip(times, times):
                self._add(state, ms, frame_id)
        return iter(self._settle(captures, settled, timer, now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return iter(self._settle(*self._read(), None, self._now(timerValues)))  # the timer is dropped after this

    def _settle(self, captures: dict[int, list], settled: int | None, timer: int | None, now: int) -> list[Row]:
        """Decides the captures that are due, keeps the others and sets the slot's timer, if it is not the one it has."""
        due = [capture for capture, state in captures.items() if self._due(state) <= now]
        decided = [self._decide(capture, captures.pop(capture)) for capture in due]
        if captures or due:
            self.open.update((json.dumps([(capture, *state) for capture, state in captures.items()]), now if due else settled))
        first = self._first_due(captures)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        return decided

    def _decide(self, capture: int, state: list) -> Row:
        """The frame that came just when the delay was over, else the kept one, else the next, else none."""
        exact = state[4] == self.rules.delay
        frame, at = (state[3], state[4]) if exact or state[1] is None else (state[1], state[2])
        return Row(capture_id=capture, frame_id=frame, at_ms=at, n_frames=state[5], is_fallback=at is None or at > self.rules.limit)

    def close(self) -> None:
        pass


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each slot in an Arrow batch as one row."""
    for batch in batches:
        packed = pa.Table.from_batches([batch]).group_by("slot").aggregate([("ts", "max"), ("capture_id", "list"), ("ms", "list"), ("frame_id", "list")])
        yield from packed.select(["slot", "ts_max", "capture_id_list", "ms_list", "frame_id_list"]).rename_columns(["slot", "ts", "captures", "ms", "frames"]).to_batches()


def choose_frames(captures: DataFrame, rules: FrameRules, lateness: str = "1 day", by_event_time: bool = True, slots: int = SLOTS) -> DataFrame:
    """One row for each capture of a stream (capture_id, ts, frame_id; a request has no frame_id) once its frame is certain.

    `is_fallback` says that none came before the limit; frame_id is null if none came at all. By event time, rows
    may be out of order by `lateness`, but that a request comes in no later batch than its frames. What comes for a decided
    capture changes nothing. Captures are dealt over `slots` by their id, for as long as the checkpoint lives: a task holds the
    undecided captures of one slot.
    """
    captures.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    slot = F.pmod(F.xxhash64("capture_id"), F.lit(slots)).alias("slot")
    rows = captures.select(slot, F.col("capture_id").cast("long"), "ts", F.unix_millis("ts").alias("ms"), "frame_id")
    rows = rows.repartition("slot").mapInArrow(_packs, _PACKED)  # a row costs Python far more than a place in an array
    if by_event_time:
        rows = rows.withWatermark("ts", lateness)
    return rows.groupBy("slot").transformWithState(FrameChoice(rules, by_event_time), CHOSEN, "Append", "EventTime" if by_event_time else "ProcessingTime")


def take_frames(spark: SparkSession, source: str, target: str, rules: FrameRules, lateness: str = "1 day", state_partitions: int | None = None) -> None:
    """Chooses frames of the captures (capture_id, ts, frame_id) that came to a folder since the last call with this target, as one batch.

    A new target's state has `state_partitions`, else two for each core that Spark counts on (no more than it shuffles into).
    """
    stream = spark.readStream.schema(CAPTURES).parquet(source)
    shuffled, target = spark.conf.get("spark.sql.shuffle.partitions"), target.rstrip("/")
    spark.conf.set("spark.sql.shuffle.partitions", state_partitions or min(int(shuffled), 2 * spark.sparkContext.defaultParallelism))
    try:  # the query copies the settings when it starts
        writer = choose_frames(stream, rules, lateness).writeStream.format("parquet").option("path", target)
        query = writer.option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    try:
        query.awaitTermination()
    finally:
        query.stop()


def choose_frames_at_rest(captures: DataFrame, rules: FrameRules) -> DataFrame:
    """The same over a finished table, by grouping."""
    asked = captures.filter("frame_id IS NULL").groupBy("capture_id").agg(F.min(F.unix_millis("ts")).alias("_asked"))
    frames = captures.filter("frame_id IS NOT NULL").select("capture_id", "frame_id", F.unix_millis("ts").alias("_ms"))
    at = F.col("_ms") - F.col("_asked")
    known = asked.join(frames, "capture_id", "left").withColumn("at_ms", F.when(at.between(0, rules.end), at))
    pair = F.struct("at_ms", "frame_id")
    early, late, exact = F.col("at_ms") < rules.delay, F.col("at_ms") >= rules.delay, F.col("at_ms") == rules.delay
    best = known.groupBy("capture_id").agg(F.min(F.when(exact, pair)).alias("e"), F.max(F.when(early, pair)).alias("k"), F.min(F.when(late, pair)).alias("l"), F.count("at_ms").cast("int").alias("n_frames"))
    taken = best.withColumn("t", F.coalesce("e", "k", "l"))
    return taken.select("capture_id", F.col("t.frame_id").alias("frame_id"), F.col("t.at_ms").alias("at_ms"), "n_frames", F.coalesce(F.col("t.at_ms") > rules.limit, F.lit(True)).alias("is_fallback"))
