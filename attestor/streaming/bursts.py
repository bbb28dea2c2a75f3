"""Bursts of frames as a stream: each burst's consensus once it has ended.

A camera's frames wait in its state until the watermark has passed them; from then on nothing can come
before them, so bursts are cut in the order of event time, whatever the order of arrival. A burst ends
with a gap, or with its last frame that fits. State holds the frames that wait and those of the open burst,
which are no more than fit in one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.consensus import AGREE
from .voter import milliseconds, rocksdb

_FRAME = "ms long, frame_no long, reason string, quality double, name string, hp int, printed_id string"
_RESULT = (
    "camera {}, burst_start_ms long, n_frames long, n_passed long, best_frame long, name string, hp int, printed_id string, "
    "name_agreement double, hp_agreement double, id_agreement double"
)
_SUFFIXES = (" ex", " gx", " v", " vmax", " vstar")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits for the places of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def alike(a: str, b: str) -> float:
    """The indel similarity of two bare names, from 0 to 1, in whole percent with halves to even."""
    if not a or not b:
        return 0.0
    return round(200 * common_length(a, b) / (len(a) + len(b))) / 100


def _most(values: list):
    """The most frequent value and its count; of equals the first."""
    best = max(dict.fromkeys(values), key=values.count, default=None)
    return best, values.count(best) if values else 0


def consensus(frames: list[tuple]) -> dict | None:
    """What a burst's frames (of _FRAME, in order) agree on, as ``operators.consensus.burst_consensus`` has it; None if no frame passes."""
    passed = [f for f in frames if f[2] is None]
    if not passed:
        return None
    names = [f[4] for f in passed if f[4] is not None]
    bare = {n: "".join(c for c in n.lower() if "a" <= c <= "z") for n in names}
    rated = []
    for first, n in enumerate(dict.fromkeys(names)):
        scores = [alike(bare[n], bare[m]) for m in names]
        # the sums of SQL are rounded alike, so equal means stay equal
        rated.append((round(sum(scores) / len(names), 9), n.lower().endswith(_SUFFIXES), -first, n, round(sum(s >= AGREE for s in scores) / len(names), 9)))
    best = max(rated, default=None)
    hp, n_hp = _most([f[5] for f in passed if f[5] is not None])
    printed, n_id = _most([f[6] for f in passed if f[6] is not None])
    agreement = 0.0 if best is None else 1.0 if len(names) == 1 else best[4]
    return {
        "n_frames": len(frames), "n_passed": len(passed), "best_frame": max(passed, key=lambda f: (f[3], -f[1]))[1], "name": best and best[3], "hp": hp, "printed_id": printed,
        "name_agreement": round(agreement * len(names) / len(passed), 6), "hp_agreement": round(n_hp / len(passed), 9), "id_agreement": round(n_id / len(passed), 9),
    }


class Bursts(StatefulProcessor):
    """The frames of a camera that wait for the watermark or for their burst's end."""

    def __init__(self, gap: int, most: int):
        self.gap, self.most = gap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", _FRAME)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()  # what is not after it has been decided
        new = [(r["ms"], r["frame_no"], r["reason"], r["quality"], r["name"], r["hp"], r["printed_id"]) for r in rows if r["ms"] > now]
        if new:
            self.frames.appendList(new)
            self._wait(new, now)
        return iter(())

    def _wait(self, frames: list[tuple], now: int) -> None:
        """One timer, for when the next of the frames that wait can be decided."""
        timers = list(self.handle.listTimers())
        due = min([*(max(f[0], now) + self.gap + 1 for f in frames), *timers], default=None)
        for t in timers:
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(f) for f in self.frames.get())
        burst: list[tuple] = []
        done = 0
        for k, f in enumerate(held):
            if f[0] > now:
                break
            if burst and f[0] - burst[-1][0] > self.gap:
                yield from self._row(key, burst)
                burst, done = [], k
            burst.append(f)
            if len(burst) == self.most:
                yield from self._row(key, burst)
                burst, done = [], k + 1
        if burst and burst[-1][0] + self.gap < now:
            yield from self._row(key, burst)
            done += len(burst)
        left = held[done:]
        if left:
            self.frames.put(left)
            due = min((f[0] + self.gap + 1 for f in left if f[0] + self.gap + 1 > now), default=now + self.gap + 1)
            self.handle.registerTimer(due)
        else:
            self.frames.clear()

    def _row(self, key, burst: list[tuple]) -> Iterator[Row]:
        found = consensus(burst)
        if found is not None:
            yield Row(camera=key[0], burst_start_ms=burst[0][0], **found)

    def close(self) -> None:
        pass


def stream_bursts(frames: DataFrame, gap: str = "5 seconds", late: str = "10 seconds", most: int = 20) -> DataFrame:
    """Bursts of a stream of frames (camera, ts, frame_no, reason, quality, name, hp, printed_id): one row for each that has ended and of which a frame passes.

    A camera's burst ends when no frame comes for ``gap`` of event time, or with ``most`` frames; frames
    later than ``late`` are dropped. Rows (camera, burst_start and what ``consensus`` has).
    """
    rocksdb(frames.sparkSession)
    timed = frames.withWatermark("ts", late).selectExpr("camera", "ts", "unix_millis(ts) AS ms", "CAST(frame_no AS LONG) AS frame_no", "reason", "quality", "name", "CAST(hp AS INT) AS hp", "printed_id")
    result = _RESULT.format(frames.schema["camera"].dataType.simpleString())
    found = timed.groupBy("camera").transformWithState(Bursts(milliseconds(gap), most), result, "Append", "EventTime")
    rest = [c for c in found.columns if c not in ("camera", "burst_start_ms")]
    return found.selectExpr("camera", "timestamp_millis(burst_start_ms) AS burst_start", *rest)
