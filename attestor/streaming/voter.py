"""The history vote over a stream of ids, with state for each session.

Needs the RocksDB state store (``rocksdb``); Spark's arbitrary state needs it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session long, seq long, printed_id string, confidence double, status string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    """Makes queries that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def vote(history: list[tuple[str, float]], least: int) -> tuple[str | None, float, str]:
    """The verdict over a history: id, confidence and status."""
    ids = [i for i, _ in history]
    best = max(dict.fromkeys(ids), key=ids.count)  # of equals the first
    n = ids.count(best)
    if n >= least:
        return best, round(sum(c for i, c in history if i == best) / n, 6), "accepted"
    return (best, 0.5, "ambiguous") if n == 2 else (None, 0.0, "rejected")


class History(StatefulProcessor):
    """The last ``most`` admitted votes of a session, as a list; forgotten ``expire`` milliseconds after the last one."""

    def __init__(self, least: int, most: int, expire: int | None, timed: bool):
        self.least, self.most, self.expire, self.timed = least, most, expire, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lasting = {"ttlDurationMs": self.expire} if self.expire is not None and not self.timed else {}
        self.votes = handle.getListState("votes", "printed_id string, confidence double, ms long", **lasting)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        history = [(r[0], r[1], r[2]) for r in self.votes.get()] if self.votes.exists() else []
        for r in sorted(rows, key=lambda r: r["seq"]):
            if self.timed and history and r["_ms"] - history[-1][2] > self.expire:
                history = []  # the watermark comes later than the vote that shows the silence
            history = [*history, (r["printed_id"], float(r["confidence"]), r["_ms"])][-self.most :]
            yield Row(session=key[0], seq=r["seq"], **dict(zip(("printed_id", "confidence", "status"), vote([h[:2] for h in history], self.least))))
        self.votes.put(history)
        if self.timed:
            timers = list(self.handle.listTimers())
            until = max([max(h[2] for h in history) + self.expire, *timers])
            for t in timers:
                if t != until:
                    self.handle.deleteTimer(t)
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.votes.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_votes(votes: DataFrame, least: int = 3, most: int = 10, quality: float = 50.0, expire: str | None = None, time_col: str | None = None) -> DataFrame:
    """A streaming DataFrame of votes (session, seq, printed_id, confidence, frame_quality) as verdicts.

    State is kept for each session: the last ``most`` admitted votes. Votes of one micro-batch are taken
    in the order of ``seq``. With ``expire`` (such as "10 minutes") the history of a session that is silent
    for that long is forgotten, so state doesn't grow with all sessions ever seen: by event time where
    ``time_col`` names a column with a watermark (then a timer waits for the watermark), else by the clock
    (then the votes have a time to live).
    """
    rocksdb(votes.sparkSession)
    timed = expire is not None and time_col is not None
    admitted = votes.where(votes.printed_id.isNotNull() & (votes.frame_quality >= quality))
    ms = f"unix_millis({time_col})" if timed else "0L"
    rows = admitted.selectExpr("session", "seq", "printed_id", "confidence", f"{ms} AS _ms", *([time_col] if timed else []))
    mode = "EventTime" if timed else "ProcessingTime" if expire is not None else "None"
    processor = History(least, most, None if expire is None else milliseconds(expire), timed)
    return rows.groupBy("session").transformWithState(processor, OUTPUT, "Append", mode)
