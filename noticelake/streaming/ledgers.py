"""Ledgers with a clock: state of a key in a stream, timers for what is due, expiry, once in a window.

``RetryLedger`` is a stateful processor with a value state and event-time timers: Spark keeps the state in its
checkpoint, restores it after a loss, and fires a timer when the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEDGER = "key string, n long, at timestamp, event string, status string, attempts int, next_retry_at timestamp"
#: What the processor passes on: times as microseconds, which need no time zone.
_OUT = "key string, n long, at long, event string, status string, attempts int, next_retry_at long"
_STATE = "attempts int, status string, at long, due long, wake long"
_LAST = 1 << 63
_Entry = Row("key", "n", "at", "event", "status", "attempts", "next_retry_at")


class RetryLedger(StatefulProcessor):
    """Attempts of a key in order of time.

    A failure adds one to the attempts and makes a retry due after ``base`` seconds, doubled each time up to ``most``; at
    ``limit`` attempts the key has failed.  A success sets it back.  Rows come out for each attempt (event ``attempt``), when
    a retry comes due (``due``) and when a key has not been heard of for ``ttl`` seconds and its state goes (``expired``).

    Rows and not frames go in and out, as most keys have few rows a batch.  The timer of the expiry (``wake``) stays where it
    is while attempts go on, and is set anew when it fires too early.
    """

    def __init__(self, base: int, most: int, limit: int, ttl: int):
        self.base, self.most, self.limit, self.ttl = base, most, limit, 1000 * ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("ledger", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = lambda x: _LAST if x is None else x
        batch = sorted(((r["us"], r["n"], r["ok"]) for r in rows), key=lambda r: (last(r[0]), last(r[1])))
        attempts, status, latest, before, wake = self.held.get() or (0, "", -1, -1, -1)
        out = []
        due = before
        for us, n, ok in batch:
            attempts = 0 if ok else attempts + 1
            status = "done" if ok else "failed" if attempts >= self.limit else "retry"
            due = -1
            if us is not None:
                ms = us // 1000
                latest = max(latest, ms)
                if status == "retry":
                    due = ms + 1000 * int(min(self.base * 2 ** min(attempts - 1, 16), self.most))
            out.append(_Entry(key[0], n, us, "attempt", status, attempts, 1000 * due if due >= 0 else None))
        if wake < 0:
            wake = latest + self.ttl
            self.handle.registerTimer(wake)
        if due != before:
            if before >= 0 and before != wake:
                self.handle.deleteTimer(before)
            if due >= 0:
                self.handle.registerTimer(due)
        self.held.update((attempts, status, latest, due, wake))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.held.get()
        if not state:
            return
        attempts, status, latest, due, wake = state
        at, now, expires = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), latest + self.ttl
        gone = at == wake and expires <= now
        if due == at or (gone and 0 <= due <= expires):  # a retry that is due before the key expires is told first
            yield _Entry(key[0], None, 1000 * due, "due", status, attempts, 1000 * due)
            if due != at:
                self.handle.deleteTimer(due)
            due = -1
        if gone:
            yield _Entry(key[0], None, 1000 * expires, "expired", status, attempts, None)
            self.held.clear()
            if due >= 0:
                self.handle.deleteTimer(due)
            return
        if at == wake:
            wake = expires
            self.handle.registerTimer(wake)
        self.held.update((attempts, status, latest, due, wake))

    def close(self) -> None:
        pass


def retry_ledger(attempts: DataFrame, base: int, most: int, limit: int, ttl: int, late: str = "0 seconds") -> DataFrame:
    """The ledger's rows (LEDGER) of a stream of ``attempts``: key, at (timestamp), ok, n (order of those at one time).

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    seen = attempts.select(F.col("key").cast("string").alias("key"), "at", F.unix_micros("at").alias("us"), "ok", F.col("n").cast("long").alias("n")).withWatermark("at", late)
    found = seen.groupBy("key").transformWithState(RetryLedger(base, most, limit, ttl), _OUT, "Append", "EventTime")
    return found.withColumns({"at": F.timestamp_micros("at"), "next_retry_at": F.timestamp_micros("next_retry_at")})


def once_in_window(requests: DataFrame, key: str, at: str, window: str) -> DataFrame:
    """The first request of a key in each window of event time, from a stream of ``requests``; later ones go.

    A request counts with the start of its window.  State is held until the watermark, ``window`` behind the newest
    request, has passed; requests that come later than that go.
    """
    start = F.window(at, window)["start"]
    seen = requests.withColumn("__start", start).withWatermark(at, window)
    return seen.dropDuplicatesWithinWatermark([key, "__start"]).drop("__start")
