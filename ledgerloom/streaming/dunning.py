"""Dunning over a stream of charge attempts (*spec*): state per billing cycle, with event-time timers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.settlement import CANCEL_AFTER_DAYS, PAUSE_AFTER_DAYS, RETRY_HOURS

# Times are microseconds and days since 1970, so that no time zone of a worker matters.
OUTPUT = "subscription_id string, cycle_start int, state string, failures int, changed_at bigint"
_STATE = "cycles array<struct<cycle_start: int, failures: int, paid: boolean, last_failure: bigint>>"
# Workers receive the processor itself, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_DAY_MS = 24 * 3600 * 1000


def _state_of(failures: int, paid: bool) -> str:
    return "PAID" if paid else "RETRYING" if failures <= len(RETRY_HOURS) else "HELD"


def _timers(failures: int, paid: bool, last_failure: int | None) -> list[int]:
    """When a cycle pauses and is cancelled, in milliseconds; only a held one is."""
    if _state_of(failures, paid) != "HELD" or last_failure is None:
        return []
    return [last_failure // 1000 + days * _DAY_MS for days in (PAUSE_AFTER_DAYS, CANCEL_AFTER_DAYS)]


class DunningProcessor(StatefulProcessor):
    """Counts failures of each cycle; when retries are used up, timers pause and then cancel it.

    Every call to the state is a message to the JVM, which costs more than all else. So the cycles of a subscription that
    begin in one month share a state, 31 at most, which is read once and written once in a batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("cycles", _STATE)

    def _cycles(self) -> dict:
        stored = self.stored.get()
        return {start: (failures, paid, last) for start, failures, paid, last in stored[0]} if stored else {}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self._cycles()
        cycles, newest = dict(before), {}
        for row in rows:
            start, at = row.cycle_start, row.attempted_at
            failures, paid, last = cycles.get(start, (0, False, None))
            if row.succeeded:
                paid = True
            elif row.succeeded is not None:
                failures += 1
                last = at if last is None or at is not None and at > last else last
            cycles[start] = (failures, paid, last)
            seen = newest.get(start)
            newest[start] = at if seen is None or at is not None and at > seen else seen
        self.stored.update(([(start, *cycle) for start, cycle in cycles.items()],))
        due = {t for start in newest for t in _timers(*cycles[start])}
        if old := {t for start in newest if start in before for t in _timers(*before[start])}:
            others = {t for start, cycle in cycles.items() if start not in newest for t in _timers(*cycle)}
            for timer in list(self.handle.listTimers()):
                if timer in old and timer not in others:
                    self.handle.deleteTimer(timer)
        for timer in due:
            self.handle.registerTimer(timer)
        for start, at in newest.items():
            failures, paid, _ = cycles[start]
            yield Row(subscription_id=key[0], cycle_start=start, state=_state_of(failures, paid), failures=failures,
                      changed_at=at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expired = expiredTimerInfo.getExpiryTimeInMs()
        for start, cycle in self._cycles().items():
            if expired in (timers := _timers(*cycle)):
                yield Row(subscription_id=key[0], cycle_start=start, state=("PAUSED", "CANCELLED")[timers.index(expired)],
                          failures=cycle[0], changed_at=expired * 1000)

    def close(self) -> None:
        pass


def dunning_stream(attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """State changes of every cycle, however late an attempt arrives. The session must use the RocksDB state store.

    Only rows with an event time can be too late. So each attempt is read twice: once as a clock, which moves the watermark
    and the timers and is then dropped, and once without an event time, which is always taken in. A late attempt
    changes its cycle's state as it would have in time; timers that are due by then fire in the same batch.
    """
    at = F.col("attempted_at").cast("timestamp")
    timed = attempts.select(
        "subscription_id", F.trunc("cycle_start", "month").alias("_month"), F.unix_date("cycle_start").alias("cycle_start"),
        "succeeded", F.unix_micros(at).alias("attempted_at"),
        F.explode(F.array(F.struct(at.alias("time"), F.lit(False).alias("kept")),
                          F.struct(F.lit(None).cast("timestamp").alias("time"), F.lit(True).alias("kept")))).alias("_read"))
    clocked = timed.select("subscription_id", "_month", "cycle_start", "succeeded", "attempted_at",
                           F.col("_read.time").alias("_clock"), F.col("_read.kept").alias("_kept")).withWatermark("_clock", delay)
    changes = (
        # One condition on the clock: it must not be moved before the watermark.
        clocked.filter(F.when(F.col("_clock").isNull(), F.col("_kept"))).groupBy("subscription_id", "_month")
        .transformWithState(statefulProcessor=DunningProcessor(), outputStructType=OUTPUT,
                            outputMode="Update", timeMode="EventTime")
    )
    return changes.withColumns({"cycle_start": F.date_from_unix_date("cycle_start"),
                                "changed_at": F.timestamp_micros("changed_at")})
