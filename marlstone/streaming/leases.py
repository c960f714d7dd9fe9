"""Import leases and in-order delivery as keyed state with timers.

Each source hash (task) has one small state row in the state store. Event time drives the timers, so
a repeated run of the same input takes the same decisions. The session needs a state store that can
hold timers, see :data:`STATE_STORE`.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from marlstone.config import IngestSettings
from marlstone.operators.versions import COMPLETED, ERROR_CHARS, FAILED, PROCESSING
from marlstone.streaming.progress import event_frame

# The setting that keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
UPLOAD, RETRY, RESULT = "upload", "retry", "result"
LEASE_EVENT = "source_hash string, kind string, at timestamp, task_id string, ok boolean, error string, doc_id string"
DECISION = "source_hash string, task_id string, at timestamp, outcome string, status string, attempt int, error string, doc_id string"
_RECORD = "task_id string, status string, attempt int, lease_until long, error string, doc_id string"


def _millis(at: datetime) -> int:
    """State holds times as milliseconds, as timers do."""
    return round(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000)


def _moment(millis: int) -> datetime:
    return datetime.fromtimestamp(millis / 1000, timezone.utc)


class Leases(StatefulProcessor):
    """One record for each source hash: who imports it, until when, and how it ended.

    An upload starts attempt 1, or the next one after a failure or a lease that has run out; any other
    is told that it is held. A retry names the record's task. Only the task that holds the
    lease can finish it; a success that comes too late is ``lost``. A lease that runs out without a
    result is reported, so that somebody can take over.
    """

    def __init__(self, lease_seconds: float):
        self.lease = round(1000 * max(60, lease_seconds))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", _RECORD)

    def _decision(self, key, at, outcome, record, task=None) -> Row:
        task_id, status, attempt, _until, error, doc_id = record or (task, None, 0, None, None, None)
        return Row(source_hash=key[0], task_id=task or task_id, at=at, outcome=outcome, status=status, attempt=attempt, error=error, doc_id=doc_id)

    def _take(self, record, row, task):
        attempt = record[2] + 1 if record else 1
        return (task, PROCESSING, attempt, _millis(row.at) + self.lease, "", None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        record = tuple(self.record.get()) if self.record.exists() else None
        timed = record[3] if record else None
        order = {RESULT: 0, RETRY: 1, UPLOAD: 2}
        for row in sorted(rows, key=lambda r: (r.at, order[r.kind], r.task_id)):
            free = record is not None and (record[1] == FAILED or (record[1] == PROCESSING and record[3] <= _millis(row.at)))
            if row.kind == UPLOAD:
                won = record is None or free
                record = self._take(record, row, row.task_id) if won else record
                yield self._decision(key, row.at, "acquired" if won else "held", record, None if won else row.task_id)
            elif row.kind == RETRY:
                known = record is not None and record[0] == row.task_id
                if known and free:
                    record = self._take(record, row, row.task_id)
                outcome = "missing" if not known else "reclaimed" if free else f"refused:{record[1]}"
                yield self._decision(key, row.at, outcome, record, row.task_id)
            else:
                holds = record is not None and record[0] == row.task_id and record[1] == PROCESSING
                if holds and row.ok:
                    record = (record[0], COMPLETED, record[2], None, "", row.doc_id)
                elif holds:
                    record = (record[0], FAILED, record[2], None, (row.error or "")[:ERROR_CHARS], None)
                yield self._decision(key, row.at, record[1] if holds else "lost" if row.ok else "ignored", record, row.task_id)
        until = record[3] if record else None
        if until != timed:
            if timed is not None:
                self.handle.deleteTimer(timed)
            if until is not None:
                self.handle.registerTimer(until)
        if record is not None:
            self.record.update(record)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        record = tuple(self.record.get()) if self.record.exists() else None
        if record and record[1] == PROCESSING and record[3] <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._decision(key, _moment(record[3]), "expired", record)

    def close(self) -> None:
        pass


def lease_decisions(events: DataFrame, settings: IngestSettings = IngestSettings(), lateness: str = "0 seconds") -> DataFrame:
    """A decision (``DECISION``) for each event (``LEASE_EVENT``) of a stream, and for each lease that runs out.

    Events of a hash are taken in the order of their time within a micro-batch. Those later than
    ``lateness`` behind the newest are dropped.
    """
    return events.withWatermark("at", lateness).groupBy("source_hash").transformWithState(
        statefulProcessor=Leases(settings.import_claim_lease_seconds), outputStructType=DECISION, outputMode="append", timeMode="EventTime"
    )


FRAME_EVENT = "task_id string, seq long, at timestamp, event string, data string"
FRAME = "task_id string, seq long, frame string"


class InOrder(StatefulProcessor):
    """Frames of each task in the order of their numbers, from 1, each once.

    Frames behind a gap wait until it is filled or ``patience`` has passed since the first of them came;
    then the gap is given up. State is the next number and what waits, and goes ``patience`` after the
    task's last frame, so a task that has ended leaves nothing.
    """

    def __init__(self, patience: timedelta):
        self.patience = round(1000 * patience.total_seconds())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long, last long")
        self.waiting = handle.getMapState("waiting", "seq long", "frame string, at long")

    def _ready(self, key, following: int) -> Iterator[Row]:
        """Waiting frames from ``following`` on; keeps the number after them."""
        while self.waiting.containsKey((following,)):
            yield Row(task_id=key[0], seq=following, frame=self.waiting.getValue((following,))[0])
            self.waiting.removeKey((following,))
            following += 1
        self.reached = following

    def _timer(self, last: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        first = min((value[1] for _, value in self.waiting.iterator()), default=last)
        self.handle.registerTimer(first + self.patience)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        following, last = tuple(self.next.get()) if self.next.exists() else (1, None)
        for row in rows:
            now = _millis(row.at)
            last = now if last is None else max(last, now)
            if row.seq >= following and not self.waiting.containsKey((row.seq,)):
                self.waiting.updateValue((row.seq,), (row.frame, now))
        yield from self._ready(key, following)
        self.next.update((self.reached, last))
        self._timer(last)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        numbers = sorted(k[0] for k, _ in self.waiting.iterator())
        if not numbers:
            self.next.clear()
            return
        last = self.next.get()[1]
        yield from self._ready(key, numbers[0])
        self.next.update((self.reached, last))
        self._timer(last)

    def close(self) -> None:
        pass


def deliver_in_order(events: DataFrame, patience: timedelta = timedelta(minutes=5), lateness: str = "0 seconds") -> DataFrame:
    """(task_id, seq, frame) of a stream of ``FRAME_EVENT`` rows, in order within each task and each once."""
    framed = events.select("task_id", "seq", "at", event_frame(F.col("event"), F.col("data")).alias("frame"))
    return framed.withWatermark("at", lateness).groupBy("task_id").transformWithState(
        statefulProcessor=InOrder(patience), outputStructType=FRAME, outputMode="append", timeMode="EventTime"
    )


def deliverable(by: list[str], seq: Column) -> Column:
    """In a table of a task's distinct frames: true up to the first number that is missing."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(seq))
    return place == seq
