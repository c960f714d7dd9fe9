"""Named steps of a flow: timing, progress events and errors that say where they arose."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from marlstone.errors import FlowError, IngestError

EVENTS = "task_id string, step string, action string, seq long, seconds double"


class StepLog:
    """Progress of one task: (task_id, step, action, seq, seconds), readable as a table.

    ``listener`` receives every event as it happens.
    """

    def __init__(self, task_id: str, listener: Callable[[tuple], None] | None = None):
        self.task_id, self.listener, self.events = task_id, listener, []

    def record(self, step: str, action: str, seconds: float | None = None) -> None:
        event = (self.task_id, step, action, len(self.events), seconds)
        self.events.append(event)
        if self.listener is not None:
            self.listener(event)

    @contextmanager
    def step(self, name: str, error: type[FlowError] = IngestError) -> Iterator[None]:
        """Run a step; an exception that is not already typed is wrapped with its name."""
        self.record(name, "running")
        started = time.monotonic()
        try:
            yield
        except FlowError:
            raise
        except Exception as cause:
            raise error(str(cause), name, cause) from cause
        self.record(name, "done", round(time.monotonic() - started, 2))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, EVENTS)
