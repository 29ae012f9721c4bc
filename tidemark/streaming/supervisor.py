"""Keeps streaming queries running: restarts with backoff, stops on signals, reports progress."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def next_backoff_ms(now_ms: int, most_ms: int) -> int:
    return min(now_ms * 2, most_ms)


#: What a restart cannot mend: the stream's position is gone. A restart would skip events or fail again.
FATAL = ("PositionLost", "OFFSET_LOST", "STREAM_FAILED_DATA_LOSS")


class Supervisor:
    """Starts queries and, after a failure of one, stops all and starts them again, waiting longer each time; their checkpoints make that safe."""

    def __init__(self, start: Callable[[], StreamingQuery | list[StreamingQuery]], first_ms: int = 1_000, most_ms: int = 30_000, sleep: Callable[[float], None] | None = None):
        self.start, self.first_ms, self.most_ms = start, first_ms, most_ms
        self.stopping = threading.Event()
        self.sleep = sleep or self.stopping.wait
        self.restarts = 0

    def stop(self, *_) -> None:
        self.stopping.set()

    def install_signals(self) -> None:
        """On SIGTERM and SIGINT running queries stop; what they had not committed is read again after a restart."""
        for s in (signal.SIGTERM, signal.SIGINT):
            signal.signal(s, self.stop)

    def run(self) -> None:
        """Until all queries end by themselves, ``stop`` is called, or an error is fatal."""
        wait = self.first_ms
        while not self.stopping.is_set():
            session = SparkSession.getActiveSession()
            before = {q.id for q in session.streams.active} if session else set()
            queries = []
            try:
                started = self.start()
                queries = started if isinstance(started, list) else [started]
                left = list(queries)
                while left and not self.stopping.is_set():
                    left = [q for q in left if not q.awaitTermination(0.2)]  # raises what the query failed with
                return
            except Exception as e:
                if any(x in f"{type(e).__name__} {e}" for x in FATAL):
                    raise
                if any(q.lastProgress is not None for q in queries):
                    wait = self.first_ms
                self.restarts += 1
                self.sleep(wait / 1000)
                wait = next_backoff_ms(wait, self.most_ms)
            finally:
                for q in queries:
                    q.stop()
                for q in session.streams.active if session else ():  # of a start that failed half-way
                    if q.id not in before:
                        q.stop()


class ProgressLog(StreamingQueryListener):
    """The last progress of each query: rows read, rows dropped as late, and the sources' lag where they report it."""

    def __init__(self):
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event):
        self.last.setdefault(event.name or str(event.id), {"rows": 0, "late": 0})

    def onQueryProgress(self, event):
        p = event.progress
        seen = self.last.setdefault(p.name or str(p.id), {"rows": 0, "late": 0})
        seen["rows"] += p.numInputRows
        seen["late"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        seen["offsets"] = [(s.endOffset, s.latestOffset) for s in p.sources]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def watch(spark: SparkSession) -> ProgressLog:
    log = ProgressLog()
    spark.streams.addListener(log)
    return log
