"""A keyed event log over files: batch and stream readers and writers as Python data sources.

The log is a folder of JSON-lines segments, ``<partition>/<first offset>.jsonl``; a line has ``key``,
``value`` and ``timestamp``. Keys decide the partition, so that an entity's events keep their
order. A stream's offset is the next offset of each partition; a position that is no longer in the
log stops the stream with an error instead of skipping events. The folder must be one that driver
and executors share.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

LOG_SCHEMA = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
PARTITIONS = 6


class PositionLost(RuntimeError):
    """Events after the stream's position are no longer in the log."""


def segments(path: str, partition: int) -> list[tuple[int, str]]:
    folder = os.path.join(path, str(partition))
    if not os.path.isdir(folder):
        return []
    return sorted((int(f[:-6]), os.path.join(folder, f)) for f in os.listdir(folder) if f.endswith(".jsonl") and f[0] != ".")


def ends(path: str, partitions: int) -> dict[str, int]:
    """The offset after the last event of each partition."""
    out = {}
    for p in range(partitions):
        own = segments(path, p)
        out[str(p)] = own[-1][0] + sum(1 for _ in open(own[-1][1], encoding="utf-8")) if own else 0
    return out


def read_range(path: str, topic: str, partition: int, start: int, end: int) -> Iterator[tuple]:
    from datetime import datetime

    expected = start
    for first, file in segments(path, partition):
        if first >= end:
            break
        with open(file, encoding="utf-8") as f:
            for offset, line in enumerate(f, first):
                if start <= offset < end:
                    if offset != expected:
                        raise PositionLost(f"partition {partition}: {expected} is not in the log, the next is {offset}")
                    expected += 1
                    x = json.loads(line)
                    yield x["key"], x["value"], topic, partition, offset, datetime.fromisoformat(x["timestamp"])
    if expected < end:
        raise PositionLost(f"partition {partition}: {expected} is not in the log")


class _Range(InputPartition):
    def __init__(self, partition: int, start: int, end: int):
        self.partition, self.start, self.end = partition, start, end


class _Reader(DataSourceReader):
    def __init__(self, path, topic, count):
        self.path, self.topic, self.count = path, topic, count

    def partitions(self):
        last = ends(self.path, self.count)
        return [_Range(p, s[0][0], last[str(p)]) for p in range(self.count) if (s := segments(self.path, p))] or [_Range(0, 0, 0)]

    def read(self, partition):
        yield from read_range(self.path, self.topic, partition.partition, partition.start, partition.end)


class _StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self):
        return {str(p): (s[0][0] if (s := segments(self.path, p)) else 0) for p in range(self.count)}

    def latestOffset(self):
        return ends(self.path, self.count)

    def partitions(self, start, end):
        return [_Range(int(p), start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]

    def commit(self, end):
        pass


class _Message(WriterCommitMessage):
    def __init__(self, file: str, counts: dict[int, int]):
        self.file, self.counts = file, counts


class _Writer(DataSourceWriter):
    """Tasks write hidden files; the commit gives them their offsets by renaming."""

    def __init__(self, path: str, count: int):
        self.path, self.count = path, count

    def write(self, rows):
        from datetime import datetime, timezone

        name, files, counts = uuid.uuid4().hex, {}, {}
        try:
            for r in rows:
                p = zlib.crc32((r.key or "").encode()) % self.count
                if p not in files:
                    os.makedirs(os.path.join(self.path, str(p)), exist_ok=True)
                    files[p] = open(os.path.join(self.path, str(p), f".{name}"), "w", encoding="utf-8")
                at = datetime.now(timezone.utc).replace(tzinfo=None).isoformat()
                files[p].write(json.dumps({"key": r.key, "value": r.value, "timestamp": at}, ensure_ascii=False) + "\n")
                counts[p] = counts.get(p, 0) + 1
        finally:
            for f in files.values():
                f.close()
        return _Message(name, counts)

    def plan(self, messages) -> list[tuple[str, str]]:
        """The hidden files of all tasks and the segments that they become."""
        if any(m is None for m in messages):
            raise RuntimeError("a task did not confirm what it wrote")
        at, out = ends(self.path, self.count), []
        for m in messages:
            for p, n in m.counts.items():
                out.append((os.path.join(str(p), f".{m.file}"), os.path.join(str(p), f"{at[str(p)]:020d}.jsonl")))
                at[str(p)] += n
        return out

    def carry_out(self, plan) -> None:
        """Renames what has not been renamed yet."""
        for hidden, segment in plan:
            if os.path.exists(os.path.join(self.path, hidden)):
                os.rename(os.path.join(self.path, hidden), os.path.join(self.path, segment))

    def commit(self, messages):
        self.carry_out(self.plan(messages))

    def abort(self, messages):
        for m in messages:
            for p in m.counts if m is not None else ():
                os.remove(os.path.join(self.path, str(p), f".{m.file}"))


class _StreamWriter(DataSourceStreamWriter):
    """Batches that the log has already are not written again.

    What a batch's files become is written down before the first of them is renamed; a commit that
    was cut off is completed when the batch comes again, and the files of its second run are dropped.
    """

    KEPT = 100

    def __init__(self, path: str, count: int):
        self.inner, self.path = _Writer(path, count), path

    def write(self, rows):
        return self.inner.write(rows)

    def commit(self, messages, batchId):
        done = os.path.join(self.path, f"_batch-{batchId}")
        os.makedirs(self.path, exist_ok=True)
        if os.path.exists(done):
            with open(done, encoding="utf-8") as f:
                self.inner.carry_out(json.load(f))
            self.inner.abort(messages)
            return
        plan = self.inner.plan(messages)
        with open(f"{done}.new", "w", encoding="utf-8") as f:
            json.dump(plan, f)
        os.replace(f"{done}.new", done)
        self.inner.carry_out(plan)
        old = os.path.join(self.path, f"_batch-{batchId - self.KEPT}")
        if os.path.exists(old):
            os.remove(old)

    def abort(self, messages, batchId):
        self.inner.abort(messages)


class ChangeLog(DataSource):
    """Format ``tidemark_log``; options ``path``, ``topic``, ``partitions``."""

    @classmethod
    def name(cls):
        return "tidemark_log"

    def schema(self):
        return LOG_SCHEMA

    def _given(self):
        return self.options["path"], self.options.get("topic", "changes"), int(self.options.get("partitions", PARTITIONS))

    def reader(self, schema: StructType):
        return _Reader(*self._given())

    def streamReader(self, schema: StructType):
        return _StreamReader(*self._given())

    def writer(self, schema: StructType, overwrite: bool):
        path, _, count = self._given()
        return _Writer(path, count)

    def streamWriter(self, schema: StructType, overwrite: bool):
        path, _, count = self._given()
        return _StreamWriter(path, count)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeLog)
