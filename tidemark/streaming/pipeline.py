"""Streaming queries: log to bronze to history and state, and on to metrics and violations.

Each builder wires a source to the same operators that batches use and to the table store. Every
write names its query and batch, so that a replayed batch changes nothing. The history table is an
append-only log of transitions; intervals are derived from it by time and token, so that rows that
arrive out of order need no rewrite.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..config import Settings
from ..operators.envelope import parse_envelope, with_event_time
from ..operators.history import status_history
from ..operators.metrics import created_documents, decision_time, open_counts, product_volume, status_funnel
from ..operators.prepare import dedup_stream, prepare_events
from ..operators.quality import state_and_range_violations, transition_violations
from ..operators.state import STATE_COLUMNS, latest_per_key
from ..schemas import KEYS, PARTITIONS, SCHEMAS
from ..sources.store import UPSERT, TableStore, When

#: Clauses of the state upsert. A tombstone keeps a deleted entity's time; ``later`` compares time, then token.
LATER = "s.event_time > t.event_time OR (s.event_time = t.event_time AND s.event_token > t.event_token)"
STATE_CLAUSES = (When(matched=True, condition=LATER), When(matched=False))
STRICT_STATE_CLAUSES = (
    When(matched=True, condition="s.is_deleted", delete=True),
    When(matched=True, condition="NOT s.is_deleted AND s.event_time > t.event_time"),
    When(matched=False, condition="NOT s.is_deleted"),
)


@dataclass
class Pipeline:
    spark: SparkSession
    settings: Settings = Settings()

    def __post_init__(self):
        self.store = TableStore(self.spark, self.settings.root, self.settings.merge_buckets)

    def prepare_tables(self) -> None:
        for name, schema in SCHEMAS.items():
            if name != "log":
                self.store.ensure(name, schema, KEYS.get(name, ()), PARTITIONS.get(name, ()))

    # writes of one micro-batch; an empty one writes nothing

    def write_bronze(self, batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            self.store.append("bronze", batch, "bronze", batch_id)

    def write_silver(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        events = prepare_events(batch, self.settings.rules).persist()
        try:
            rows = events.filter("is_transition").select("entity_id", "product_type", "status", F.col("event_time").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), "event_token")
            self.store.append("history", rows, "silver-history", batch_id)
            self.store.append("created_documents", created_documents(events).select("entity_id", "product_type", "requested_amount", "event_time", "event_token"), "silver-created", batch_id)
            deleted = F.coalesce(F.col("operation_type") == "delete", F.lit(False))
            last = latest_per_key(events.select(*STATE_COLUMNS, deleted.alias("is_deleted")))
            self.store.merge("current_state", last, STRICT_STATE_CLAUSES if self.settings.strict_late_state else STATE_CLAUSES, "silver-state", batch_id)
        finally:
            events.unpersist()

    def write_funnel(self, batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            self.store.merge("status_funnel", batch, UPSERT, "gold-funnel", batch_id)

    def write_volume(self, batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            self.store.merge("product_volume", batch, UPSERT, "gold-volume", batch_id)

    def write_metrics(self, batch: DataFrame, batch_id: int) -> None:
        """Decision times and open counts, from the buckets of the history that the batch has entities in."""
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            log, deleted = self.store.touching("history", batch), self.settings.rules.deleted
            self.store.merge("decision_time", decision_time(log, batch, self.settings.rules.decisions), UPSERT, "gold-decisions", batch_id)
            bucket = self.store.bucket("history")
            new = open_counts(self.intervals(log).withColumn("bucket", bucket), deleted, ("bucket", "product_type", "status"))
            # a row for each bucket, product and status at most
            kept = self.store.read("open_by_bucket").join(batch.select(bucket.alias("bucket")).distinct(), "bucket", "left_anti")
            self.store.overwrite("open_by_bucket", kept.unionByName(new), "gold-open-buckets", batch_id)
            totals = self.store.read("open_by_bucket").groupBy("product_type", "status").agg(F.sum("quantity").alias("quantity"))
            self.store.overwrite("open_counts", totals, "gold-open", batch_id)
        finally:
            batch.unpersist()

    def write_document_violations(self, batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            self.store.append("quality_violations", state_and_range_violations(batch, self.settings.rules).withColumn("detected_at", F.current_timestamp()), "quality-documents", batch_id)

    def write_transition_violations(self, batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            found = transition_violations(self.store.touching("history", batch), batch, self.settings.rules).withColumn("detected_at", F.current_timestamp())
            self.store.append("quality_violations", found, "quality-transitions", batch_id)

    # what is read

    def history(self) -> DataFrame:
        """The transitions with their intervals."""
        return self.intervals(self.store.read("history"))

    @staticmethod
    def intervals(log: DataFrame) -> DataFrame:
        rows = log.drop("valid_to").withColumnRenamed("valid_from", "event_time")
        return status_history(rows).select("entity_id", "product_type", "status", "valid_from", "valid_to", "event_token")

    def state(self) -> DataFrame:
        return self.store.read("current_state").filter("NOT coalesce(is_deleted, false)").drop("is_deleted")

    # streams

    def deduplicated(self) -> DataFrame:
        events = with_event_time(self.store.stream("bronze", self.settings.max_files_per_trigger)).filter("event_time IS NOT NULL")
        return dedup_stream(events, self.settings.watermark)

    def _start(self, name: str, writer: DataStreamWriter, once: bool) -> StreamingQuery:
        writer = writer.queryName(name).option("checkpointLocation", f"{self.settings.checkpoints}/{name}")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.settings.trigger)).start()

    def _sink(self, name: str, stream: DataFrame, write: Callable[[DataFrame, int], None], once: bool, mode: str = "append") -> StreamingQuery:
        return self._start(name, stream.writeStream.outputMode(mode).foreachBatch(write), once)

    def start_bronze(self, log: DataFrame, once: bool = False) -> StreamingQuery:
        return self._sink("bronze", parse_envelope(log), self.write_bronze, once)

    def start_silver(self, once: bool = False) -> StreamingQuery:
        self.store.wait_until_exists("bronze")
        return self._sink("silver", self.deduplicated(), self.write_silver, once)

    def start_gold(self, once: bool = False) -> list[StreamingQuery]:
        for name in ("created_documents", "history"):
            self.store.wait_until_exists(name)
        s, log = self.settings, self.store.stream("history", self.settings.max_files_per_trigger)
        return [
            self._sink("gold-funnel", status_funnel(log, s.window, s.watermark), self.write_funnel, once, "update"),
            self._sink("gold-volume", product_volume(self.store.stream("created_documents", s.max_files_per_trigger), s.window, s.watermark), self.write_volume, once, "update"),
            self._sink("gold-metrics", log, self.write_metrics, once),
        ]

    def start_quality(self, once: bool = False) -> list[StreamingQuery]:
        return [
            self._sink("quality-documents", self.deduplicated(), self.write_document_violations, once),
            self._sink("quality-transitions", self.store.stream("history", self.settings.max_files_per_trigger), self.write_transition_violations, once),
        ]

    def run_once(self, log: DataFrame) -> None:
        """Drains the log through all stages and stops."""
        self.prepare_tables()
        for start in (lambda: [self.start_bronze(log, True)], lambda: [self.start_silver(True)], lambda: self.start_gold(True), lambda: self.start_quality(True)):
            for q in start():
                try:
                    q.awaitTermination()
                finally:
                    q.stop()


def drain(query: StreamingQuery) -> int:
    """Waits for a query that stops by itself; the rows that its watermark dropped."""
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return sum(int(o.numRowsDroppedByWatermark) for p in query.recentProgress for o in p.stateOperators)
