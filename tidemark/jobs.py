"""The pipeline's jobs: ``python -m tidemark.jobs connector|load|bronze|silver|gold|quality|compact [--once]``.

Settings come from the environment (``TIDEMARK_*``, see ``Settings``). A job runs its queries until
it gets a signal; if one fails, all of the job are stopped and started again from their checkpoints,
after a pause that grows, unless the failure is one that a restart cannot mend.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .config import Settings
from .operators.envelope import build_envelope
from .session import build_session
from .sources.changes import register
from .sources.documents import change_stream
from .sources.generator import load_stream
from .streaming.pipeline import Pipeline
from .streaming.supervisor import Supervisor, watch


def log_stream(spark: SparkSession, s: Settings) -> DataFrame:
    """The event log: files, or topics where the session has the source for them."""
    if s.log_format == "kafka":
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", s.log_servers).option("subscribe", s.log_topic)
        return reader.option("startingOffsets", "earliest").option("failOnDataLoss", "true").option("maxOffsetsPerTrigger", s.max_events_per_trigger).load()
    register(spark)
    return spark.readStream.format("tidemark_log").option("topic", s.log_topic).load(s.log_path)


def write_log(name: str, envelopes: DataFrame, s: Settings, once: bool) -> StreamingQuery:
    """Records are confirmed by the sink before the source's position is checkpointed; the trigger is the age at which a batch goes."""
    writer = envelopes.writeStream.queryName(name).option("checkpointLocation", f"{s.checkpoints}/{name}")
    if s.log_format == "kafka":
        writer = writer.format("kafka").option("kafka.bootstrap.servers", s.log_servers).option("topic", s.log_topic).option("kafka.delivery.timeout.ms", 15_000).option("kafka.request.timeout.ms", 5_000)
        start = writer.start
    else:
        register(envelopes.sparkSession)
        writer = writer.format("tidemark_log")
        start = lambda: writer.start(s.log_path)
    writer.trigger(availableNow=True) if once else writer.trigger(processingTime=s.connector_trigger)
    return start()


def starts(spark: SparkSession, s: Settings, once: bool = False) -> dict[str, Callable[[], list[StreamingQuery]]]:
    """What starts the queries of each job."""
    p = Pipeline(spark, s)

    def bronze():
        p.prepare_tables()
        return [p.start_bronze(log_stream(spark, s), once)]

    return {
        "connector": lambda: [write_log("connector", build_envelope(change_stream(spark, s.collection, "start", s.max_events_per_trigger)), s, once)],
        "load": lambda: [write_log("load", build_envelope(load_stream(spark, s.load_per_second, s.load_seed)), s, once)],
        "bronze": bronze,
        "silver": lambda: [p.start_silver(once)],
        "gold": lambda: p.start_gold(once),
        "quality": lambda: p.start_quality(once),
    }


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None, env=None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark.jobs")
    parser.add_argument("job", choices=["connector", "load", "bronze", "silver", "gold", "quality", "compact"])
    parser.add_argument("--once", action="store_true", help="take what is there, then end")
    given = parser.parse_args(arguments)
    settings = Settings.from_env(env)
    own = spark is None
    spark = spark or build_session(f"tidemark-{given.job}")
    if given.job == "compact":
        store = Pipeline(spark, settings).store
        for name in ("bronze", "history", "created_documents", "quality_violations"):
            if store.exists(name):
                store.compact(name)
        return
    watch(spark)
    supervisor = Supervisor(starts(spark, settings, given.once)[given.job], settings.retry_first_ms, settings.retry_most_ms)
    if own:
        supervisor.install_signals()
    supervisor.run()


if __name__ == "__main__":
    main()
