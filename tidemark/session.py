"""The session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution and the RocksDB state store; ``settings`` (dots as ``__``) win."""
    builder = SparkSession.builder.appName(app)
    chosen = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    for k, v in chosen.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
