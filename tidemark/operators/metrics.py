"""Windowed funnel and volume, decision times and open counts; batches and streams alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .envelope import amount_at
from ..functions.documents import text_at


def _windowed(df: DataFrame, time: str, window: str, by: Sequence[str], aggregates: dict, watermark: str | None) -> DataFrame:
    source = df.withWatermark(time, watermark) if watermark and df.isStreaming else df
    grouped = source.groupBy(F.window(time, window).alias("_w"), *by).agg(*[x.alias(n) for n, x in aggregates.items()])
    return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, *aggregates)


def status_funnel(history: DataFrame, window: str = "1 day", watermark: str | None = None, time: str = "valid_from") -> DataFrame:
    """Transitions by tumbling window, product and status."""
    return _windowed(history, time, window, ("product_type", "status"), {"quantity": F.count("*")}, watermark)


def created_documents(events: DataFrame) -> DataFrame:
    """Inserts with the product and amount of their document."""
    doc = F.col("full_document_json")
    return events.filter(F.col("operation_type") == "insert").withColumns({"product_type": text_at(doc, "$.tipo_produto"), "requested_amount": amount_at(doc)})


def product_volume(created: DataFrame, window: str = "1 day", watermark: str | None = None, time: str = "event_time") -> DataFrame:
    """Number and value of created documents by tumbling window and product."""
    return _windowed(created, time, window, ("product_type",), {"volume": F.count("*"), "total_value": F.sum("requested_amount")}, watermark)


def decision_time(history: DataFrame, decisions: DataFrame | None = None, statuses: Sequence[str] = ("aprovada", "recusada")) -> DataFrame:
    """Each decided entity's last decision and the seconds from its first entry to it.

    ``decisions``: the history rows of a batch; the whole history by default. One pass over the
    history: first entry and last decision are both combined where rows are read, before the shuffle.
    """
    if decisions is None:
        last = F.max(F.when(F.col("status").isin(*statuses), F.struct("valid_from", "event_token", "product_type", "status"))).alias("d")
        both = history.groupBy("entity_id").agg(F.min("valid_from").alias("created_at"), last).filter("d is not null")
    else:
        own = decisions.filter(F.col("status").isin(*statuses)).groupBy("entity_id").agg(F.max(F.struct("valid_from", "event_token", "product_type", "status")).alias("d"))
        first = history.join(own.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.min("valid_from").alias("created_at"))
        both = own.join(first, "entity_id")
    return both.select(
        "entity_id", F.col("d.product_type").alias("product_type"), F.col("d.status").alias("decision_status"), "created_at", F.col("d.valid_from").alias("decided_at"),
        (F.unix_timestamp(F.col("d.valid_from")) - F.unix_timestamp("created_at")).alias("decision_seconds"),
    )


def open_counts(history: DataFrame, deleted: str = "deletada", by: Sequence[str] = ("product_type", "status")) -> DataFrame:
    """Entities by product and status that are open now."""
    return history.filter(F.col("valid_to").isNull() & (F.col("status") != deleted)).groupBy(*by).agg(F.count("*").alias("quantity"))
