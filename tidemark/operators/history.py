"""Status history: intervals in which an entity had a status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def status_history(transitions: DataFrame, key: str = "entity_id", time: str = "event_time", token: str = "event_token") -> DataFrame:
    """All transitions with ``valid_from`` and ``valid_to``, the next transition's time in (time, token) order; null means open.

    Derived from the append-only log of transitions, so that rows that arrive out of order end up
    in their place. An entity's transitions are one window partition.
    """
    w = W.partitionBy(key).orderBy(time, token)
    return transitions.withColumns({"valid_from": F.col(time), "valid_to": F.lead(time).over(w)})


def close_and_append(history: DataFrame, batch: DataFrame, columns: Sequence[str] = ("entity_id", "product_type", "status", "valid_from", "valid_to", "event_token"), key: str = "entity_id", token: str = "event_token") -> DataFrame:
    """The history after a batch of transitions (``valid_from`` set), in the incremental form.

    Intervals inside the batch close each other; the entity's open row closes at its first
    transition of the batch. Right for batches in order of time; ``status_history`` has no such
    need.
    """
    w = W.partitionBy(key).orderBy("valid_from", token)
    new = batch.withColumns({"valid_to": F.lead("valid_from").over(w), "_nth": F.row_number().over(w)})
    first = new.filter("_nth = 1").select(F.col(key).alias("_key"), F.col("valid_from").alias("_first"))
    closed = history.join(first, F.col(key) == F.col("_key"), "left").withColumn("valid_to", F.coalesce("valid_to", "_first"))
    return closed.select(*columns).unionByName(new.select(*columns))
