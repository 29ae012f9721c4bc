"""The current state of each entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_COLUMNS = ("entity_id", "product_type", "customer_cpf", "customer_name", "requested_amount", "status", "created_at", "updated_at", "residual_fields_json", "event_time", "event_token")


def latest_per_key(events: DataFrame, keys: Sequence[str] = ("entity_id",), order: Sequence[str] = ("event_time", "event_token")) -> DataFrame:
    """Each key's last event. Rows are combined where they are read, before the shuffle, so that an entity with very many events is no hot task."""
    rest = [c for c in events.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return events.groupBy(*keys).agg(best).select(*keys, "_last.*").select(*events.columns)


def current_state(events: DataFrame, keys: Sequence[str] = ("entity_id",), order: Sequence[str] = ("event_time", "event_token"), deleted: str = "operation_type = 'delete'") -> DataFrame:
    """The entities whose last event is no delete, with that event."""
    return latest_per_key(events, keys, order).filter(~F.coalesce(F.expr(deleted), F.lit(False)))


def apply_changes(state: DataFrame, batch: DataFrame, columns: Sequence[str] = STATE_COLUMNS, strict: bool = False) -> DataFrame:
    """``state`` (``columns`` and ``is_deleted``) after a batch of events.

    By default an event counts if its (time, token) is later than the row's, deletes too, and a
    deleted entity stays as a tombstone, so that the order of arrival does not matter. ``strict``
    has the plain clauses instead: a matched delete removes the row whatever its time, a matched
    other event counts if its time alone is later, an unmatched event that is no delete is inserted.
    """
    key, rest = columns[0], columns[1:]
    last = latest_per_key(batch.select(*columns, (F.coalesce(F.col("operation_type") == "delete", F.lit(False))).alias("is_deleted")), (key,))
    old = state.select(*[F.col(c).alias(f"old_{c}") for c in columns], F.col("is_deleted").alias("old_is_deleted"))
    both = old.join(last, F.col(f"old_{key}").eqNullSafe(F.col(key)), "full_outer").withColumns({"_has_old": F.col("old_is_deleted").isNotNull(), "_has_new": F.col("is_deleted").isNotNull()})
    if strict:
        take = F.col("_has_new") & (~F.col("_has_old") | F.col("is_deleted") | F.coalesce(F.col("event_time") > F.col("old_event_time"), F.lit(False)))
    else:
        later = F.struct("event_time", "event_token") > F.struct("old_event_time", "old_event_token")
        take = F.col("_has_new") & (~F.col("_has_old") | later)
    pick = lambda c: F.when(take, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    out = both.select(F.coalesce(f"old_{key}", key).alias(key), *[pick(c) for c in (*rest, "is_deleted")])
    return out.filter("NOT is_deleted") if strict else out
