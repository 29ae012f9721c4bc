"""Data-quality violations: impossible states, amounts out of range, invalid transitions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Rules
from ..functions.documents import text_at
from .envelope import amount_at

#: Names of violations and the texts of their details.
IMPOSSIBLE_STATE, OUT_OF_RANGE, INVALID_TRANSITION = "estado_impossivel", "valor_fora_de_faixa", "transicao_invalida"
STATE_TEXT, RANGE_TEXT, ARROW, NOTHING = "status desconhecido: ", "valor_solicitado fora da faixa esperada: ", " -> ", "nulo"


def impossible_state(status: Column, known: Iterable[str]) -> Column:
    return status.isNull() | ~status.isin(*known)


def out_of_range(amount: Column, product: Column, ranges: Iterable[tuple[str, float, float]]) -> Column:
    """Null amounts and unknown products are out of range; bounds are inclusive."""
    fits = F.lit(False)
    for name, low, high in ranges:
        fits = F.when(product == name, amount.between(low, high)).otherwise(fits)
    return ~F.coalesce(fits, F.lit(False))


def valid_transition(before: Column, after: Column, edges: Iterable[tuple[str, str]], deleted: str) -> Column:
    """From nothing, to itself, to deleted, or along an edge. A null status after a known one is invalid."""
    on_edge = F.lit(False)
    for a in dict.fromkeys(x for x, _ in edges):
        on_edge = F.when(before == a, after.isin(*[y for x, y in edges if x == a])).otherwise(on_edge)
    return before.isNull() | F.coalesce((before == after) | (after == deleted) | on_edge, F.lit(False))


def state_and_range_violations(events: DataFrame, rules: Rules = Rules(), doc: Column | None = None) -> DataFrame:
    """Violations of all events but deletes, by their document (by default the image as it came); one event can have two.

    Both checks run in one pass over the events.
    """
    doc = F.coalesce("full_document_json", "full_document_before_change_json") if doc is None else doc
    with_fields = events.filter(F.col("operation_type") != "delete").select("entity_id", text_at(doc, "$.tipo_produto").alias("product_type"), text_at(doc, "$.status").alias("status"), amount_at(doc).alias("amount"))
    return violations_of(with_fields, rules)


def violations_of(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same over typed rows ``entity_id, product_type, status, amount``."""
    none = F.lit(NOTHING)
    state = F.when(impossible_state(F.col("status"), rules.statuses), F.struct(F.lit(IMPOSSIBLE_STATE).alias("violation_type"), F.concat(F.lit(STATE_TEXT), F.coalesce("status", none)).alias("detail")))
    amount = F.when(out_of_range(F.col("amount"), F.col("product_type"), rules.ranges), F.struct(F.lit(OUT_OF_RANGE).alias("violation_type"), F.concat(F.lit(RANGE_TEXT), F.coalesce(F.col("amount").cast("string"), none)).alias("detail")))
    found = rows.select("entity_id", "product_type", F.explode(F.filter(F.array(state, amount), lambda v: v.isNotNull())).alias("v"))
    return found.select(F.col("v.violation_type").alias("violation_type"), "entity_id", "product_type", F.col("v.detail").alias("detail"))


def transition_violations(history: DataFrame, batch: DataFrame | None = None, rules: Rules = Rules(), key: str = "entity_id", time: str = "valid_from", token: str = "event_token") -> DataFrame:
    """Transitions that the lifecycle does not allow, by their predecessor in the whole history.

    With ``batch`` (its history rows) only entities of the batch are gone through and only its
    tokens reported: predecessors of earlier batches count. Whether a side of these semi-joins is
    broadcast is left to its measured size.
    """
    rows = history if batch is None else history.join(batch.select(key).distinct(), key, "left_semi")
    w = W.partitionBy(key).orderBy(time, token)
    lagged = rows.withColumn("_before", F.lag("status").over(w))
    if batch is not None:
        lagged = lagged.join(batch.select(token).distinct(), token, "left_semi")
    bad = lagged.filter(~valid_transition(F.col("_before"), F.col("status"), rules.edges, rules.deleted))
    detail = F.concat(F.coalesce("_before", F.lit(NOTHING)), F.lit(ARROW), F.col("status"))
    return bad.select(F.lit(INVALID_TRANSITION).alias("violation_type"), F.col(key).alias("entity_id"), "product_type", detail.alias("detail"))


def lifecycle_graph(spark, rules: Rules = Rules()) -> DataFrame:
    """The lifecycle's edges, and which of their ends are terminal."""
    values = ", ".join(f"('{a}', '{b}', {str(b in rules.terminals).lower()})" for a, b in rules.edges)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(from_status, to_status, to_terminal)")
