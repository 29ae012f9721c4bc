"""Deduplicated events to typed events: the event's own change laid over its image, and whether it moves the status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Rules
from ..functions.documents import changed_fields, date_of, double_of, lay_over, moves_status, parse_fields, text_of, without


def dedup_batch(events: DataFrame, token: str = "event_token", order: tuple[str, ...] = ("event_time",)) -> DataFrame:
    """One row for each token, the first in ``order``; rows with a null token are one group, as on a stream.

    A token holds a few copies, so that no window partition is large; of the nulls, which may be
    many, each task hands on its first.
    """
    nth = F.row_number().over(W.partitionBy(token).orderBy(*order))
    known = events.filter(F.col(token).isNotNull()).withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
    return known.unionByName(events.filter(F.col(token).isNull()).orderBy(*order).limit(1))


def dedup_stream(events: DataFrame, watermark: str, token: str = "event_token", time: str = "event_time") -> DataFrame:
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark([token])


def prepare_events(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``bronze`` rows with ``event_time`` to typed events: the image and its update are parsed once each, and all fields come from what is parsed.

    Malformed documents give null fields and ``is_malformed``; they are not dropped.
    """
    image = F.coalesce("full_document_json", "full_document_before_change_json")
    update = F.col("update_description_json")
    parsed = events.select("*", parse_fields(image).alias("_base"), parse_fields(changed_fields(update)).alias("_over"))
    laid = parsed.withColumn("_doc", lay_over(F.col("_base"), F.col("_over")))
    doc = F.col("_doc")
    return laid.withColumns({
        "source_document_json": F.to_json(doc),
        "status": F.when(F.col("operation_type") == "delete", F.lit(rules.deleted)).otherwise(text_of(doc["status"])),
        "product_type": text_of(doc["tipo_produto"]), "customer_cpf": text_of(doc["cpf_cliente"]), "customer_name": text_of(doc["nome_cliente"]),
        "requested_amount": double_of(doc["valor_solicitado"]), "created_at": date_of(doc["data_criacao"]), "updated_at": date_of(doc["data_atualizacao"]),
        "residual_fields_json": F.to_json(without(doc, rules.common_fields)),
        "is_transition": moves_status(F.col("operation_type"), F.col("_over")),
        "is_malformed": image.isNotNull() & F.col("_base").isNull(),
    }).drop("_base", "_over", "_doc")
