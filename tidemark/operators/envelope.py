"""Change events, their envelope on the log, and the typed envelope table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.documents import double_at, text_at

#: The envelope's keys on the log.
ENVELOPE_KEYS = ("id_proposta", "operation_type", "cluster_time", "cluster_time_epoch", "resume_token", "document_key", "full_document", "full_document_before_change", "update_description", "chave_derivada_de_fallback")


def entity_id(after: Column, before: Column, key: Column, event: Column, field: str = "id_proposta") -> tuple[Column, Column]:
    """The id of the changed document and whether it is a stand-in: after image, before image, then document key, then event id."""
    own = F.coalesce(text_at(after, f"$.{field}"), text_at(before, f"$.{field}"))
    return F.coalesce(own, text_at(key, "$._id"), event), own.isNull()


def build_envelope(changes: DataFrame) -> DataFrame:
    """Change events (JSON text columns ``event_id, document_key, full_document, full_document_before_change, update_description``, plus ``operation_type`` and ``cluster_time_epoch``) as log records ``key, value``."""
    id_, fallback = entity_id(F.col("full_document"), F.col("full_document_before_change"), F.col("document_key"), F.col("event_id"))
    raw = lambda c: F.coalesce(F.col(c), F.lit("null"))  # noqa: E731  JSON stays as it came
    quoted = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""), F.lit("null"))
    parts = {
        "id_proposta": quoted(id_), "operation_type": quoted(F.col("operation_type")),
        "cluster_time": F.coalesce(F.concat(F.lit('{"$timestamp": {"t": '), F.col("cluster_time_epoch").cast("string"), F.lit(', "i": 1}}')), F.lit("null")),
        "cluster_time_epoch": F.coalesce(F.col("cluster_time_epoch").cast("string"), F.lit("null")),
        "resume_token": F.concat(F.lit('{"_data": '), quoted(F.col("event_id")), F.lit("}")),
        "document_key": raw("document_key"), "full_document": raw("full_document"),
        "full_document_before_change": raw("full_document_before_change"), "update_description": raw("update_description"),
        "chave_derivada_de_fallback": fallback.cast("string"),
    }
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), parts[k]) for k in ENVELOPE_KEYS])
    return changes.select(id_.cast("string").alias("key"), F.concat(F.lit("{"), body, F.lit("}")).alias("value"))


#: The envelope as it is read: nested documents stay JSON text.
_ENVELOPE = StructType([StructField(k, StructType([StructField("_data", StringType())]) if k == "resume_token" else StringType()) for k in ENVELOPE_KEYS if k != "cluster_time"])


def parse_envelope(log: DataFrame) -> DataFrame:
    """Log records as rows of the ``bronze`` schema, each parsed once; works on batches and streams. A malformed record has null fields."""
    value = F.col("value").cast("string")
    parsed = log.select("*", F.from_json(value, _ENVELOPE).alias("_e"))
    at = lambda c: F.col(f"_e.{c}")
    epoch = at("cluster_time_epoch").try_cast("bigint")
    return parsed.select(
        F.col("key").cast("string").alias("kafka_key"), F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_timestamp"), value.alias("raw_envelope"),
        at("id_proposta").alias("entity_id"), at("operation_type").alias("operation_type"),
        epoch.alias("cluster_time_epoch"), at("resume_token._data").alias("event_token"),
        (at("chave_derivada_de_fallback") == "true").alias("key_is_fallback"),
        at("document_key").alias("document_key_json"), at("full_document").alias("full_document_json"),
        at("full_document_before_change").alias("full_document_before_change_json"),
        at("update_description").alias("update_description_json"),
        F.to_date(F.timestamp_seconds(epoch)).alias("event_date"), F.current_timestamp().alias("ingested_at"),
    )


def with_event_time(bronze: DataFrame) -> DataFrame:
    return bronze.withColumn("event_time", F.timestamp_seconds("cluster_time_epoch"))


def amount_at(doc: Column) -> Column:
    return double_at(doc, "$.valor_solicitado")
