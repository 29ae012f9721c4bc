"""The stored ``events`` and ``orders`` tables seen as change events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Rules

#: The lifecycle and ranges that the events are held against.
EVENT_RULES = Rules(
    edges=(("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view")),
    statuses=("signup", "view", "click", "error"),
    deleted="error",
    decisions=("purchase", "click"),
    ranges=(("p0", 10.0, 400.0), ("p1", 0.0, 300.0)),
    common_fields=("id_proposta", "tipo_produto", "status", "valor_solicitado"),
)
#: The same as a view in SQL.
CDC_SQL = """cdc AS (
    SELECT CAST(user_id AS VARCHAR) AS entity_id, event_id AS event_token, ts AS event_time, 'p' || CAST(user_id % 3 AS VARCHAR) AS product_type,
           event_type AS status, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation_type,
           value AS amount, props FROM events)"""
#: Where the view is cut into batches.
SLICES = ("2024-01-11", "2024-01-21")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if a scan gives fewer."""
    plan, cores = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext.defaultParallelism
    if plan.nodeName() == "AdaptiveSparkPlan" or plan.execute().getNumPartitions() >= cores:
        return df  # with a shuffle it is spread already
    return df.repartition(cores)


def cdc(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return events.select(
        F.col("user_id").cast("string").alias("entity_id"), F.col("event_id").alias("event_token"), F.col("ts").cast("timestamp").alias("event_time"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("product_type"), F.col("event_type").alias("status"), op.alias("operation_type"),
        F.col("value").alias("amount"), "props",
    )


def cdc_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc(table(spark, sf_dir, "events"))


def slices_of(events: DataFrame, time: str = "event_time") -> list[DataFrame]:
    """The view in three batches by time."""
    a, b = (F.lit(x).cast("timestamp") for x in SLICES)
    t = F.col(time)
    return [events.filter(t < a), events.filter((t >= a) & (t < b)), events.filter(t >= b)]


def documents(view: DataFrame) -> DataFrame:
    """The view as change events with JSON documents, as ``build_envelope`` takes them; spread, as JSON is work for all cores."""
    view = spread(view)
    doc = F.to_json(F.struct(F.col("entity_id").alias("id_proposta"), F.col("product_type").alias("tipo_produto"), F.col("status"), F.col("amount").alias("valor_solicitado"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    named = F.when(F.col("status") == "view", F.lit('{"updatedFields":{"valor_solicitado":1.5}}')).otherwise(F.to_json(F.struct(F.struct("status").alias("updatedFields"))))
    return view.select(
        F.col("event_token").cast("string").alias("event_id"), "operation_type", F.unix_timestamp("event_time").alias("cluster_time_epoch"),
        F.concat(F.lit('{"_id":"key-'), "entity_id", F.lit('"}')).alias("document_key"),
        F.when(F.col("operation_type") != "delete", doc).alias("full_document"), F.when((F.col("operation_type") == "delete") & (F.col("event_token") % 2 == 0), doc).alias("full_document_before_change"),
        F.when(F.col("operation_type") == "update", named).alias("update_description"),
    )


def ntz(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as other engines return them."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"})


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``; where that is unset, a local session gets one of its own."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
