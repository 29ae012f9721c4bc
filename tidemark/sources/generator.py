"""A seeded load of change events: entities that are created, move through the lifecycle, are corrected and deleted.

Everything follows from the entity's number and the seed, so that any range of entities can be made
anywhere, in batch or from a rate stream, by JVM expressions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the domain: where each status leads, with what weight.
MOVES = {
    "em_analise": (("pendente_documentacao", 0.25), ("aprovada", 0.45), ("recusada", 0.25), ("cancelada", 0.05)),
    "pendente_documentacao": (("em_analise", 0.6), ("aprovada", 0.2), ("recusada", 0.1), ("cancelada", 0.1)),
    "aprovada": (("paga", 0.85), ("cancelada", 0.15)),
}
PRODUCTS = (("consignado", 0.5), ("cartao", 0.3), ("fgts", 0.2))
FIRST_STATUS = "em_analise"
DELETE_SHARE, CORRECTION_SHARE = 0.02, 0.05


def uniform(seed: int, *of: Column) -> Column:
    """A number in [0, 1) from a digest that any engine can work out."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), *[c.cast("string") for c in of])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def choose(u: Column, weights) -> Column:
    total, below, out = sum(w for _, w in weights), 0.0, None
    for value, w in weights:
        below += w / total
        out = F.when(u < below, F.lit(value)) if out is None else out.when(u < below, F.lit(value))
    return out.otherwise(F.lit(weights[-1][0]))


def next_status(status: Column, u: Column) -> Column:
    """Where a status leads; null from a terminal one."""
    out = F.lit(None).cast("string")
    for at, weights in MOVES.items():
        out = F.when(status == at, choose(u, weights)).otherwise(out)
    return out


def change_events(entities: DataFrame, seed: int = 42, steps: int = 6, start: int = 1_704_067_200) -> DataFrame:
    """Change events (input of ``build_envelope``) of the entities whose numbers are in column ``id``; at most ``steps`` moves each."""
    e = F.col("id")
    amount = F.round(F.lit(500) + uniform(seed + 1, e) * 49_500, 2)
    base = entities.select(
        "id", F.concat(F.lit("p-"), e.cast("string")).alias("entity"), choose(uniform(seed, e), PRODUCTS).alias("product"), amount.alias("amount"),
        (uniform(seed + 2, e) < DELETE_SHARE).alias("deleted"), (F.lit(start) + F.pmod(F.xxhash64(F.lit(seed + 3), e), F.lit(2_000_000))).alias("t0"),
    )

    def longer(path, i):
        move = next_status(F.element_at(path, -1), uniform(seed + 10, e, i))
        return F.concat(path, F.filter(F.array(move), lambda m: m.isNotNull()))

    base = base.withColumn("path", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(F.lit(FIRST_STATUS)), longer))
    ops = base.select("*", F.posexplode("path").alias("step", "status"))
    when = F.col("t0") + F.col("step") * 600
    moves = ops.select("*", F.when(F.col("step") == 0, "insert").otherwise("update").alias("op"), when.alias("epoch"), F.lit(0).alias("kind"))
    fixes = ops.filter(uniform(seed + 4, e, F.col("step")) < CORRECTION_SHARE).select("*", F.lit("update").alias("op"), (when + 60).alias("epoch"), F.lit(1).alias("kind"))
    ends = ops.filter(F.col("deleted") & (F.col("step") == F.size("path") - 1)).select("*", F.lit("delete").alias("op"), (when + 120).alias("epoch"), F.lit(2).alias("kind"))
    rows = moves.unionByName(fixes).unionByName(ends)
    value = F.when(F.col("kind") == 1, F.round(F.col("amount") * 1.1, 2)).otherwise(F.col("amount"))
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    date = lambda c: F.struct(iso(c).alias("$date"))
    doc = F.to_json(F.struct(
        F.concat(F.lit("o-"), e.cast("string")).alias("_id"), F.col("entity").alias("id_proposta"), F.col("product").alias("tipo_produto"),
        F.lpad(F.pmod(F.xxhash64(F.lit(seed + 5), e), F.lit(10**11)).cast("string"), 11, "0").alias("cpf_cliente"), F.concat(F.lit("Cliente "), e.cast("string")).alias("nome_cliente"),
        value.alias("valor_solicitado"), "status", date(F.col("t0")).alias("data_criacao"), date(F.col("epoch")).alias("data_atualizacao"),
        F.when(F.col("product") == "consignado", 12 * (1 + F.pmod(e, F.lit(7)))).alias("prazo_meses"), F.when(F.col("product") == "cartao", 300 + F.pmod(e, F.lit(701))).alias("score_credito"), F.when(F.col("product") == "fgts", F.lit("Banco A")).alias("banco_parceiro"),
    ))
    changed = F.when(F.col("kind") == 0, F.to_json(F.struct(F.struct("status").alias("updatedFields")))).when(F.col("kind") == 1, F.to_json(F.struct(F.struct(value.alias("valor_solicitado")).alias("updatedFields"))))
    return rows.select(
        F.concat_ws("-", F.lpad(F.col("epoch").cast("string"), 12, "0"), F.col("id").cast("string"), F.col("kind").cast("string")).alias("event_id"),
        F.col("op").alias("operation_type"), F.col("epoch").alias("cluster_time_epoch"), F.to_json(F.struct(F.concat(F.lit("o-"), e.cast("string")).alias("_id"))).alias("document_key"),
        F.when(F.col("op") != "delete", doc).alias("full_document"), F.when(F.col("op") == "delete", doc).alias("full_document_before_change"),
        F.when(F.col("op") == "update", changed).alias("update_description"),
    )


def generate(spark: SparkSession, entities: int, seed: int = 42) -> DataFrame:
    return change_events(spark.range(entities), seed)


def load_stream(spark: SparkSession, per_second: int, seed: int = 42) -> DataFrame:
    """The same as a stream of so many new entities a second."""
    return change_events(spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("id")), seed)
