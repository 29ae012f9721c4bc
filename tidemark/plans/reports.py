"""The SQL reports over the stored tables, and the views that they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import TableStore

#: Each text runs in Spark and, over tables of these names, in other engines.
REPORTS = {
    "report_funnel": """
        SELECT product_type, status, CAST(sum(quantity) AS BIGINT) AS total_quantity
        FROM status_funnel GROUP BY product_type, status ORDER BY product_type, total_quantity DESC, status
    """,
    "report_approval_rate": """
        SELECT product_type, CAST(nullif(sum(yes), 0) AS BIGINT) AS approved, CAST(nullif(sum(no), 0) AS BIGINT) AS rejected,
               round(CAST(nullif(sum(yes), 0) AS DOUBLE) / sum(yes + no), 4) AS approval_rate
        FROM (
            SELECT product_type, CASE WHEN status = '{approved}' THEN quantity ELSE 0 END AS yes, CASE WHEN status = '{rejected}' THEN quantity ELSE 0 END AS no
            FROM status_funnel
        ) AS decided GROUP BY product_type HAVING sum(yes + no) > 0 ORDER BY product_type
    """,
    "report_decision_time": """
        SELECT product_type, decision_status, count(*) AS entities, round(avg(decision_seconds) / 60.0, 1) AS mean_minutes
        FROM decision_time GROUP BY product_type, decision_status ORDER BY product_type, decision_status
    """,
    "report_volume": """
        SELECT window_start, product_type, volume, total_value, round(total_value / volume, 2) AS mean_value
        FROM product_volume ORDER BY window_start, product_type
    """,
    "report_violations": """
        SELECT violation_type, product_type, count(*) AS quantity, max(detected_at) AS last_detected
        FROM quality_violations GROUP BY violation_type, product_type ORDER BY quantity DESC, violation_type, product_type
    """,
    "report_reconciliation": """
        SELECT CAST(sum(quantity) AS BIGINT) AS open_entities FROM open_counts
    """,
}
DECISIONS = {"approved": "aprovada", "rejected": "recusada"}
#: Names under which existing queries know the tables and their columns.
ALIASES = {
    "funil_status": ("status_funnel", {"window_start": "janela_inicio", "window_end": "janela_fim", "product_type": "tipo_produto", "quantity": "quantidade"}),
    "tempo_decisao": ("decision_time", {"entity_id": "id_proposta", "product_type": "tipo_produto", "decision_status": "status_decisao", "created_at": "data_criacao", "decided_at": "data_decisao", "decision_seconds": "tempo_decisao_segundos"}),
    "contagem_atual_por_status": ("open_counts", {"product_type": "tipo_produto", "quantity": "quantidade"}),
    "volume_valor_por_produto": ("product_volume", {"window_start": "janela_inicio", "window_end": "janela_fim", "product_type": "tipo_produto", "total_value": "valor_total"}),
    "qualidade_violacoes": ("quality_violations", {"violation_type": "tipo_violacao", "entity_id": "id_proposta", "product_type": "tipo_produto", "detail": "detalhe", "detected_at": "detectado_em"}),
}


def register_views(store: TableStore, aliases: bool = True) -> None:
    """Temporary views over the last version of each stored table."""
    for name in ("status_funnel", "product_volume", "decision_time", "open_counts", "quality_violations"):
        if store.exists(name):
            store.read(name).createOrReplaceTempView(name)
    for alias, (name, columns) in ALIASES.items() if aliases else ():
        if store.exists(name):
            store.read(name).withColumnsRenamed(columns).createOrReplaceTempView(alias)


def report(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """A report over the given tables, or over views of their names."""
    text = REPORTS[name].format(**DECISIONS)
    if not tables:
        return spark.sql(text)
    for table in tables:
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(text, **tables)
