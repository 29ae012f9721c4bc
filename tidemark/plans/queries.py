"""The registered queries: every operator over the stored tables, and the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.documents import is_transition, overlay_document, residual_fields, text_at
from ..operators.envelope import build_envelope, parse_envelope, with_event_time
from ..operators.history import close_and_append, status_history
from ..operators.metrics import created_documents, decision_time, open_counts, product_volume, status_funnel
from ..operators.prepare import dedup_batch, dedup_stream, prepare_events
from ..operators.quality import lifecycle_graph, state_and_range_violations, transition_violations, violations_of
from ..operators.state import apply_changes, current_state, latest_per_key
from ..sources.changes import register
from ..sources.documents import DocumentStore
from ..sources.documents import change_stream as read_change_stream
from ..sources.generator import CORRECTION_SHARE, DELETE_SHARE, FIRST_STATUS, MOVES, PRODUCTS, change_events
from ..sources.store import UPSERT, TableStore, When
from ..streaming.pipeline import STRICT_STATE_CLAUSES, Pipeline, drain
from .cdc_view import CDC_SQL, EVENT_RULES, SLICES, cdc, cdc_of, documents, ntz, scratch, slices_of, table
from .reports import DECISIONS, REPORTS, register_views, report

_R = EVENT_RULES


def _history(spark, d):
    return status_history(cdc_of(spark, d))


def _log_records(envelopes: DataFrame) -> DataFrame:
    """Envelopes as records of a keyed log."""
    return envelopes.select("key", "value", F.lit("changes").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp"))


def _bronze(spark, d):
    return parse_envelope(_log_records(build_envelope(documents(cdc_of(spark, d)))))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return cdc(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


def bronze_envelope(spark, d):
    return _bronze(spark, d).select("entity_id", "operation_type", "cluster_time_epoch", "event_token", "key_is_fallback", "event_date", text_at(F.col("full_document_json"), "$.k").try_cast("int").alias("k"))


def bronze_by_date(spark, d):
    store = TableStore(spark, scratch(spark))
    rows = _bronze(spark, d)
    store.ensure("bronze", rows.schema)
    store.append("bronze", rows, "bronze", 0)
    store.append("bronze", rows, "bronze", 0)  # a replay adds nothing
    return store.read("bronze").groupBy("event_date").agg(F.count("*").alias("events"))


def dedup_tokens(spark, d):
    view = cdc_of(spark, d)
    return ntz(dedup_batch(view.unionByName(view)).select("event_token", "entity_id", "event_time"))


def dedup_tokens_stream(spark, d):
    root = scratch(spark)
    store = TableStore(spark, root)
    stream = _event_stream(spark, d).select("event_token", "entity_id", "event_time")
    store.ensure("events", stream.schema)
    both = dedup_stream(stream.unionByName(stream), "100 days")
    drain(both.writeStream.foreachBatch(lambda b, i: store.append("events", b, "dedup", i) and None).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    return ntz(store.read("events"))


def transition_filter(spark, d):
    bronze = _bronze(spark, d)
    return bronze.filter(is_transition(F.col("operation_type"), F.col("update_description_json"))).select("event_token", "operation_type")


def document_overlay(spark, d):
    update = F.concat(F.lit('{"updatedFields":{"k":'), (F.col("event_token") % 7).cast("string"), F.lit(',"extra":"x"}}'))
    update = F.when(F.col("event_token") % 2 == 0, update)
    doc = overlay_document(F.col("props"), update)
    return cdc_of(spark, d).select("event_token", text_at(doc, "$.k").cast("int").alias("k"), text_at(doc, "$.extra").alias("extra"))


def residual_document_fields(spark, d):
    doc = residual_fields(F.col("full_document_json"), _R.common_fields)
    return _bronze(spark, d).select("event_token", text_at(doc, "$.k").try_cast("int").alias("k"), text_at(doc, "$.status").alias("status"))


def prepared_events(spark, d):
    rows = prepare_events(with_event_time(_bronze(spark, d)), _R)
    return ntz(rows.select("event_token", "entity_id", "event_time", "product_type", "status", "requested_amount", "is_transition", "is_malformed"))


def scd2_history(spark, d):
    return ntz(_history(spark, d).select("entity_id", "product_type", "status", "valid_from", "valid_to", "event_token"))


def scd2_close_and_append(spark, d):
    columns = ("entity_id", "product_type", "status", "valid_from", "valid_to", "event_token")
    batches = [s.withColumnRenamed("event_time", "valid_from").select("entity_id", "product_type", "status", "valid_from", F.lit(None).cast("timestamp").alias("valid_to"), "event_token") for s in slices_of(cdc_of(spark, d))]
    out = batches[0].limit(0)
    for b in batches:
        out = close_and_append(out, b, columns)
    return ntz(out)


_STATE = ("entity_id", "product_type", "status", "amount", "event_time", "event_token")


def current_state_batch(spark, d):
    return ntz(current_state(cdc_of(spark, d)).select(*_STATE))


def current_state_merge(spark, d):
    view = cdc_of(spark, d)
    store = TableStore(spark, scratch(spark), buckets=8)
    deleted = (F.col("operation_type") == "delete").alias("is_deleted")
    store.ensure("state", view.select(*_STATE, deleted).schema, ("entity_id",))
    later = "s.event_time > t.event_time OR (s.event_time = t.event_time AND s.event_token > t.event_token)"
    for i, s in enumerate(slices_of(view)):
        store.merge("state", latest_per_key(s.select(*_STATE, deleted)), (When(True, later), When(False)), "state", i)
    return ntz(store.read("state").filter("NOT is_deleted").drop("is_deleted"))


def current_state_out_of_order(spark, d):
    """The last slice first: the guard keeps later events."""
    view = cdc_of(spark, d)
    state = view.select(*_STATE, F.lit(False).alias("is_deleted")).limit(0)
    for s in reversed(slices_of(view)):
        state = apply_changes(state, s, _STATE)
    return ntz(state.filter("NOT is_deleted").drop("is_deleted"))


def status_funnel_batch(spark, d):
    return ntz(status_funnel(_history(spark, d)))


def _stream_to_table(spark, d, build, name, keys):
    root = scratch(spark)
    store = TableStore(spark, root, buckets=8)
    stream = build(_event_stream(spark, d))
    store.ensure(name, stream.schema, keys)
    drain(stream.writeStream.outputMode("update").foreachBatch(lambda b, i: store.merge(name, b, UPSERT, name, i) and None).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    return store.read(name)


def status_funnel_stream(spark, d):
    return ntz(_stream_to_table(spark, d, lambda s: status_funnel(s.withColumnRenamed("event_time", "valid_from"), watermark="10 minutes"), "funnel", ("window_start", "window_end", "product_type", "status")))


def _created(view):
    return view.filter(F.col("operation_type") == "insert").withColumn("requested_amount", F.col("amount"))


def _rounded(df):
    return ntz(df.withColumn("total_value", F.round("total_value", 2)))


def product_volume_batch(spark, d):
    return _rounded(product_volume(_created(cdc_of(spark, d))))


def product_volume_stream(spark, d):
    return _rounded(_stream_to_table(spark, d, lambda s: product_volume(_created(s), watermark="10 minutes"), "volume", ("window_start", "window_end", "product_type")))


def product_volume_documents(spark, d):
    return _rounded(product_volume(created_documents(with_event_time(_bronze(spark, d)))))


def product_volume_orders(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("event_time"), F.col("o_orderpriority").alias("product_type"), F.col("o_totalprice").alias("requested_amount"))
    return _rounded(product_volume(orders, window="7 days"))


def decision_time_batch(spark, d):
    return ntz(decision_time(_history(spark, d), statuses=_R.decisions))


def decision_time_incremental(spark, d):
    history = _history(spark, d)
    store = TableStore(spark, scratch(spark), buckets=8)
    store.ensure("decision_time", decision_time(history, statuses=_R.decisions).schema, ("entity_id",))
    for i, s in enumerate(slices_of(history, "valid_from")):
        store.merge("decision_time", decision_time(history, s, _R.decisions), UPSERT, "decisions", i)
    return ntz(store.read("decision_time"))


def open_counts_batch(spark, d):
    return open_counts(_history(spark, d), _R.deleted)


def open_counts_overwrite(spark, d):
    history = _history(spark, d)
    store = TableStore(spark, scratch(spark))
    counts = open_counts(history, _R.deleted)
    store.ensure("open_counts", counts.schema)
    for i in range(2):
        store.overwrite("open_counts", counts, "open", i)
    store.compact("open_counts")
    return store.read("open_counts")


def state_range_violations(spark, d):
    view = cdc_of(spark, d).filter("operation_type <> 'delete'")
    return violations_of(view.select("entity_id", "product_type", "status", "amount"), _R).drop("detail")


def state_range_violations_documents(spark, d):
    return state_and_range_violations(_bronze(spark, d), _R)


def orders_range_violations(spark, d):
    orders = table(spark, d, "orders")
    rules = Settings(rules=type(_R)(statuses=("O", "F"), ranges=(("1-URGENT", 1_000.0, 200_000.0), ("2-HIGH", 1_000.0, 100_000.0)))).rules
    rows = orders.select(F.col("o_orderkey").cast("string").alias("entity_id"), F.col("o_orderpriority").alias("product_type"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    return violations_of(rows, rules).drop("detail")


def transition_violations_batch(spark, d):
    return transition_violations(_history(spark, d), rules=_R)


def transition_violations_incremental(spark, d):
    history = _history(spark, d)
    return transition_violations(history, slices_of(history, "valid_from")[-1], _R)


def _quality(spark, d):
    history = _history(spark, d)
    v = transition_violations(history, rules=_R).unionByName(violations_of(cdc_of(spark, d).filter("operation_type <> 'delete'").select("entity_id", "product_type", "status", "amount"), _R))
    return v.withColumn("detected_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))


def _events_report(spark, name, **tables):
    for t in tables.values():
        t.schema  # noqa: B018  resolve before the text is bound
    return report(spark, name, **tables)


def report_funnel(spark, d):
    return _events_report(spark, "report_funnel", status_funnel=status_funnel(_history(spark, d)))


def report_approval_rate(spark, d):
    renamed = status_funnel(_history(spark, d)).replace({"click": DECISIONS["approved"], "purchase": DECISIONS["rejected"]}, subset=["status"])
    return _events_report(spark, "report_approval_rate", status_funnel=renamed)


def report_decision_time(spark, d):
    return _events_report(spark, "report_decision_time", decision_time=decision_time(_history(spark, d), statuses=_R.decisions))


def report_volume(spark, d):
    volume = product_volume(_created(cdc_of(spark, d)))
    out = _events_report(spark, "report_volume", product_volume=volume)
    return ntz(out.withColumn("total_value", F.round("total_value", 2)))


def report_violations(spark, d):
    return ntz(_events_report(spark, "report_violations", quality_violations=_quality(spark, d)))


def report_reconciliation(spark, d):
    return _events_report(spark, "report_reconciliation", open_counts=open_counts(_history(spark, d), _R.deleted))


def reconciliation(spark, d):
    """Open entities by the history and by the current state."""
    a = open_counts(_history(spark, d), _R.deleted).agg(F.sum("quantity").alias("by_history"))
    b = current_state(cdc_of(spark, d)).agg(F.count("*").alias("by_state"))
    return a.select(F.lit(1).alias("one"), "by_history").join(b.select(F.lit(1).alias("one"), "by_state"), "one").drop("one")


def merge_generic(spark, d):
    """All kinds of clauses, with a null key."""
    nation = table(spark, d, "nation").select(F.when(F.col("n_nationkey") != 7, F.col("n_nationkey")).alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    store = TableStore(spark, scratch(spark), buckets=4)
    store.ensure("nation", nation.schema, ("k",))
    store.append("nation", nation.filter("k IS NULL OR k < 20"))
    source = nation.filter("k IS NULL OR k >= 10").withColumn("name", F.concat("name", F.lit("+")))
    store.merge("nation", source, (When(True, "s.region = 1", delete=True), When(True, "s.region = 2", {"name": "s.name"}), When(True, "s.k IS NULL", {"name": "concat(t.name, '?')"}), When(False, "s.region <> 3", {"k": "s.k", "name": "s.name", "region": "s.region"})))
    return store.read("nation")


def late_rows_dropped(spark, d):
    """A window that the watermark has passed stays as it was."""
    root = scratch(spark)
    store = TableStore(spark, root, buckets=2)
    rows = spark.sql("SELECT * FROM VALUES (0, '2024-01-01 10:00:10'), (1, '2024-01-01 11:00:00'), (2, '2024-01-01 10:00:15'), (3, '2024-01-01 11:00:20') AS t(n, at)")
    typed = rows.select("n", F.lit("p0").alias("product_type"), F.lit("view").alias("status"), F.col("at").cast("timestamp").alias("valid_from"))
    store.ensure("history", typed.schema)
    stream = status_funnel(store.stream("history"), "1 minute", "30 seconds")
    store.ensure("funnel", stream.schema, ("window_start", "window_end", "product_type", "status"))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, i: store.merge("funnel", b, UPSERT, "funnel", i) and None).option("checkpointLocation", f"{root}/checkpoint").trigger(processingTime="100 milliseconds").start()
    try:
        for n in range(4):
            store.append("history", typed.filter(F.col("n") == n))
            q.processAllAvailable()
    finally:
        q.stop()
    return ntz(store.read("funnel"))


def id_fallback(spark, d):
    changes = documents(cdc_of(spark, d)).withColumns({
        "full_document": F.when(F.col("cluster_time_epoch") % 3 == 0, F.col("full_document")), "full_document_before_change": F.when(F.col("cluster_time_epoch") % 5 == 0, F.col("full_document_before_change")),
        "document_key": F.when(F.col("cluster_time_epoch") % 2 == 0, F.col("document_key")),
    })
    return parse_envelope(_log_records(build_envelope(changes))).select("event_token", "entity_id", "key_is_fallback")


def lifecycle_edges(spark, d):
    return lifecycle_graph(spark)


def change_log_round_trip(spark, d):
    """Envelopes written to a keyed log of files and read back."""
    register(spark)
    path = scratch(spark).removeprefix("file:")
    build_envelope(documents(cdc_of(spark, d))).write.format("tidemark_log").mode("append").save(path)
    bronze = parse_envelope(spark.read.format("tidemark_log").load(path))
    return bronze.select("kafka_key", "entity_id", "operation_type", "event_token", "cluster_time_epoch")


def load_generator(spark, d):
    """The load of an entity for each customer, by operation and the status that it leaves behind."""
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    doc = F.coalesce("full_document", "full_document_before_change")
    events = change_events(n).select("event_id", "operation_type", text_at(doc, "$.tipo_produto").alias("product_type"), text_at(doc, "$.status").alias("status"))
    return events.groupBy("operation_type", "product_type", "status").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("tokens"))


_TABLES = ("bronze", "history", "created_documents", "current_state", "status_funnel", "product_volume", "decision_time", "open_counts", "quality_violations")


def full_pipeline(spark, d):
    """All events through the log, bronze, history, state, metrics and violations; rows of each table."""
    root = scratch(spark)
    settings = Settings(root=f"{root}/tables", checkpoints=f"{root}/checkpoints", merge_buckets=4, watermark="60 days", rules=_R)
    pipeline = Pipeline(spark, settings)
    register(spark)
    path = f"{root}/log".removeprefix("file:")
    build_envelope(documents(cdc_of(spark, d))).write.format("tidemark_log").mode("append").save(path)
    pipeline.run_once(spark.readStream.format("tidemark_log").load(path))
    out = None
    for name in _TABLES:
        n = pipeline.store.read(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


def store_replay_stream(spark, d):
    """Slices appended, replayed, cut off before they are moved, and compacted; what a stream of the table then gives."""
    root = scratch(spark)
    store = TableStore(spark, root)
    view = cdc_of(spark, d).select("event_token", "operation_type", F.to_date("event_time").alias("event_date"))
    store.ensure("events", view.schema, partition_by=("event_date",))
    slices = [view.filter(f"event_token % 3 = {i}") for i in range(3)]
    for i, s in enumerate(slices):
        writer = TableStore(spark, root)
        if i == 2:
            writer._publish = lambda *_: None  # it dies between its commit and the move
        writer.append("events", s, "q", i)
        store.append("events", s, "q", i)
        if i == 1:
            store.compact("events")
    store.ensure("copies", view.schema)
    drain(store.stream("events").writeStream.foreachBatch(lambda b, i: store.append("copies", b, "copies", i) and None).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    return store.read("copies").groupBy("event_date", "operation_type").agg(F.count("*").alias("events"))


def stored_views(spark, d):
    """SQL over the stored tables under the names that existing queries use."""
    store = TableStore(spark, scratch(spark))
    funnel = status_funnel(_history(spark, d))
    store.ensure("status_funnel", funnel.schema)
    store.append("status_funnel", funnel)
    register_views(store)
    return spark.sql("SELECT tipo_produto, status, CAST(sum(quantidade) AS BIGINT) AS quantidade_total FROM funil_status GROUP BY tipo_produto, status")


def current_state_strict(spark, d):
    """The plain clauses, which are right for batches in order."""
    view = cdc_of(spark, d)
    store = TableStore(spark, scratch(spark), buckets=8)
    deleted = (F.col("operation_type") == "delete").alias("is_deleted")
    store.ensure("state", view.select(*_STATE, deleted).schema, ("entity_id",))
    for i, s in enumerate(slices_of(view)):
        store.merge("state", latest_per_key(s.select(*_STATE, deleted)), STRICT_STATE_CLAUSES, "state", i)
    return ntz(store.read("state").drop("is_deleted"))


def change_stream(spark, d):
    """A collection of nations: inserts, updates and deletes, its change stream, and the envelopes of it."""
    path = f"{scratch(spark)}/collection".removeprefix("file:")
    store = DocumentStore(path)
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():
        store.insert(str(r.n_nationkey), {"id_proposta": r.n_name, "status": "open", "region": r.n_regionkey}, r.n_nationkey)
        if r.n_regionkey == 1:
            store.set_fields(str(r.n_nationkey), {"status": "closed"}, 100 + r.n_nationkey)
        if r.n_regionkey == 2:
            store.delete(str(r.n_nationkey), 200 + r.n_nationkey)
        store.flush()
    root = scratch(spark)
    tables = TableStore(spark, root)
    envelopes = parse_envelope(_log_records(build_envelope(read_change_stream(spark, path, "start", 10))))
    tables.ensure("bronze", envelopes.schema)
    drain(envelopes.writeStream.foreachBatch(lambda b, i: tables.append("bronze", b, "bronze", i) and None).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    doc = F.coalesce("full_document_json", "full_document_before_change_json")
    return tables.read("bronze").select("entity_id", "operation_type", "cluster_time_epoch", text_at(doc, "$.status").alias("status"), text_at(F.col("update_description_json"), "$.updatedFields.status").alias("own_status"))


_NAMES = {
    "current_state_batch": "current_state", "status_funnel_batch": "status_funnel", "product_volume_batch": "product_volume",
    "decision_time_batch": "decision_time", "open_counts_batch": "open_counts", "transition_violations_batch": "transition_violations",
}
QUERIES = {
    _NAMES.get(f.__name__, f.__name__): f
    for f in (
        bronze_envelope, bronze_by_date, dedup_tokens, dedup_tokens_stream, transition_filter, document_overlay, residual_document_fields, prepared_events,
        scd2_history, scd2_close_and_append, current_state_batch, current_state_merge, current_state_out_of_order, status_funnel_batch, status_funnel_stream,
        product_volume_batch, product_volume_stream, product_volume_documents, product_volume_orders, decision_time_batch, decision_time_incremental,
        open_counts_batch, open_counts_overwrite, state_range_violations, state_range_violations_documents, orders_range_violations, transition_violations_batch,
        transition_violations_incremental, report_funnel, report_approval_rate, report_decision_time, report_volume, report_violations, report_reconciliation,
        reconciliation, merge_generic, late_rows_dropped, id_fallback, lifecycle_edges, change_log_round_trip, load_generator, full_pipeline,
        store_replay_stream, stored_views, current_state_strict, change_stream,
    )
}

# the same results in SQL

_HISTORY = f"{CDC_SQL}, history AS (SELECT *, event_time AS valid_from, lead(event_time) OVER (PARTITION BY entity_id ORDER BY event_time, event_token) AS valid_to, lag(status) OVER (PARTITION BY entity_id ORDER BY event_time, event_token) AS before FROM cdc)"
_FUNNEL = "status_funnel AS (SELECT date_trunc('day', valid_from) AS window_start, date_trunc('day', valid_from) + INTERVAL 1 DAY AS window_end, product_type, status, count(*) AS quantity FROM history GROUP BY ALL)"
_VOLUME = "product_volume AS (SELECT date_trunc('day', event_time) AS window_start, date_trunc('day', event_time) + INTERVAL 1 DAY AS window_end, product_type, count(*) AS volume, sum(amount) AS total_value FROM cdc WHERE operation_type = 'insert' GROUP BY ALL)"
_DECISIONS = """decision_time AS (
    SELECT h.entity_id, d.product_type, d.status AS decision_status, min(h.valid_from) AS created_at, d.valid_from AS decided_at,
           CAST(floor(epoch(d.valid_from)) AS BIGINT) - CAST(floor(epoch(min(h.valid_from))) AS BIGINT) AS decision_seconds
    FROM history h JOIN (SELECT * FROM history WHERE status IN ('purchase', 'click') QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, event_token DESC) = 1) d USING (entity_id)
    GROUP BY h.entity_id, d.product_type, d.status, d.valid_from)"""
_OPEN = "open_counts AS (SELECT product_type, status, count(*) AS quantity FROM history WHERE valid_to IS NULL AND status <> 'error' GROUP BY ALL)"
_EDGES = " OR ".join(f"(before = '{a}' AND status = '{b}')" for a, b in _R.edges)
_BAD = f"SELECT 'transicao_invalida' AS violation_type, entity_id, product_type, before || ' -> ' || status AS detail, valid_from FROM history WHERE before IS NOT NULL AND before <> status AND status <> 'error' AND NOT ({_EDGES})"
_RANGE = "NOT coalesce(CASE product_type WHEN 'p0' THEN amount BETWEEN 10 AND 400 WHEN 'p1' THEN amount BETWEEN 0 AND 300 ELSE false END, false)"
_STATES = f"""SELECT 'estado_impossivel' AS violation_type, entity_id, product_type FROM cdc WHERE operation_type <> 'delete' AND status NOT IN ('signup', 'view', 'click', 'error')
    UNION ALL SELECT 'valor_fora_de_faixa', entity_id, product_type FROM cdc WHERE operation_type <> 'delete' AND {_RANGE}"""
_STATE_SQL = f"WITH {CDC_SQL} SELECT entity_id, product_type, status, amount, event_time, event_token FROM cdc QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_time DESC, event_token DESC) = 1"
_STATE_SQL = f"SELECT * FROM ({_STATE_SQL}) WHERE status <> 'error'"
_HISTORY_SQL = f"WITH {_HISTORY} SELECT entity_id, product_type, status, valid_from, valid_to, event_token FROM history"
_FUNNEL_SQL = f"WITH {_HISTORY}, {_FUNNEL} SELECT * FROM status_funnel"
_VOLUME_SQL = f"WITH {CDC_SQL}, {_VOLUME} SELECT window_start, window_end, product_type, volume, round(total_value, 2) AS total_value FROM product_volume"
_DECISIONS_SQL = f"WITH {_HISTORY}, {_DECISIONS} SELECT * FROM decision_time"
_OPEN_SQL = f"WITH {_HISTORY}, {_OPEN} SELECT * FROM open_counts"
_TEXT = {k: v.format(**DECISIONS) for k, v in REPORTS.items()}
_EPOCH = "CAST(floor(epoch(event_time)) AS BIGINT)"

_PREPARED = f"{CDC_SQL}, prepared AS (SELECT CAST(event_token AS VARCHAR) AS event_token, CASE WHEN bare THEN 'key-' || entity_id ELSE entity_id END AS entity_id, date_trunc('second', event_time) AS event_time, CASE WHEN NOT bare THEN product_type END AS product_type, status, operation_type, amount FROM (SELECT *, operation_type = 'delete' AND event_token % 2 = 1 AS bare FROM cdc)), history AS (SELECT *, event_time AS valid_from, lead(event_time) OVER w AS valid_to, lag(status) OVER w AS before FROM prepared WHERE status <> 'view' WINDOW w AS (PARTITION BY entity_id ORDER BY event_time, event_token))"
_DETAILS = f"""SELECT 'estado_impossivel' AS violation_type, entity_id, product_type, 'status desconhecido: ' || status AS detail FROM cdc WHERE operation_type <> 'delete' AND status NOT IN ('signup', 'view', 'click', 'error')
    UNION ALL SELECT 'valor_fora_de_faixa', entity_id, product_type, 'valor_solicitado fora da faixa esperada: ' || CAST(amount AS VARCHAR) FROM cdc WHERE operation_type <> 'delete' AND {_RANGE}"""
_ROWS = {
    "bronze": "SELECT count(*) FROM prepared", "history": "SELECT count(*) FROM history", "created_documents": "SELECT count(*) FROM prepared WHERE operation_type = 'insert'",
    "current_state": "SELECT count(DISTINCT entity_id) FROM prepared", "status_funnel": "SELECT count(*) FROM (SELECT DISTINCT date_trunc('day', valid_from), product_type, status FROM history)",
    "product_volume": "SELECT count(*) FROM (SELECT DISTINCT date_trunc('day', event_time), product_type FROM prepared WHERE operation_type = 'insert')",
    "decision_time": "SELECT count(DISTINCT entity_id) FROM history WHERE status IN ('purchase', 'click')", "open_counts": "SELECT count(*) FROM (SELECT DISTINCT product_type, status FROM history WHERE valid_to IS NULL AND status <> 'error')",
    "quality_violations": f"SELECT (SELECT count(*) FROM ({_BAD})) + (SELECT count(*) FROM ({_STATES}))",
}


def _uniform_sql(seed: int, *of: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join([str(seed), *of])})), 1, 8) AS BIGINT) / 4294967296.0)"


def _choose_sql(u: str, weights) -> str:
    below, total, out = 0.0, sum(w for _, w in weights), "CASE"
    for value, w in weights:
        below += w / total
        out += f" WHEN {u} < {below!r} THEN '{value}'"
    return f"{out} ELSE '{weights[-1][0]}' END"


_MOVE_SQL = "CASE status " + " ".join(f"WHEN '{s}' THEN {_choose_sql(_uniform_sql(52, 'id', 'step + 1'), w)}" for s, w in MOVES.items()) + " END"
_LOAD_SQL = f"""
    WITH RECURSIVE e AS (SELECT c_custkey AS id, {_choose_sql(_uniform_sql(42, 'c_custkey'), PRODUCTS)} AS product_type, {_uniform_sql(44, 'c_custkey')} < {DELETE_SHARE} AS deleted FROM customer),
    path AS (SELECT id, 0 AS step, '{FIRST_STATUS}' AS status FROM e UNION ALL SELECT id, step + 1, {_MOVE_SQL} FROM path WHERE step < 6 AND status IN ({', '.join(f"'{s}'" for s in MOVES)})),
    ops AS (SELECT p.*, e.product_type, e.deleted, step = max(step) OVER (PARTITION BY id) AS ends FROM path p JOIN e USING (id)),
    events AS (
        SELECT CASE step WHEN 0 THEN 'insert' ELSE 'update' END AS operation_type, product_type, status FROM ops
        UNION ALL SELECT 'update', product_type, status FROM ops WHERE {_uniform_sql(46, 'id', 'step')} < {CORRECTION_SHARE}
        UNION ALL SELECT 'delete', product_type, status FROM ops WHERE deleted AND ends
    )
    SELECT operation_type, product_type, status, count(*) AS events, count(*) AS tokens FROM events GROUP BY ALL
"""

ORACLE_SQL = {
    "bronze_envelope": f"WITH {CDC_SQL} SELECT CASE WHEN operation_type = 'delete' AND event_token % 2 = 1 THEN 'key-' || entity_id ELSE entity_id END AS entity_id, operation_type, {_EPOCH} AS cluster_time_epoch, CAST(event_token AS VARCHAR) AS event_token, operation_type = 'delete' AND event_token % 2 = 1 AS key_is_fallback, CAST(event_time AS DATE) AS event_date, CASE WHEN operation_type <> 'delete' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM cdc",
    "bronze_by_date": "SELECT CAST(ts AS DATE) AS event_date, count(*) AS events FROM events GROUP BY 1",
    "dedup_tokens": f"WITH {CDC_SQL} SELECT DISTINCT event_token, entity_id, event_time FROM cdc",
    "dedup_tokens_stream": f"WITH {CDC_SQL} SELECT DISTINCT event_token, entity_id, event_time FROM cdc",
    "transition_filter": f"WITH {CDC_SQL} SELECT CAST(event_token AS VARCHAR) AS event_token, operation_type FROM cdc WHERE status <> 'view'",
    "document_overlay": f"WITH {CDC_SQL} SELECT event_token, CASE WHEN event_token % 2 = 0 THEN CAST(event_token % 7 AS INTEGER) ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, CASE WHEN event_token % 2 = 0 THEN 'x' END AS extra FROM cdc",
    "residual_document_fields": f"WITH {CDC_SQL} SELECT CAST(event_token AS VARCHAR) AS event_token, CASE WHEN operation_type <> 'delete' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, CAST(NULL AS VARCHAR) AS status FROM cdc",
    "prepared_events": f"WITH {CDC_SQL}, c AS (SELECT *, operation_type = 'delete' AND event_token % 2 = 1 AS bare FROM cdc) SELECT CAST(event_token AS VARCHAR) AS event_token, CASE WHEN bare THEN 'key-' || entity_id ELSE entity_id END AS entity_id, date_trunc('second', event_time) AS event_time, CASE WHEN NOT bare THEN product_type END AS product_type, status, CASE WHEN bare THEN NULL WHEN status = 'view' THEN 1.5 ELSE amount END AS requested_amount, status <> 'view' AS is_transition, false AS is_malformed FROM c",
    "scd2_history": _HISTORY_SQL, "scd2_close_and_append": _HISTORY_SQL,
    "current_state": _STATE_SQL, "current_state_merge": _STATE_SQL, "current_state_out_of_order": _STATE_SQL,
    "status_funnel": _FUNNEL_SQL, "status_funnel_stream": _FUNNEL_SQL,
    "product_volume": _VOLUME_SQL, "product_volume_stream": _VOLUME_SQL, "product_volume_documents": _VOLUME_SQL,
    "product_volume_orders": "WITH o AS (SELECT time_bucket(INTERVAL 7 DAY, o_orderdate, TIMESTAMP '1970-01-01') AS window_start, * FROM orders) SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, o_orderpriority AS product_type, count(*) AS volume, round(sum(o_totalprice), 2) AS total_value FROM o GROUP BY ALL",
    "decision_time": _DECISIONS_SQL, "decision_time_incremental": _DECISIONS_SQL, "open_counts": _OPEN_SQL, "open_counts_overwrite": _OPEN_SQL,
    "state_range_violations": f"WITH {CDC_SQL} {_STATES}", "state_range_violations_documents": f"WITH {CDC_SQL} {_DETAILS}",
    "load_generator": _LOAD_SQL,
    "full_pipeline": f"WITH {_PREPARED} " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, ({x}) AS n_rows" for t, x in _ROWS.items()),
    "store_replay_stream": f"WITH {CDC_SQL} SELECT CAST(event_time AS DATE) AS event_date, operation_type, count(*) AS events FROM cdc GROUP BY ALL",
    "stored_views": f"WITH {_HISTORY} SELECT product_type AS tipo_produto, status, count(*) AS quantidade_total FROM history GROUP BY ALL",
    "current_state_strict": _STATE_SQL,
    "change_stream": "WITH n AS (SELECT *, CASE n_regionkey WHEN 1 THEN 'closed' ELSE 'open' END AS status FROM nation) SELECT n_name AS entity_id, op AS operation_type, CAST(n_nationkey + more AS BIGINT) AS cluster_time_epoch, CASE WHEN op = 'insert' THEN 'open' ELSE status END AS status, CASE op WHEN 'update' THEN 'closed' END AS own_status FROM n JOIN (VALUES ('insert', 0, NULL), ('update', 100, 1), ('delete', 200, 2)) AS o(op, more, region) ON region IS NULL OR region = n_regionkey",
    "orders_range_violations": "WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, o_orderpriority AS product_type, o_orderstatus AS status, o_totalprice AS amount FROM orders) SELECT 'estado_impossivel' AS violation_type, entity_id, product_type FROM o WHERE status IS NULL OR status NOT IN ('O', 'F') UNION ALL SELECT 'valor_fora_de_faixa', entity_id, product_type FROM o WHERE NOT coalesce(CASE product_type WHEN '1-URGENT' THEN amount BETWEEN 1000 AND 200000 WHEN '2-HIGH' THEN amount BETWEEN 1000 AND 100000 ELSE false END, false)",
    "transition_violations": f"WITH {_HISTORY} SELECT violation_type, entity_id, product_type, detail FROM ({_BAD})",
    "transition_violations_incremental": f"WITH {_HISTORY} SELECT violation_type, entity_id, product_type, detail FROM ({_BAD}) WHERE valid_from >= TIMESTAMP '{SLICES[1]}'",
    "report_funnel": f"WITH {_HISTORY}, {_FUNNEL} {_TEXT['report_funnel']}",
    "report_approval_rate": f"WITH {_HISTORY}, {_FUNNEL.replace('status_funnel', 'f')}, status_funnel AS (SELECT * REPLACE (CASE status WHEN 'click' THEN 'aprovada' WHEN 'purchase' THEN 'recusada' ELSE status END AS status) FROM f) {_TEXT['report_approval_rate']}",
    "report_decision_time": f"WITH {_HISTORY}, {_DECISIONS} {_TEXT['report_decision_time']}",
    "report_volume": f"WITH {CDC_SQL}, {_VOLUME} SELECT * REPLACE (round(total_value, 2) AS total_value) FROM ({_TEXT['report_volume']})",
    "report_violations": f"WITH {_HISTORY}, quality_violations AS (SELECT violation_type, entity_id, product_type, TIMESTAMP '2024-02-01' AS detected_at FROM ({_BAD}) UNION ALL SELECT *, TIMESTAMP '2024-02-01' FROM ({_STATES})) {_TEXT['report_violations']}",
    "report_reconciliation": f"WITH {_HISTORY}, {_OPEN} {_TEXT['report_reconciliation']}",
    "reconciliation": f"WITH {_HISTORY}, {_OPEN} SELECT (SELECT CAST(sum(quantity) AS BIGINT) FROM open_counts) AS by_history, (SELECT count(*) FROM ({_STATE_SQL})) AS by_state",
    "merge_generic": "WITH n AS (SELECT CASE WHEN n_nationkey <> 7 THEN n_nationkey END AS k, n_name AS name, n_regionkey AS region FROM nation) SELECT k, CASE WHEN (k IS NULL OR k >= 10) AND region = 2 THEN name || '+' WHEN k IS NULL THEN name || '?' WHEN k >= 20 THEN name || '+' ELSE name END AS name, region FROM n WHERE CASE WHEN k IS NULL THEN region <> 1 WHEN k < 10 THEN true WHEN k < 20 THEN region <> 1 ELSE region <> 3 END",
    "late_rows_dropped": "SELECT TIMESTAMP '2024-01-01 10:00:00' AS window_start, TIMESTAMP '2024-01-01 10:01:00' AS window_end, 'p0' AS product_type, 'view' AS status, CAST(1 AS BIGINT) AS quantity UNION ALL SELECT TIMESTAMP '2024-01-01 11:00:00', TIMESTAMP '2024-01-01 11:01:00', 'p0', 'view', CAST(2 AS BIGINT)",
    "id_fallback": f"WITH {CDC_SQL}, c AS (SELECT *, {_EPOCH} AS e FROM cdc), i AS (SELECT *, CASE WHEN operation_type <> 'delete' AND e % 3 = 0 THEN entity_id WHEN operation_type = 'delete' AND event_token % 2 = 0 AND e % 5 = 0 THEN entity_id END AS own FROM c) SELECT CAST(event_token AS VARCHAR) AS event_token, coalesce(own, CASE WHEN e % 2 = 0 THEN 'key-' || entity_id END, CAST(event_token AS VARCHAR)) AS entity_id, own IS NULL AS key_is_fallback FROM i",
    "lifecycle_edges": "SELECT * FROM (VALUES ('em_analise', 'pendente_documentacao', false), ('em_analise', 'aprovada', false), ('em_analise', 'recusada', true), ('em_analise', 'cancelada', true), ('pendente_documentacao', 'em_analise', false), ('pendente_documentacao', 'aprovada', false), ('pendente_documentacao', 'recusada', true), ('pendente_documentacao', 'cancelada', true), ('aprovada', 'paga', true), ('aprovada', 'cancelada', true)) AS t(from_status, to_status, to_terminal)",
    "change_log_round_trip": f"WITH {CDC_SQL}, c AS (SELECT *, CASE WHEN operation_type = 'delete' AND event_token % 2 = 1 THEN 'key-' || entity_id ELSE entity_id END AS id FROM cdc) SELECT id AS kafka_key, id AS entity_id, operation_type, CAST(event_token AS VARCHAR) AS event_token, {_EPOCH} AS cluster_time_epoch FROM c",
}
