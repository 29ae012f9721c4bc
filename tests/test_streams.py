"""The pipeline end to end: what the batches of a stream leave in the tables."""

import datetime
import itertools
import json
import os
import signal
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark import jobs
from tidemark.operators.prepare import dedup_batch, dedup_stream
from tidemark.plans.reports import register_views
from tidemark.operators.state import STATE_COLUMNS, apply_changes
from tidemark.sources.changes import PositionLost, read_range, register
from tidemark.sources.documents import DocumentStore, change_stream, read_changes
from tidemark.sources.generator import generate, load_stream
from tidemark.sources.store import UPSERT, DuplicateSourceKeys, TableStore, When
from tidemark.streaming.pipeline import Pipeline
from tidemark.streaming.supervisor import Supervisor, watch


@pytest.fixture
def pipeline(spark, tmp_path):
    p = Pipeline(spark, Settings(root=str(tmp_path / "t"), checkpoints=str(tmp_path / "c"), merge_buckets=2, watermark="2 minutes"))
    p.prepare_tables()
    return p


def event(token, op, epoch, status="em_analise", amount=5000.0, update=None, entity="p1", product="cartao", before=None):
    doc = json.dumps({"id_proposta": entity, "tipo_produto": product, "status": status, "valor_solicitado": amount})
    return json.dumps({
        "id_proposta": entity, "operation_type": op, "cluster_time_epoch": epoch, "resume_token": {"_data": token}, "document_key": {"_id": "k"},
        "full_document": None if op == "delete" else json.loads(doc), "full_document_before_change": json.loads(before or doc) if op == "delete" else None,
        "update_description": {"updatedFields": update} if update is not None else None, "chave_derivada_de_fallback": False,
    })


def feed(p, *batches):
    """Each batch goes through bronze and silver by itself."""
    for values in batches:
        rows = p.spark.createDataFrame([(v,) for v in values], "value string")
        from tidemark.operators.envelope import parse_envelope

        log = rows.select(F.lit("k").alias("key"), "value", F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"), F.current_timestamp().alias("timestamp"))
        p.store.append("bronze", parse_envelope(log))
        q = p.start_silver(once=True)
        q.awaitTermination()


def history(p):
    return [(r.status, r.valid_from.timestamp(), r.valid_to.timestamp() if r.valid_to else None) for r in p.history().orderBy("valid_from", "event_token").collect()]


def test_transition_correction_delete_duplicate(pipeline):
    p = pipeline
    feed(p, [event("t1", "insert", 1000, amount=100.0), event("t1", "insert", 1000, amount=100.0)], [event("t2", "update", 1010, "paga", update={"status": "aprovada"}), event("t3", "update", 1020, "aprovada", 250.0, {"valor_solicitado": 250.0})])
    assert history(p) == [("em_analise", 1000, 1010), ("aprovada", 1010, None)]  # its own change, not the newer image
    (state,) = p.state().collect()
    assert (state.status, state.requested_amount) == ("aprovada", 250.0)
    feed(p, [event("t4", "delete", 1030)])
    assert history(p)[-1] == ("deletada", 1030, None) and p.state().count() == 0
    feed(p, [event("t5", "update", 1025, "aprovada", 1.0, {"valor_solicitado": 1.0})])
    assert p.state().count() == 0  # an older event does not bring it back


def test_out_of_order_within_the_watermark(pipeline):
    p = pipeline
    feed(p, [event("a", "insert", 5000, "em_analise")], [event("c", "update", 5060, "paga", update={"status": "paga"})], [event("b", "update", 5030, "aprovada", update={"status": "aprovada"})])
    assert history(p) == [("em_analise", 5000, 5030), ("aprovada", 5030, 5060), ("paga", 5060, None)]
    assert p.state().first().status == "paga"


def test_gold_and_quality(pipeline):
    p = pipeline
    feed(p, [event("1", "insert", 36000, amount=10_000.0), event("2", "insert", 36010, amount=999_999.0, entity="p2"), event("3", "update", 37800, "recusada", update={"status": "recusada"})])
    for q in (*p.start_gold(once=True), *p.start_quality(once=True)):
        q.awaitTermination()
    feed(p, [event("4", "update", 37860, "aprovada", update={"status": "aprovada"}), event("5", "insert", 37870, "odd", 5000.0, entity="p3")])
    for q in (*p.start_gold(once=True), *p.start_quality(once=True)):
        q.awaitTermination()
    read = p.store.read
    assert {(r.status, r.quantity) for r in read("status_funnel").collect()} == {("em_analise", 2), ("recusada", 1), ("aprovada", 1), ("odd", 1)}
    assert [(r.volume, r.total_value) for r in read("product_volume").collect()] == [(3, 1_014_999.0)]
    assert [(r.decision_status, r.decision_seconds) for r in read("decision_time").collect()] == [("aprovada", 1860)]
    assert {(r.status, r.quantity) for r in read("open_counts").collect()} == {("em_analise", 1), ("aprovada", 1), ("odd", 1)}
    found = {(r.violation_type, r.entity_id, r.detail) for r in read("quality_violations").collect()}
    assert found == {("valor_fora_de_faixa", "p2", "valor_solicitado fora da faixa esperada: 999999.0"), ("estado_impossivel", "p3", "status desconhecido: odd"), ("transicao_invalida", "p1", "recusada -> aprovada")}
    before = {t: read(t).count() for t in ("status_funnel", "quality_violations", "history")}
    p.write_transition_violations(read("history"), 0)  # a replay of a batch
    assert before == {t: read(t).count() for t in before}


def test_state_is_the_same_in_any_order(spark):
    rows = [("e", "x", i, t, op) for i, (t, op) in enumerate([(1, "insert"), (2, "update"), (2, "update"), (3, "delete"), (4, "insert")])]
    base = spark.createDataFrame([(e, p, f"t{i}", float(t), op) for e, p, i, t, op in rows], "entity_id string, product_type string, event_token string, at double, operation_type string")
    events = base.select("entity_id", "product_type", "event_token", F.col("at").cast("timestamp").alias("event_time"), "operation_type")
    columns = ("entity_id", "product_type", "event_time", "event_token")
    results = set()
    for order in itertools.islice(itertools.permutations(range(5)), 0, 120, 17):
        state = events.select(*columns, F.lit(False).alias("is_deleted")).limit(0)
        for i in order:
            state = apply_changes(state, events.filter(F.col("event_token") == f"t{i}"), columns)
        results.add(tuple(map(tuple, state.select("event_token", "is_deleted").collect())))
    assert results == {(("t4", False),)}
    assert len(STATE_COLUMNS) == 11


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), buckets=3)
    with pytest.raises(RuntimeError):
        store.wait_until_exists("t", 2, 0.0, lambda s: None)
    store.ensure("t", "k long, v string", ("k",))
    store.ensure("t", "k long, v string", ("k",))
    assert store.read("t").count() == 0 and store.exists("t")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    assert store.append("t", rows, "q", 0) and not store.append("t", rows, "q", 0)
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k long, v string")
    assert store.merge("t", new, UPSERT, "q", 1) and not store.merge("t", new, UPSERT, "q", 1)
    want = {(1, "a"), (2, "B"), (3, "C"), (None, "N")}
    assert {tuple(r) for r in store.read("t").collect()} == want
    with pytest.raises(DuplicateSourceKeys):
        store.merge("t", new.union(new), UPSERT)
    store.merge("t", new, (When(True, "s.k = 2", delete=True),))
    assert {r.k for r in store.read("t").collect()} == {1, 3, None}
    version = store.history("t")[-1]["version"]
    assert store.compact("t") and {r.k for r in store.read("t").collect()} == {1, 3, None}
    assert store.read("t", version).count() == 3
    store.overwrite("t", rows)
    assert store.vacuum("t") > 0 and store.read("t").count() == 3


def stream_count(store, name):
    view = f"rows_{uuid.uuid4().hex}"
    q = store.stream(name).writeStream.format("memory").queryName(view).trigger(availableNow=True).start()
    q.awaitTermination()
    return store.spark.table(view).count()


def test_streams_see_committed_appends_once(spark, tmp_path, monkeypatch):
    """A writer is cut off before its commit, another between commit and move; then the batches are replayed, and the table is compacted."""
    store = TableStore(spark, str(tmp_path))
    store.ensure("t", "n long, at date", partition_by=("at",))
    rows = spark.range(5).select(F.col("id").alias("n"), F.when(F.col("id") > 0, F.to_date(F.lit("2024-01-01"))).alias("at"))
    store.append("t", rows, "q", 0)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            store.append("t", rows, "q", 1)
    assert store.read("t").count() == stream_count(store, "t") == 5
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: None)
        store.append("t", rows, "q", 1)
    again = TableStore(spark, str(tmp_path))
    assert not again.append("t", rows, "q", 1)
    assert again.read("t").count() == stream_count(again, "t") == 10
    assert again.compact("t") and again.read("t").count() == stream_count(again, "t") == 10
    assert again.vacuum("t") == 0 and stream_count(again, "t") == 10
    assert {r["at"] for r in again.stream("t").sparkSession.table(_last_view(again)).collect()} == {None, datetime.date(2024, 1, 1)}


def _last_view(store):
    view = f"rows_{uuid.uuid4().hex}"
    store.stream("t").writeStream.format("memory").queryName(view).trigger(availableNow=True).start().awaitTermination()
    return view


def test_commits_are_whole_and_lost_races_retry(spark, tmp_path):
    a, b = TableStore(spark, str(tmp_path)), TableStore(spark, str(tmp_path))
    a.ensure("t", "n long")
    rows = spark.range(2).toDF("n")
    state = a._state("t")
    assert b.append("t", rows, "b", 0)
    commit = {"operation": "append", "add": [], "remove": [], "query": None, "batch": None}
    assert not a._commit("t", state, commit)  # its number is taken
    (tmp_path / "t" / "_log" / ".half").write_text("{")  # a writer was cut off
    for i in range(45):
        assert a.append("t", rows.limit(0) if i else rows, "a", i)
    assert a.read("t").count() == 4 and b.read("t").count() == 4 and not b.append("t", rows, "a", 44)
    assert len(list((tmp_path / "t" / "_log").glob("*.state"))) == 2 and a.read("t", 1).count() == 2
    with pytest.raises(LookupError):
        a.read("t", 99)


def test_partition_filters_prune_and_buckets_are_read_alone(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), buckets=8)
    store.ensure("t", "n long, at date", partition_by=("at",))
    store.append("t", spark.sql("SELECT id AS n, date_add(DATE'2024-01-01', CAST(id % 3 AS INT)) AS at FROM range(30)"))
    one = store.read("t").filter("at = DATE'2024-01-02'")
    assert one.count() == 10 and "PartitionFilters: [isnotnull(at" in one._jdf.queryExecution().toString()
    store.ensure("k", "k long, v long", ("k",))
    store.append("k", spark.range(100).selectExpr("id AS k", "id AS v"))
    some = store.touching("k", spark.range(1).selectExpr("7L AS k"))
    assert 0 < some.count() < 60 and some.filter("k = 7").count() == 1


def test_empty_batches_write_nothing(pipeline, spark):
    p = pipeline
    before = {t: p.store._log(t)[0] for t in ("bronze", "history", "status_funnel", "product_volume", "decision_time", "open_counts", "quality_violations")}
    p.write_bronze(p.store.read("bronze"), 0)
    p.write_silver(p.store.read("bronze").withColumn("event_time", F.current_timestamp()), 0)
    p.write_funnel(p.store.read("status_funnel"), 0)
    p.write_volume(p.store.read("product_volume"), 0)
    p.write_metrics(p.store.read("history"), 0)
    p.write_document_violations(p.store.read("bronze"), 0)
    p.write_transition_violations(p.store.read("history"), 0)
    assert before == {t: p.store._log(t)[0] for t in before}


def test_first_of_null_tokens(spark):
    rows = spark.createDataFrame([(None, 3.0), (None, 1.0), ("a", 2.0), ("a", 0.5)], "event_token string, event_time double")
    assert {tuple(r) for r in dedup_batch(rows).collect()} == {(None, 1.0), ("a", 0.5)}


def test_change_log(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(f"k{i % 3}", f"v{i}") for i in range(30)], "key string, value string").coalesce(1)
    rows.write.format("tidemark_log").mode("append").save(path)
    rows.write.format("tidemark_log").mode("append").save(path)
    got = spark.read.format("tidemark_log").load(path)
    assert got.count() == 60 and got.groupBy("partition", "offset").count().filter("count > 1").count() == 0
    stream = spark.readStream.format("tidemark_log").load(path)
    q = stream.writeStream.format("memory").queryName("log_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("log_rows").count() == 60
    part = next(p for p in range(6) if (tmp_path / "log" / str(p)).is_dir())
    next(iter(sorted((tmp_path / "log" / str(part)).glob("*.jsonl")))).unlink()
    with pytest.raises(PositionLost):
        list(read_range(path, "t", part, 0, 5))


def test_log_writer_completes_a_commit_that_was_cut_off(tmp_path, monkeypatch):
    from tidemark.sources import changes

    path = str(tmp_path / "log")
    writer = changes._StreamWriter(path, 6)
    row = lambda i: type("Row", (), {"key": f"k{i}", "value": f"v{i}"})()
    first = [writer.write([row(i) for i in range(8)]), writer.write([row(i) for i in range(8, 16)])]
    renames = []
    real = os.rename

    def cut_off(a, b):
        if len(renames) == 3:
            raise OSError("killed")
        renames.append(b)
        real(a, b)

    with monkeypatch.context() as m:
        m.setattr(changes.os, "rename", cut_off)
        with pytest.raises(OSError):
            writer.commit(first, 0)
    again = changes._StreamWriter(path, 6)
    again.commit([again.write([row(i) for i in range(16)])], 0)
    again.commit([again.write([row(i) for i in range(16)])], 0)
    again.commit([again.write([row(16)])], 1)
    values = sorted(r[1] for p in range(6) for r in read_range(path, "t", p, 0, changes.ends(path, 6)[str(p)]))
    assert values == sorted(f"v{i}" for i in range(17))
    assert not [f for d, _, names in os.walk(path) for f in names if f.startswith(".")]


def test_change_stream_resumes_and_stops_where_it_cannot(spark, tmp_path):
    store = DocumentStore(str(tmp_path / "c"))
    for i in range(6):
        store.insert(f"k/{i}", {"n": i}, i)
        store.flush()
    store.set_fields("k/0", {"n": 10}, 7)
    store.set_fields("k/0", {"n": 11}, 8)
    store.delete("k/1", 9)
    store.flush()

    def run(view, checkpoint, **options):
        q = change_stream(spark, str(tmp_path / "c"), **options).writeStream.format("memory").queryName(view).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()
        return [tuple(r) for r in spark.table(view).orderBy("event_id").select("operation_type", "document_key", "full_document", "full_document_before_change", "update_description").collect()]

    rows = run("changes_a", "a", resume_after="start")
    assert [r[0] for r in rows] == ["insert"] * 6 + ["update", "update", "delete"]
    # an update has the image of when it is read, its own fields and the image before it
    assert json.loads(rows[6][2]) == {"n": 11} and json.loads(rows[6][3]) == {"n": 0} and json.loads(rows[6][4])["updatedFields"] == {"n": 10}
    assert rows[8][2] is None and json.loads(rows[8][3]) == {"n": 1}
    assert len(run("changes_b", "b", resume_after=f"{5:020d}")) == 3
    assert run("changes_c", "c") == []  # from now on
    store.trim(6)
    with pytest.raises(PositionLost):
        list(read_changes(str(tmp_path / "c"), 0, 9))
    with pytest.raises(Exception, match="PositionLost"):
        run("changes_d", "d", resume_after=f"{1:020d}")
    store.drop()
    with pytest.raises(PositionLost):
        list(read_changes(str(tmp_path / "c"), 6, 9))


def test_jobs_from_a_collection_to_metrics(spark, tmp_path):
    env = {f"TIDEMARK_{k}": str(tmp_path / v) for k, v in {"ROOT": "t", "CHECKPOINTS": "cp", "COLLECTION": "docs", "LOG_PATH": "log"}.items()}
    env |= {"TIDEMARK_MERGE_BUCKETS": "2", "TIDEMARK_MAX_EVENTS_PER_TRIGGER": "2"}
    store = DocumentStore(str(tmp_path / "docs"))
    doc = {"id_proposta": "p1", "tipo_produto": "cartao", "status": "em_analise", "valor_solicitado": 900.0}
    store.insert("1", doc, 1_000)
    store.insert("2", doc | {"id_proposta": "p2"}, 1_001)
    store.set_fields("1", {"status": "aprovada"}, 1_060)
    store.delete("2", 1_070)
    store.flush()
    for job in ("connector", "bronze", "silver", "gold", "quality"):
        jobs.main([job, "--once"], spark, env)
    tables = TableStore(spark, str(tmp_path / "t"))
    assert tables.read("bronze").count() == 4 and tables.read("history").count() == 4
    assert [(r.entity_id, r.decision_seconds) for r in tables.read("decision_time").collect()] == [("p1", 60)]
    assert [(r.status, r.quantity) for r in tables.read("open_counts").collect()] == [("aprovada", 1)]
    jobs.main(["compact"], spark, env)
    jobs.main(["bronze", "--once"], spark, env)
    assert tables.read("bronze").count() == 4
    register_views(tables)
    assert spark.sql("SELECT sum(quantidade) AS n FROM contagem_atual_por_status").first().n == 1
    with pytest.raises(ValueError):
        Settings.from_env({"TIDEMARK_LOG_FORMAT": "kafka"})


def test_load_as_a_stream(spark):
    events = load_stream(spark, 50)
    assert events.isStreaming and events.columns == generate(spark, 1).columns
    q = events.writeStream.format("memory").queryName("load_rows").start()
    try:
        for _ in range(100):
            if spark.table("load_rows").count() > 20:
                break
            time.sleep(0.2)
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("load_rows").filter("operation_type = 'insert'").count() >= 10


def test_supervised_queries_restart_together_and_stop_on_a_signal(spark, tmp_path):
    progress, store = watch(spark), TableStore(spark, str(tmp_path))
    store.ensure("t", "n long")
    store.append("t", spark.range(3).toDF("n"))
    failures, halves = [], []

    def start():
        def write(batch, i):
            if not failures:
                failures.append(i)
                raise OSError("down")
            if batch.count():
                os.kill(os.getpid(), signal.SIGTERM)

        sink = lambda f, name: store.stream("t").writeStream.foreachBatch(f).queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        first = sink(write, "watched")
        if len(failures) == 1 and not halves:  # the second cannot start: the first must not be left running
            halves.append(1)
            raise OSError("no start")
        return [first, sink(lambda b, i: None, "other")]

    before = signal.getsignal(signal.SIGTERM), signal.getsignal(signal.SIGINT)
    try:
        s = Supervisor(start, 1, 2)
        s.install_signals()
        s.run()
    finally:
        signal.signal(signal.SIGTERM, before[0])
        signal.signal(signal.SIGINT, before[1])
        spark.streams.removeListener(progress)
    assert s.restarts == 2 and s.stopping.is_set() and not spark.streams.active
    assert progress.last["watched"]["rows"] in (0, 3)


def test_tokens_expire_with_the_watermark(spark, tmp_path):
    """A copy within the watermark is dropped; a late one, which the state no longer has, is dropped as late."""
    store = TableStore(spark, str(tmp_path))
    store.ensure("e", "event_token string, event_time timestamp")
    store.ensure("out", "event_token string, event_time timestamp")
    row = lambda t, at: spark.createDataFrame([(t, at)], "event_token string, at string").select("event_token", F.col("at").cast("timestamp").alias("event_time"))
    q = dedup_stream(store.stream("e"), "1 minute").writeStream.foreachBatch(lambda b, i: store.append("out", b, "o", i) and None).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for t, at in (("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:00:30"), ("b", "2024-01-01 11:00:00"), ("c", "2024-01-01 11:00:10"), ("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 11:00:20")):
            store.append("e", row(t, at))
            q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.event_token, str(r.event_time)) for r in store.read("out").collect())
    assert got == [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 11:00:20"), ("b", "2024-01-01 11:00:00"), ("c", "2024-01-01 11:00:10")]
