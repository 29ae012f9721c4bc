"""Expressions and rules on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.config import Rules, Settings
from tidemark.functions.documents import date_of, double_of, has_field, is_transition, overlay_document, parse_fields, residual_fields, text_of
from tidemark.operators.quality import impossible_state, out_of_range, valid_transition
from tidemark.streaming.supervisor import Supervisor, next_backoff_ms


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_transitions(spark):
    rows = [("insert", None), ("delete", None), ("replace", None), ("update", '{"updatedFields":{"status":null}}'), ("update", '{"updatedFields":{"x":1}}'), ("update", None), ("drop", None), (None, None), ("update", "{bad")]
    got = values(spark, rows, "op string, u string", is_transition(F.col("op"), F.col("u")))
    assert [x for (x,) in got] == [True, True, True, True, False, False, False, False, False]


def test_overlay_and_residual(spark):
    rows = [('{"a":1,"status":"old"}', '{"updatedFields":{"status":"new","b":null}}'), ('{"a":1}', None), (None, '{"updatedFields":{"a":2}}'), ("{bad", None)]
    got = values(spark, rows, "d string, u string", overlay_document(F.col("d"), F.col("u")), text_of(parse_fields(overlay_document(F.col("d"), F.col("u")))["status"]), residual_fields(F.col("d"), ("status",)), has_field(F.col("u"), "b"))
    assert json.loads(got[0][0]) == {"a": 1, "status": "new", "b": None} and got[0][1] == "new" and json.loads(got[0][2]) == {"a": 1} and got[0][3]
    assert json.loads(got[1][0]) == {"a": 1} and not got[1][3]
    assert got[2][0] is None and got[3][0] is None


def test_dates(spark):
    rows = [('{"t":{"$date":"2024-01-01T10:00:00.5Z"}}',), ('{"t":{"$date":{"$numberLong":"-1000"}}}',), ('{"t":"no"}',), (None,)]
    got = values(spark, rows, "d string", date_of(parse_fields(F.col("d"))["t"]).cast("double"))
    assert [x for (x,) in got] == [1704103200.5, -1.0, None, None]


def test_parsed_values(spark):
    rows = [('{"a":"x","n":"12.5"}',), ('{"a":5,"n":3}',), ('{"a":{"b":[1,"c"]},"n":"no"}',), ('{"a":null,"n":true}',), ("{}",), ("[",)]
    doc = parse_fields(F.col("d"))
    got = values(spark, rows, "d string", text_of(doc["a"]), double_of(doc["n"]))
    assert got[:2] == [("x", 12.5), ("5", 3.0)] and json.loads(got[2][0]) == {"b": [1, "c"]} and got[2][1] is None
    assert [x for x, _ in got[3:]] == [None, None, None] and got[4][1] is None


def test_states_and_ranges(spark):
    r = Rules()
    rows = [("em_analise", 5000.0, "cartao"), ("odd", 999_999.0, "cartao"), (None, None, "cartao"), ("paga", 500.0, "cartao"), ("paga", 1.0, None), ("deletada", 1.0, "other")]
    got = values(spark, rows, "s string, v double, p string", impossible_state(F.col("s"), r.statuses), out_of_range(F.col("v"), F.col("p"), r.ranges))
    assert got == [(False, False), (True, True), (True, True), (False, False), (False, True), (False, True)]


def test_valid_transitions(spark):
    r = Rules()
    rows = [(None, "paga"), ("paga", "paga"), ("paga", "deletada"), ("em_analise", "aprovada"), ("recusada", "aprovada"), ("em_analise", None), ("odd", "aprovada")]
    got = values(spark, rows, "a string, b string", valid_transition(F.col("a"), F.col("b"), r.edges, r.deleted))
    assert [x for (x,) in got] == [True, True, True, True, False, False, False]
    assert set(r.terminals) == {"recusada", "paga", "cancelada"}


@pytest.mark.parametrize("env", [{"TIDEMARK_MERGE_BUCKETS": "0"}, {"TIDEMARK_MERGE_BUCKETS": "x"}, {"TIDEMARK_WINDOW": "often"}, {"TIDEMARK_RETRY_FIRST_MS": "9", "TIDEMARK_RETRY_MOST_MS": "1"}, {"TIDEMARK_STRICT_LATE_STATE": "maybe"}])
def test_bad_settings(env):
    with pytest.raises(ValueError):
        Settings.from_env(env)


def test_settings():
    assert Settings.from_env({}) == Settings()
    assert Settings.from_env({"TIDEMARK_WINDOW": "1 hour", "TIDEMARK_MERGE_BUCKETS": "4", "TIDEMARK_STRICT_LATE_STATE": "true"}) == Settings(window="1 hour", merge_buckets=4, strict_late_state=True)


def test_supervisor_backs_off_and_gives_up_on_lost_positions():
    waits, calls = [], []

    def start():
        calls.append(1)
        raise OSError("down") if len(calls) < 4 else RuntimeError("PositionLost: gone")

    with pytest.raises(RuntimeError):
        Supervisor(start, 10, 25, waits.append).run()
    assert waits == [0.01, 0.02, 0.025] and next_backoff_ms(20_000, 30_000) == 30_000
