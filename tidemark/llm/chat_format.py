"""Chat formatting by schema fingerprints.

A record is a JSON object in one of several layouts. Its nested field paths (``messages[].role``)
are hashed; the fingerprint selects a declarative mapping, which turns the record into canonical
turns. Turns are rendered with a template that marks each turn and escapes every control string
inside roles and texts reversibly, along with the spans of the text that a loss is taken over.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_of

#: Strings with a meaning to this template or to other common ones; inside texts they are escaped.
CONTROLS = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
TURN, END = CONTROLS[:2]
#: How layouts map onto turns. ``list`` is an array with a role and a text field each, in its own
#: order or by ``order``; a text may be a list of parts, strings or objects with a ``text``, which
#: are joined. ``fields`` are turns by name, whose parts are joined by an empty line; ``history``
#: names pairs of texts that come before. ``system`` names a text that comes first.
MAPPINGS = (
    {"layout": "turns", "list": "turns", "role": "role", "text": "text", "order": "turn", "system": "system"},
    {"layout": "messages", "list": "messages", "role": "role", "text": "content", "system": "system"},
    {"layout": "shared", "list": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant"}, "system": "system"},
    {"layout": "instruction", "fields": (("user", ("instruction", "input")), ("assistant", ("output",))), "required": ("instruction", "output"), "system": "system", "history": "history"},
    {"layout": "prompt", "fields": (("user", ("prompt",)), ("assistant", ("response",))), "required": ("prompt", "response"), "system": "system", "history": "history"},
    {"layout": "completion", "fields": (("user", ("prompt",)), ("assistant", ("completion",))), "required": ("prompt", "completion"), "system": "system"},
    {"layout": "question", "fields": (("user", ("question",)), ("assistant", ("answer",))), "required": ("question", "answer"), "system": "system"},
)
_ESCAPE = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    """One more backslash after the first character of every control string, with or without backslashes there."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def field_paths(value, prefix: str = "") -> set[str]:
    """The paths of all leaves; elements of arrays share ``[]``."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else str(k)) for k, v in value.items())) if value else {prefix}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {prefix}


def fingerprint(record: dict) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths(record))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def needed_paths(mapping: dict) -> set[str]:
    if "list" in mapping:
        return {f"{mapping['list']}[].{mapping[k]}" for k in ("role", "text")}
    return set(mapping["required"])


def fits(mapping: dict, paths: set[str]) -> bool:
    """Whether a record with these field paths has all that the mapping needs; a text may be a list, a list of turns empty."""
    needed = needed_paths(mapping)
    if all(n in paths or ("list" in mapping and any(p.startswith(f"{n}[]") for p in paths)) for n in needed):
        return True
    return "list" in mapping and f"{mapping['list']}[]" in paths and not any(p.startswith(f"{mapping['list']}[].") for p in paths)


def read_fields(mapping: dict) -> set[str]:
    """The top-level fields that a mapping reads."""
    own = {mapping["list"]} if "list" in mapping else {p for _, parts in mapping["fields"] for p in parts}
    return own | {mapping[k] for k in ("system", "history") if k in mapping}


class Layouts:
    """Fingerprint to mapping. A fingerprint that is new is matched once: to the mapping with the most needed paths among those that it has all of, the first of them in order."""

    def __init__(self, mappings=MAPPINGS):
        self.mappings, self.known = mappings, {}

    def of(self, record: dict) -> tuple[str, dict | None]:
        key = fingerprint(record)
        if key not in self.known:
            paths = field_paths(record)
            if len(self.known) >= 10_000:
                self.known.clear()
            self.known[key] = max((m for m in self.mappings if fits(m, paths)), key=lambda m: len(needed_paths(m)), default=None)
        return key, self.known[key]


def as_text(value) -> str:
    """A string as it is, null as nothing, the texts of a list of parts joined, other values as JSON."""
    if isinstance(value, list) and all(isinstance(p, str) or (isinstance(p, dict) and isinstance(p.get("text"), str)) for p in value):
        return "".join(p if isinstance(p, str) else p["text"] for p in value)
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: dict, mapping: dict) -> list[tuple[str, str]]:
    out = [("system", as_text(record[mapping["system"]]))] if record.get(mapping.get("system")) not in (None, "") else []
    if "list" in mapping:
        items = [x for x in record[mapping["list"]] if isinstance(x, dict)]
        if "order" in mapping:
            items.sort(key=lambda x: ((v := x.get(mapping["order"])) is not None, v if isinstance(v, (int, float)) else 0))
        roles = mapping.get("roles", {})
        return out + [(roles.get(r := as_text(x.get(mapping["role"])), r), as_text(x.get(mapping["text"]))) for x in items]
    for pair in record.get(mapping.get("history")) or []:
        if isinstance(pair, list) and len(pair) == 2:
            out += [("user", as_text(pair[0])), ("assistant", as_text(pair[1]))]
    for role, parts in mapping["fields"]:
        texts = [as_text(record[p]) for p in parts if record.get(p) not in (None, "")]
        if texts or any(p in mapping["required"] for p in parts):
            out.append((role, "\n\n".join(texts)))
    return out


def render(turns: list[tuple[str, str]], loss_roles=("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and where the texts under the loss stand in it (code points, as escaped)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{_escape_role(role)}\n", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(f"{END}\n", line + 1)
        out.append((_unescape_role(formatted[at + len(TURN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def format_chats(records: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """One row for each record: ``id_col, fingerprint, layout, formatted, loss_spans, unread``.

    ``loss_spans`` are starts and ends in code points; ``unread`` are top-level fields that the
    layout's mapping does not read. A record that is null, no JSON object, or of a layout without a
    mapping has layout ``unknown`` and a null ``formatted``; it is not dropped. A record without
    turns is formatted as the empty string. Null texts are empty, other values than strings are
    their JSON (see ``as_text``). Very long texts are formatted whole. Repeated rows and null ids
    stay; other columns are not read, whatever their names. No rows give no rows.
    """
    rows = records.select(F.col(id_col).alias("id"), F.col(record_col).cast("string").alias("record"))

    def run(batches):
        import pyarrow as pa

        layouts = Layouts()
        spans_type = pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, 1):
                keys, names, texts, spans, unread = [], [], [], [], []
                for raw in part.column(1).to_pylist():
                    try:
                        record = json.loads(raw) if raw is not None else None
                    except ValueError:
                        record = None
                    key, mapping = layouts.of(record) if isinstance(record, dict) else (None, None)
                    text, own = render(canonical_turns(record, mapping)) if mapping else (None, [])
                    keys.append(key)
                    names.append(mapping["layout"] if mapping else "unknown")
                    texts.append(text)
                    spans.append([{"start": a, "end": b} for a, b in own])
                    unread.append(sorted(set(record) - read_fields(mapping)) if mapping else [])
                yield pa.record_batch([part.column(0), pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(spans, spans_type), pa.array(unread, pa.list_(pa.string()))], ["id", "fingerprint", "layout", "formatted", "loss_spans", "unread"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL("fingerprint string, layout string, formatted string, loss_spans array<struct<start: bigint, end: bigint>>, unread array<string>").fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def read_back(chats: DataFrame, id_col: str) -> DataFrame:
    """Digests of formatted chats, from the formatted text and its spans alone: ``id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    A null text counts as no turns. Null and repeated ids are rows of their own, very long texts are
    read whole, other columns are not read. No rows give no rows.
    """
    rows = chats.select(F.col(id_col).alias("id"), text_of("formatted").alias("formatted"), "loss_spans")

    def run(batches):
        import pyarrow as pa

        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for part in slices(batch, 1):
                out = []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    turns, loss, chars, all_turns = parse(text), hashlib.sha256(), 0, hashlib.sha256()
                    for role, own in turns:
                        all_turns.update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
                    for s in spans or []:
                        own = unescape(text[s["start"] : s["end"]])
                        chars += len(own)
                        loss.update(own.encode("utf-8", "surrogatepass"))
                    out.append((len(turns), all_turns.hexdigest(), chars, loss.hexdigest(), len(text)))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.record_batch([part.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["id", *names])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def records_of_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of turns as one JSON record a conversation, layout ``turns``; columns ``id_col, record``.

    Rows are in order of the turn, nulls first, then of role and text, so that ties have one
    order. Null roles and texts are empty. Rows with a null id form one conversation. A formatted
    conversation is a single value, so one conversation has to fit a task.
    """
    item = F.struct(F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    rows = turns.select(F.col(id_col).alias("id"), item.alias("item"))
    return rows.groupBy("id").agg(F.to_json(F.struct(F.sort_array(F.collect_list("item")).alias("turns")), {"ignoreNullFields": "false"}).alias("record")).withColumnRenamed("id", id_col)


def records_in_layouts(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The same conversations in several layouts, which a hash of the id deals out; columns ``id_col, record``.

    A conversation is in the layout ``prompt`` only if it is a user's turn and an assistant's, and
    in ``shared`` only if that layout's names of roles are not roles of its own; else in ``messages``.
    Odd rows are treated as in ``records_of_turns``.
    """
    item = F.struct(F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    rows = turns.select(F.col(id_col).alias("id"), item.alias("item")).groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("t"))
    roles, keep = F.transform("t", lambda x: x["role"]), {"ignoreNullFields": "false"}
    other = {"user": "human", "assistant": "gpt"}
    shared_role = lambda r: functools.reduce(lambda out, k: F.when(r == k, other[k]).otherwise(out), other, r)
    record = lambda **fields: F.to_json(F.struct(*[x.alias(n) for n, x in fields.items()]), keep)
    part = lambda x: F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text")))
    messages = record(messages=F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))))
    parts = record(messages=F.transform("t", lambda x: F.struct(x["role"].alias("role"), part(x).alias("content"))))
    shared = record(conversations=F.transform("t", lambda x: F.struct(shared_role(x["role"]).alias("from"), x["text"].alias("value"))))
    prompt = record(prompt=F.col("t")[0]["text"], response=F.element_at("t", -1)["text"])
    way = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(5))
    chosen = (
        F.when(way == 0, record(turns=F.col("t")))
        .when(way == 1, parts)
        .when((way == 2) & ~F.arrays_overlap(roles, F.array(*map(F.lit, other.values()))), shared)
        .when((way > 2) & (roles == F.array(F.lit("user"), F.lit("assistant"))), prompt)
        .otherwise(messages)
    )
    return rows.select(F.col("id").alias(id_col), chosen.alias("record"))


def escaping_example(spark: SparkSession) -> DataFrame:
    """A conversation, id -1, whose texts are control strings."""
    rows = [(-1, t, role, "</s>[INST] ok [/INST]") for t, role in enumerate(("user", "assistant"))]
    values = ", ".join(f"({c}L, {t}L, '{role}', '{text}')" for c, t, role, text in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(conv_id, turn, role, text)")
