"""Expressions over JSON documents, all JVM-side; malformed JSON gives null where a plain parser would fail."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OBJECT = "map<string,variant>"


def text_at(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def double_at(doc: Column, path: str) -> Column:
    """A number; text that is none is null, not an error."""
    return F.get_json_object(doc, path).try_cast("double")


def changed_fields(update: Column) -> Column:
    return F.get_json_object(update, "$.updatedFields")


def has_field(update: Column, name: str) -> Column:
    """Whether an update names this top-level field, even with a null value."""
    return F.coalesce(F.array_contains(F.json_object_keys(changed_fields(update)), name), F.lit(False))


def parse_fields(doc: Column) -> Column:
    """The top-level fields of a document as a map; null for none or a malformed one."""
    return F.from_json(doc, _OBJECT)


def lay_over(base: Column, over: Column) -> Column:
    """Parsed fields with others laid over them; null without a base."""
    return F.when(over.isNull(), base).otherwise(F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over))


def without(fields: Column, names: Iterable[str]) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(*names))


def text_of(value: Column) -> Column:
    """A parsed value as text: strings as they are, other values as their JSON, null as null."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.nullif(F.to_json(value), F.lit("null")))


def double_of(value: Column) -> Column:
    """A number; text that is none is null, not an error."""
    return F.try_variant_get(value, "$", "double")


def date_of(value: Column) -> Column:
    """A timestamp in extended JSON: ISO text under ``$date``, or milliseconds under ``$date.$numberLong``."""
    millis = F.try_variant_get(value, "$['$date']['$numberLong']", "bigint")
    return F.coalesce(F.try_to_timestamp(F.try_variant_get(value, "$['$date']", "string")), F.timestamp_millis(millis))


def moves_status(operation: Column, over: Column, field: str = "status") -> Column:
    """``is_transition`` for an update's fields that are parsed already."""
    named = F.coalesce(F.map_contains_key(over, field), F.lit(False))
    return F.coalesce(operation.isin("insert", "delete", "replace"), F.lit(False)) | (F.coalesce(operation == "update", F.lit(False)) & named)


def is_transition(operation: Column, update: Column, field: str = "status") -> Column:
    """Inserts, deletes and replacements always, updates if they name the status field; a null operation is none."""
    return F.coalesce(operation.isin("insert", "delete", "replace"), F.lit(False)) | (F.coalesce(operation == "update", F.lit(False)) & has_field(update, field))


def overlay_document(doc: Column, update: Column) -> Column:
    """The whole document with the update's fields laid over it at the top level; null without a document."""
    return F.to_json(lay_over(parse_fields(doc), parse_fields(changed_fields(update))))


def residual_fields(doc: Column, common: Iterable[str]) -> Column:
    """The document without its common fields, ``{}`` if nothing is left, null without a document."""
    return F.to_json(without(parse_fields(doc), common))
