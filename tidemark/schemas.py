"""Schemas of the stored tables as DDL (parsed where a session is there); all columns are nullable."""

from __future__ import annotations

SCHEMAS = {
    # the event log and what is parsed from it
    "log": "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp",
    "bronze": "kafka_key string, kafka_topic string, kafka_partition int, kafka_offset bigint, kafka_timestamp timestamp, raw_envelope string, entity_id string, operation_type string, cluster_time_epoch bigint, event_token string, key_is_fallback boolean, document_key_json string, full_document_json string, full_document_before_change_json string, update_description_json string, event_date date, ingested_at timestamp",
    "history": "entity_id string, product_type string, status string, valid_from timestamp, valid_to timestamp, event_token string",
    "current_state": "entity_id string, product_type string, customer_cpf string, customer_name string, requested_amount double, status string, created_at timestamp, updated_at timestamp, residual_fields_json string, event_time timestamp, event_token string, is_deleted boolean",
    # deduplicated inserts, so that the volume needs one stateful operator only
    "created_documents": "entity_id string, product_type string, requested_amount double, event_time timestamp, event_token string",
    "status_funnel": "window_start timestamp, window_end timestamp, product_type string, status string, quantity bigint",
    "product_volume": "window_start timestamp, window_end timestamp, product_type string, volume bigint, total_value double",
    "decision_time": "entity_id string, product_type string, decision_status string, created_at timestamp, decided_at timestamp, decision_seconds bigint",
    # open entities of each bucket of the history
    "open_by_bucket": "bucket int, product_type string, status string, quantity bigint",
    "open_counts": "product_type string, status string, quantity bigint",
    "quality_violations": "violation_type string, entity_id string, product_type string, detail string, detected_at timestamp",
}
#: The columns that identify a row of the tables that are upserted; of the history, those that its buckets follow.
KEYS = {
    "history": ("entity_id",),
    "current_state": ("entity_id",),
    "status_funnel": ("window_start", "window_end", "product_type", "status"),
    "product_volume": ("window_start", "window_end", "product_type"),
    "decision_time": ("entity_id",),
}
#: Columns whose values have a folder each.
PARTITIONS = {"bronze": ("event_date",)}
