"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import CONTROLS, escaping_example, format_chats, read_back, records_in_layouts
from .common import read_table, ship
from .dart_minhash import near_duplicates
from .exact_dedup import exact_dedup
from .language_id import identify_languages
from .lattice_lm import score_texts
from .mixing import mix_sources
from .packing import pack_documents
from .token_counts import count_tokens
from .top_k import exact_top_k
from .toxicity import toxicity_scores


def crc_remainder(modulus: int) -> Column:
    return F.crc32(F.col("id").cast("string").cast("binary")) % modulus


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), crc_remainder(7) != 2)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    records = records_in_layouts(turns.unionByName(escaping_example(spark)))
    return read_back(format_chats(records, "conv_id", "record"), "conv_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: shipped(f)
    for f in (
        op1_lattice_lm,
        op2_best_fit_packing,
        op3_exact_dedup,
        op4_toxicity,
        op5_chat_formatting,
        op6_language_id,
        op7_exact_top_k,
        op8_minhash_near_dedup,
        op9_token_counts,
        op10_source_mixing,
    )
}

ORACLE_SQL = {
    "op5_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), g AS (
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                   sum(length(role) + length(text) + 17)::BIGINT AS plain_chars,
                   sum(length(regexp_replace(text, '{CONTROL}', '\0.', 'g')) - length(text))::BIGINT AS escapes
            FROM t GROUP BY conv_id
        )
        SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, plain_chars + escapes AS formatted_chars FROM g
    """.replace("{CONTROL}", "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS)),
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\s\x0b]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS run FROM w
        ), c AS (SELECT doc_id, run, count(*) AS n FROM s GROUP BY ALL),
        t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY ALL),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM met JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE m >= CAST(0.8 AS DOUBLE) * (x.n + y.n - m)),
        linked AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id AS id, doc_id AS label FROM w UNION SELECT linked.b, r.label FROM r JOIN linked ON r.id = linked.a WHERE r.label < linked.b)
        SELECT id AS doc_id, min(label) AS class_id, min(label) = id AS kept FROM r GROUP BY id
    """,
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text),
        j AS (SELECT d.doc_id, g.keep_id, g.group_size, sha256(d.text) AS text_sha256,
                     row_number() OVER (PARTITION BY d.doc_id, d.text ORDER BY g.keep_id) AS nth
              FROM d JOIN g ON d.text = g.text)
        SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id AND nth = 1, false) AS kept, text_sha256 FROM j
    """,
}
