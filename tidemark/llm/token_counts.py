"""Token counts by rank-synchronous merging of ragged arrays (see ``bpe_arrays``)."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_BPE, slices, spread, text_of, vocabulary_path

#: Tokens beyond which a document is over the limit.
TOKEN_LIMIT = 512


@cache
def counter(path: str):
    from .bpe_arrays import ByteBpe

    return ByteBpe(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row for each row: ``id_col, n_bytes, n_tokens, over_limit``.

    Texts are counted whole, as the library counts them: no begin or end token, a special string
    inside a text is one token. A null text is empty and has no tokens; null and repeated ids
    are passed on. Other columns are not read. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = rows.schema["id"].dataType

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        bpe = counter(vocabulary_path(vocabulary))
        for batch in batches:
            for part in slices(batch, 1):
                counts = pa.array(bpe.count(part.column(1).to_pylist()), pa.int64())
                yield pa.record_batch([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), counts], ["id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = spread(rows).mapInArrow(run, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
