"""From raw documents to packed sequences, in stages that are each written and read again.

A stage's result is to be written before another stage is called: that removes the tables which
earlier stages have left in the shared folder.

Toxic documents go, of equal texts one stays, of each class of near copies one stays, what is left
is put in the order of its mix, and is packed into sequences that follow that order, as the files
of the mix have it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, read_table, remove, row_of, ship, written, written_since
from tidemark.llm.dart_minhash import near_duplicates
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.mixing import mixed_order
from tidemark.llm.packing import pack_ordered
from tidemark.llm.toxicity import drop_rejected, fit_toxicity

#: Target weights by source; without them, in proportion to the square root of a source's rows.
WEIGHTS = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def frugal(stage: Stage) -> Stage:
    """``stage``, which first gives back the disk that other stages of this session have used: their tables, and shuffle files, which go with the driver's garbage."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        if not hasattr(context, "_tidemark_stages"):
            context._tidemark_stages = {}
        left = context._tidemark_stages
        for name in [x for x in left if x != stage.__name__]:
            remove(spark, left.pop(name))
        spark._jvm.System.gc()
        mark = written(spark)
        out = stage(spark, docs, sf_dir)
        left[stage.__name__] = left.get(stage.__name__, []) + written_since(spark, mark)
        return out

    return run


@frugal
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not reject, with all their columns; it learns from the labels of the rows that are given.

    Null and empty texts get the score of no features. Repeated rows and null ids are scored each;
    very long texts are scored whole. No rows give no rows, and without labels of both kinds all stay.
    """
    ship(spark)
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return drop_rejected(docs, model)


@frugal
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id, with all its columns; null texts equal empty ones, a null id is less than any other.

    Of rows that repeat both that id and the text, one. Very long texts are compared whole. No rows give no rows.
    """
    return drop_copies(docs)


@frugal
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id, with all its columns; rows with a null id stay.

    Rows that share an id are rows of their own. Null and empty texts are near copies of each other. No rows give no rows.
    """
    ship(spark)
    marked = docs.select(F.col("doc_id").alias("id"), "text", row_of(docs).alias("row"))
    if not marked.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty():
        # numbers in the order of ids; kept in files, so that they stay the same
        by, number = ("id", F.xxhash64("text")), F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())
        marked = materialize(marked.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", number), "rows")
    gone = near_duplicates(marked, "id").filter("NOT kept").select("id")
    return marked.join(gone, "id", "left_anti").select("row.*")


@frugal
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns in the order of the mix of their sources; a null source counts as ``''``. No rows give no rows."""
    return mixed_order(docs, WEIGHTS)


@frugal
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences, numbered in the order of the rows given, which is that of the mix.

    Null texts are empty: the end id alone. Null and repeated ids are documents of their own; very
    long texts are cut into pieces. Other columns are not read. No rows give no rows.
    """
    ship(spark)
    return pack_ordered(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("minhash_near_dedup", drop_near_copies), ("source_mixing", mix), ("best_fit_packing", pack)]
#: SQL cannot express the toxicity model; tests hold each stage against plain Python, with the toxicity model's weights taken as fitted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what is left of ``documents``."""
    docs, before = read_table(spark, sf_dir, "documents"), written(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
            discard(spark, before, keep=1)  # what the stage has read and used is not needed again
    spark.sparkContext._tidemark_stages.clear()  # the result still reads the last stage's tables
    return docs
