"""Exact deduplication over an extendible-hash index kept in shared files.

1. Every text gets a 64-bit key. Copies are combined where they are read and meet as whole texts,
   which are compared byte by byte: one entry for each different text, with its number of copies.
2. A directory over the leading bits of the keys says which bucket a key is in. It begins at the
   depth that the number of entries asks for; a bucket over its capacity is split by one more bit
   and the directory doubles, until only chains of one key are longer than a bucket. Executors
   count and split; the driver sees whether a bucket is overfull, and nothing of the directory.
3. Owner tasks take ranges of buckets, put the entries of each key into a chain and write one
   sorted index file each.
4. Every row looks up its bucket in the directory and meets that bucket's entries there, by key and
   by the digest that tells the links of a chain apart.

Only DataFrame functions are used. The rows of a text with more than a thousandth of all rows are
dealt over pages, to each of which the entry is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, paged_join, power_of_two, row_of, text_of

#: Index entries that a bucket holds before it is split.
BUCKET_CAPACITY = 65_536
#: Cells of a directory that may be sent to all tasks; a larger one is joined by shuffle.
DIRECTORY_CELLS = 1 << 20


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = BUCKET_CAPACITY) -> tuple[DataFrame, int]:
    """``cell, bucket, local_depth`` for the cells of a directory over the keys ``h`` of ``entries``, and its depth.

    ``cell`` are the first ``depth`` bits of a key; a bucket of a lower local depth has several
    cells. ``bucket`` is the bucket's first key. Cells without keys are left out. A bucket of
    which all entries share one key is not split, as no bit tells them apart.
    """
    depth = power_of_two(entries.count() / capacity).bit_length() - 1
    left, leaves = entries.select("h"), []
    while True:
        cells = left.groupBy(_prefix(depth).alias("cell")).agg(F.count("*").alias("n"), (F.min("h") < F.max("h")).alias("splits"))
        cells = materialize(cells.withColumn("over", F.col("splits") & (F.col("n") > capacity)), "dedup-cells")
        leaves.append(cells.filter("NOT over").select("cell", F.lit(depth).alias("local_depth")))
        over = cells.filter("over").select("cell")
        if depth == 64 or over.isEmpty():
            break
        left = left.withColumn("cell", _prefix(depth)).join(over, "cell", "left_semi").select("h")
        depth += 1
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    below = F.expr(f"shiftleft(1L, {depth} - local_depth)")
    first = F.expr(f"shiftleft(cell, {depth} - local_depth)")
    bucket = F.expr("CASE WHEN local_depth = 0 THEN 0L ELSE shiftleft(cell, 64 - local_depth) END")
    cells = found.select(F.explode(F.sequence(first, first + below - 1)).alias("cell"), bucket.alias("bucket"), "local_depth")
    return materialize(cells, "dedup-directory"), depth


def in_buckets(rows: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the bucket of their key ``h``."""
    cells = cells.select("cell", "bucket")
    small = cells.count() <= DIRECTORY_CELLS
    return rows.withColumn("cell", _prefix(depth)).join(F.broadcast(cells) if small else cells, "cell").drop("cell")


def build_index(entries: DataFrame, capacity: int = BUCKET_CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """The index files of ``entries`` (one row for each different text, columns ``h, sha``), with ``bucket`` and the ``link`` of its key's chain, and the directory with its depth."""
    cells, depth = directory(entries, capacity)
    owned = in_buckets(entries, cells, depth).repartitionByRange(max(1, cells.select("bucket").distinct().count()), "bucket", "h")
    chained = owned.withColumn("link", F.row_number().over(W.partitionBy("bucket", "h").orderBy("sha")))
    return materialize(chained.sortWithinPartitions("bucket", "h", "link"), "dedup-index"), cells, depth


def linked_rows(rows: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """``id, text`` and, if rows have a stable number already, ``uid`` to ``uid, id, keep_id, group_size, kept, sha``."""
    keyed = rows.withColumn("h", F.xxhash64("text"))
    uid = F.col("uid") if "uid" in rows.columns else F.monotonically_increasing_id()
    # written once, so that a number stays the same row's even if a task is run again
    numbered = materialize(keyed.select(uid.alias("uid"), "id", "h", F.sha2("text", 256).alias("sha")), "dedup-rows")
    texts = keyed.groupBy("h", "text").agg(F.count("*").alias("n"), F.max("id").alias("keep_id")).select("h", F.sha2("text", 256).alias("sha"), "n", "keep_id")
    # of rows that repeat both the largest id and the text, any one
    keepers = numbered.groupBy("h", "sha").agg(F.coalesce(F.max_by("uid", "id"), F.min("uid")).alias("keep_uid"))
    entries = materialize(texts.join(keepers, ["h", "sha"]), "dedup-entries")
    index, cells, depth = build_index(entries, capacity)
    met = paged_join(in_buckets(numbered, cells, depth), index, ["bucket", "h", "sha"], "n", numbered.count(), F.col("uid"))
    return met.select("uid", "id", "keep_id", F.col("n").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"), "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical; null counts as the empty text, so null and empty
    rows form one group. Of equal texts the row with the largest id is kept; a null id is less
    than any other. Of rows that repeat both that id and the text, one is kept. Very long texts
    are compared whole. Other columns are not read, whatever their names. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = linked_rows(rows, capacity)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever their names.

    Null texts count as empty and stay null in the row that is kept. Of rows that repeat both the
    id and the text one stays, even if other columns differ. No rows give no rows.
    """
    marked = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    marked = materialize(marked.withColumn("uid", F.monotonically_increasing_id()), "dedup-input")
    kept = linked_rows(marked.select("uid", "id", "text"), capacity).filter("kept").select("uid")
    return marked.select("uid", "row").join(kept, "uid", "left_semi").select("row.*")
