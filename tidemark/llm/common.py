"""What the corpus operators share: table access, the shared folder, small inline tables, text of words."""

from __future__ import annotations

import functools
import json
import operator
import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets one of its own."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().rstrip("/")


def _own_tables(spark: SparkSession) -> list[str]:
    """Paths that this session has written and not removed yet."""
    context = spark.sparkContext
    if not hasattr(context, "_tidemark_tables"):
        context._tidemark_tables = []
    return context._tidemark_tables


def relieve(spark: SparkSession) -> bool:
    """Collects the driver's garbage if its heap has grown beyond half of its limit, at most once in ``RELIEF`` calls; says whether it did.

    The plans of many short jobs are garbage soon, but the heap grows to its limit before the
    collector looks at them, and keeps the memory; a full collection gives it back, and lets Spark
    remove the shuffle files and broadcasts of frames that are gone.
    """
    context = spark.sparkContext
    context._tidemark_calls = getattr(context, "_tidemark_calls", RELIEF) + 1
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if context._tidemark_calls < RELIEF or runtime.totalMemory() * 2 < runtime.maxMemory():
        return False
    context._tidemark_calls = 0
    spark._jvm.System.gc()
    return True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet below the shared folder and reads it back.

    A lost executor costs nothing then, as the files are not on its disk. The folder is named
    afresh each time; ``discard`` removes what this session has left.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    relieve(spark)
    _own_tables(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that are written between two full collections of the driver's garbage, at least.
RELIEF = 6


class Mark(int):
    """The number of tables there were; ``paths`` keeps which, so that it stays right when some of them are removed."""

    paths: frozenset[str]


def written(spark: SparkSession) -> Mark:
    """A mark for ``discard`` and ``written_since``."""
    own = _own_tables(spark)
    mark = Mark(len(own))
    mark.paths = frozenset(own)
    return mark


def written_since(spark: SparkSession, mark: int) -> list[str]:
    """Paths of the tables that ``materialize`` has written since a mark, and that are still there; since 0, all of them."""
    own = _own_tables(spark)
    return [p for p in own if p not in mark.paths] if isinstance(mark, Mark) else own[mark:]


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    """Removes tables that this session's ``materialize`` has written; frames that read them no longer work."""
    own = _own_tables(spark)
    for name in [p for p in paths if p in own]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        own.remove(name)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """``remove`` for all tables since a mark, but for the last ``keep``."""
    own = written_since(spark, since)
    remove(spark, own[: max(0, len(own) - keep)])


#: Parts that a key with more than its share of rows is dealt to, and keys that can have such a share.
PAGES = 1_000


def _pages(n: str, total: int) -> Column:
    """Parts of about a thousandth of ``total`` that a key's ``n`` rows make; 1 for a key with no more than that."""
    return F.when(F.col(n) * PAGES > max(1, total), F.least(F.col(n), F.ceil(F.col(n) * PAGES / max(1, total)))).otherwise(1).cast("int")


def hot_keys(counts: DataFrame, n: str, total: int) -> DataFrame:
    """Keys with more than one row and more than a thousandth of ``total`` rows, with ``_pages``; at most ``PAGES`` rows, as their counts sum to ``total`` at most."""
    return counts.withColumn("_pages", _pages(n, total)).filter("_pages > 1")


def paged_join(rows: DataFrame, entries: DataFrame, on: Sequence[str], n: str, total: int, deal: Column) -> DataFrame:
    """``rows`` joined to ``entries``, which have one row a key and in ``n`` the rows of that key, ``total`` of them together.

    A hot key's entry is copied to pages and its rows are dealt over them by ``deal``, so that no
    task gets all rows of a key, whatever its share. Keys are not null. Entries are read twice.
    """
    hot = hot_keys(entries, n, total).select(*[F.col(c).alias(f"_hot_{c}") for c in on], "_pages")
    same = [F.col(c) == F.col(f"_hot_{c}") for c in on]
    dealt = rows.join(F.broadcast(hot), functools.reduce(operator.and_, same), "left")
    dealt = dealt.withColumn("_page", F.coalesce(F.pmod(F.xxhash64(deal), "_pages"), F.lit(0)).cast("int")).drop("_pages", *[f"_hot_{c}" for c in on])
    copied = entries.withColumn("_page", F.explode(F.sequence(F.lit(0), _pages(n, total) - 1)))
    return dealt.join(copied, [*on, "_page"]).drop("_page")


def row_of(df: DataFrame) -> Column:
    """All columns as one struct, so that no helper's name can clash with theirs; ``select("<name>.*")`` gives them back."""
    return F.struct(F.col("*"))


def _scan_rows(df: DataFrame) -> Column | None:
    """File and row number of what a plain scan of Parquet files reads; None if ``df`` is anything else."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation" or "Hadoop" not in plan.relation().getClass().getSimpleName():
        return None
    found = df.metadataColumn("_metadata")
    return found if "row_index" in df.select(found.alias("m")).schema["m"].dataType.names else None


def file_order(path: str) -> list:
    """Sorts files as Spark's writers number them, by partition and then by part; numbers compare as such, whatever their digits."""
    return [int(x) if i % 2 else x for i, x in enumerate(re.split(r"([0-9]+)", path))]


def numbered(df: DataFrame, columns: Sequence[Column], number: str) -> DataFrame:
    """``columns`` of ``df``, and each row's place in it as ``number``, from 0.

    A scan of files does not keep the order in which they were written, since it deals files by
    size. So the place comes from the files: in the order of ``file_order``, and from the row's
    number in its file. A filter leaves gaps. What is no plain scan of Parquet is written first.
    The driver gets one row for each file.
    """
    at = _scan_rows(df)
    if at is None:
        df = materialize(df.select(*columns), "ordered")
        at, columns = df.metadataColumn("_metadata"), [df[f"`{c}`"] for c in df.columns]
    rows = df.select(*columns, at["file_path"].alias("_path"), at["row_index"].alias("_at"))
    ends = {r._path: r.n for r in rows.groupBy("_path").agg((F.max("_at") + 1).alias("n")).collect()}
    before, first = 0, []
    for path in sorted(ends, key=file_order):
        first.append((path, before))
        before += ends[path]
    first = df.sparkSession.createDataFrame(first, "_path string, _first long")
    return rows.join(F.broadcast(first), "_path").withColumn(number, F.col("_first") + F.col("_at")).drop("_path", "_first", "_at")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if a scan gives fewer; what is done row by row then uses them all."""
    plan, cores = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext.defaultParallelism
    if plan.nodeName() == "AdaptiveSparkPlan" or plan.execute().getNumPartitions() >= cores:
        return df  # with a shuffle it is spread already
    return df.repartition(cores)


def inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table from a bounded number of driver-side rows, as a literal in the plan."""
    values = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(values).alias("r")).select("r.*")


def text_of(name: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def power_of_two(n: float) -> int:
    """The least power of two that is not below ``n``."""
    return 1 << max(0, (max(1, int(-(-n // 1))) - 1).bit_length())


#: Vocabulary files come with a package that every node has; a path may be given instead.
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Characters that a Python worker handles at a time, whole texts included.
SLICE_CHARS = 2_000_000


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this node; an absolute path stands for itself."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch, column: int, chars: int = SLICE_CHARS):
    """Consecutive parts of an Arrow batch with about ``chars`` bytes of text each, or a single longer text."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + chars, side="right")))
        yield batch.slice(start, end - start)
        start = end


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that their Python finds it wherever it runs."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-package-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))
    context._tidemark_shipped = True
