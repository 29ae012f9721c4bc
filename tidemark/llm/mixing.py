"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are dealt into blocks of equal size. With integer weights ``w`` that sum
to ``H`` over the sources that still have blocks, block ``j`` of a source is released at slot
``floor(j * H / w)`` and is due at slot ``ceil((j + 1) * H / w)``; at each slot the released
block with the earliest deadline goes next. That schedule meets every deadline and repeats
after ``H`` slots, so that one frame of ``H`` slots, worked out once, places every block of any
corpus: each source is at all times within less than one block of its share. When a source has
no blocks left, a new phase begins in which the others keep their relative weights.

The frames come from the weights and the number of blocks of each source alone. On the rows
only DataFrame functions run: rows of a source are spread over hashed buckets, counted there
and numbered within a bucket, so that neither a source with most of the rows nor an id that many
rows share is a hot key.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hot_keys, materialize, power_of_two, row_of

#: Rows in a block.
BLOCK_ROWS = 16
#: Rows that a hashed bucket is meant to hold, and buckets of the largest source at least.
BUCKET_ROWS, BUCKETS = 8_192, 256
#: What default weights sum to, about.
PARTS = 1_000
#: Sources that have a place of their own in the schedule; the rarest beyond that share one.
MAX_SOURCES = 1_024
#: Slots of all frames together; weights whose sum would lead to more are rounded to a smaller sum.
FRAME_SLOTS = 1 << 20


def reduced(weights: Mapping[str, int]) -> dict[str, int]:
    """The weights without their common divisor, rounded to a smaller sum (1 at least each) if their frames would have more than ``FRAME_SLOTS`` slots."""
    shared = math.gcd(*weights.values()) if weights else 1
    out, most = {s: w // shared for s, w in weights.items()}, FRAME_SLOTS // max(1, len(weights))
    total = sum(out.values())
    return out if total <= most else {s: max(1, w * most // total) for s, w in out.items()}


def frame(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of one frame, by source, from earliest-deadline-first over the blocks' windows."""
    total = sum(weights.values())
    waiting: dict[int, list[str]] = {}
    for s in sorted(weights):
        waiting.setdefault(0, []).append(s)
    slots: dict[str, list[int]] = {s: [] for s in weights}
    ready: list[tuple[int, str]] = []
    for t in range(total):
        for s in waiting.pop(t, []):
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if (j := len(slots[s])) < weights[s]:
            waiting.setdefault(max(t + 1, j * total // weights[s]), []).append(s)
    return slots


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[dict]:
    """For each source and each phase in which it has blocks: its first and end block, the phase's first slot, its frame."""
    left = {s: n for s, n in blocks.items() if n > 0}
    base, out, phase = 0, [], 0
    while left:
        active = {s: weights[s] for s in left}
        total, slots = sum(active.values()), frame(active)

        def end(s: str) -> int:  # the slot after its last block
            whole, rest = divmod(left[s] - 1, active[s])
            return whole * total + slots[s][rest] + 1

        length = min(end(s) for s in left)
        whole, rest = divmod(length, total)
        for s in list(left):
            n = whole * active[s] + sum(x < rest for x in slots[s])
            done = blocks[s] - left[s]
            out.append({"source": s, "phase": phase, "first": done, "end": done + n, "base": base, "parts": active[s], "total": total, "slots": slots[s]})
            left[s] -= n
            if not left[s]:
                del left[s]
        base, phase = base + length, phase + 1
    return out


def balanced_weights(counts: Mapping[str, int], exponent: float = 0.5, parts: int = PARTS) -> dict[str, int]:
    """Integer weights in proportion to ``count ** exponent``, at least 1 each, that sum to about ``parts``."""
    total = sum(n**exponent for n in counts.values()) or 1
    return {s: max(1, round(max(parts, len(counts)) * n**exponent / total)) for s, n in counts.items()}


def mix_sources(docs: DataFrame, weights: Mapping[str, int] | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, keep: Sequence[str] = (), max_sources: int = MAX_SOURCES) -> DataFrame:
    """Each row's place in the mix: ``id_col, source, block, phase, slot, release, deadline, position``.

    ``slot`` is the place of the row's block in the schedule, from 0 and without gaps; ``release``
    and ``deadline`` bound it (``release <= slot < deadline``). ``position`` orders the rows:
    ``slot * block_rows`` plus the place in the block; a source's last block may be shorter.
    ``weights`` are integers by source; absent sources get weight 1 (see ``reduced`` for large
    sums). By default they are proportional to the square root of a source's rows. Of more than
    ``max_sources`` sources, the rarest share one place and the sum of their weights, in which
    their rows follow a hash. A null source counts as the source ``''``.
    Within a source, rows follow a hash of their id, then the id. Rows with a null id, and rows of
    an id with more than a thousandth of all rows, follow a hash of their number in the input.
    Every row is placed exactly once; none is dropped or repeated. No rows give no rows. Only the
    two named columns are read, and those in ``keep``, which are given back; the latter must not
    have a name that this function returns or one that begins with ``_mix``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_mix_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), *keep)
    # written once, so that a row's number stays the same even if a task is run again
    rows = materialize(rows.withColumn("_mix_uid", F.monotonically_increasing_id()), "mix-rows")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    total = rows.count()
    counts = {r.source: r.n for r in sizes.orderBy(F.desc("n"), "source").limit(max_sources).collect()}
    listed = sum(counts.values())
    names = list(counts)
    group = F.coalesce(F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("source")) - 1, F.lit(-1))
    group = F.when(group < 0, F.lit(len(names))).otherwise(group).cast("int")
    parts = {s: int(weights.get(s, 1)) for s in counts} if weights is not None else {}
    if any(p < 1 for p in parts.values()):
        raise ValueError("weights must be positive integers")
    if listed < total:  # the rest of the sources, as one
        rest = f"{len(names)} and more"
        names.append(rest)
        counts[rest] = total - listed
        if weights is not None:
            own = F.when(F.lit(False), 1)
            for s, w in weights.items():
                own = own.when(F.col("source") == s, int(w))
            parts[rest] = sizes.filter(~F.col("source").isin(names)).agg(F.sum(own.otherwise(1))).first()[0]
    parts = reduced(parts) if weights is not None else balanced_weights(counts)
    plan = phases(parts, {s: -(-n // block_rows) for s, n in counts.items()})
    fields = ("phase", "first", "end", "base", "parts", "total", "slots")
    by_group = [[] for _ in names]
    place = {s: i for i, s in enumerate(names)}
    for p in plan:
        by_group[place[p["source"]]].append(tuple(p[k] for k in fields))
    schema = "_mix_group int, _mix_plan array<struct<phase: int, first: bigint, end: bigint, base: bigint, parts: bigint, total: bigint, slots: array<int>>>"
    # one row a group, and no more than FRAME_SLOTS slots in all
    planned = materialize(spark.createDataFrame(list(enumerate(by_group)), schema).coalesce(1), "mix-plan")

    n_buckets = power_of_two(max(BUCKETS, max(counts.values(), default=0) / BUCKET_ROWS * 2))
    hot = hot_keys(rows.filter("_mix_id IS NOT NULL").groupBy("_mix_id").agg(F.count("*").alias("n")), "n", total).select(F.col("_mix_id").alias("_mix_hot"))
    known = rows.join(F.broadcast(hot), F.col("_mix_id") == F.col("_mix_hot"), "left")
    by_number = F.col("_mix_id").isNull() | F.col("_mix_hot").isNotNull()
    key = F.when(by_number, F.xxhash64("_mix_uid", F.lit(8))).otherwise(F.xxhash64(F.col("_mix_id").cast("string"), F.lit(7)))
    dealt = known.withColumns({"_mix_key": key, "_mix_group": group}).withColumn("_mix_bucket", F.shiftrightunsigned("_mix_key", 64 - (n_buckets.bit_length() - 1)))
    in_bucket = dealt.groupBy("_mix_group", "_mix_bucket").agg(F.count("*").alias("_mix_size"))
    before = in_bucket.withColumn("_mix_before", F.sum("_mix_size").over(W.partitionBy("_mix_group").orderBy("_mix_bucket")) - F.col("_mix_size")).drop("_mix_size")
    nth = F.row_number().over(W.partitionBy("_mix_group", "_mix_bucket").orderBy("_mix_key", F.col("_mix_id").asc_nulls_last(), "_mix_uid"))
    # counts of buckets are as many as (group, bucket) pairs: joined by shuffle on the key that numbering has already dealt by
    numbered = dealt.withColumn("_mix_nth", nth).join(before, ["_mix_group", "_mix_bucket"]).withColumn("_mix_n", F.col("_mix_before") + F.col("_mix_nth") - 1)
    placed = (
        numbered.withColumns({"_mix_block": F.floor(F.col("_mix_n") / block_rows), "_mix_within": F.col("_mix_n") % block_rows})
        .join(F.broadcast(planned), "_mix_group")
        .withColumn("_mix_p", F.expr("filter(_mix_plan, x -> x.first <= _mix_block and _mix_block < x.end)[0]"))
        .withColumn("_mix_i", F.expr("_mix_block - _mix_p.first"))
        .withColumn("_mix_slot", F.expr("_mix_p.base + (_mix_i div _mix_p.parts) * _mix_p.total + _mix_p.slots[cast(_mix_i % _mix_p.parts as int)]"))
    )
    return placed.select(
        F.col("_mix_id").alias(id_col), "source", F.col("_mix_block").alias("block"), F.col("_mix_p.phase").alias("phase"), F.col("_mix_slot").alias("slot"),
        F.expr("_mix_p.base + _mix_i * _mix_p.total div _mix_p.parts").alias("release"),
        F.expr("_mix_p.base + ((_mix_i + 1) * _mix_p.total + _mix_p.parts - 1) div _mix_p.parts").alias("deadline"),
        (F.col("_mix_slot") * block_rows + F.col("_mix_within")).alias("position"), *keep,
    )


def mixed_order(docs: DataFrame, weights: Mapping[str, int] | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs``, whatever their names, in the order of the mix: partitions and the rows in them are sorted by position.

    Files that it is written to keep that order in their names and rows; ``common.numbered`` reads it.
    Null sources count as ``''`` and stay null; null and repeated ids are rows of their own. No rows give no rows.
    """
    marked = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("origin"))
    marked = materialize(marked.withColumn("uid", F.monotonically_increasing_id()), "mix-input")
    places = mix_sources(marked, weights, "origin", "id", keep=["uid"]).select("uid", "position")
    return marked.select("uid", "row").join(places, "uid").repartitionByRange("position").sortWithinPartitions("position").select("row.*")
