"""Packing documents into sequences: best-fit decreasing by partition, certified by lower bounds.

1. Every document becomes token ids and an end id; only documents that are longer than a
   sequence are cut. A piece as long as a sequence fills one.
2. The other pieces are dealt to partitions of bounded size, two at least. Each partition packs its
   pieces by best-fit decreasing and sums a family of dual feasible functions over them; the
   largest sum, rounded up, is a lower bound on the sequences that its pieces need. A partition
   that uses no more is certified.
3. The same bound over all pieces of the table is held against the number of all sequences. While
   that is larger, partitions with gaps exchange pieces: an uncertified partition gives those of all
   its sequences with a gap, a certified one those of its emptiest sequence, which is what rounding
   up has left. All other sequences are settled. What is given is dealt anew over fewer partitions
   and packed again. An exchange that uses more sequences than before is undone.

Where rows have an order that is to be kept, such as that of a mix of sources, partitions are
contiguous ranges of the rows' positions in it, and a sequence is numbered by the position of its first piece, its longest. A sequence then holds
rows of one range, but for the pieces that were exchanged, whose ranges are wider.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BPE, inline, materialize, numbered, power_of_two, slices, spread, text_of, vocabulary_path
from .mixing import mix_sources

#: Tokens in a sequence, and the id that ends a document.
CAPACITY = 2_048
END_ID = 0
#: Pieces that one partition packs, about.
PARTITION_PIECES = 50_000
#: Pieces in a range of the mix at first, about, and cells that ranges are made of, at most.
MIXED_PIECES = 4_096
CELLS = 16_384
#: Exchanges at most, and those in a row that may save nothing.
ROUNDS, PATIENCE = 15, 2


@cache
def encoder(path: str):
    from .bpe_arrays import WordBpe

    return WordBpe(path)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE, capacity: int = CAPACITY, end_id: int = END_ID, keep: Sequence[str] = ()) -> DataFrame:
    """The pieces of all documents: ``id, piece, start, length, ids_crc32`` and the columns in ``keep``."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *keep)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa

        bpe = encoder(vocabulary_path(vocabulary))
        for batch in batches:
            for part in slices(batch, 1):
                of, piece, start, length, crc = [], [], [], [], []
                for i, raw in enumerate(bpe.encode(part.column(1).to_pylist())):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[a : a + 4 * capacity]
                        of.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                of = pa.array(of, pa.int64())
                own = [part.column(2 + c).take(of) for c in range(len(keep))]
                yield pa.record_batch([part.column(0).take(of), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *own], ["id", "piece", "start", "length", "ids_crc32", *keep])

    kept = [rows.schema[c] for c in keep]
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")), *kept])
    return rows.mapInArrow(run, schema)


def dual_feasible_sums(counts: np.ndarray, capacity: int) -> dict[str, float]:
    """For each function of the family the sum over the pieces (``counts`` by length); none exceeds the sequences that these pieces need.

    The family: the length itself; thresholds that round lengths above ``capacity - e`` up and
    those below ``e`` down; and floors to multiples of ``1 / k`` that are kept where exact.
    """
    n, x = counts.astype(np.float64), np.arange(capacity + 1)
    out = {"volume": float((n * x).sum()) / capacity}
    for parts in (3, 4, 5, 6, 8):
        e = capacity // parts
        f = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        out[f"threshold-{parts}"] = float((n * f).sum()) / capacity
    for k in range(1, 11):
        exact = (k + 1) * x % capacity == 0
        f = np.where(exact, x / capacity, (k + 1) * x // capacity / k)
        out[f"floor-{k}"] = float((n * f).sum())
    return out


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that pieces of these ``counts`` by length need at least."""
    return int(np.ceil(max(dual_feasible_sums(counts, capacity).values()) - 1e-6))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The bin and the offset of each piece, and what each bin has left. Ties keep the given order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[int] = []
    by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # a bit for each amount that some bin has left
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_left[room].pop()
            if not by_left[room]:
                open_ ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room = room - n
        if room:
            by_left[room].append(b)
            open_ |= 1 << room
    return bins, offsets, left


def mixed_ranges(pieces: DataFrame, parts: int, width: int) -> DataFrame:
    """``pieces`` with ``_p``: contiguous ranges of ``position`` with about equal numbers of pieces, made of cells ``width`` wide."""
    cell = F.expr(f"position div {width}L")
    found = sorted((r.cell, r.n) for r in pieces.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect())
    total, before, cells = sum(n for _, n in found), 0, []
    for c, n in found:
        cells.append({"_cell": c, "_p": before * parts // total})
        before += n
    return pieces.withColumn("_cell", cell).join(F.broadcast(inline(pieces.sparkSession, cells, "_cell long, _p long")), "_cell").drop("_cell")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with ``sequence_id, offset, partition_certified`` and ``certified``.

    ``certified``: no packing of all these pieces uses fewer sequences in all, as their lower bound
    proves. ``partition_certified``: the same of the partition that the sequence was packed in and
    its pieces. ``rounds``: exchanges at most; where they end the search, ``certified`` is false.
    If ``pieces`` have a ``position``, one for each document, ranges of it are packed and ``sequence_id`` follows it.
    """
    cols = pieces.columns
    mixed = "position" in cols
    # a text has less than 2^31 bytes, and no more ids with its end id
    bits = ((1 << 31) // capacity + 1).bit_length()
    number = F.shiftleft("position", bits) + F.col("piece") if mixed else F.monotonically_increasing_id() * 2
    whole = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": number, "offset": F.lit(0).cast("long"), "partition_certified": F.lit(True)})
    done = [whole]
    todo = pieces.filter(F.col("length") < capacity)
    by_length = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each length
    counts = np.bincount(list(by_length), weights=list(by_length.values()), minlength=capacity + 1) if by_length else np.zeros(capacity + 1)
    bound, settled, n = lower_bound(counts, capacity), int(counts[capacity]), int(counts[:capacity].sum())
    p = width = None
    if mixed and n:
        width = max(1, partition_pieces // 8, -(-(todo.agg(F.max("position")).first()[0] + 1) // CELLS))
    schema = T.StructType([*todo.schema.fields, *(T.StructField(c, T.LongType()) for c in ("bin", "offset")), T.StructField("partition_certified", T.BooleanType()), T.StructField("given", T.BooleanType())])

    def pack(key, table):
        import pyarrow as pa

        table = table.select(cols).combine_chunks()
        table = table.sort_by([(c, "ascending") for c in (("position", "piece") if mixed else ("ids_crc32", "start"))])
        lengths = table.column("length").to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        room = np.array(left, np.int64)
        certified = len(left) <= lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        given = room > 0
        if certified:
            given &= np.arange(len(room)) == room.argmax()
        names = key[0].as_py() << 32 | np.arange(len(left))
        if mixed:
            first = offsets == 0
            names[bins[first]] = ((table.column("position").to_numpy() << bits) + table.column("piece").to_numpy())[first]
        for name, values in (("bin", names[bins]), ("offset", offsets)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table.append_column("partition_certified", pa.array(np.full(len(lengths), certified))).append_column("given", pa.array(given[bins]))

    def named(packed, round_):
        name = F.col("bin") if mixed else (F.col("bin") * (rounds + 1) + round_) * 2 + 1
        return packed.select(*cols, name.alias("sequence_id"), "offset", "partition_certified")

    before = before_used = None  # the placement of ``todo`` in the exchange before
    idle = round_ = 0
    while n:
        needed = power_of_two(n / max(partition_pieces, PARTITION_PIECES if p else 1))
        p = max(2, power_of_two(n / partition_pieces)) if p is None else max(1, needed, min(power_of_two(n / partition_pieces), p // (4 if mixed else 2)))
        if mixed:
            dealt = mixed_ranges(todo, p, width)
        else:
            dealt = todo.withColumn("_p", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.lit(round_)), F.lit(p)))
        packed = materialize(dealt.groupBy("_p").applyInArrow(pack, schema), f"packed-{round_}")
        first = F.col("offset") == 0
        sums = packed.agg(F.count(F.when(first, 1)).alias("used"), F.count(F.when(first & F.col("given"), 1)).alias("given"), F.count(F.when(F.col("given"), 1)).alias("n")).first()
        worse = before_used is not None and sums.used > before_used
        idle = idle + 1 if before_used is not None and sums.used >= before_used else 0
        proven = settled + sums.used <= bound
        over = proven or p == 1 or round_ == rounds or idle == PATIENCE or sums.n == 0
        if worse and over:
            done.append(before)
            settled += before_used
            break
        if not worse:
            if over:
                done.append(named(packed, round_))
                settled += sums.used
                break
            done.append(named(packed.filter("NOT given"), round_))
            settled += sums.used - sums.given
            given = packed.filter("given")
            todo, n, before, before_used = given.select(*cols), sums.n, named(given, round_), sums.given
        round_ += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("certified", F.lit(settled <= bound))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE, capacity: int = CAPACITY, end_id: int = END_ID, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Packs all rows; one row a piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset, partition_certified, certified``.

    A null text is empty: the end id alone. Null and repeated ids are packed as rows of their own.
    Very long texts are cut into pieces of ``capacity`` ids, the last of which may be shorter.
    Pieces fill a sequence from offset 0 without gaps. ``certified`` says that the lower bound over
    all pieces proves the number of all sequences; see ``pack_pieces``. Other columns are not read,
    whatever their names. No rows give no rows.
    """
    pieces = materialize(cut_documents(spread(docs.select(id_col, text_col)), id_col, text_col, vocabulary, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity, partition_pieces, rounds).withColumnRenamed("id", id_col)


def pack_mixed(docs: DataFrame, weights: Mapping[str, int] | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE, capacity: int = CAPACITY, end_id: int = END_ID, partition_pieces: int = MIXED_PIECES) -> DataFrame:
    """``pack_documents`` with sequences in the order of the mix: each ``sequence_id`` is larger than those of earlier positions.

    Positions are those of ``mix_sources``. They follow from ids, sources and weights alone and are
    worked out here from the rows given, as files do not keep the order of rows. A sequence stands
    at the position of its longest piece; the others are from the same range of about
    ``partition_pieces`` pieces, or of a wider one where pieces were exchanged. Odd rows are
    treated as ``pack_documents`` and ``mix_sources`` say; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"), F.col(source_col).cast("string").alias("origin"), F.monotonically_increasing_id().alias("row"))
    pieces = materialize(cut_documents(rows, "doc", "text", vocabulary, capacity, end_id, ["origin", "row"]), "pieces")
    places = mix_sources(pieces.filter("piece = 0"), weights, "origin", "id", keep=["row"]).select("row", "position")
    placed = materialize(pieces.join(places, "row").drop("row", "origin"), "placed")
    return pack_pieces(placed, capacity, partition_pieces).drop("position").withColumnRenamed("id", id_col)


def pack_ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE, capacity: int = CAPACITY, end_id: int = END_ID, partition_pieces: int = MIXED_PIECES) -> DataFrame:
    """``pack_documents`` with sequences in the order of the rows of ``docs``, which files keep too (``common.numbered``).

    A sequence stands at the position of its longest piece; the others are from the same range of
    about ``partition_pieces`` pieces, or of a wider one where pieces were exchanged. Odd rows are
    treated as ``pack_documents`` says; other columns are not read, whatever their names.
    """
    rows = numbered(docs, [F.col(id_col).alias("doc"), text_of(text_col).alias("text")], "position")
    pieces = materialize(cut_documents(rows, "doc", "text", vocabulary, capacity, end_id, ["position"]), "pieces")
    return pack_pieces(pieces, capacity, partition_pieces).drop("position").withColumnRenamed("id", id_col)
