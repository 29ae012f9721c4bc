"""Near-duplicate classes by DartMinHash.

Signatures. A text is a weighted set: its runs of five words, weighted by how often each occurs.
For each element, darts are a Poisson process of rate 1 over (weight, rank), fixed by hashing:
the plane is cut into regions that double in weight and in rank, every region's number of darts
and their places follow from the hash of element and region. A dart counts for a text if it lies
below the element's weight there; each dart names one of ``K`` coordinates, and the dart of
lowest rank is the coordinate's value. Two texts agree in a coordinate with the probability of
their weighted Jaccard similarity. Only ranks up to a limit that fills all coordinates are thrown,
so that a text costs about ``K log K`` darts; texts with an empty coordinate go again further.

Joining. Copies (equal weighted sets) collapse to their smallest id. The others' signatures are
cut into bands; texts that share a band's values meet in a bucket, of which one member leads.
Leaders are compared with the members exactly, by the weighted Jaccard similarity of the whole
texts, and links at or over the threshold are closed to components. Where a bucket then holds
several components, members outside its largest one are compared with a few members of that one,
and what still stands outside with all members of the bucket. So every pair that shares a bucket
is either compared or known to be connected, and no group's pairs are listed.

Texts are compared in tasks of two sides of bounded size: a leader and a fragment of its members, a
fragment of outsiders and a fragment of the bucket. A text is sent once to each task that it takes
part in, a leader's once for each fragment, and no task holds more than two fragments.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_CHARS, materialize, paged_join, slices, spread, text_of

SHINGLE = 5
THRESHOLD = 0.8
#: Bands and rows in each; at similarity 0.8 a pair shares no band with probability 3e-6.
BANDS, ROWS = 32, 5
K = BANDS * ROWS
#: The lowest rank region ends at ``2 ** LOWEST``; later ones double.
LOWEST = -10
#: Darts a coordinate that are thrown at first, beyond ``ln K``.
MARGIN = 2.0
#: Members of a bucket's largest component that an outsider meets first.
MEETINGS = 4
#: Edges that are left when one task closes the rest of them.
LAST_EDGES = 8_192
#: Texts and bytes of text in a fragment, about; a longer text is one by itself.
FRAGMENT, FRAGMENT_BYTES = 500, 2_000_000


def poisson_limits(area: float) -> np.ndarray:
    """The hash values from which a region of this area has 1, 2, ... darts."""
    out, p, total, n = [], np.exp(-area), 0.0, 0
    while True:
        total += p
        if total >= 1 - 2.0**-53 or n > 40:
            return np.array(out, np.uint64)
        out.append(min(int(total * 2.0**64), 2**64 - 1))
        n += 1
        p *= area / n


def throw(h: np.ndarray, of: np.ndarray, weight: np.ndarray, limit: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All darts that count, of elements whose texts share the rank limit: text, coordinate, rank, dart."""
    from .words import mix, seeded

    found = []
    nu = 0
    while len(h):
        w0, w1 = 2.0**nu - 1, 2.0 ** (nu + 1) - 1
        inside = weight > w0
        if not inside.all():
            h, of, weight = h[inside], of[inside], weight[inside]
        if not len(h):
            break
        rho = 0
        while True:
            r0, r1 = (0.0 if rho == 0 else 2.0 ** (LOWEST + rho - 1)), 2.0 ** (LOWEST + rho)
            if r0 >= limit:
                break
            parts = max(1, int((w1 - w0) * (r1 - r0)))  # so that no part has more than area 1
            step = (r1 - r0) / parts
            limits = poisson_limits((w1 - w0) * step)
            wanted = min(parts, int(np.ceil((limit - r0) / step)))
            block = max(1, 4_000_000 // max(1, len(h)))
            for a in range(0, wanted, block):
                sub = np.arange(a, min(wanted, a + block))
                salt = mix(sub.astype(np.uint64) + seeded(3, nu, rho))
                cell = mix(h[:, None] ^ salt[None, :])
                hit, part = np.nonzero(cell >= limits[0])
                cell = cell[hit, part]
                darts = np.searchsorted(limits, cell, side="right")
                of_cell = np.repeat(np.arange(len(cell)), darts)
                nth = np.arange(len(of_cell)) - np.repeat(np.cumsum(darts) - darts, darts)
                dart = mix(cell[of_cell] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                place = mix(dart ^ seeded(4))
                i = hit[of_cell]
                at_weight = w0 + (w1 - w0) * ((place >> np.uint64(32)).astype(np.float64) * 2.0**-32)
                rank = r0 + step * (sub[part[of_cell]] + (place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
                ok = (at_weight < weight[i]) & (rank < limit)
                dart, i = dart[ok], i[ok]
                coordinate = ((mix(dart ^ seeded(5)) >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
                found.append((of[i], coordinate.astype(np.int64), rank[ok], dart))
            rho += 1
        nu += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(h: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """The ``n`` texts' signatures: for each coordinate the dart of lowest rank. Each text has an element of positive weight."""
    out = np.zeros((n, k), np.uint64)
    size = np.bincount(of, weights=weight, minlength=n)
    todo = np.arange(n)
    # powers of two, so that texts of like size share their regions
    level = np.ceil(np.log2(k * (np.log(k) + MARGIN) / np.maximum(size, 1e-12))).astype(np.int64)
    while len(todo):
        again = []
        for e in np.unique(level[todo]):
            texts = todo[level[todo] == e]
            for s in range(0, len(texts), 256):
                own = texts[s : s + 256]
                local = np.full(n, -1)
                local[own] = np.arange(len(own))
                at = np.flatnonzero(local[of] >= 0)
                t, c, rank, dart = throw(h[at], local[of[at]], weight[at], 2.0**e, k)
                key = t * k + c
                order = np.lexsort((rank, key))
                first = order[np.flatnonzero(np.diff(key[order], prepend=-1))]
                out[own[t[first]], c[first]] = dart[first]
                filled = np.bincount(t[first], minlength=len(own))
                again.append(own[filled < k])
        todo = np.concatenate(again)
        level[todo] += 1
    return out


def sign_texts(texts, size: int, bands: int, rows: int):
    """For an Arrow array of texts: two 64-bit fingerprints of the weighted set of each, and the bands' hashes."""
    from .words import mix, seeded, shingles, weighted

    n = len(texts)
    h, of, weight = weighted(*shingles(texts, size))
    own = [mix(h ^ seeded(6, i)) * mix(weight.astype(np.uint64) + seeded(7, i)) for i in range(2)]
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    prints = [mix(np.add.reduceat(x, starts)) for x in own]
    signed = signatures(h, of, weight, n, bands * rows).reshape(n, bands, rows)
    out = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        out = mix(out + signed[:, :, r] * (seeded(8, r) | np.uint64(1)))
    return prints, out


def close(a, b):
    """For Arrow arrays of the ends of edges: their nodes, and the smallest node of each one's component."""
    import pyarrow as pa
    import pyarrow.compute as pc

    nodes = pc.unique(pa.concat_arrays([a, b]))
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = (pc.index_in(x, nodes).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes.take(pa.array(label))


def close_last(edges: DataFrame) -> DataFrame:
    """``node, parent``, the smallest node of its component, of at most ``LAST_EDGES`` edges in one task."""
    kind = edges.schema["a"].dataType

    def run(batches):
        import pyarrow as pa

        if held := list(batches):
            table = pa.Table.from_batches(held)
            yield pa.record_batch(list(close(*(table.column(c).combine_chunks() for c in ("a", "b")))), ["node", "parent"])

    return edges.coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("parent", kind)]))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of its component, for all nodes of ``edges`` (a, b).

    In each round a node adopts the neighbour of lowest priority, a hash that is new in each
    round, if that is below its own or its only neighbour, twice over; edges inside what is joined
    then vanish. A star is joined in one round, of a chain more than half of the nodes, so that the
    rounds grow with the logarithm of the nodes. Each round is written to the shared folder; nodes
    with very many edges are dealt over pages. The last ``LAST_EDGES`` edges are closed by one task,
    as rounds over so few are only plans and jobs, which take the driver's memory.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    steps = []
    while n := edges.count():
        if n <= LAST_EDGES:
            steps.append(materialize(close_last(edges), "parents"))
            if len(steps) == 1:
                return steps[0].select("node", F.col("parent").alias("label"))
            break
        priority = lambda c, r=len(steps): F.xxhash64(c, F.lit(r), F.lit(11))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        up = both.groupBy("node").agg(F.min_by("to", priority("to")).alias("to"), F.min(priority("to")).alias("least"), F.count("*").alias("n"))
        up = materialize(up.select("node", "n", F.when((F.col("n") == 1) | (F.col("least") < priority("node")), F.col("to")).otherwise(F.col("node")).alias("parent")), "parents")
        adopted = up.groupBy("parent").agg(F.count("*").alias("m"))
        over = materialize(adopted.join(up.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent"), "grandparents")
        # two that adopt each other go to the lower one
        mutual = (F.col("grand") == F.col("node")) & (F.col("parent") != F.col("node"))
        last = F.when(mutual & (priority("parent") < priority("node")), F.col("parent")).otherwise(F.col("grand"))
        step = materialize(paged_join(up, over, ["parent"], "m", up.count(), F.col("node")).select("node", "n", last.alias("parent")), "parents")
        steps.append(step)
        of_a, of_b = (step.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parent").alias(f"p{c}")) for c in "ab")
        joined = paged_join(paged_join(edges, of_a, ["a"], "na", 2 * n, F.col("b")), of_b, ["b"], "nb", 2 * n, F.col("a")).filter("pa <> pb")
        edges = materialize(joined.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label"))
    root = steps[-1].select("node", F.col("parent").alias("root"))
    for step in reversed(steps[:-1]):
        counts = step.groupBy("parent").agg(F.count("*").alias("m"))
        known = counts.join(root.withColumnRenamed("node", "parent"), "parent", "left").select("parent", "m", F.coalesce("root", "parent").alias("root"))
        root = materialize(paged_join(step.select("node", "parent"), materialize(known, "roots"), ["parent"], "m", step.count(), F.col("node")).select("node", "root"), "roots")
    least = materialize(root.groupBy("root").agg(F.min("node").alias("label"), F.count("*").alias("m")), "least")
    return materialize(paged_join(root, least, ["root"], "m", root.count(), F.col("node")).select("node", "label"), "labels")


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node, label``) after more links (``a, b``): only what these join is closed again."""
    links = materialize(links, "links")
    known = labels.select("node", "label")
    ends = links.select("a").union(links.select("b")).distinct().withColumnRenamed("a", "node")
    known = materialize(known.unionByName(ends.join(known, "node", "left_anti").withColumn("label", F.col("node"))), "known")
    of = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    more = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    counts = known.groupBy("label").agg(F.count("*").alias("m"))
    entries = counts.join(more.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").withColumn("now", F.coalesce("now", "label"))
    return materialize(paged_join(known, materialize(entries, "roots"), ["label"], "m", known.count(), F.col("node")).select("node", F.col("now").alias("label")), "labels")


def whole_tasks(batches, most: int = SLICE_CHARS):
    """Tables of rows with their tasks whole, from batches sorted by ``task``; of about ``most`` bytes of text, or one task."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size, last = [], 0, None

    def ready():
        return pa.Table.from_batches(held).combine_chunks()

    for batch in batches:
        task = batch.column("task").to_numpy()
        if not len(task):
            continue
        starts = np.flatnonzero(np.diff(task, prepend=task[0] - 1 if last is None else last))
        before = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))])
        at = 0
        for s in starts:
            if size + before[s] - before[at] >= most or (s == 0 and size >= most):
                if s > at:
                    held.append(batch.slice(at, s - at))
                if held:
                    yield ready()
                held, size, at = [], 0, s
        held.append(batch.slice(at))
        size += before[-1] - before[at]
        last = task[-1]
    if held:
        yield ready()


def compare_tasks(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (``a, b``) between the two sides of each task; ``rows``: ``task, side, rep, label, band, bands, text``, side 0 or 1.

    Pairs of one label are known to be connected. Where rows have ``bands``, a pair that shares
    several buckets is compared in that of the first band. Of a text's links to one component in a
    task, one is returned.
    """
    kind = rows.schema["rep"].dataType

    def compare(batches):
        import pyarrow as pa

        from .words import shingles, weighted

        for table in whole_tasks(batches):
            table = table.sort_by([("task", "ascending"), ("side", "ascending")]).combine_chunks()
            task, side, rep, label, band = (table.column(c).to_numpy() for c in ("task", "side", "rep", "label", "band"))
            flat = table.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            lists = table.column("bands").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first_band = np.cumsum(lists) - lists
            h, of, w = weighted(*shingles(table.column("text").combine_chunks(), size))
            ends, total = np.searchsorted(of, np.arange(len(rep) + 1)), np.bincount(of, weights=w, minlength=len(rep))
            starts = np.append(np.flatnonzero(np.diff(task, prepend=task[0] - 1)), len(task))
            out_a, out_b = [], []
            for start, stop in zip(starts[:-1], starts[1:], strict=True):
                mid = start + int(np.searchsorted(side[start:stop], 1))
                lo, hi = ends[mid], ends[stop]
                if mid in (start, stop):
                    continue
                keys, weights, owner = h[lo:hi], w[lo:hi], of[lo:hi] - mid
                width = lists[start]
                bands = flat[first_band[start] : first_band[start] + width * (stop - start)].reshape(stop - start, -1) if width else None
                for i in range(start, mid):
                    wanted = label[mid:stop] != label[i]
                    if bands is not None:
                        wanted &= (bands[mid - start :] == bands[i - start]).argmax(axis=1) == band[i]
                    if not wanted.any():
                        continue
                    own_h, own_w = h[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]]
                    at = np.minimum(np.searchsorted(own_h, keys), len(own_h) - 1)
                    shared = np.bincount(owner, weights=np.where(own_h[at] == keys, np.minimum(own_w[at], weights), 0.0), minlength=stop - mid)
                    found = mid + np.flatnonzero(wanted & (shared >= threshold * (total[mid:stop] + total[i] - shared)))
                    _, first = np.unique(label[found], return_index=True)
                    out_a += [min(rep[i], rep[j]) for j in found[first]]
                    out_b += [max(rep[i], rep[j]) for j in found[first]]
            yield pa.record_batch([pa.array(out_a, table.schema.field("rep").type), pa.array(out_b, table.schema.field("rep").type)], ["a", "b"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(compare, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def fragments(n: str, size: str):
    """How many fragments ``n`` texts of ``size`` bytes make."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / FRAGMENT), F.ceil(F.col(size) / FRAGMENT_BYTES)).cast("int")


def fragment_of(c: str, parts):
    return F.pmod(F.xxhash64(c, F.lit(10)), parts.cast("long")).cast("int")


def star_links(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Those of ``pairs`` (``leader, rep, size`` of the latter, distinct) that are similar enough, as ``a, b``; ``texts``: ``rep, text``."""
    pairs = materialize(pairs, "pairs")
    stars = materialize(pairs.groupBy("leader").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("parts", fragments("n", "bytes")), "stars")
    dealt = paged_join(pairs.select("leader", "rep"), stars, ["leader"], "n", pairs.count(), F.col("rep"))
    task = lambda f: F.xxhash64("leader", f)
    members = dealt.select(task(fragment_of("rep", F.col("parts"))).alias("task"), F.lit(1).alias("side"), "rep")
    leaders = stars.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("f")).select(task(F.col("f")).alias("task"), F.lit(0).alias("side"), F.col("leader").alias("rep"))
    # the only label of a text is itself here
    rows = leaders.unionByName(members).join(texts.select("rep", "text"), "rep")
    return compare_tasks(rows.select("task", "side", "rep", F.col("rep").alias("label"), F.lit(0).alias("band"), F.array().cast("array<bigint>").alias("bands"), "text"), size, threshold)


def outsider_links(unsettled: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links of members outside a bucket's main component to all members that they are not connected to; ``unsettled``: ``bucket, band, rep, size, label, n, main``; ``texts``: ``rep, text, bands``."""
    # of buckets with the same members that of the lowest band does: it is the first that its pairs share
    both = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in (12, 13)]
    sets = unsettled.groupBy("bucket", "band").agg(F.count("*").alias("n"), *both)
    first = materialize(sets.groupBy("n", "x12", "x13").agg(F.min_by("bucket", "band").alias("bucket")).select("bucket", "n"), "first")
    rows = materialize(paged_join(unsettled.drop("n"), first, ["bucket"], "n", unsettled.count(), F.col("rep")), "outsiders")
    rows = rows.withColumn("out", F.col("label") != F.col("main"))
    count = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    sides = rows.groupBy("bucket").agg(*[count(c, x).alias(f"{a}{b}") for a, c in (("o", F.col("out")), ("m", ~F.col("out"))) for b, x in (("n", F.lit(1)), ("size", F.col("size")))], F.count("*").alias("n"))
    sides = materialize(sides.select("bucket", "n", fragments("on", "osize").alias("po"), fragments("mn", "msize").alias("pm")), "sides")
    dealt = paged_join(rows.drop("n", "size"), sides, ["bucket"], "n", rows.count(), F.col("rep"))
    dealt = materialize(dealt.withColumn("f", fragment_of("rep", F.when(F.col("out"), F.col("po")).otherwise(F.col("pm")))), "dealt")
    up_to = lambda a, b: F.explode(F.sequence(a, b))
    zero, own = F.lit(0), ("bucket", "band", "rep", "label", "f")
    outside, inside = dealt.filter("out"), dealt.filter("NOT out")
    parts = (
        outside.select(*own, F.lit("m").alias("kind"), F.lit(0).alias("side"), up_to(zero, F.col("pm") - 1).alias("g")).select("*", F.col("f").alias("i"), F.col("g").alias("j")),
        inside.select(*own, F.lit("m").alias("kind"), F.lit(1).alias("side"), up_to(zero, F.col("po") - 1).alias("g")).select("*", F.col("g").alias("i"), F.col("f").alias("j")),
        # of two fragments of outsiders the lower one is side 0, so that a pair has one task
        outside.select(*own, F.lit("o").alias("kind"), F.lit(0).alias("side"), up_to(F.col("f"), F.col("po") - 1).alias("g")).select("*", F.col("f").alias("i"), F.col("g").alias("j")),
        outside.select(*own, F.lit("o").alias("kind"), F.lit(1).alias("side"), up_to(zero, F.col("f")).alias("g")).select("*", F.col("g").alias("i"), F.col("f").alias("j")),
    )
    tasks = functools.reduce(DataFrame.unionByName, parts).select(F.xxhash64("bucket", "kind", "i", "j").alias("task"), "side", "rep", "label", "band")
    rows = tasks.join(texts.select("rep", "text", "bands"), "rep")
    return compare_tasks(rows.select("task", "side", "rep", "label", "band", "bands", "text"), size, threshold)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row: ``id_col, class_id, kept``; a class is a component of texts linked at ``threshold`` or more.

    ``class_id`` is the smallest id of the class, ``kept`` holds for that id's row. Words are
    lower-cased and stand between white space. A text of fewer than ``size`` words is one element,
    so that it is similar only to the same words; null and empty texts are copies of each other.
    Rows with a null id are each a class of their own, with a null ``class_id``, and are kept. Ids are
    meant to name one text: rows that share an id and have different texts are marked by the class
    of their own text each, and a link of one may join another's class too. Texts are compared
    whole, whatever their length. Other columns are not read. No rows give no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    nameless = source.filter("id is null").select("id", F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    source = source.filter("id is not null")
    id_type = source.schema["id"].dataType

    def sign(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for part in slices(batch, 1):
                (f1, f2), keys = sign_texts(part.column(1), size, bands, rows)
                length = pc.binary_length(part.column(1)).cast(pa.int64())
                flat = pa.array(keys.view(np.int64).ravel(), pa.int64())
                ends = pa.array(np.arange(part.num_rows + 1) * bands, pa.int32())
                yield pa.record_batch([part.column(0), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), length, pa.ListArray.from_arrays(ends, flat)], ["id", "f1", "f2", "size", "bands"])

    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("f1 long, f2 long, size long, bands array<long>").fields])
    signed = materialize(spread(source).mapInArrow(sign, schema), "signed")
    items = signed.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("size").alias("size"), F.any_value("bands").alias("bands"), F.count("*").alias("n"))
    items = materialize(items, "items")

    buckets = items.select("rep", "size", F.posexplode("bands").alias("band", "key")).select("rep", "size", "band", F.xxhash64("band", "key").alias("bucket"))
    # the same few texts lead many buckets, so that most pairs of leader and member are the same in several
    lead = lambda c: F.min_by(c, F.xxhash64(c, F.lit(8)))
    led = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("n"), lead("rep").alias("leader")).filter("n > 1"), "led")
    members = materialize(paged_join(buckets, led, ["bucket"], "n", items.count() * bands, F.col("rep")).select("bucket", "band", "rep", "size", "leader"), "members")
    wanted = members.select(F.col("rep").alias("id")).distinct().join(items.select(F.col("rep").alias("id"), F.col("bands").alias("bands")), "id")
    texts = materialize(source.join(wanted, "id").select(F.col("id").alias("rep"), "text", "bands"), "texts")

    def open_members(members, labels):
        """Members of buckets that hold several components, with their label and the bucket's largest one."""
        labelled = members.join(labels, F.col("rep") == F.col("node"), "left").select("bucket", "band", "rep", "size", F.coalesce("label", "rep").alias("label"))
        labelled = materialize(labelled, "labelled")
        counted = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        sizes = counted.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
        open_ = materialize(sizes.filter("parts > 1").select("bucket", "n", F.col("most.label").alias("main")), "open")
        return materialize(paged_join(labelled, open_, ["bucket"], "n", labelled.count(), F.col("rep")), "open")

    labels = components(star_links(members.filter("rep <> leader").select("leader", "rep", "size").distinct(), texts, size, threshold))
    # the leader has met all others
    unsettled = open_members(members.filter("rep <> leader").select("bucket", "band", "rep", "size"), labels)
    if not unsettled.isEmpty():
        slot = F.pmod(F.xxhash64("rep", F.lit(9)), F.lit(MEETINGS))
        hosts = unsettled.filter("label = main").groupBy("bucket", slot.alias("slot")).agg(lead("rep").alias("leader")).select("bucket", "leader")
        meetings = unsettled.filter("label <> main").join(hosts, "bucket").select("leader", "rep", "size").distinct()
        labels = merge_components(labels, star_links(meetings, texts, size, threshold))
        unsettled = open_members(unsettled.select("bucket", "band", "rep", "size"), labels)
    if not unsettled.isEmpty():
        labels = merge_components(labels, outsider_links(unsettled, texts, size, threshold))

    classes = items.select("f1", "f2", "rep", "n").join(labels, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", F.coalesce("label", "rep").alias("class_id"))
    out = paged_join(signed.select("id", "f1", "f2"), materialize(classes, "classes"), ["f1", "f2"], "n", signed.count(), F.col("id"))
    out = out.select("id", "class_id", (F.col("id") == F.col("class_id")).alias("kept")).unionByName(nameless)
    return out.withColumnRenamed("id", id_col)
