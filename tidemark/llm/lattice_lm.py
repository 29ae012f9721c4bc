"""Language-model scores from the lattice of all segmentations of a text.

The vocabulary is an existing public one with word ends; no piece is added or removed. None of the
public files that are installed holds unigram scores (they hold merges), so that the scores are
estimated here: they start from the order in the vocabulary and are re-estimated by expected counts
over all segmentations of the distinct training words (forward-backward in log space), for each
class of texts (language) on its own.

The lattice of a word has an edge for each piece, and one for the whole word if training has seen
it (``word_segments``; without it the pieces are all there is). Forward recursion in log space sums
over all paths. The whole-word edge has the word's count less a discount, in its class and, for a
share of what the discount leaves, in all classes; pieces have the rest. So pieces are estimated on
what is left to them, one count for each distinct word; without whole-word edges on all tokens.
Discounts follow from the numbers of words that occur once to four times.

A text is a sequence of words and an end; its probability is the classes' mixture of the products.
Classes are never read when texts are scored. All of this is a distribution over texts of any words.

Word counts of the training rows are grouped before they are shuffled. The most frequent words go
to all tasks, as many as a fixed bound; all other words of a document meet their counts in a join
by word, in which, being rare, none is hot.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BPE, materialize, slices, spread, text_of, vocabulary_path

#: Frequent words that are sent to all tasks, and the longest of them in bytes.
HEAD_WORDS, HEAD_BYTES = 300_000, 64
#: Rounds of re-estimation; weight of the first scores in it, in counts.
ROUNDS = 6
PRIOR_COUNT = 100.0
#: Of what discounts leave in a class, the share of words seen in any class; pieces have the rest.
SHARED = 0.1
#: Classes of training rows that have scores of their own; the rarest beyond that share one.
MAX_CLASSES = 8
#: Distinct words that a task counts before it hands on its sums.
COUNTER_WORDS = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a vocabulary file by a hash of their bytes: those inside a word and those that end one."""

    def __init__(self, path: str):
        from .bpe_arrays import byte_symbols

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        suffix = spec["model"]["end_of_word_suffix"]
        special = {t["content"] for t in spec["added_tokens"]}
        inner, ends = [], []
        self.size = len(spec["model"]["vocab"])
        self.order = np.full(self.size, -1, np.int64)
        for piece, i in spec["model"]["vocab"].items():
            if piece in special:
                continue
            self.order[i] = i
            ending = piece.endswith(suffix) and piece != suffix
            (ends if ending else inner).append((bytes(byte_of[c] for c in (piece[: -len(suffix)] if ending else piece)), i))
        self.longest = max(len(b) for b, _ in inner + ends)
        # a table by a short hash of all beginnings of pieces: few strings go on to be pieces
        self.begun = np.zeros(1 << 22, bool)
        self.inner, self.ends = self._table(inner), self._table(ends)

    def _table(self, pieces):
        h = np.zeros(len(pieces), np.uint64)
        with np.errstate(over="ignore"):
            for k, (b, _) in enumerate(pieces):
                x = np.uint64(0)
                for c in b:
                    x = x * _P + np.uint64(c + 1)
                    self.begun[int(x >> np.uint64(42))] = True
                h[k] = x
        ids = np.array([i for _, i in pieces], np.int64)
        order = np.argsort(h)
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces share a hash")
        lengths = np.array([len(b) for b, _ in pieces])[order]
        bits = np.zeros(1 << 20, bool)
        bits[(h >> np.uint64(44)).astype(np.int64)] = True
        return h[order], ids[order], bits, lengths

    def find(self, h: np.ndarray, length: int, ending: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashed strings are pieces, and the pieces' ids."""
        keys, ids, bits, lengths = self.ends if ending else self.inner
        maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
        ok = (keys[at] == h[maybe]) & (lengths[at] == length)
        return maybe[ok], ids[at[ok]]

    def first_scores(self) -> np.ndarray:
        """Natural logs of probabilities that fall with the place in the vocabulary."""
        p = np.where(self.order >= 0, 1.0 / (self.order + 10.0), 0.0)
        with np.errstate(divide="ignore"):
            return np.log(p / p.sum())


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def word_groups(words: list[bytes], most: int = 1 << 20):
    """(places, matrix of bytes) for words of one length each, at most ``most`` bytes together or one word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    sorted_ = lengths[order]
    start = 0
    while start < len(order):
        n = int(sorted_[start])
        end = min(int(np.searchsorted(sorted_, n, side="right")), start + max(1, most // max(1, n * 8)))
        at = order[start:end]
        yield at, np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), n)
        start = end


def lattice(pieces: Pieces, scores: np.ndarray, group: np.ndarray, keep: bool = False):
    """Forward log probabilities of words of one length (rows of bytes) for each column of ``scores``, and with ``keep`` the lattice's edges."""
    n, size = group.shape
    codes = np.ascontiguousarray(group.T).astype(np.uint64) + np.uint64(1)
    alpha = np.full((size + 1, n, scores.shape[1]), -np.inf)
    alpha[0] = 0.0
    edges = []
    for s in range(size):
        live, h = np.arange(n), np.zeros(n, np.uint64)
        for e in range(s + 1, min(size, s + pieces.longest) + 1):
            h = h * _P + codes[e - 1, live]
            more = pieces.begun[(h >> np.uint64(42)).astype(np.int64)]
            live, h = live[more], h[more]
            if not len(live):
                break
            at, ids = pieces.find(h, e - s, e == size)
            if len(at):
                at = live[at]
                alpha[e, at] = np.logaddexp(alpha[e, at], alpha[s, at] + scores[ids])
                if keep:
                    edges.append((s, e, at, ids))
    return alpha, edges


def marginals(pieces: Pieces, scores: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Each word's log probability, summed over all segmentations, for each column of ``scores``."""
    out = np.zeros((len(words), scores.shape[1]))
    for at, group in word_groups(words):
        out[at] = lattice(pieces, scores, group)[0][-1]
    return out


def expected_counts(pieces: Pieces, scores: np.ndarray, words: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Expected numbers of all pieces in words of these weights, for each column of ``scores`` and ``weight``."""
    out = np.zeros(scores.shape)
    for k in range(scores.shape[1]):
        used = np.flatnonzero(weight[:, k])
        own_words = [words[i] for i in used]
        for at, group in word_groups(own_words):
            alpha, edges = lattice(pieces, scores[:, k : k + 1], group, keep=True)
            alpha = alpha[:, :, 0]
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0.0
            total, w = alpha[-1], weight[used[at], k]
            all_ids, all_x = [], []
            for s, e, own, ids in reversed(edges):
                step = scores[ids, k] + beta[e, own]
                beta[s, own] = np.logaddexp(beta[s, own], step)
                all_ids.append(ids)
                all_x.append(w[own] * np.exp(alpha[s, own] + step - total[own]))
            out[:, k] += np.bincount(np.concatenate(all_ids), weights=np.concatenate(all_x), minlength=len(out))
    return out


def gathered(batches, rows: int = 100_000):
    """Arrow batches joined to larger ones, so that words of each length are many."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def split_tokens(texts):
    """Words of an Arrow array of texts as the contract has them, with the text of each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    of = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    words = parts.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        words, of = words.filter(pa.array(full)), of[full]
    return words, of


def count_words(texts: DataFrame, classes: int) -> DataFrame:
    """``word, class, c`` over the columns ``text, class``; each task sums up what it has before the shuffle, within a bound."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0

        def merged(tables):
            return pa.concat_tables(tables).group_by(["word", "class"]).aggregate([("c", "sum")]).rename_columns(["word", "class", "c"])

        for batch in batches:
            for part in slices(batch, 0):
                words, of = split_tokens(part.column(0))
                coded = words.dictionary_encode()
                key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * classes + part.column(1).to_numpy()[of]
                pair, times = np.unique(key, return_counts=True)
                held.append(pa.table({"word": coded.dictionary.take(pa.array(pair // classes)), "class": pa.array(pair % classes, pa.int32()), "c": pa.array(times, pa.int64())}))
                n += len(pair)
                if n > 2 * COUNTER_WORDS:
                    held = [merged(held)]
                    n = held[0].num_rows
                    if n > COUNTER_WORDS:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, n = [], 0
        if held:
            yield from merged(held).to_batches(max_chunksize=50_000)

    return texts.select("text", "class").mapInArrow(run, "word string, class int, c long")


def fit_scores(counts: DataFrame, classes: int, vocabulary: str = WORD_BPE, rounds: int = ROUNDS, by_token: bool = False) -> np.ndarray:
    """The pieces' log probabilities by class after ``rounds`` of re-estimation on all distinct words (column ``cs``: counts by class), weighted by their counts if ``by_token``."""
    spark = counts.sparkSession
    first = np.repeat(pieces_of(vocabulary_path(vocabulary)).first_scores()[:, None], classes, axis=1)
    scores = first
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(scores)

        def run(batches, sent=sent):
            import pyarrow as pa

            pieces, total = pieces_of(vocabulary_path(vocabulary)), np.zeros(sent.value.shape)
            for part in gathered(batches):
                if part.num_rows:
                    weight = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, classes).astype(np.float64)
                    weight = weight if by_token else (weight > 0).astype(np.float64)
                    total += expected_counts(pieces, sent.value, part.column(0).cast(pa.binary()).to_pylist(), weight)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], ["at", "x"])

        found = counts.select("word", "cs").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        total = np.exp(first) * PRIOR_COUNT
        np.add.at(total.reshape(-1), found["at"].to_numpy(), found["x"].to_numpy())
        with np.errstate(divide="ignore"):
            scores = np.log(total / total.sum(axis=0))
        sent.unpersist()
    return scores


def discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts of 0, 1, 2, and 3 or more, by the numbers ``n`` of words that occur once to four times."""
    if min(n[:3]) == 0:
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    d = [(k + 1) - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return np.array([0.0, *(min(max(x, 0.1), k + 0.9) for k, x in enumerate(d))])


class WordModel:
    """Probabilities of words by class from their pieces' and their counts; ``tokens`` and ``left`` (what discounts leave) by class.

    ``shared``: discounted counts of all words over all classes. ``words`` is whether whole-word edges are there.
    """

    def __init__(self, words: bool, discount: np.ndarray, tokens: np.ndarray, left: np.ndarray, shared: float):
        self.words, self.discount, self.tokens, self.left, self.shared = words, discount, tokens, left, shared

    def less(self, c: np.ndarray) -> np.ndarray:
        return c - self.discount[np.minimum(c, 3).astype(np.int64)]

    def log10(self, sub: np.ndarray, cs: np.ndarray) -> np.ndarray:
        """Of words whose pieces have the log probabilities ``sub`` and whose counts are ``cs`` (both by class)."""
        rest = np.log(self.left / self.tokens) + sub
        if not self.words:
            return rest / np.log(10)
        if self.shared:
            with np.errstate(divide="ignore"):
                seen = np.log(self.less(cs.sum(axis=1)) / self.shared * SHARED)[:, None] + np.log(self.left / self.tokens)
            rest = np.logaddexp(rest + np.log(1 - SHARED), seen)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(self.less(cs) / self.tokens), rest) / np.log(10)


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", class_col: str = "lang", vocabulary: str = WORD_BPE, head_words: int = HEAD_WORDS, max_classes: int = MAX_CLASSES, word_segments: bool = True) -> DataFrame:
    """One row for each row: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``learn`` is a condition on ``id``; rows that it does not hold for, or is null for, are held
    out. ``class_col`` is read of the training rows alone; null is a class like any other, and
    beyond ``max_classes`` classes the rarer ones are one. ``word_segments``: see above. A null text is empty: its only token is
    the end. Repeated rows are counted and scored each. Very long texts and words are scored
    whole. Other columns are not read. No rows give no rows. Without training rows all base scores
    are 0, pieces keep their first scores and an end has probability one half.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.coalesce(F.col(class_col).cast("string"), F.lit("")).alias("name"))
    rows = rows.withColumn("learnt", F.coalesce(learn, F.lit(False)))
    train = rows.filter("learnt")
    names = train.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(max_classes - 1).collect()
    class_of = F.coalesce(F.array_position(F.array(*[F.lit(r.name) for r in names]).cast("array<string>"), F.col("name")) - 1, F.lit(-1)).cast("int")
    others = len(names)
    train = train.withColumn("class", F.when(class_of < 0, F.lit(others)).otherwise(class_of))
    sizes = {r["class"]: r.n for r in train.groupBy("class").agg(F.count("*").alias("n")).collect()}
    k = max([*sizes, 0]) + 1
    by_class = [F.sum(F.when(F.col("class") == i, F.col("c")).otherwise(0)) for i in range(k)]
    counts = materialize(count_words(spread(train), max_classes).groupBy("word").agg(F.sum("c").alias("c"), F.array(*by_class).alias("cs")), "word-counts")
    n_texts = sum(sizes.values())
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    when = lambda c: F.count(F.when(c, 1))
    of = [F.col("cs")[i] for i in range(k)]
    totals = counts.agg(
        zero("c").alias("n"), F.count("*").alias("v"), *[when(F.col("c") == i).alias(f"t{i}") for i in range(1, 5)],
        *[zero(x).alias(f"n{i}") for i, x in enumerate(of)], *[when(x == m).alias(f"v{m}_{i}") for i, x in enumerate(of) for m in (1, 2)], *[when(x > 2).alias(f"v3_{i}") for i, x in enumerate(of)],
    ).first()
    n_tokens, n_types = totals.n + n_texts, totals.v + (n_texts > 0)
    ends = np.array([sizes.get(i, 0) for i in range(k)], np.float64)
    words = np.array([totals[f"n{i}"] for i in range(k)], np.float64)
    prior = np.log10((ends + 0.5) / (ends.sum() + 0.5 * k))
    taken = discounts([totals[f"t{i}"] for i in range(1, 5)])
    left = sum(taken[m] * np.array([totals[f"v{m}_{i}"] for i in range(k)], np.float64) for m in (1, 2, 3)) if word_segments else words
    shared = totals.n - (taken[1] * totals.t1 + taken[2] * totals.t2 + taken[3] * (totals.v - totals.t1 - totals.t2))
    # a class without words: pieces alone, at even odds with the end
    bare = words == 0
    ends = np.maximum(ends, 1)
    tokens, left = np.where(bare, 2 * ends, words + ends), np.where(bare, ends, left)
    model = WordModel(word_segments, taken, tokens, left, float(shared))
    end_scores = np.log10(ends / tokens)
    scores = fit_scores(counts, k, vocabulary, by_token=not word_segments)

    frequent = counts.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(head_words).toArrow()
    head_c, head_cs = frequent.column("c").to_numpy(), frequent.column("cs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    head = frequent.column("word").to_pylist()
    head_lm = model.log10(marginals(pieces_of(vocabulary_path(vocabulary)), scores, [w.encode() for w in head]), head_cs)
    least = int(head_c.min()) if len(head) == head_words else 0
    sent = spark.sparkContext.broadcast((head, head_c, head_lm))

    def run(batches):
        import pyarrow as pa

        head, head_c, head_lm = sent.value
        place = {w: i for i, w in enumerate(head)}
        c_of, lm_of = np.append(head_c, 0), np.vstack([head_lm, np.zeros(k)])
        for batch in batches:
            for part in slices(batch, 3):
                n = part.num_rows
                words, of = split_tokens(part.column(3))
                coded = words.dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                at = np.array([place.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)[code] if len(code) else np.zeros(0, np.int64)
                size = np.bincount(of, minlength=n)
                lm = np.stack([np.bincount(of, weights=lm_of[at, i], minlength=n) for i in range(k)], axis=1)
                base = np.bincount(of, weights=np.log10(c_of[at] + 1.0), minlength=n)
                seen = np.bincount(of, weights=at >= 0, minlength=n).astype(np.int64)
                rare, m = np.flatnonzero(at < 0), max(1, len(coded.dictionary))
                pair, times = np.unique(of[rare] * np.int64(m) + code[rare], return_counts=True)
                splits = pa.array(np.searchsorted(pair // m, np.arange(n + 1)), pa.int32())
                tail = coded.dictionary.take(pa.array(pair % m))
                yield pa.record_batch(
                    [*part.columns[:3], pa.array(size + 1, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(lm.ravel(), pa.float64())), pa.ListArray.from_arrays(splits, tail), pa.ListArray.from_arrays(splits, pa.array(times, pa.int64()))],
                    ["row", "id", "learnt", "n_tokens", "seen", "base", "lm", "rare", "times"],
                )

    def rare_scores(batches):
        import pyarrow as pa

        from .bpe_arrays import ChunkCache

        pieces, learnt = pieces_of(vocabulary_path(vocabulary)), sent_scores.value
        known = ChunkCache(lambda words: list(marginals(pieces, learnt, [w.encode("utf-8", "surrogatepass") for w in words])), 100_000)
        for part in gathered(batches):
            if part.num_rows:
                coded = part.column(1).dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                sub = np.array(known.of(coded.dictionary.to_pylist()))[code]
                given = part.column(3)
                cs = np.zeros((part.num_rows, k))
                has = given.is_valid().to_numpy(zero_copy_only=False)
                cs[has] = given.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                times = part.column(2).to_numpy()
                lm = model.log10(sub, cs) * times[:, None]
                base = np.log10(cs.sum(axis=1) + 1.0) * times
                seen = np.where(cs.sum(axis=1) > 0, times, 0)
                # a row's words are together only after the shuffle by row: sums, not words, go there
                yield pa.record_batch([part.column(0), pa.array(base, pa.float64()), pa.array(seen, pa.int64()), *(pa.array(lm[:, i], pa.float64()) for i in range(k))], ["row", "base", "seen", *(f"lm{i}" for i in range(k))])

    sent_scores = spark.sparkContext.broadcast(scores)
    numbered = spread(rows.select("id", "learnt", "text")).select(F.monotonically_increasing_id().alias("row"), "id", "learnt", "text")
    schema = T.StructType([*numbered.schema.fields[:3], *T.StructType.fromDDL("n_tokens long, seen long, base double, lm array<double>, rare array<string>, times array<long>").fields])
    scored = materialize(numbered.mapInArrow(run, schema), "scored")
    words = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    unsent = counts.filter((F.col("c") <= least) | (F.octet_length("word") > HEAD_BYTES)) if least else counts.filter(F.octet_length("word") > HEAD_BYTES)
    met = words.join(unsent.select("word", "cs"), "word", "left").select("row", "word", "times", "cs")
    sums = ["base", "seen", *(f"lm{i}" for i in range(k))]
    more = met.mapInArrow(rare_scores, "row long, base double, seen long, " + ", ".join(f"lm{i} double" for i in range(k))).groupBy("row").agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
    both = scored.drop("rare", "times").join(more, "row", "left")
    added = lambda c, x: x + F.coalesce(F.col(f"more_{c}"), F.lit(0))
    of_class = [added(f"lm{i}", F.col("lm")[i]) + float(end_scores[i] + prior[i]) for i in range(k)]
    both = both.withColumns({"by": F.array(*of_class), "known": added("seen", F.col("seen")), "sum": added("base", F.col("base"))}).withColumn("top", F.array_max("by"))
    down, end = float(np.log10(n_tokens + n_types + 1)), float(np.log10(n_texts + 1))
    return both.select(
        F.col("id").alias(id_col), (~F.col("learnt")).alias("held_out"), "n_tokens",
        (F.col("known") + int(n_texts > 0)).alias("n_known"),
        F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("sum") + end - F.col("n_tokens") * down).alias("base_score"),
        (F.col("top") + F.log10(F.aggregate("by", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - F.col("top"))))).alias("score"),
    )
