"""Operators on odd rows and small brute-force cases."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat_format, dart_minhash, exact_dedup, language_id, lattice_lm, mixing, packing, token_counts, top_k, toxicity
from tidemark.llm.bpe_arrays import ByteBpe, WordBpe
from tidemark.llm.common import vocabulary_path


def test_exact_dedup_of_odd_rows(odd, empty):
    rows = exact_dedup.exact_dedup(odd, capacity=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].kept and not by[1][0].kept and not by[None][0].kept and by[1][0].group_size == 3 and by[1][0].keep_id == 2
    assert by[4][0].kept and not by[3][0].kept
    assert sorted(r.kept for r in by[9]) == [False, True] and by[9][0].group_size == 2
    assert len(rows) == 10 and exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 4, 5, 7, 8, 9], key=str)


def test_directory_splits_only_overfull_buckets(spark):
    """Keys that share their leading bits make the directory double; a chain of one key is not split."""
    keys = [1 << 62 | i << 40 for i in range(8)] + [i << 60 for i in range(-8, 0)] + [5] * 9
    entries = spark.createDataFrame([(k, f"{i:02}") for i, k in enumerate(keys)], "h long, sha string")
    index, cells, depth = exact_dedup.build_index(entries, 4)
    rows = index.collect()
    by = {}
    for r in rows:
        by.setdefault(r.bucket, []).append(r)
    assert sorted(r.h for r in rows) == sorted(keys)
    assert all(len(x) <= 4 or len({r.h for r in x}) == 1 for x in by.values())
    assert sorted(r.link for r in rows if r.h == 5) == list(range(1, 10))
    unsigned = lambda h: h % (1 << 64)
    found = {r.cell: (r.bucket, r.local_depth) for r in cells.collect()}
    assert all(found[unsigned(r.h) >> (64 - depth)][0] == r.bucket for r in rows)
    assert depth > max(d for _, d in found.values()) - 1 and len({d for _, d in found.values()}) > 1
    assert all(unsigned(r.h) >> (64 - found[unsigned(r.h) >> (64 - depth)][1]) == unsigned(r.bucket) >> (64 - found[unsigned(r.h) >> (64 - depth)][1]) for r in rows)


def test_colliding_keys_stay_apart(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(*c) * 0)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(rows, capacity=1).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1)}


def test_copies_of_one_text_and_no_id(spark):
    """A hot text is dealt over pages; of its rows without an id one stays."""
    rows = spark.createDataFrame([(None, "same") for _ in range(3_000)] + [(i, f"own {i}") for i in range(3_000)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(rows).filter("doc_id IS NULL").groupBy("kept", "keep_id", "group_size").count().collect()
    assert sorted(map(tuple, got)) == [(False, None, 3_000, 2_999), (True, None, 3_000, 1)]
    assert exact_dedup.drop_copies(rows).count() == 3_001


def test_paged_join_deals_hot_keys(spark):
    from tidemark.llm.common import PAGES, paged_join

    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    entries = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    joined = paged_join(rows, entries, ["k"], "n", 20_000, F.col("id"))
    assert joined.columns == ["k", "id", "n", "v"] and joined.filter("v = 2 * k").count() == 20_000 and joined.select("id").distinct().count() == 20_000
    assert entries.filter(F.col("n") * PAGES > 20_000).count() == 1
    few = rows.limit(30)
    assert paged_join(few, few.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", 30, F.col("id")).count() == 30


def test_mixing_of_odd_rows(odd, empty):
    rows = mixing.mix_sources(odd, block_rows=2).collect()
    assert len(rows) == 10 and len({r.position for r in rows}) == 10 and "" in {r.source for r in rows}
    assert mixing.mix_sources(empty).count() == 0
    few = mixing.mix_sources(odd, block_rows=2, max_sources=2).collect()
    assert len(few) == 10 and len({r.position for r in few}) == 10 and {r.source for r in few} == {r.source for r in rows}
    ordered = mixing.mixed_order(odd)
    assert ordered.columns == odd.columns and Counter(map(tuple, ordered.collect())) == Counter(map(tuple, odd.collect()))
    assert mixing.mixed_order(empty).columns == odd.columns and mixing.mixed_order(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(odd, {"a": 0})


def test_mixing_of_many_rows_without_an_id(spark):
    rows = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("source"))
    got = mixing.mix_sources(rows.unionAll(rows.filter("doc_id = 2").withColumn("doc_id", F.lit(2).cast("long"))), {"a": 2, "b": 2}).collect()
    assert len(got) == 4_001 and len({r.position for r in got}) == 4_001
    slots = sorted({(r.slot, r.source) for r in got if r.phase == 0})
    assert [s for _, s in slots[:6]] in (["a", "b"] * 3, ["b", "a"] * 3)  # 2 to 2 is 1 to 1


def test_weights_are_reduced():
    assert mixing.reduced({"a": 30, "b": 20}) == {"a": 3, "b": 2} and mixing.reduced({}) == {}
    large = mixing.reduced({"a": 10**12, "b": 3 * 10**12 + 1, "c": 1})
    assert sum(large.values()) <= mixing.FRAME_SLOTS // 3 + 1 and large["c"] == 1 and abs(large["b"] / large["a"] - 3) < 1e-4


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.tuples(st.integers(1, 40), st.integers(1, 60)), min_size=1))
def test_frames_keep_deadlines_and_lag(spec):
    weights, blocks = {s: w for s, (w, _) in spec.items()}, {s: n for s, (_, n) in spec.items()}
    order = {}
    for p in mixing.phases(weights, blocks):
        for j in range(p["first"], p["end"]):
            i = j - p["first"]
            slot = p["base"] + i // p["parts"] * p["total"] + p["slots"][i % p["parts"]]
            assert slot not in order
            assert p["base"] + i * p["total"] // p["parts"] <= slot < p["base"] - (-(i + 1) * p["total"] // p["parts"])
            order[slot] = (p["source"], p["phase"])
    assert sorted(order) == list(range(sum(blocks.values())))
    first = [s for t, (s, phase) in sorted(order.items()) if phase == 0]
    total, seen = sum(weights.values()), Counter()
    for t, s in enumerate(first, 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * w / total) < 1 for x, w in weights.items())


def test_tokens_of_odd_rows(odd, empty):
    got = {r.doc_id: r for r in token_counts.count_tokens(odd).collect()}
    assert got[3].n_tokens == 0 and got[4].n_tokens == 0 and token_counts.count_tokens(empty).count() == 0
    pieces = packing.pack_documents(odd, partition_pieces=3).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 3, 4, 5, 7, 8, 9, None} and packing.pack_documents(empty).count() == 0
    room = Counter()
    for p in pieces:
        room[p.sequence_id] += p.length
    assert max(room.values()) <= 2048 and [p.length for p in pieces if p.doc_id == 3] == [1]


def check_packed(pieces, capacity):
    """Sequences are filled from offset 0 without gaps and hold no more than ``capacity``."""
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for own in by.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(p.length for p in own) <= capacity
    return by


def test_sequences_follow_the_mix(spark):
    rng = np.random.default_rng(8)
    counts = {"a": 2_400, "b": 300, "c": 300}
    rows = [(i, "w " * int(rng.integers(1, 30)), s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack_mixed(docs, {"a": 1, "b": 1, "c": 2}, capacity=40, partition_pieces=128).collect()
    by = check_packed(pieces, 40)
    assert {p.doc_id for p in pieces} == set(range(3_000)) and len(pieces) == 3_000
    assert len(by) <= 1.03 * sum(p.length for p in pieces) / 40
    source, seen, n = {i: s for i, _, s in rows}, Counter(), 0
    for q in sorted(by):
        seen.update(source[p.doc_id] for p in by[q])
        n += len(by[q])
        if n >= 300:
            break
    for s, w in {"a": 0.25, "b": 0.25, "c": 0.5}.items():
        assert abs(seen[s] / n - w) < 0.08


def test_mixed_packing_of_odd_rows(odd, empty):
    pieces = packing.pack_mixed(odd, partition_pieces=3).collect()
    plain = packing.pack_documents(odd).collect()
    what = lambda rows: sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in rows)
    assert what(pieces) == what(plain) and pieces[0].__fields__ == plain[0].__fields__
    check_packed(pieces, 2_048)
    assert packing.pack_mixed(empty).count() == 0


texts = st.text(alphabet=st.sampled_from("ab 'sΣéİ\n\t\x1c<|endoftxsr>１日😀.,!"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(texts, st.text(max_size=40)), min_size=1, max_size=5))
def test_merging_gives_what_the_library_gives(batch):
    from tokenizers import Tokenizer

    batch = [t.encode("utf-8", "replace").decode() for t in batch] + ["aaaaaaa <|endoftext|>  x"]
    for name, own in (("byte_bpe_50k.json", _byte()), ("word_bpe_49k.json", _word())):
        library = _library(name, Tokenizer)
        want = [library.encode(t, add_special_tokens=False).ids for t in batch]
        if isinstance(own, ByteBpe):
            assert own.count(batch) == list(map(len, want))
        else:
            assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(batch)] == want


_made = {}


def _byte():
    return _made.setdefault("byte", None) or _made.update(byte=ByteBpe(vocabulary_path("byte_bpe_50k.json"))) or _made["byte"]


def _word():
    return _made.setdefault("word", None) or _made.update(word=WordBpe(vocabulary_path("word_bpe_49k.json"))) or _made["word"]


def _library(name, kind):
    return _made.setdefault(name, None) or _made.update({name: kind.from_file(vocabulary_path(name))}) or _made[name]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_packing_and_its_bounds(lengths):
    x = np.array(lengths)
    bins, offsets, left = packing.best_fit_decreasing(x, 20)
    for b in range(len(left)):
        own = sorted(zip(offsets[bins == b], x[bins == b], strict=True))
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) + left[b] == 20
    counts = np.bincount(x, minlength=21)
    assert all(v <= len(left) + 1e-9 for v in packing.dual_feasible_sums(counts, 20).values())


def fewest(lengths, capacity):
    """The fewest bins, by trying all ways."""

    def fill(rest, rooms, most):
        if not rest:
            return len(rooms)
        if len(rooms) > most:
            return most + 1
        n, more = rest[0], rest[1:]
        for r in set(rooms):
            if r >= n:
                i = rooms.index(r)
                most = min(most, fill(more, [*rooms[:i], r - n, *rooms[i + 1 :]], most))
        return min(most, fill(more, [*rooms, capacity - n], most)) if len(rooms) < most else most

    return fill(sorted(lengths, reverse=True), [], len(lengths))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bounds_never_pass_the_fewest(lengths):
    assert packing.lower_bound(np.bincount(lengths, minlength=21), 20) <= fewest(lengths, 20) <= len(packing.best_fit_decreasing(np.array(lengths), 20)[2])


def test_bounds_are_sharp_where_halves_do_not_fit():
    assert packing.lower_bound(np.bincount([11] * 6, minlength=21), 20) == 6


def pieces_of_lengths(spark, lengths):
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long")


def test_certificates_are_true(spark):
    """Whatever the partitions are, ``certified`` holds only where no packing of all pieces is smaller."""
    rng = np.random.default_rng(2)
    for lengths in ([9, 9, 2, 11, 11, 11], [20, 20, 1], [11, 9, 10, 10, 5, 5, 5, 5], list(rng.integers(1, 21, 9)), list(rng.integers(3, 12, 9))):
        for partition_pieces in (2, 3, 100):
            rows = packing.pack_pieces(pieces_of_lengths(spark, [int(x) for x in lengths]), 20, partition_pieces).collect()
            used = len(check_packed(rows, 20))
            assert sorted(r.length for r in rows) == sorted(lengths)
            assert {r.certified for r in rows} == {used <= packing.lower_bound(np.bincount(lengths, minlength=21), 20)}
            assert not rows[0].certified or used == fewest([int(x) for x in lengths], 20)


def test_exchanges_save_what_partitions_leave(spark):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(1, 400, 3_000)]
    run = lambda **k: packing.pack_pieces(pieces_of_lengths(spark, lengths), 1_000, 200, **k).collect()
    best, plain, least = run(), run(rounds=0), -(-sum(lengths) // 1_000)
    assert least <= len(check_packed(best, 1_000)) <= least + 1 < len(check_packed(plain, 1_000))
    assert best[0].certified == (len(check_packed(best, 1_000)) == least) and not plain[0].certified and all(r.partition_certified for r in plain)


control = st.lists(st.sampled_from([*chat_format.CONTROLS, "\\", "<", "[", "|", "a", "\n", "<\\|turn|>", "%0A", "é"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), control), control), max_size=5))
def test_chats_round_trip(turns):
    text, spans = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for c in chat_format.CONTROLS[2:]:
        assert c not in text


def test_layouts(spark):
    import json

    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "x", "output": "o", "extra": {"a": [1]}}, {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"question": "q", "answer": "a"}, {"odd": 1}, [1], {"messages": []},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, None), (99, "{bad")], "id long, record string")
    got = {r.id: r for r in chat_format.format_chats(df, "id", "record").collect()}
    turns = {i: chat_format.parse(r.formatted) for i, r in got.items() if r.formatted is not None}
    assert turns == {0: [("user", "p"), ("assistant", "r")], 1: [("user", "i\n\nx"), ("assistant", "o")], 2: [("user", "u"), ("assistant", "")], 3: [("user", "h"), ("assistant", "g")], 4: [("user", "q"), ("assistant", "a")], 7: []}
    assert [got[i].layout for i in (5, 6, 98, 99)] == ["unknown"] * 4 and got[0].fingerprint != got[1].fingerprint
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, None, "x"), (None, None, "user", "y"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(chat_format.records_of_turns(rows), "conv_id", "record"), "conv_id").collect()}
    assert back[1].n_turns == 4 and back[None].n_turns == 1 and back[1].loss_chars == 0
    assert chat_format.format_chats(chat_format.records_of_turns(rows.limit(0)), "conv_id", "record").count() == 0


def test_conversations_in_several_layouts(spark):
    rows = [(i, t, r, f"{r} {t} of {i}") for i in range(40) for t, r in enumerate(["user", "assistant"] if i % 2 else ["system", "user", "assistant", "user", "human"][: 2 + i % 4])]
    rows += [(50, 0, "user", "x" * 300_000), (51, 0, "human", "h"), (51, 1, "gpt", None), (None, None, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("id", "t", "item", "record", "formatted", "a.b")})
    chats = chat_format.format_chats(chat_format.records_in_layouts(turns), "conv_id", "record").collect()
    assert {r.layout for r in chats} == {"turns", "messages", "shared", "prompt"} and all(r.unread == [] for r in chats)
    got = {r.conv_id: chat_format.parse(r.formatted) for r in chats}
    want = {}
    for i, _, r, t in rows:
        want.setdefault(i, []).append((r, t or ""))
    assert got == want


def test_fields_beside_the_turns():
    read = lambda r: chat_format.canonical_turns(r, chat_format.Layouts().of(r)[1])
    assert read({"system": "s", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, "b"]}, {"role": "assistant", "content": "c"}]}) == [("system", "s"), ("user", "ab"), ("assistant", "c")]
    assert read({"instruction": "i", "output": "o", "history": [["p", "q"]], "system": "s"}) == [("system", "s"), ("user", "p"), ("assistant", "q"), ("user", "i"), ("assistant", "o")]
    tie = {"prompt": "p", "response": "r", "question": "q", "answer": "a"}
    assert chat_format.Layouts().of(tie)[1]["layout"] == "prompt" and set(tie) - chat_format.read_fields(chat_format.Layouts().of(tie)[1]) == {"question", "answer"}


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6) * rng.choice([0.1, 1, 5])]) for i in range(300)]
    rows += [(300, None), (301, [float("nan")] * 6), (302, [1.0, None]), (303, rows[0][1]), (None, rows[0][1]), (304, [1.0, 2.0]), (305, []), (50, rows[50][1])]
    got = top_k.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, k=4, block_bytes=150).collect()
    good = [(i, np.floor(256 * np.pad(np.array(v), (0, 6 - len(v))))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:4]
            want.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    assert Counter(map(tuple, got)) == want
    assert top_k.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).count() == 0
    few = top_k.exact_top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 256 * 512)]


def test_top_k_with_one_very_long_vector(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 700 if i == 7 else 3)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("id", "v", "norm", "q", "uid", "a.b")})
    got = Counter(map(tuple, top_k.exact_top_k(docs, F.col("id") % 7 == 0).collect()))
    wide = np.array([np.floor(256 * np.pad(np.array(v), (0, 700 - len(v)))) for _, v in rows])
    want = Counter()
    for q in range(0, 60, 7):
        best = sorted((-int(wide[q] @ w), i) for i, w in enumerate(wide) if i != q)[:5]
        want.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    assert got == want


def test_top_k_where_tasks_read_short_vectors_first(spark):
    """More files than cores; long vectors have few distinct values, so that their files are the smallest and are read last."""
    rng = np.random.default_rng(4)
    short, long_ = rng.uniform(-1, 1, (20_000, 4)), rng.choice([-40.0, 40.0], (4_000, 4))
    vectors = np.concatenate([short, long_])
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, x in conf.items():
            spark.conf.set(c, x)
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
        got = Counter(map(tuple, top_k.exact_top_k(rows, F.col("id") % 200 == 0).collect()))
    finally:
        for c, x in before.items():
            spark.conf.set(c, x)
    ints, want = np.floor(256 * vectors), Counter()
    for q in range(0, len(ints), 200):
        scores = ints @ ints[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(ints)), -scores))[:5]
        want.update((q, n, int(i), int(scores[i])) for n, i in enumerate(best, 1))
    assert got == want


def test_scan_takes_tiles_in_any_order():
    rng = np.random.default_rng(6)
    q, tiles = rng.integers(-9, 9, (20, 4)).astype(float), [(np.arange(100) + 100 * n, rng.integers(-9, 9, (100, 4)) * float(size)) for n, size in enumerate((50, 1, 80, 100))]
    found = top_k.scan(tiles, np.arange(1_000, 1_020), q, np.eye(4), np.full(20, -np.inf), 3, 1)
    scores = q @ np.concatenate([v for _, v in tiles]).T
    assert np.array_equal(found.score.reshape(20, 3), -np.sort(-scores, axis=1)[:, :3])


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 200).astype(np.uint64)
    a, b = rng.integers(1, 9, 200).astype(float), rng.integers(1, 9, 200).astype(float)
    a[:40], b[160:] = 0, 0
    x = np.concatenate([h[a > 0], h[b > 0]])
    of = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    s = dart_minhash.signatures(x, of, np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.03 and (s != 0).all()


def test_near_duplicates_of_odd_rows(odd, empty):
    got = {}
    for r in dart_minhash.near_duplicates(odd).collect():
        got.setdefault(r.doc_id, []).append((r.class_id, r.kept))
    assert got[1] == [(1, True)] and got[2] == [(1, False)] and got[3] == [(3, True)] and got[4] == [(3, False)]
    assert got[None] == [(None, True)] and got[9] == [(9, True)] * 2 and got[7] == [(7, True)] and len(got) == 9
    assert dart_minhash.near_duplicates(empty).count() == 0


def test_chains_of_near_copies_join(spark):
    """Each text is like the next one only: outsiders of a bucket are compared too."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        words = list(base)
        words[: 2 * i] = [f"n{j}" for j in range(2 * i)]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{i}-{j}" for j in range(60))) for i in range(20)]
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(40)} == {0} and all(got[100 + i] == 100 + i for i in range(20))


def test_long_chains_and_stars_join_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = dart_minhash.materialize
    monkeypatch.setattr(dart_minhash, "materialize", lambda df, name: rounds.append(name) or real(df, name))
    chain = [(i, i + 1) for i in range(200)]
    star = [(1_000, 1_000 + i) for i in range(1, 300)]
    got = {r.node: r.label for r in dart_minhash.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1_000 + i: 1_000 for i in range(300)}
    assert rounds.count("grandparents") <= 9


def test_few_edges_are_closed_in_one_task(spark, monkeypatch):
    """Whatever number of rounds goes before; before, a single edge took a round of four tables and three more."""
    written, real = [], dart_minhash.materialize
    monkeypatch.setattr(dart_minhash, "materialize", lambda df, name: written.append(name) or real(df, name))
    rng = np.random.default_rng(3)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 400, (300, 2))] + [(f"z{i}", f"z{i + 1}") for i in range(150)]
    label = {x: x for e in pairs for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    edges = spark.createDataFrame(pairs, "a string, b string")
    for last in (8_192, 100, 0):
        monkeypatch.setattr(dart_minhash, "LAST_EDGES", last)
        written.clear()
        assert {r.node: r.label for r in dart_minhash.components(edges).collect()} == label
        assert last < 8_192 or written == ["edges", "parents"]
    assert dart_minhash.components(edges.limit(0)).count() == 0


def test_more_links_merge_components(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, label long")
    got = {r.node: r.label for r in dart_minhash.merge_components(labels, spark.createDataFrame([(2, 4), (7, 9), (1, 2)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 9: 7}


def test_groups_just_below_the_threshold_are_split_over_tasks(spark, monkeypatch):
    """Texts that all share buckets and are not similar enough: all pairs are compared, none in a task of more than two fragments; two similar ones among them are found."""
    sizes = []
    real = dart_minhash.compare_tasks

    def spy(rows, *a):
        sizes.append(max((r["count"] for r in rows.groupBy("task").count().collect()), default=0))
        return real(rows, *a)

    monkeypatch.setattr(dart_minhash, "compare_tasks", spy)
    monkeypatch.setattr(dart_minhash, "FRAGMENT", 10)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(base + [f"t{i}_{j}" for j in range(17)])) for i in range(120)]
    rows[77] = (77, rows[33][1].replace("t33_16", "other"))
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 33 if i == 77 else i for i in range(120)}
    assert len(sizes) == 3 and max(sizes) <= 40


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (5, 5), (20, 4)]
    got = {r.node: r.label for r in dart_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 10: 10, 11: 10, 12: 10}


def test_ftrl(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(vocabulary, rng.integers(5, 80)))
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                words.insert(int(rng.integers(0, len(words))), rng.choice(["vilest", "nasty"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(None, None), (1000, ""), (1001, "vilest " * 5_000)]
    labels += [(None, 1, 1), (1002, None, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, known, toxicity.FtrlSettings(l1=1.0)).collect()}
    held = [i for i in range(900) if got[i].held_out]
    right = np.mean([got[i].predicted == (i % 5 == 0) for i in held])
    assert len(held) > 200 and right > 0.95 and got[1001].predicted == 1 and got[1000].predicted == 0 and len(got) == 903
    assert toxicity.toxicity_scores(docs.limit(0), known.limit(0)).count() == 0
    at, weights, _ = toxicity.fit_toxicity(docs, known, F.lit(True))
    assert 0 < len(at) < 2_000 and (weights != 0).all()


def test_lattice_by_enumeration():
    pieces = lattice_lm.pieces_of(vocabulary_path("word_bpe_49k.json"))
    scores = pieces.first_scores()[:, None]
    import json

    with open(vocabulary_path("word_bpe_49k.json")) as f:
        vocab = json.load(f)["model"]["vocab"]

    def total(word):
        if not word:
            return 0.0
        out = math.exp(scores[vocab[word + "</w>"], 0]) if word + "</w>" in vocab else 0.0
        for k in range(1, len(word)):
            if word[:k] in vocab:
                out += math.exp(scores[vocab[word[:k]], 0]) * total(word[k:])
        return out

    words = ["the", "banana", "x", "zqzqz", "thandble"]
    got = lattice_lm.marginals(pieces, scores, [w.encode() for w in words])[:, 0]
    assert np.allclose(got, [math.log(total(w)) for w in words])
    found = lattice_lm.expected_counts(pieces, scores, [b"the"], np.array([[2.0]]))
    assert abs(sum(found[i, 0] for p, i in vocab.items() if p.endswith("</w>")) - 2.0) < 1e-9


@pytest.mark.parametrize("segments", [True, False])
def test_lm_scores_against_plain_python(spark, monkeypatch, segments):
    """Whole tables: segmentations enumerated, counts in dictionaries, words in the head and beyond it; pieces' scores as fitted."""
    import json

    rng = np.random.default_rng(5)
    pool = {"en": "the cat sat on mat banana thandble with by", "de": "der die das und banana stein enschsch"}
    rows = [(i, " ".join(rng.choice(pool[k].split(), rng.integers(0, 12), p=None)), k) for i, k in enumerate(["en", "de", "en"] * 8)]
    rows += [(90, "the unseen zqzqz cat", "en"), (91, None, "de"), (92, "y" * 90, "en")]
    fitted = []
    real = lattice_lm.fit_scores
    monkeypatch.setattr(lattice_lm, "fit_scores", lambda *a, **k: fitted.append(real(*a, **k)) or fitted[-1])
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in lattice_lm.score_texts(frame, F.col("id") < 20, head_words=4, word_segments=segments).collect()}
    with open(vocabulary_path("word_bpe_49k.json")) as f:
        vocab = json.load(f)["model"]["vocab"]
    learnt = [(t.split(), k) for i, t, k in rows if i < 20]
    names = sorted({k for _, k in learnt}, key=lambda k: (-sum(x == k for _, x in learnt), k))
    counts = [Counter(w for t, x in learnt if x == k for w in t) for k in names]
    every = sum(counts, Counter())
    ends = [sum(x == k for _, x in learnt) for k in names]
    d = lattice_lm.discounts([sum(c == m for c in every.values()) for m in range(1, 5)])
    less = lambda c: c - d[min(c, 3)]

    def pieces(word, k):
        out = math.exp(fitted[0][vocab[word + "</w>"], k]) if word + "</w>" in vocab else 0.0
        return out + sum(math.exp(fitted[0][vocab[word[:n]], k]) * pieces_known(word[n:], k) for n in range(1, len(word)) if word[:n] in vocab)

    known = {}

    def pieces_known(word, k):
        if (word, k) not in known:
            known[word, k] = pieces(word, k)
        return known[word, k]

    def p_word(w, k):
        n, left = sum(counts[k].values()) + ends[k], sum(float(d[min(c, 3)]) for c in counts[k].values())
        if not segments:
            return sum(counts[k].values()) / n * pieces_known(w, k)
        shared = less(every[w]) / sum(less(c) for c in every.values()) if every[w] else 0.0
        own = less(counts[k][w]) if counts[k][w] else 0.0
        return own / n + left / n * (lattice_lm.SHARED * shared + (1 - lattice_lm.SHARED) * pieces_known(w, k))

    for i, t, _ in rows:
        total = 0.0
        for k in range(len(names)):
            n = sum(counts[k].values()) + ends[k]
            total += (ends[k] + 0.5) / (sum(ends) + 0.5 * len(names)) * ends[k] / n * math.prod(p_word(w, k) for w in (t or "").split())
        assert math.isclose(got[i], math.log10(total), rel_tol=1e-7), i


def test_lm_of_odd_rows(odd, empty, spark):
    got = lattice_lm.score_texts(odd, F.col("id") != 5, head_words=3).collect()
    assert len(got) == 10 and all(r.score < 0 and math.isfinite(r.score) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3].n_tokens == 1 and by[5].held_out and by[None].held_out and by[5].n_known == 1
    assert lattice_lm.score_texts(empty, F.lit(True)).count() == 0
    none = lattice_lm.score_texts(odd, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_languages(spark, empty, odd):
    docs = spark.createDataFrame([(i, "the house and the garden with that" if i % 2 else "das Haus und der Garten mit dem", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    pages = [(i, "http://a.example.com/x", "<html lang='de'><p>das Haus mit dem Garten</p>") for i in range(12)]
    pages += [(20, "http://a.example.com/y", None), (21, None, None), (22, "http://[bad", "<p>the garden with that house</p>"), (23, "http://b.example.org/en/", "<html lang=xx></html>"), (23, "http://b.example.org/en/", "<html lang=xx></html>"), (None, "", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("zz"))
    got = {r.page_id: r for r in language_id.identify_languages(frame, docs).collect()}
    assert got[0].lang == "de" and got[20].lang == "de" and got[22].lang == "en" and got[23].declared == "other" and len(got) == 17
    assert language_id.identify_languages(frame, docs).count() == len(pages)
    assert language_id.identify_languages(frame.limit(0), docs).count() == 0
    assert {r.lang for r in language_id.identify_languages(frame, docs.limit(0)).collect()} == {None}


WORDS = {"en": "the house and garden with that this from they were", "de": "das haus und der garten mit dem nicht eine von", "fr": "la maison et le jardin avec cette pour dans une"}


def test_languages_against_plain_python(spark):
    """All posteriors, from the same text model, by counting in dictionaries; and the planted languages are found."""
    rng = np.random.default_rng(4)
    text = lambda k, n: " ".join(rng.choice(WORDS[k].split(), n))
    docs = spark.createDataFrame([(i, text(k, 30), k) for i, k in enumerate(["en", "de", "fr"] * 12)], "doc_id long, text string, lang string")
    pages, truth = [], {}
    for i in range(90):
        k = ["en", "de", "fr"][i % 3]
        host = {"en": "a.example.co.uk", "de": "b.example.at", "fr": "c.example.com"}[k] if i % 4 else "d.example.com"
        path = f"/{k}/x" if i % 5 == 0 else "/x"
        lang = f' lang="{k}-XX"' if i % 7 else ""
        pages.append((i, f"http://{host}{path}", f"<html{lang}><head><script>var das = 1;</script><title>nicht</title></head><body><p>{text(k, 3 + i % 9)}</p>&amp;&eacute;</body></html>"))
        truth[i] = k
    settings_ = language_id.LanguageSettings()
    got = {r.page_id: r for r in language_id.identify_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert np.mean([got[i].lang == k for i, k in truth.items()]) >= 0.97
    langs, model = language_id.fit_text_model(docs, settings_, "doc_id", "text", "lang")
    assert langs == ["de", "en", "fr"]
    ll, soft, levels, declared, named = [], [], [], [], []
    for _, url, page in pages:
        body = page[page.index("<p>") + 3 : page.index("</p>")] + " &é"
        code, _ = language_id.gram_codes(pa.array([body]), settings_.bits)
        x = model[:, code].sum(axis=1) * min(len(code), settings_.text_grams) / len(code)
        ll.append(x)
        soft.append(np.exp(x - x.max()) / np.exp(x - x.max()).sum())
        host = url.split("/")[2]
        domain = ".".join(host.split(".")[-3:] if host.endswith(".co.uk") else host.split(".")[-2:])
        levels.append((host, domain, host.split(".")[-1]))
        named.append(next((k for k in langs if f"/{k}/" in url), ""))
        declared.append(page[12:14] if page.startswith("<html lang") else "")
    soft, a, k0 = np.array(soft), settings_.smoothing, settings_.strength
    world = (soft.sum(axis=0) + 1) / (len(pages) + 3)

    def table(values, known):
        return {v: np.log((sum((s for s, x in zip(soft, values) if x == v), np.zeros(3)) + a) / (soft.sum(axis=0) + a * len(known))) for v in known}

    by_declared, by_named = table(declared, {"", "other", *langs}), table(named, {"", *langs})
    for n, (i, _, _) in enumerate(pages):
        prior = world
        for level in (2, 1, 0):
            same = [m for m in range(len(pages)) if levels[m][level] == levels[n][level]]
            prior = (soft[same].sum(axis=0) - soft[n] + k0 * prior) / (len(same) - 1 + k0)
        total = ll[n] + np.log(prior) + by_declared[declared[n]] + by_named[named[n]]
        p = np.exp(total - total.max())
        p /= p.sum()
        assert got[i].lang == langs[int(total.argmax())] and got[i].host == levels[n][0]
        assert abs(got[i].probability - p.max()) < 1e-9


def test_languages_beyond_the_most_are_one(spark):
    rows = [(i, "abc def ghi", "aa") for i in range(5)] + [(10 + i, "xyz uvw rst", "bb") for i in range(3)] + [(20, "mno pqr jkl", "cc"), (21, "mno pqr stu", "dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    long_page = "<p>" + "mno pqr " * 60_000 + "</p>"
    pages = spark.createDataFrame([(1, "http://h/", "<p>abc def</p>"), (2, None, long_page)], "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("id", "text", "uid", "host", "a.b")})
    got = {r.page_id: r.lang for r in language_id.identify_languages(pages, docs, language_id.LanguageSettings(max_languages=2)).collect()}
    assert got == {1: "aa", 2: "other"}


def test_ftrl_against_a_plain_loop():
    """Each coordinate by itself, in plain Python, in the same order of rows."""
    rng = np.random.default_rng(0)
    s = toxicity.FtrlSettings(bits=5, epochs=3, alpha=0.7, beta=0.5, l1=0.3, l2=0.1)
    rows = [np.sort(rng.choice(32, rng.integers(0, 9), replace=False)) for _ in range(40)]
    labels = rng.integers(0, 2, 40).astype(float)
    z, n, order = [0.0] * 33, [0.0] * 33, np.random.default_rng(7)

    def weight(i):
        l1 = 0.0 if i == 32 else s.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for r in order.permutation(len(rows)):
            own = [*rows[r].tolist(), 32]
            w = {i: weight(i) for i in own}
            gap = 1 / (1 + math.exp(-sum(w.values()))) - labels[r]
            for i in own:
                z[i] += gap - (math.sqrt(n[i] + gap * gap) - math.sqrt(n[i])) / s.alpha * w[i]
                n[i] += gap * gap
    got, intercept = toxicity.fit_ftrl(rows, labels, s)
    assert np.allclose(got, [weight(i) for i in range(32)]) and math.isclose(intercept, weight(32)) and (got == 0).any()


def test_labels_both_ways_are_not_learnt_from(spark, odd, empty):
    docs = spark.createDataFrame([(i, "bad" if i % 2 else "good") for i in range(60)], "doc_id long, text string")
    labels = [(i, 1, i % 2) for i in range(60)]
    clean, mixed = (toxicity.fit_toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), F.lit(True), toxicity.FtrlSettings(l1=0.1)) for x in (labels[2:], labels + [(0, 1, 1), (1, 1, 0), (4, 1, 0)]))
    assert np.array_equal(clean[0], mixed[0]) and np.array_equal(clean[1], mixed[1])
    scored = toxicity.score_toxicity(odd, clean)
    assert scored.columns == ["doc_id", "score", "predicted"] and scored.count() == 10
    kept = toxicity.drop_rejected(odd, clean)
    assert kept.columns == odd.columns and {r.score for r in kept.collect()} == {0} and toxicity.drop_rejected(empty, clean).count() == 0


def test_hash_is_stable():
    from tidemark.llm.words import hash_words

    (h,) = hash_words(pa.array(["a", "b", "a"]))
    assert h[0] == h[2] != h[1]
