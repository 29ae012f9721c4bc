"""The corpus queries with SQL against it, and the contracts of the others on whole tables."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from support import DATA, same_rows
from tidemark.llm.common import read_table
from tidemark.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, ORACLE_SQL[name])


def documents(spark):
    return [(r.doc_id, r.text or "") for r in read_table(spark, DATA, "documents").collect()]


def test_lm_columns_by_brute_force(spark):
    rows, got = documents(spark), {r.doc_id: r for r in QUERIES["op1_lattice_lm"](spark, DATA).collect()}
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        own, r = [*words(t), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0


def test_packing_by_brute_force(spark):
    import numpy as np
    from tokenizers import Tokenizer

    from tidemark.llm.common import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    pieces = QUERIES["op2_best_fit_packing"](spark, DATA).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in documents(spark):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc.pop(i), key=lambda p: p.piece)
        assert [(p.piece, p.start) for p in own] == [(k, 2048 * k) for k in range(-(-len(ids) // 2048))]
        assert all(p.length == len(x := ids[p.start : p.start + 2048]) and p.ids_crc32 == zlib.crc32(x.tobytes()) for p in own)
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(p.length for p in pieces) // 2048) + 1


def test_counts_by_the_library(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.common import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op9_token_counts"](spark, DATA).collect()}
    for i, t in documents(spark):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 512)


def test_near_copies_by_brute_force(spark):
    rows, got = documents(spark), {r.doc_id: r.class_id for r in QUERIES["op8_minhash_near_dedup"](spark, DATA).collect()}
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in rows for w in [t.lower().split()]}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in sets}


def test_toxicity_columns(spark):
    rows = QUERIES["op4_toxicity"](spark, DATA).collect()
    assert len(rows) == len(documents(spark))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_languages_agree_with_clean_evidence(spark):
    rows = QUERIES["op6_language_id"](spark, DATA).collect()
    clear = [r for r in rows if r.text_lang == r.declared == r.suggested]
    assert len(rows) == read_table(spark, DATA, "pages").count() and len(clear) > len(rows) // 2
    assert all(r.lang == r.text_lang for r in clear)


def test_mix_keeps_rows_and_shares(spark):
    from tidemark.llm.mixing import balanced_weights

    docs = read_table(spark, DATA, "documents")
    rows = QUERIES["op10_source_mixing"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert len({r.position for r in rows}) == len(rows)
    weights = balanced_weights({r.source: r["count"] for r in docs.groupBy("source").count().collect()})
    slots = sorted({(r.slot, r.source) for r in rows if r.phase == 0})
    total, seen = sum(weights.values()), Counter()
    for t, (_, s) in enumerate(slots, 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * w / total) < 1 for x, w in weights.items())
    assert all(r.release <= r.slot < r.deadline for r in rows)


def test_pipeline(spark):
    import corpus_pipeline

    docs = read_table(spark, DATA, "documents")
    columns, last = docs.columns, docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        from tidemark.llm.common import materialize

        last = materialize(stage(spark, last, DATA), name)
        kept.append(last.count())
        if name != "best_fit_packing":
            assert last.columns == columns
    toxic = {r.doc_id for r in read_table(spark, DATA, "labels").filter("toxic = 1").collect()}
    assert kept[0] <= docs.count() - 0.5 * len(toxic) and kept[1] <= kept[0] and kept[2] == kept[3] <= kept[1]
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == kept[3]


def test_stages_pack_in_the_order_of_the_mix(spark):
    """Each text nearly fills a sequence, so that a prefix of sequences is one of documents."""
    import corpus_pipeline
    from tidemark.llm.common import materialize
    from tidemark.llm.mixing import balanced_weights

    counts = {"a": 360, "b": 40, "c": 40}
    rows = [(i, "the " * 1_100, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = materialize(stages["source_mixing"](spark, docs, DATA), "mixed")
    pieces = stages["best_fit_packing"](spark, mixed, DATA).orderBy("sequence_id").collect()
    assert len({p.sequence_id for p in pieces}) == len(rows)
    weights, seen = balanced_weights(counts), Counter(rows[p.doc_id][2] for p in pieces[:128])
    # blocks of 16 rows, and less than one block from each share
    assert all(abs(seen[s] - 128 * w / sum(weights.values())) < 16 for s, w in weights.items())
    assert seen["a"] < 128 * counts["a"] / len(rows) - 8


def test_packing_takes_the_order_that_the_stage_before_has_left(spark):
    """Texts that nearly fill a sequence, in files of uneven size: sequences follow the rows as written, and the mix changes them."""
    import corpus_pipeline
    from tidemark.llm.common import materialize

    stages = dict(corpus_pipeline.STAGES)
    rows = [(i, "the " * (1_100 if i % 7 else 1_900), "a" if i < 150 else "b") for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = lambda df: [p.doc_id for p in stages["best_fit_packing"](spark, df, DATA).orderBy("sequence_id").collect()]
    # rows 0 to 99 in one file, the rest in eleven
    part = F.when(F.col("doc_id") < 100, 0).otherwise((F.col("doc_id") - 92).cast("int").bitwiseAND(-8))
    back = docs.repartitionByRange(24, part.desc()).sortWithinPartitions(part.desc(), F.col("doc_id").desc())
    written = materialize(back, "back")
    assert len(written.inputFiles()) > 10
    assert order(written) == order(back) == list(range(180))[::-1]
    mixed = materialize(stages["source_mixing"](spark, written, DATA), "mixed")
    assert order(mixed) == [r.doc_id for r in stages["source_mixing"](spark, written, DATA).collect()]
    assert Counter(rows[i][2] for i in order(mixed)[:64])["b"] >= 16


def test_near_copies_stage_keeps_clean_texts_of_repeated_ids(spark):
    import corpus_pipeline

    words = lambda s, n=60: [f"{s}{i}" for i in range(n)]
    base, near = words("w"), [*words("w")[:-1], "other"]
    rows = [(3, " ".join(base)), (5, " ".join(words("a"))), (5, " ".join(base).upper()), (6, " ".join(words("b"))), (6, " ".join(near)), (7, "alone"), (None, " ".join(base)), (None, "alone")]
    kept = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert kept.columns == ["doc_id", "text"]
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[1], rows[3], *rows[5:]])


def test_each_stage_against_plain_python(spark):
    """Rows that each stage leaves, their order after mixing and all pieces; of toxicity the model's weights are taken as fitted."""
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tidemark.llm import toxicity
    from tidemark.llm.common import materialize, vocabulary_path
    from tidemark.llm.mixing import mix_sources

    docs = read_table(spark, DATA, "documents")
    at, weights, intercept = toxicity.fit_toxicity(docs, read_table(spark, DATA, "labels"), F.lit(True))
    weight, bits = dict(zip(at.tolist(), weights.tolist(), strict=True)), toxicity.FtrlSettings().bits
    logit = lambda t: intercept + sum(weight.get(x, 0.0) for x in toxicity.features(pa.array([t]), bits)[0].tolist())
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DATA)
        out[name] = made.collect()
        docs = materialize(made, name)
        if name == "source_mixing":
            position = {r.doc_id: r.position for r in mix_sources(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in read_table(spark, DATA, "documents").collect()}
    left = {i: t for i, t in texts.items() if 1 / (1 + math.exp(-logit(t))) < toxicity.CUT}
    assert 0 < len(left) < len(texts) and sorted(r.doc_id for r in out["toxicity"]) == sorted(left)
    left = {i: t for t, i in {t: i for i, t in sorted(left.items())}.items()}
    assert sorted(r.doc_id for r in out["exact_dedup"]) == sorted(left)
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in left.items() for w in [t.lower().split()]}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and label[a] != label[b] and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    left = {i: t for i, t in left.items() if label[i] == i}
    assert sorted(r.doc_id for r in out["minhash_near_dedup"]) == sorted(left)
    assert [r.doc_id for r in out["source_mixing"]] == sorted(left, key=position.get)
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    want = set()
    for i, t in left.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, a // 2048, a, len(x := ids[a : a + 2048]), zlib.crc32(x.tobytes())) for a in range(0, len(ids), 2048)}
    packed = out["best_fit_packing"]
    assert len(packed) == len(want) and {(p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in packed} == want
    first = [position[p.doc_id] for p in sorted(packed, key=lambda p: p.sequence_id) if p.offset == 0]
    assert first == sorted(first)


def test_stages_of_odd_rows(spark, odd, empty):
    """All columns of all names come through, null and repeated ids too; empty tables stay empty."""
    import corpus_pipeline

    rows = Counter(map(tuple, odd.collect()))
    kept = {"toxicity": 10, "exact_dedup": 6, "minhash_near_dedup": 7, "source_mixing": 10}
    for name, stage in corpus_pipeline.STAGES:
        made, none = stage(spark, odd, DATA), stage(spark, empty, DATA)
        assert none.count() == 0 and none.columns == made.columns
        if name in kept:
            own = Counter(map(tuple, made.collect()))
            assert made.columns == odd.columns and own <= rows and sum(own.values()) == kept[name]
        else:
            assert {r.doc_id for r in made.collect()} == {1, 2, 3, 4, 5, 7, 8, 9, None}


def test_held_out_labels_are_told_apart(spark):
    """On the real labels of a larger table: rows that were not learnt from."""
    larger = DATA.replace("sf0.001", "sf0.01")
    label = {r.doc_id: r.toxic for r in read_table(spark, larger, "labels").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in QUERIES["op4_toxicity"](spark, larger).collect() if r.held_out and r.doc_id in label]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.9 * len(held)
    assert sum(a and not b for a, b in held) <= 0.02 * len(held)


def test_stages_give_back_what_others_have_used(spark):
    import corpus_pipeline
    from tidemark.llm import common

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame([(i, f"text {i % 7}", "s") for i in range(30)], "doc_id long, text string, source string")
    mark = common.written(spark)
    assert stages["exact_dedup"](spark, docs, DATA).count() == 7
    left = common.written_since(spark, mark)
    own = common.materialize(docs, "of-the-caller")
    assert left and stages["source_mixing"](spark, own, DATA).count() == 30
    now = common.written_since(spark, 0)
    assert not set(left) & set(now) and own.count() == 30


def test_marks_hold_when_older_tables_go(spark):
    from tidemark.llm import common

    common.materialize(spark.range(2), "old")
    old, mark = common.written_since(spark, 0)[-1:], common.written(spark)
    common.remove(spark, old)
    common.materialize(spark.range(3), "new")
    assert len(common.written_since(spark, mark)) == 1
    common.discard(spark, mark)
    assert common.written_since(spark, mark) == []


def test_own_tables_are_removed(spark):
    from tidemark.llm import common

    mark = common.written(spark)
    first, last = common.materialize(spark.range(3), "a"), common.materialize(spark.range(4), "b")
    common.discard(spark, mark, keep=1)
    assert last.count() == 4 and common.written(spark) == mark + 1
    import pytest

    with pytest.raises(Exception, match="(?i)not.*exist|no such file"):
        first.collect()
