"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence are combined in log space: the likelihood of the visible text under
character models of each language; the language that the markup declares; the language that the
address names (path segment or subdomain); and a prior for the host. Every model but the text's is
counted over all pages by grouped aggregation, with the text's posterior as soft labels: what is
declared and named in pages of each language, and how languages are spread over all pages, over an
address suffix, over a domain and over a host, each level smoothed by the one above. So what a
suffix says of the language is learnt, whatever its letters are.
"""

from __future__ import annotations

import html
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialize, paged_join, slices, spread, text_of


@dataclass(frozen=True)
class LanguageSettings:
    """``sample_docs``: labelled documents of each language that the text model is fitted on, at most. ``max_languages``: the rarest beyond that are one, ``other``.

    ``strength``: pages that each level of the host prior counts for. ``text_grams``: character
    grams that the text's likelihood counts for, at most, as grams of one text are not independent.
    """

    sample_docs: int = 1_000
    max_languages: int = 64
    bits: int = 16
    strength: float = 4.0
    smoothing: float = 0.5
    text_grams: float = 60.0


#: Markup that is not visible text, and then all tags.
HIDDEN = r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>"
TAGS = r"(?s)<[^>]*>"
#: Where markup declares its language, by precedence.
DECLARED = (
    r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})",
    r"(?is)<meta[^>]*?\bcontent-language\b[^>]*?\bcontent\s*=\s*[\"']?([a-z]{2,3})",
    r"(?is)<meta[^>]*?\bog:locale\b[^>]*?\bcontent\s*=\s*[\"']?([a-z]{2,3})",
)
#: Second-level labels below which names are registered.
SECOND_LEVEL = frozenset("ac co com edu gob gouv gov go ne net nom or org".split())
OTHER = "other"


def gram_codes(texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of three characters of lower-cased words and their edges, and the text of each."""
    from .words import mix, split_words

    import pyarrow as pa
    import pyarrow.compute as pc

    words, of = split_words(texts, letters_only=True)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = pc.binary_join_element_wise("", words, "", " ")
    length = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(of, length)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = owner[:-2] == owner[2:]
    code = mix((points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:])[inside]) >> np.uint64(64 - bits)
    return code.astype(np.int64), owner[:-2][inside]


def fit_text_model(docs: DataFrame, settings: LanguageSettings, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of hashed grams, from a bounded sample of labelled documents by a hash of their id."""
    known = docs.select(F.col(id_col).alias("id"), F.lower(F.substring_index(F.col(lang_col), "-", 1)).alias("lang")).filter("lang is not null and lang <> ''")
    found = [r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.max_languages + 1).collect()]
    langs = sorted(found[: settings.max_languages]) + ([OTHER] if len(found) > settings.max_languages else [])
    if not langs:
        return [], np.zeros((0, 1 << settings.bits))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1, F.lit(-1))
    place = F.when(place < 0, len(langs) - 1).otherwise(place).cast("int")
    # of each language the first by hash, cut where rows are read
    nth = F.row_number().over(W.partitionBy("k").orderBy(F.xxhash64("id"), "id"))
    sample = known.filter("id is not null").groupBy("id").agg(F.min("lang").alias("lang")).select("id", place.alias("k")).withColumn("nth", nth).filter(F.col("nth") <= settings.sample_docs)
    wanted = materialize(sample.select("id", "k"), "sample")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(wanted), "id").select("k", "text")
    bits, n = settings.bits, len(langs)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(n << bits)
        for batch in batches:
            for part in slices(batch, 1):
                code, of = gram_codes(part.column(1), bits)
                # each document weighs the same, however long
                size = np.maximum(np.bincount(of, minlength=part.num_rows), 1)
                np.add.at(total, (part.column(0).to_numpy().astype(np.int64)[of] << bits) + code, 1.0 / size[of])
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "x"])

    found = rows.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    counts = np.zeros(n << bits)
    counts[found["at"].to_numpy()] = found["x"].to_numpy()
    counts = counts.reshape(n, -1)
    counts = counts / counts.sum(axis=1, keepdims=True)
    return langs, np.log(0.98 * counts + 0.02 / counts.shape[1])


def address_of(url: str | None, langs: set[str]) -> tuple[str, str, str, str]:
    """Host, domain, suffix and the language that the address names: a path segment, else the host's first label."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return "", "", "", ""
    labels = host.split(".")
    deep = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL
    segments = [s.lower().split("-")[0] for s in parts.path.split("/") if s]
    named = next((s for s in segments if s in langs), "") or (labels[0] if len(labels) > 2 and labels[0] in langs else "")
    return host, ".".join(labels[-3 if deep else -2 :]), labels[-1], named


def identify_languages(pages: DataFrame, docs: DataFrame, settings: LanguageSettings = LanguageSettings(), page_col: str = "page_id", url_col: str = "url", html_col: str = "html", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each page: ``page_col, lang, probability, text_lang, declared, suggested, host``.

    ``docs`` give labelled text. Null markup has no text and declares nothing, a null address has
    the host ``''``; such pages rest on the priors. Declarations of other languages count as one
    value, none as another. Of languages with equal posteriors the first in order is given.
    Repeated rows and null ids are pages of their own; very long pages are read whole. Without
    labelled text ``lang`` is null. Other columns are not read, whatever their names. No rows give
    no rows.
    """
    langs, model = fit_text_model(docs, settings, id_col, text_col, lang_col)
    rows = pages.select(F.col(page_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    if not langs:
        empty = F.lit(None).cast("string")
        return rows.select(F.col("id").alias(page_col), empty.alias("lang"), F.lit(None).cast("double").alias("probability"), empty.alias("text_lang"), empty.alias("declared"), empty.alias("suggested"), empty.alias("host"))
    n, bits, most = len(langs), settings.bits, settings.text_grams
    sent = pages.sparkSession.sparkContext.broadcast(model)
    stripped = spread(rows).select(
        "id", "url", F.coalesce(*[F.nullif(F.lower(F.regexp_extract("html", x, 1)), F.lit("")) for x in DECLARED], F.lit("")).alias("declared"),
        F.regexp_replace(F.regexp_replace("html", HIDDEN, " "), TAGS, " ").alias("text"),
    )

    def evidence(batches):
        import pyarrow as pa

        known = set(langs) - {OTHER}
        for batch in batches:
            for part in slices(batch, 3):
                m = part.num_rows
                texts = [html.unescape(t) if "&" in t else t for t in part.column(3).to_pylist()]
                code, of = gram_codes(pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), bits)
                size = np.bincount(of, minlength=m)
                ll = np.stack([np.bincount(of, weights=sent.value[k][code], minlength=m) for k in range(n)], axis=1)
                ll *= (np.minimum(size, most) / np.maximum(size, 1))[:, None]
                soft = np.exp(ll - ll.max(axis=1, keepdims=True))
                soft /= soft.sum(axis=1, keepdims=True)
                host, domain, suffix, named = zip(*(address_of(u, known) for u in part.column(1).to_pylist()), strict=True)
                said = [x if x in known else OTHER if x else "" for x in part.column(2).to_pylist()]
                ends = pa.array(np.arange(m + 1) * n, pa.int32())
                yield pa.record_batch([part.column(0), *(pa.array(x, pa.string()) for x in (host, domain, suffix, named, said)), *(pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (ll, soft))], ["id", "host", "domain", "suffix", "suggested", "declared", "ll", "soft"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL("host string, domain string, suffix string, suggested string, declared string, ll array<double>, soft array<double>").fields])
    seen = materialize(stripped.mapInArrow(evidence, schema).withColumn("uid", F.monotonically_increasing_id()), "evidence")

    def sums(by):
        return seen.groupBy(*by).agg(F.array(*[F.sum(F.col("soft")[k]) for k in range(n)]).alias("s"), F.count("*").alias("c"))

    # (n + 2) values at most each: what pages of each language declare and suggest
    a = settings.smoothing
    totals = np.zeros(n)
    logs = {}
    for what in ("declared", "suggested"):
        found = {r[what]: np.array(r.s) for r in sums([what]).collect()}
        values = {"", OTHER, *langs} if what == "declared" else {"", *langs}
        table = {v: found.get(v, np.zeros(n)) for v in values}
        totals = sum(table.values())
        logs[what] = {v: np.log((x + a) / (totals + a * len(values))) for v, x in table.items()}
    world = (totals + 1.0) / (totals.sum() + n)
    literal = lambda v: F.array(*[F.lit(float(x)) for x in v])

    def pick(what):
        out = literal(logs[what][""])
        for v, x in logs[what].items():
            if v:
                out = F.when(F.col(what) == v, literal(x)).otherwise(out)
        return out

    # a host's pages may be a third of all: each level's sums meet their pages over pages of the join
    joined, total_rows = seen, seen.count()
    for level, by in (("h", ["host", "domain", "suffix"]), ("d", ["domain", "suffix"]), ("x", ["suffix"])):
        entries = materialize(sums(by).withColumnsRenamed({"s": f"{level}s", "c": f"{level}c"}), f"pages-by-{by[0]}")
        joined = paged_join(joined, entries, by, f"{level}c", total_rows, F.col("uid"))
    k0 = settings.strength
    out = []
    for k in range(n):
        own = F.col("soft")[k]  # a page is no evidence for itself
        suffix = (F.col("xs")[k] - own + k0 * float(world[k])) / (F.col("xc") - 1 + k0)
        domain = (F.col("ds")[k] - own + k0 * suffix) / (F.col("dc") - 1 + k0)
        host = (F.col("hs")[k] - own + k0 * domain) / (F.col("hc") - 1 + k0)
        out.append(F.col("ll")[k] + F.log(F.greatest(host, F.lit(1e-12))))
    total = F.array(*[x + pick("declared")[k] + pick("suggested")[k] for k, x in enumerate(out)])
    names = F.array(*[F.lit(x) for x in langs])
    scored = joined.select("id", "host", "declared", "suggested", "soft", total.alias("total")).withColumn("top", F.array_max("total"))
    weight = F.aggregate("total", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    at = lambda c, m: F.element_at(names, F.array_position(c, m).cast("int"))
    return scored.select(F.col("id").alias(page_col), at(F.col("total"), F.col("top")).alias("lang"), (1 / weight).alias("probability"), at(F.col("soft"), F.array_max("soft")).alias("text_lang"), "declared", "suggested", "host")
