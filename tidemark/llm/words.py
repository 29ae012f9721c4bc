"""Words of many texts as flat arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX[0]
    x ^= x >> np.uint64(33)
    x *= MIX[1]
    return x ^ (x >> np.uint64(33))


def seeded(*parts: int) -> np.uint64:
    """A 64-bit constant from small integers."""
    return np.uint64(xxhash.xxh3_64_intdigest(repr(parts).encode()))


def split_words(texts: pa.Array, letters_only: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts, one after the other, and the text that each belongs to; words stand between white space.

    ``letters_only``: between anything but letters and digits.
    """
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    if letters_only:
        low = pc.replace_substring_regex(low, r"[^\pL\pN]+", " ")
    parts = pc.utf8_split_whitespace(low)
    of = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    words = parts.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py():
        words, of = words.filter(full), of[full.to_numpy(zero_copy_only=False)]
    return words, of


def hash_words(words: pa.Array, *prefixes: int) -> list[np.ndarray]:
    """A 64-bit hash of each word, then of its first letters for each of ``prefixes``; each distinct word of the array is hashed once."""
    if not len(words):
        return [np.zeros(0, np.uint64)] * (1 + len(prefixes))
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    digest, out = xxhash.xxh3_64_intdigest, []
    for distinct in (coded.dictionary, *(pc.utf8_slice_codeunits(coded.dictionary, 0, n) for n in prefixes)):
        out.append(np.array([digest(w) for w in distinct.cast(pa.binary()).to_pylist()], np.uint64)[at])
    return out


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the text of each. A text of fewer words, even none, has one shingle: all its words."""
    words, of = split_words(texts)
    (h,) = hash_words(words)
    n = len(texts)
    count = np.bincount(of, minlength=n) if len(of) else np.zeros(n, np.int64)
    first = np.cumsum(count) - count
    odd = [seeded(1, i) | np.uint64(1) for i in range(size)]
    out_h, out_of = [], []
    if len(h) >= size:
        total = np.zeros(len(h) - size + 1, np.uint64)
        for i in range(size):
            total += mix(h[i : len(h) - size + 1 + i] ^ odd[i])
        inside = of[: len(total)] == of[size - 1 :]
        out_h.append(mix(total[inside]))
        out_of.append(of[: len(total)][inside])
    short = np.flatnonzero(count < size)
    if len(short):
        own = np.full(len(short), seeded(2), np.uint64)
        for i in range(size - 1):
            has = count[short] > i
            own[has] = mix(own[has] + h[first[short[has]] + i] * odd[i])
        out_h.append(own)
        out_of.append(short)
    return np.concatenate(out_h) if out_h else np.zeros(0, np.uint64), np.concatenate(out_of) if out_of else np.zeros(0, np.int64)


def weighted(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, element) pairs in order, with the number of times that each occurs."""
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return h[at], of[at], np.diff(at, append=len(h)).astype(np.float64)
