"""Byte-pair merging over ragged numpy arrays, all sequences at the same time.

A batch of pre-tokens is one flat array of symbols plus the sequence of each symbol. In every
round each sequence finds the lowest rank among its adjacent pairs and merges all places of that
pair, from the left where they overlap; sequences without a mergeable pair leave the batch. As a
merged symbol only takes part in later ranks, that gives what merging one pair at a time gives.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import regex

#: White space of the libraries' patterns, character by character (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NO_RANK = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


#: Blocks whose characters have been the same in all recent versions of Unicode; text with others is split by the library.
SETTLED = re.compile("[^\\x00-\\u024f\\u0370-\\u0377\\u037a-\\u037f\\u0384-\\u038a\\u0391-\\u03a1\\u03a3-\\u045f\\u2010-\\u2027\\u2030-\\u205e\\u3041-\\u3096\\u30a1-\\u30fe\\u4e00-\\u9fa5\\uac00-\\ud7a3]")


def library_pieces(library, text: str) -> list[str]:
    """How the library itself splits a text before merging."""
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    return [bytes(byte_of[c] for c in piece).decode("utf-8", "surrogatepass") for piece, _ in library.pre_tokenizer.pre_tokenize_str(text)]


class RankMerger:
    """The merges of a tokenizer file (.json, model BPE over byte-level symbols)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in byte_symbols()], np.int64)
        keys, ids = [], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            keys.append(vocab[a] << 20 | vocab[b])
            ids.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self._keys, self._ranks = np.array(keys, np.int64)[order], order.astype(np.int64)
        self._merged = np.array(ids, np.int64)
        # a table by a short hash of the pair: most pairs are not in it and need no search
        self._bits = np.zeros(1 << 21, bool)
        self._bits[self._slot(self._keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(-7046029254386353131) >> np.int64(43)) & np.int64((1 << 21) - 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), NO_RANK)
        keys = a << 20 | b
        maybe = np.flatnonzero(self._bits[self._slot(keys)])
        if len(maybe):
            k = keys[maybe]
            at = np.minimum(np.searchsorted(self._keys, k), len(self._keys) - 1)
            hit = self._keys[at] == k
            out[maybe[hit]] = self._ranks[at[hit]]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols' ids of all words, one after the other, and the number of each word's. Words are not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return np.zeros(0, np.int64), lengths
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths) - 1
        symbols = self.first[raw]
        symbols[ends] = self.last[raw[ends]]
        seq = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_seq = [], []
        # rank of the pair that begins at each symbol; none at the end of a sequence
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1] = self._rank(symbols[:-1], symbols[1:])
        rank[ends] = NO_RANK
        while len(symbols):
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            sizes = np.diff(starts, append=len(seq))
            low = np.minimum.reduceat(rank, starts)
            live = low < NO_RANK
            if not live.all():
                keep = np.repeat(live, sizes)
                done_symbols.append(symbols[~keep])
                done_seq.append(seq[~keep])
                symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
                low, sizes = low[live], sizes[live]
                if not len(symbols):
                    break
            hit = rank == np.repeat(low, sizes)
            overlap = hit[1:] & hit[:-1]
            if overlap.any():  # runs such as aaa: every other place, from the left
                at = np.flatnonzero(hit)
                run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                odd = (np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 1
                hit[at[odd]] = False
            at = np.flatnonzero(hit)
            symbols[at] = self._merged[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            last_of = np.flatnonzero(np.diff(seq, append=-1))
            ended = np.zeros(len(symbols), bool)
            ended[last_of] = True
            ended[at] = ended[at + 1]
            symbols, seq, rank, ended, hit = symbols[stay], seq[stay], rank[stay], ended[stay], hit[stay]
            # only pairs that hold a merged symbol are new
            hit[:-1] |= hit[1:]
            rank[hit] = NO_RANK
            redo = np.flatnonzero(hit & ~ended)
            rank[redo] = self._rank(symbols[redo], symbols[redo + 1])
        symbols, seq = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_seq, seq])
        order = np.argsort(seq, kind="stable")
        return symbols[order], np.bincount(seq, minlength=len(words))


class ChunkCache:
    """What a function of many chunks gives for each, kept up to a bound and then begun afresh."""

    def __init__(self, compute, bound: int = 400_000):
        self.compute, self.bound, self.known = compute, bound, {}

    def of(self, chunks: list) -> list:
        known = self.known
        new = list(set(chunks).difference(known))
        if new:
            if len(known) + len(new) > self.bound:
                known.clear()
                new = list(set(chunks))
            # bounded work arrays, however many chunks one text has
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                known.update(zip(part, self.compute(part), strict=True))
        return list(map(known.__getitem__, chunks))


class ByteBpe:
    """Counts tokens as the library does for a byte-level file: special strings are one token each, texts are whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merger = RankMerger(path)
        # the pattern of byte-level splitting (fixed values), white space spelled out
        self.fine = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.edge = re.compile(rf"\A(?:[{SPACE}]|\Z)|[{SPACE}]\Z")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merger.special, key=len, reverse=True)))) if self.merger.special else None
        self.cache = ChunkCache(self._count)

    def pieces(self, text: str) -> list[str]:
        return self.fine.findall(text) if not SETTLED.search(text) else library_pieces(self.library, text)

    def _count(self, chunks: list[str]) -> list[int]:
        """Tokens of what follows a space, with that space; -1 if white space at an edge makes them depend on what stands around."""
        words, of = [], []
        for i, c in enumerate(chunks):
            if self.edge.search(c):
                continue
            found = self.pieces(" " + c)
            words += found
            of += [i] * len(found)
        out = np.bincount(np.array(of, np.int64), weights=self._sizes(words), minlength=len(chunks)).astype(np.int64)
        out[out == 0] = -1
        return out.tolist()

    def _sizes(self, words: list[str]) -> np.ndarray:
        unique = {w: k for k, w in enumerate(dict.fromkeys(words))}
        _, sizes = self.merger.merge([w.encode("utf-8", "surrogatepass") for w in unique])
        return sizes[np.fromiter(map(unique.__getitem__, words), np.int64, len(words))]

    def count(self, texts: list[str]) -> list[int]:
        chunks, parts, out = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            own = [t]
            if self.special and (found := self.special.findall(t)):
                out[i] = len(found)
                own = self.special.split(t)
            for part in own:
                if part:
                    first, *rest = part.split(" ")
                    parts.append((i, part, first, len(rest)))
                    chunks += rest
        sizes, at, words, of = self.cache.of(chunks), 0, [], []
        for i, part, first, n in parts:
            own = sizes[at : at + n]
            at += n
            # a part whose spaces all stand singly between other characters is the sum of its chunks
            plain = n == 0 or (min(own) > 0 and not self.edge.search(first))
            found = self.pieces(first if plain else part)
            words += found
            of += [i] * len(found)
            out[i] += sum(own) if plain else 0
        if words:
            more = np.bincount(np.array(of, np.int64), weights=self._sizes(words), minlength=len(texts)).astype(np.int64)
            out = (np.array(out, np.int64) + more).tolist()
        return out


class WordBpe:
    """The ids that the library gives for a file of lower-cased words with word ends, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merger = RankMerger(path)
        # the file's pattern (fixed values), white space spelled out
        self.fine = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        if any("<" not in x for x in self.merger.special):
            raise ValueError("special strings hold '<' here")
        self.special = regex.compile("|".join(map(regex.escape, self.merger.special)) or r"(?!)")
        #: Separators for Python that the library takes as text.
        self.odd = regex.compile(r"[\x1c-\x1f]")
        self.space = regex.compile(rf"[^{SPACE}]+")
        self.normal = self.library.normalizer
        self.marks = frozenset(".,;:!?")
        self.cache, self.words = ChunkCache(self._ids), ChunkCache(self._merged)

    def _merged(self, words: list[str]) -> list[bytes]:
        ids, sizes = self.merger.merge([w.encode("utf-8", "surrogatepass") for w in words])
        raw, ends = ids.astype("<u4").tobytes(), [0, *(np.cumsum(sizes) * 4).tolist()]
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def _pieces(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The words of what stands between white space; no special string is in it."""
        if chunk.isascii():
            text = chunk.lower()
        else:
            # Python lowers a final sigma in another way
            text = self.normal.normalize_str(chunk) if "\u03a3" in chunk or SETTLED.search(chunk) else unicodedata.normalize("NFC", chunk).lower()
            if SETTLED.search(text):
                return library_pieces(self.library, text)
        if text.isalpha():
            return (text,)
        if text[-1:] in self.marks and text[:-1].isalpha():
            return text[:-1], text[-1]
        return self.fine.findall(text)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        pieces, whole = [], {}
        for i, c in enumerate(chunks):
            if "<" in c and self.special.search(c):
                whole[i] = np.array(self.library.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
                pieces.append(())
            else:
                pieces.append(self._pieces(c))
        found, out, at = self.words.of([w for own in pieces for w in own]), [], 0
        for own in pieces:
            n = len(own)
            out.append(found[at] if n == 1 else b"".join(found[at : at + n]))
            at += n
        for i, raw in whole.items():
            out[i] = raw
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.space.findall(t) if self.odd.search(t) else t.split() for t in texts]
        parts = self.cache.of([c for own in split for c in own])
        out, at = [], 0
        for own in split:
            out.append(b"".join(parts[at : at + len(own)]))
            at += len(own)
        return out
