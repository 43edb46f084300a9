"""Vectorised splitting of texts into the words of byte-level BPE, and encoding by distinct word."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from framelark.llm.packed import pieces, prefix_hash, ragged, range_hash, text_bytes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The endings that follow an apostrophe as one word.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number, other."""
    if not _CLASSES:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, every):
                table[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def split_words(text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(code points, starts, ends)`` of the words of the texts ``text[bounds[i]:bounds[i + 1]]``.

    As the usual byte-level pattern does: endings after an apostrophe; runs of letters,
    numbers or other characters with at most one blank before them; white space, whose
    last character stays apart when a word follows.
    """
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return cp, np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = char_classes()[cp]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    first = first[:n]
    space = kind == SPACE
    before = np.r_[False, (cp[:-1] == 0x20)] & ~first  # a blank of the same text stands before
    fresh = first | np.r_[True, kind[1:] != kind[:-1]]
    start = fresh & ~(~space & before)
    follows = np.r_[~space[1:] & ~first[1:], False]
    start |= space & follows
    quote = np.flatnonzero((cp == 0x27) & fresh & ~before)
    for i in quote.tolist():
        stop = i + 1
        while stop < n and stop < i + 3 and not first[stop]:
            stop += 1
        after = text[i + 1 : stop]
        for e in ENDINGS:
            if after.startswith(e):
                start[i + 1] = False
                end = i + 1 + len(e)
                if end < n:
                    start[end] |= kind[end] == LETTER
                break
    starts = np.flatnonzero(start)
    return cp, starts, np.r_[starts[1:], n]


class WordCoder:
    """Encodes texts word by word; words seen before are looked up by their 64-bit hash.

    Up to ``most`` words are remembered; beyond that the memory starts anew.
    """

    def __init__(self, encode_word: Callable[[str], list[int]], special: dict[str, int], most: int = 2_000_000):
        self.encode_word, self.special, self.most = encode_word, special, most
        self.special_pattern = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0

    def shrink(self, most: int = 400_000) -> None:
        """Start anew if more than ``most`` words are remembered (about 15 MB)."""
        if len(self.hashes) > most:
            self._forget()

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode new words (sorted by hash) and remember them."""
        if len(self.hashes) > self.most:
            self._forget()
        encode_word = self.encode_word
        lists = [encode_word(w) for w in words]
        length = np.fromiter(map(len, lists), np.int32, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(length.sum()))
        while self.used + len(flat) > len(self.store):
            self.store = np.r_[self.store, np.zeros(len(self.store), np.uint32)]
        self.store[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(length, dtype=np.int64) - length
        self.used += len(flat)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.begin, self.length = np.insert(self.begin, at, begin), np.insert(self.length, at, length)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of an Arrow column of texts; null counts as empty."""
        buf, off = text_bytes(column)
        parts, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first, last in pieces(off, 1 << 20):
            raw = buf[off[first] : off[last]]
            ids, per = self._encode(raw, off[first : last + 1] - off[first])
            parts.append(ids)
            counts.append(per)
        return np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int64)

    def _encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upto = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        bounds = upto[off]  # in characters
        text = raw.tobytes().decode("utf-8", "replace")
        if len(text) != bounds[-1]:  # not UTF-8: decode text by text
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
            text, bounds = "".join(texts), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        cuts, marks = bounds, {}
        if self.special_pattern and any(s in text for s in self.special):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                for m in self.special_pattern.finditer(text, a, b):
                    marks[m.start()] = (m.end(), self.special[m[0]])
            cuts = np.unique(np.r_[bounds, [x for s, (e, _) in marks.items() for x in (s, e)]].astype(np.int64))
        cp, starts, ends = split_words(text, cuts)
        if marks:
            inside = np.zeros(len(cp) + 1, bool)
            for s, (e, _) in marks.items():
                inside[s + 1 : e] = True
            starts = starts[~inside[starts]]
            ends = np.r_[starts[1:], len(cp)]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        hashes, at, word = np.unique(
            range_hash(prefix_hash(cp), starts, ends), return_index=True, return_inverse=True
        )
        for where, fixed in self._fixed(starts, ends, marks):
            word[where] = len(hashes) + fixed
        place = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(place, len(self.hashes) - 1)] != hashes
        if new.any():
            if len(self.hashes) > self.most:
                self._forget()
                new[:] = True
            which = at[new]
            self._learn(hashes[new], [text[s:e] for s, e in zip(starts[which].tolist(), ends[which].tolist())])
            place = np.searchsorted(self.hashes, hashes)
        most = max([0, *self.special.values()]) + 1
        begin = np.r_[self.begin[place], self.used + np.arange(most)]
        length = np.r_[self.length[place], np.ones(most, np.int32)].astype(np.int64)
        if marks:
            store = np.r_[self.store[: self.used], np.arange(most, dtype=np.uint32)]
        else:
            store = self.store
        out = store[ragged(begin[word], length[word])]
        doc = np.searchsorted(bounds, starts, "right") - 1
        per = np.bincount(doc, weights=length[word], minlength=len(off) - 1).astype(np.int64)
        return out, per

    @staticmethod
    def _fixed(starts: np.ndarray, ends: np.ndarray, marks: dict[int, tuple[int, int]]):
        """The words that are special strings, with their ids."""
        for s, (e, special_id) in marks.items():
            yield int(np.searchsorted(starts, s)), special_id


def byte_chars() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """``(tokens, merges in rank order, special tokens)`` of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = byte_chars()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    raw = lambda s: bytes(back[c] for c in s)
    tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
    return tokens, merges, special


def ids_list(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
