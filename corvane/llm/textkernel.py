"""Vectorised scanning of Arrow text columns: code points, words and rolling hashes in numpy.

A word is a maximal run of letters, marks and numbers, folded to lower case one
code point at a time; in scripts written without spaces (Han, kana, Thai, Lao, Khmer, Burmese, Tibetan) each
letter with its marks is a word of its own, unless `solo` is false. Hashes are 64-bit polynomials taken from prefix sums, so a
chunk of texts is scanned without a Python loop over rows, words or characters.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_state: dict[str, np.ndarray] = {}

WORD, SPACE, OTHER = 1, 2, 0
#: Scripts without spaces between words, and the share of a word that one of their letters stands for.
SOLO = {0.5: ((0x3005, 0x3007), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)), 0.25: ((0x0E01, 0x0EFF), (0x0F40, 0x0FBC), (0x1000, 0x109F), (0x1780, 0x17D3))}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if "lower" not in _state:
        kind = np.zeros(0x110000, np.uint8)
        lower = np.arange(0x110000, dtype=np.uint32)
        cat = unicodedata.category
        for i in range(0x110000):
            ch = chr(i)
            if cat(ch)[0] in "LMN":
                kind[i] = WORD
                low = ch.lower()
                if len(low) == 1:
                    lower[i] = ord(low)
            elif ch.isspace():
                kind[i] = SPACE
        _state["kind"], _state["lower"] = kind, lower
    return _state["kind"], _state["lower"]


def _shares() -> np.ndarray:
    """The share of a word that each code point's letter stands for; 0 for a mark in any script, 1 for a letter of other scripts."""
    if "share" not in _state:
        share = np.ones(0x110000, np.float32)
        for value, ranges in SOLO.items():
            for lo, hi in ranges:
                share[lo : hi + 1] = value
        for i in np.flatnonzero(_tables()[0] == WORD):
            if unicodedata.category(chr(i))[0] == "M":
                share[i] = 0
        _state["share"] = share
    return _state["share"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _state or len(_state["pow"]) < n:
        m = 1 << max(18, (n - 1).bit_length())
        for name, base in (("pow", _BASE), ("inv", _INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _state[name] = np.cumprod(x)
    return _state["pow"], _state["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Scan:
    """Code points, words and word hashes of a column of texts (null counts as empty)."""

    def __init__(self, texts: pa.Array, solo: bool = True) -> None:
        kind, lower = _tables()
        arr = pc.fill_null(texts.cast(pa.large_string()), "")
        n = self.n_docs = len(arr)
        lens = pc.utf8_length(arr).to_numpy(zero_copy_only=False).astype(np.int64)
        buffers = arr.buffers()
        off = np.frombuffer(buffers[1], np.int64)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = bytes(memoryview(buffers[2])[off[0] : off[-1]]) if buffers[2] is not None else b""
        self.cps = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
        if lens.sum() != len(self.cps):  # ill-formed text: count what was decoded
            parts = [raw[a - off[0] : b - off[0]].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
            lens = np.array([len(p) for p in parts], np.int64)
            self.cps = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.low = lower[self.cps]
        self.kind = kind[self.cps]
        self.start = np.zeros(n + 1, np.int64)
        np.cumsum(lens, out=self.start[1:])
        total = len(self.cps)
        cut = np.zeros(total + 1, bool)
        cut[self.start] = True
        w = self.kind == WORD
        before = np.empty(total, bool)
        after = np.empty(total, bool)
        if total:
            before[0], before[1:] = False, w[:-1]
            after[-1], after[:-1] = False, w[1:]
        opens, closes = w & (cut[:-1] | ~before), w & (cut[1:] | ~after)
        if solo and total and int(self.cps.max()) >= 0x0E01:
            share = _shares()[self.cps]
            alone, mark = w & (share > 0) & (share < 1), w & (share == 0)
            # a word begins at such a letter, and at any letter behind one and its marks
            place = np.arange(total)
            letter = np.maximum.accumulate(np.where(w & ~mark, place, -1))  # the last letter up to each place
            behind = np.append(False, (letter[:-1] >= 0) & alone[np.maximum(letter[:-1], 0)])
            fresh = w & ~mark & (alone | behind)
            opens |= fresh
            closes |= w & np.append(fresh[1:], False)
        self.ws, self.we = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.doc = np.searchsorted(self.start, self.ws, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=n).astype(np.int64)
        self.first = np.zeros(n + 1, np.int64)  # index of each text's first word
        np.cumsum(self.n_words, out=self.first[1:])
        self._sums = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            power, _ = _powers(len(self.low) + 1)
            self._sums = np.zeros(len(self.low) + 1, np.uint64)
            np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * power[: len(self.low)], out=self._sums[1:])
        return self._sums

    def span_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the folded characters lo..hi, whatever their place."""
        _, inv = _powers(len(self.low) + 1)
        return mix((self.sums[hi] - self.sums[lo]) * inv[lo])

    def weights(self) -> np.ndarray:
        """The share of a word that each word stands for."""
        if not len(self.ws) or int(self.cps.max()) < 0x0E01:
            return np.ones(len(self.ws), np.float32)
        share = _shares()[self.cps[self.ws]]
        return np.where(share > 0, share, 1)

    def word_hashes(self) -> np.ndarray:
        return self.span_hash(self.ws, self.we)

    def text_of(self, i: int) -> str:
        return self.slice(self.start[i], self.start[i + 1])

    def slice(self, lo: int, hi: int) -> str:
        return self.cps[lo:hi].tobytes().decode("utf-32-le", "surrogatepass")

    def words(self, lo: int, hi: int) -> list[str]:
        """The folded words lo..hi (word indices)."""
        return [self.low[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(self.ws[lo:hi], self.we[lo:hi], strict=True)]


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n successive word hashes (len(words) - n + 1 of them, none for fewer words)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out *= np.uint64(_BASE)
        out += words[j : j + m]
    return mix(out)


def doc_shingles(scan: Scan, n: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text index) of every n-word shingle; a text of 1..n-1 words has one shingle of all its words."""
    words = scan.word_hashes() if words is None else words
    all_ = shingle_hashes(words, n)
    doc = scan.doc[: len(all_)]
    inside = doc == scan.doc[n - 1 : n - 1 + len(all_)]
    hashes, docs = all_[inside], doc[inside]
    short = np.flatnonzero((scan.n_words > 0) & (scan.n_words < n))
    if len(short):
        extra = []
        for i in short:
            x = np.full(1, scan.n_words[i], np.uint64)
            for w in words[scan.first[i] : scan.first[i + 1]]:
                x = x * np.uint64(_BASE) + w
            extra.append(mix(x)[0])
        hashes, docs = np.concatenate([hashes, np.array(extra, np.uint64)]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        hashes, docs = hashes[order], docs[order]
    return hashes, docs
