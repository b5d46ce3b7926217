"""Hashed word and subword features, worked out once for each distinct chunk."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np

LETTERS = re.compile(r"[^\W\d_]+")


def bucket(term: str, mask: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & mask


def subwords(chunk: str, orders: Iterable[int], mask: int) -> list[int]:
    """Buckets of each run of letters in ``chunk``: the word, and its character
    n-grams with the ends marked."""
    out = []
    for word in LETTERS.findall(chunk):
        out.append(bucket(word, mask))
        marked = f"<{word}>"
        for n in orders:
            out.extend(bucket(marked[i : i + n], mask) for i in range(len(marked) - n + 1))
    return out


_U = np.uint64
_letters: list[np.ndarray] = []


def ngram_buckets(chunks: list[str], orders: Iterable[int], mask: int) -> tuple[np.ndarray, np.ndarray]:
    """``(chunk, bucket)`` of the character n-grams of each run of letters, its ends
    marked: the same grams as ``subwords`` for all chunks at once, hashed in numpy."""
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    text = "\n" + "\n".join(chunks) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inner = _letters[0][codes]
    owner = np.cumsum(codes == 10) - 1
    marked = np.where(inner, codes, 1).astype(np.uint64)
    owners, buckets = [], []
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h, ok = np.full(m, n, np.uint64), inner[:m] | inner[1 : m + 1] if n == 2 else np.ones(m, bool)
        for j in range(n):
            h = h * _U(0x100000001B3) + marked[j : j + m]
            if 0 < j < n - 1:
                ok &= inner[j : j + m]
        h = h[ok]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        buckets.append(((h ^ (h >> _U(32))) & _U(mask)).astype(np.int64))
        owners.append(np.where(inner[:m], owner[:m], owner[1 : m + 1])[ok])  # a letter's, never the mark's
    return np.concatenate(owners), np.concatenate(buckets)


class ChunkRows:
    """A row of ``width`` numbers for each chunk, computed when first met.  ``compute``
    gives one chunk's row or, with ``many``, a matrix for a list of chunks.  Holds at
    most ``most`` chunks and starts afresh when full, so memory is bounded."""

    def __init__(self, compute: Callable, width: int, most: int = 250_000, many: bool = False):
        self.compute, self.most, self.many = compute, most, many
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, width))

    def total(self, counts: Counter) -> np.ndarray:
        """The sum of the rows of ``counts``, weighted by its counts."""
        return sum(k @ rows for k, rows in self.parts(counts))

    def parts(self, counts: Counter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Counts and their rows; a text with more distinct chunks than fit comes in parts."""
        if len(counts) > self.most // 2:
            items = list(counts.items())
            for i in (0, 1):
                yield from self.parts(Counter(dict(items[i::2])))
            return
        found = list(map(self.at.get, counts))
        if None in found:
            new = [c for c, i in zip(counts, found, strict=True) if i is None]
            if len(self.at) + len(new) > self.most:
                self.at.clear()
                new = list(counts)
            need = len(self.at) + len(new)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), self.rows.shape[1]))
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            first = need - len(new)
            if self.many:
                self.rows[first:need] = self.compute(new)
            else:
                flat = np.fromiter(chain.from_iterable(map(self.compute, new)), np.float64, len(new) * self.rows.shape[1])
                self.rows[first:need] = flat.reshape(len(new), -1)
            self.at.update(zip(new, range(first, need), strict=True))
            found = list(map(self.at.__getitem__, counts))
        yield np.fromiter(counts.values(), np.float64, len(counts)), self.rows[found]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
