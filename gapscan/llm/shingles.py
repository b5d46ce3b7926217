"""Word shingles as 64-bit hashes, vectorised over a batch of whole texts.

Words are what stands between ASCII white space in the lower-cased text.  A text
of fewer than ``width`` words is one shingle of all its words; no words, none."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, 2 * _SEGMENT)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        up, down = np.full(n, _P), np.full(n, inverse)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def word_hashes(raw: bytes) -> np.ndarray:
    """One hash for each word, in order.  Long input is taken in segments that end
    at white space, so memory follows the segment and the number of words."""
    if len(raw) > 2 * _SEGMENT:
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + _SEGMENT)
            while end < len(raw) and raw[end] > 32:
                end += 1
            out.append(_segment_hashes(raw[at:end]))
            at = end
        return np.concatenate(out)
    return _segment_hashes(raw)


def _segment_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = b > 32
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_batch(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, hash, count)`` of the distinct shingles of each text, ordered by
    text and hash."""
    lows = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    words = [word_hashes(x) for x in lows] if max(map(len, lows), default=0) > _SEGMENT else None
    if words is None:  # one pass over the joined texts; words never cross the line feeds
        joined = b"\n".join(lows)
        flat = word_hashes(joined) if lows else np.zeros(0, np.uint64)
        b = np.frombuffer(joined, np.uint8)
        inside = np.zeros(len(b) + 1, np.int8)
        inside[1:] = b > 32
        starts = np.flatnonzero(np.diff(inside) == 1)
        bounds = np.cumsum([len(x) + 1 for x in lows])
        counts = np.diff(np.searchsorted(starts, bounds), prepend=0) if lows else np.zeros(0, np.int64)
    else:
        flat, counts = np.concatenate(words), np.array([len(x) for x in words])
    n = len(flat)
    doc = np.repeat(np.arange(len(lows)), counts)
    size = np.minimum(counts, width)  # words in a shingle of this text
    hashes = np.zeros(n, np.uint64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the end
    for j in range(width):
        part = mix(flat + np.uint64((j + 1) * int(_P) & (1 << 64) - 1))
        hashes[: n - j] += np.where(left[: n - j] > j, part[j:], np.uint64(0))
    whole = left >= np.repeat(size, counts)
    doc, hashes = doc[whole], mix(hashes[whole])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return doc[first], hashes[first], np.diff(first, append=len(doc))


def text_batches(column, most_bytes: int = _SEGMENT, most_rows: int = 1000):
    """Slices ``(from, texts)`` of an Arrow string column, bounded in bytes."""
    held, size, start = [], 0, 0
    for i, x in enumerate(column):
        text = x.as_py()
        if held and (size + len(text or "") > most_bytes or len(held) >= most_rows):
            yield start, held
            held, size, start = [], 0, i
        held.append(text)
        size += len(text or "")
    if held:
        yield start, held
