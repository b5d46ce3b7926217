"""A counting quotient filter over packed word-id n-grams.

A key is ``m`` word ids of ``bits`` bits each.  A Feistel permutation mixes all ids into
the first and back into the others; it can be undone, so a key is held whole: the high
bits of the first mixed id are its *quotient* (the slot), all other bits its *remainder*.
Nothing is hashed away, so counts are exact and keys can be read back.

A filter keeps its entries in order of quotient and remainder, slot by slot: for each
occupied slot its distance from the one before and the length of its run, for each entry
the remainder in whole bytes and a count of as many bytes as it needs.  Two filters in
that order are merged as sorted lists are, adding the counts of equal entries.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SALTS = tuple(_U(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1) for i in range(8))


def _stir(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (x + salt) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


def permute(ids: np.ndarray, bits: int) -> np.ndarray:
    """``ids`` (one row per key, ``m`` columns) mixed; ``restore`` undoes it."""
    out, mask, m = ids.astype(_U), _U((1 << bits) - 1), ids.shape[1]
    odd = _U(0xD6E8FEB86659FD93)
    for j in range(1, m):
        out[:, 0] = (out[:, 0] + _stir(out[:, j], _SALTS[j])) & mask
    out[:, 0] = (out[:, 0] * odd) & mask  # odd factors can be undone
    for j in range(1, m):
        out[:, j] ^= _stir(out[:, 0], _SALTS[j + 1]) & mask
    return out


def restore(mixed: np.ndarray, bits: int) -> np.ndarray:
    out, mask, m = mixed.astype(_U), _U((1 << bits) - 1), mixed.shape[1]
    back = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    for j in range(1, m):
        out[:, j] ^= _stir(out[:, 0], _SALTS[j + 1]) & mask
    out[:, 0] = (out[:, 0] * back) & mask
    for j in range(1, m):
        out[:, 0] = (out[:, 0] - _stir(out[:, j], _SALTS[j])) & mask
    return out


def in_order(mixed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in the filter's order, the counts of equal ones added."""
    if not len(mixed):
        return mixed, counts
    order = np.lexsort(mixed.T[::-1])
    mixed, counts = mixed[order], counts[order]
    first = np.flatnonzero(np.append(True, (mixed[1:] != mixed[:-1]).any(1)))
    return mixed[first], np.add.reduceat(counts, first)


def _varints(x: np.ndarray) -> bytes:
    """Numbers in base 128, lowest digit first, a high bit on all digits but the last."""
    x = x.astype(_U)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >= _U(1 << 7 * k)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(x)), size)
    digit = np.arange(end[-1] if len(x) else 0) - np.repeat(end - size, size)
    low = (x[owner] >> (_U(7) * digit.astype(_U))) & _U(127)
    return (low.astype(np.uint8) | np.where(digit < size[owner] - 1, 128, 0).astype(np.uint8)).tobytes()


def _unvarints(raw: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The first ``n`` numbers of ``raw`` and the bytes they take."""
    if not n:
        return np.zeros(0, _U), 0
    ends = np.flatnonzero(raw < 128)[:n] + 1
    starts = np.append(0, ends[:-1])
    digit = np.arange(ends[-1]) - np.repeat(starts, ends - starts)
    parts = (raw[: ends[-1]] & 127).astype(_U) << (_U(7) * digit.astype(_U))
    return np.add.reduceat(parts, starts), int(ends[-1])


def _bytes(x: np.ndarray, size: int) -> bytes:
    return x.astype(">u8").view(np.uint8).reshape(len(x), 8)[:, 8 - size :].tobytes()


def _unbytes(raw: np.ndarray, n: int, size: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 8 - size :] = raw[: n * size].reshape(n, size)
    return wide.reshape(-1).view(">u8").astype(_U)


class QuotientFilter:
    """Entries ``mixed`` (in order, distinct) with ``counts``."""

    def __init__(self, mixed: np.ndarray, counts: np.ndarray, bits: int, quotient_bits: int = 16):
        self.mixed, self.counts, self.bits, self.shift = mixed, counts, bits, _U(bits - min(bits, quotient_bits))

    @classmethod
    def of(cls, ids: np.ndarray, bits: int, counts: np.ndarray | None = None) -> QuotientFilter:
        ones = np.ones(len(ids), np.int64) if counts is None else counts
        return cls(*in_order(permute(ids, bits), ones), bits)

    def merge(self, *others: QuotientFilter) -> QuotientFilter:
        all_ = [self, *others]
        return QuotientFilter(*in_order(np.concatenate([f.mixed for f in all_]), np.concatenate([f.counts for f in all_])), self.bits)

    def at_least(self, least: int) -> QuotientFilter:
        hit = self.counts >= least
        return QuotientFilter(self.mixed[hit], self.counts[hit], self.bits)

    def keys(self) -> np.ndarray:
        return restore(self.mixed, self.bits)

    def blocks(self, block_bits: int):
        """``(block, filter)`` for each range of slots that shares its high bits."""
        block = (self.mixed[:, 0] >> _U(self.bits - block_bits)).astype(np.int64) if block_bits else np.zeros(len(self.mixed), np.int64)
        edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(block[a]), QuotientFilter(self.mixed[a:b], self.counts[a:b], self.bits)

    def dump(self) -> bytes:
        n, m = self.mixed.shape
        slot = self.mixed[:, 0] >> self.shift
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if n else np.zeros(0, np.int64)
        steps = np.diff(slot[first], prepend=_U(0))
        head = np.array([n, m, len(first), self.bits, int(self.shift)], "<u8").tobytes()
        rests = [_bytes(self.mixed[:, 0] & ((_U(1) << self.shift) - _U(1)), (int(self.shift) + 7) // 8)] if self.shift else []
        rests += [_bytes(self.mixed[:, j], (self.bits + 7) // 8) for j in range(1, m)]
        return b"".join([head, _varints(steps), _varints(np.diff(first, append=n)), _varints(self.counts), *rests])

    @classmethod
    def load(cls, raw: bytes) -> QuotientFilter:
        n, m, slots, bits, shift = map(int, np.frombuffer(raw[:40], "<u8"))
        rest = np.frombuffer(raw, np.uint8)[40:]
        numbers = []
        for size in (slots, slots, n):
            found, used = _unvarints(rest, size)
            numbers.append(found)
            rest = rest[used:]
        steps, runs, counts = numbers
        mixed = np.zeros((n, m), _U)
        mixed[:, 0] = np.repeat(np.cumsum(steps), runs.astype(np.int64)) << _U(shift)
        if shift:
            size = (shift + 7) // 8
            mixed[:, 0] |= _unbytes(rest, n, size)
            rest = rest[n * size :]
        size = (bits + 7) // 8
        for j in range(1, m):
            mixed[:, j] = _unbytes(rest, n, size)
            rest = rest[n * size :]
        out = cls(mixed, counts.astype(np.int64), bits)
        out.shift = _U(shift)
        return out
