"""DartMinHash signatures of weighted sets.

For every element the plane of weight and rank is strewn with darts, a Poisson
process of density one that depends only on the element's hash.  Darts within the
element's weight hit.  Each dart belongs to one of ``k`` coordinates, and the
signature keeps the hit of the smallest rank in each.  Two sets agree in a
coordinate with the chance of their weighted Jaccard similarity.  Only ranks up to
theta = T / total weight are drawn, about T hits whatever the size of the set; a
set with an empty coordinate is drawn again with twice the theta.

Weight is cut into unit cells and rank into dyadic cells, so an element with little
weight, or ranks beyond theta, costs nothing.
"""

from __future__ import annotations

import math

import numpy as np

from .shingles import mix

_FIRST = 1.0 / 16  # the first rank cell; each further cell ends at twice the rank
_U = np.uint64
_cdfs: dict[float, np.ndarray] = {}


def _poisson_cdf(lam: float) -> np.ndarray:
    if lam not in _cdfs:
        top = int(lam + 12 * math.sqrt(lam) + 16)
        logs = np.arange(top) * math.log(lam) - lam - np.cumsum(np.log(np.maximum(np.arange(top), 1)))
        _cdfs[lam] = np.cumsum(np.exp(logs))
    return _cdfs[lam]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * (1.0 / (1 << 53))


def signatures(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """``n_docs`` x ``k`` dart ids (0 in the rows of empty sets)."""
    out = np.zeros((n_docs, k), np.uint64)
    total = np.bincount(doc, weights, n_docs)
    todo = np.flatnonzero(total > 0)
    theta = np.zeros(n_docs)
    theta[todo] = k * (math.log(k) + 2) / total[todo]
    cells = np.ceil(weights).astype(np.int64)
    cell = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
    within = np.minimum(1.0, np.repeat(weights, cells) - cell)
    cdoc = np.repeat(doc, cells)
    seed = np.repeat(hashes, cells) + cell.astype(np.uint64) * _U(0xD1B54A32D192ED03)
    while len(todo):
        live = np.zeros(n_docs, bool)
        live[todo] = True
        full = _draw(cdoc, seed, within, live, theta, k, out)
        todo = todo[~full[todo]]
        theta[todo] *= 2
    return out


def _draw(cdoc, seed, within, live, theta, k, out) -> np.ndarray:
    docs, ids, ranks = [], [], []
    lo, hi, level = 0.0, _FIRST, 0
    limit = np.where(live, theta, 0.0)[cdoc]
    at = np.flatnonzero(limit > lo)
    while len(at):
        lam = hi - lo
        base = mix(seed[at] ^ _U((level + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
        n = np.searchsorted(_poisson_cdf(lam), _unit(base), side="right")
        some = np.flatnonzero(n)
        n = n[some]
        which = np.repeat(at[some], n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(np.repeat(base[some], n) + (nth.astype(np.uint64) + _U(1)) * _U(0xE7037ED1A0B428DB))
        rank = lo + lam * _unit(dart)
        hit = rank < limit[which]
        if within.min() < 1.0:
            hit &= _unit(mix(dart ^ _U(0x8EBC6AF09C88C6E3))) < within[which]
        docs.append(cdoc[which[hit]])
        ids.append(dart[hit])
        ranks.append(rank[hit])
        lo, hi, level = hi, 2 * hi, level + 1
        at = at[limit[at] > lo]
    docs, ids, ranks = np.concatenate(docs), np.concatenate(ids), np.concatenate(ranks)
    slot = docs * k + (mix(ids ^ _U(0x589965CC75374CC3)) % _U(k)).astype(np.int64)
    order = np.lexsort((ranks, slot))
    slot, ids = slot[order], ids[order]
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    got, ids = slot[first], ids[first]
    filled = np.bincount(got // k, minlength=len(out)) == k
    use = filled[got // k]
    out.reshape(-1)[got[use]] = ids[use]
    return filled


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    n, k = signature.shape
    bands = signature.reshape(n, k // rows, rows)
    key = np.zeros(bands.shape[:2], np.uint64)
    for r in range(rows):
        key = mix(key ^ bands[:, :, r])
    return mix(key + np.arange(k // rows, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15))
