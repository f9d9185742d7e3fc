"""DartMinHash signatures of weighted sets, computed for many sets at once with numpy.

Every element owns the plane of (weight, rank) points, and darts fall on it as a Poisson process that
depends on the element alone. A set sees the darts whose weight coordinate is below the element's weight
in the set and whose rank is below a limit; each dart belongs to one of k coordinates, and the signature
keeps the earliest rank per coordinate. Two sets agree in a coordinate with the probability of their
weighted Jaccard similarity. The limit is chosen so that about ``k * (ln k + 2)`` darts are seen, whatever
the size of the set; sets with an empty coordinate look again with twice the limit.

The plane is cut into cells, so that only cells below the limit are looked at: rank cells are
[0, 1/16), [1/16, 1/8), [1/8, 1/4) ... and weight cells [0, 1), [1, 2), [2, 4) ...
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_FIRST_RANK = 1 / 16
_UNIT = 2.0**-53


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * _UNIT


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Inverse distribution function of a Poisson number at ``u``."""
    count = np.zeros(len(u), dtype=np.int64)
    term = total = np.exp(-mean)
    live = np.flatnonzero(u >= total)
    j = 0
    while len(live):
        count[live] += 1
        j += 1
        term *= mean / j
        total += term
        live = live[u[live] >= total] if j < 20 * mean + 60 else live[:0]
    return count


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def signatures(elements: np.ndarray, weights: np.ndarray | None, owner: np.ndarray, sets: int, k: int) -> np.ndarray:
    """Signature bits (``sets`` x ``k`` of uint64; all ones for an empty set).

    ``elements`` are uint64 hashes, ``owner`` gives the set of each, ``weights`` its weight (None: 1 each).
    An element named twice in a set with the same weight counts once.
    """
    best = np.full(sets * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    size = np.bincount(owner, weights=weights, minlength=sets).astype(np.float64)
    limit = np.zeros(sets)
    limit[size > 0] = k * (np.log(k) + 2) / size[size > 0]
    done = np.zeros(sets)
    todo = size > 0
    while todo.any():
        chosen = todo[owner]
        e, o = elements[chosen], owner[chosen]
        w = None if weights is None else weights[chosen]
        _throw(best, e, w, o, limit, done, k)
        done = np.where(todo, limit, done)
        todo &= (best.reshape(sets, k) == np.iinfo(np.uint64).max).any(axis=1)
        limit = np.where(todo, limit * 2, limit)
    return best.reshape(sets, k)


def _throw(best, elements, weights, owner, limit, done, k) -> None:
    """Darts with a rank below the limits of their sets; cells wholly below ``done`` were thrown before."""
    cell, low = 0, 0.0
    top, seen = limit[owner], done[owner]
    while True:
        high = _FIRST_RANK * 2.0**cell
        at = np.flatnonzero((top > low) & (seen < high))
        if not (top > low).any():
            return
        if len(at):
            strip, wlow = 0, 0.0
            while len(at):
                whigh = 2.0**strip
                area = (high - low) * (whigh - wlow)
                tag = _U((cell + 1) * 1000003 + strip * 7919)
                with np.errstate(over="ignore"):
                    region = mix(elements[at] + tag * _GOLDEN)
                counts = _poisson(_unit(region), area)
                hit = np.flatnonzero(counts)
                times = counts[hit]
                with np.errstate(over="ignore"):
                    darts = mix(np.repeat(region[hit], times) + (_ranges(times).astype(np.uint64) + _U(1)) * _GOLDEN)
                who = np.repeat(at[hit], times)
                second = mix(darts ^ _GOLDEN)
                rank = low + (high - low) * _unit(second)
                keep = rank < top[who]
                if weights is not None:
                    keep &= wlow + (whigh - wlow) * _unit(mix(second ^ _GOLDEN)) < weights[who]
                darts, who, rank = darts[keep], who[keep], rank[keep]
                slot = owner[who] * k + (darts % _U(k)).astype(np.int64)
                np.minimum.at(best, slot, rank.view(np.uint64))
                if weights is None:
                    break
                at = at[weights[at] > whigh]
                strip, wlow = strip + 1, whigh
        cell, low = cell + 1, high


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash per run of ``rows`` coordinates and its number."""
    sets, k = signature.shape
    out = np.tile(np.arange(k // rows, dtype=np.uint64), (sets, 1))
    for r in range(rows):
        with np.errstate(over="ignore"):
            out = mix(out * _GOLDEN + signature[:, r : rows * (k // rows) : rows] + _U(r + 1))
    return out


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for the words met lately."""

    MOST = 1 << 17

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(hashes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and their documents; a shorter document is one run.

    ``hashes`` holds the words of all documents one after the other, ``lengths`` the words of each.
    """
    starts = np.cumsum(lengths) - lengths
    runs = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    owner = np.repeat(np.arange(len(lengths)), runs)
    at = np.repeat(starts, runs) + _ranges(runs)
    padded = np.concatenate([hashes, np.zeros(n, dtype=np.uint64)])
    width = np.repeat(np.minimum(lengths, n), runs)
    out = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            word = padded[at + i]
            out = np.where(i < width, mix(out * _GOLDEN + word + _U(i + 1)), out)
    return out, owner
