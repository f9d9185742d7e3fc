"""Two-level hierarchical Pitman-Yor restaurants, seated by Gibbs sampling with numpy.

Every context is a restaurant, every occurrence of a word in it a customer; customers of a word sit at tables of
that word, and each table is one customer of the parent restaurant, which all contexts share. The state of a
(context, word) pair with c customers is its number of tables t, the seating itself being summed out: given
everything else,

    P(t) ~ S(c, t) * prod_{i<t} (theta + d * (T + i)) * parent(word) ** t

with T the other tables of the restaurant and S the generalised Stirling numbers. A sweep draws every t anew,
in interleaved blocks, with T brought up to date after each block. Up to ``EXACT`` customers the draw is from this
distribution; later customers of a more frequent pair are seated in batches that grow by a twentieth, the
number of new tables in a batch being binomial.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EXACT = 96
THETA = 1.0
BLOCKS = 4
_CELLS = 1 << 18


@lru_cache(maxsize=8)
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c, t up to ``most``."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        stay = table[c] + np.log(np.maximum(c - t * discount, 1e-300))
        table[c + 1] = np.where(t <= c + 1, np.logaddexp(np.concatenate([[-np.inf], table[c, :-1]]), stay), -np.inf)
        table[c + 1, 0] = -np.inf
    return table


def discount_of(once: int, twice: int) -> float:
    """A discount from the numbers of words that occur once and twice."""
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once + twice else 0.5


def sweep(room: np.ndarray, customers: np.ndarray, tables: np.ndarray, log_parent: np.ndarray, rooms: int,
          discount: float, rng: np.random.Generator) -> np.ndarray:
    """New numbers of tables; ``room`` numbers the restaurant of each pair from 0."""
    tables = tables.copy()
    totals = np.bincount(room, weights=tables, minlength=rooms)
    block_of = rng.integers(0, BLOCKS, len(room))
    for block in range(BLOCKS):
        at = np.flatnonzero((block_of == block) & (customers > 1))
        if not len(at):
            continue
        others = totals[room[at]] - tables[at]
        new = _draw(customers[at], others, log_parent[at], discount, rng)
        np.add.at(totals, room[at], new - tables[at])
        tables[at] = new
    return tables


def _draw(customers, others, log_parent, discount, rng) -> np.ndarray:
    stirling = log_stirling(discount)
    out = np.ones(len(customers), dtype=np.int64)
    first = np.minimum(customers, EXACT)
    order = np.argsort(first, kind="stable")
    cuts = np.flatnonzero(np.diff(first[order])) + 1
    for same in np.split(order, cuts):
        c = int(first[same[0]])
        step = max(1, _CELLS // c)
        for a in range(0, len(same), step):
            rows = same[a : a + step]
            grow = np.cumsum(np.log(THETA + discount * (others[rows][:, None] + np.arange(c))), axis=1)
            logits = stirling[c, 1 : c + 1] + grow + np.arange(1, c + 1) * log_parent[rows][:, None]
            # The largest of the logits with Gumbel noise is a draw from their softmax.
            out[rows] = 1 + (logits - np.log(-np.log(rng.random(logits.shape)))).argmax(axis=1)
    live = np.flatnonzero(customers > EXACT)
    seated = np.full(len(live), EXACT, dtype=np.int64)
    while len(live):
        batch = np.minimum(np.maximum(seated // 20, 1), customers[live] - seated)
        fresh = (THETA + discount * (others[live] + out[live])) * np.exp(log_parent[live])
        chance = fresh / (fresh + np.maximum(seated - discount * out[live], 1e-9))
        out[live] += rng.binomial(batch, np.clip(chance, 0.0, 1.0))
        seated = seated + batch
        more = seated < customers[live]
        live, seated = live[more], seated[more]
    return np.minimum(out, customers)


class Root:
    """The restaurant that all contexts share; its own parent is uniform over ``words``."""

    def __init__(self, words: int):
        self.words = words
        self.tables: np.ndarray | None = None
        self.discount = 0.5

    def reseat(self, customers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Seat the children's tables as customers and return the predictive distribution."""
        at = np.flatnonzero(customers)
        if self.tables is None:
            self.tables = np.zeros(self.words, dtype=np.int64)
            self.discount = discount_of(int((customers == 1).sum()), int((customers == 2).sum()))
        count = customers[at].astype(np.int64)
        start = np.clip(self.tables[at], 1, np.maximum(count, 1))
        uniform = np.full(len(at), -np.log(self.words))
        self.tables[:] = 0
        self.tables[at] = sweep(np.zeros(len(at), dtype=np.int64), count, start, uniform, 1, self.discount, rng)
        share = np.where(customers > 0, customers - self.discount * self.tables, 0.0)
        rest = THETA + self.discount * self.tables.sum()
        return (share + rest / self.words) / (THETA + customers.sum())


def seen_part(customers, tables, room_customers, discount) -> np.ndarray:
    """What a pair's own customers contribute to its predictive probability."""
    return (customers - discount * tables) / (THETA + room_customers)


def rest_part(room_customers, room_tables, discount) -> np.ndarray:
    """What a restaurant leaves to its parent."""
    return (THETA + discount * room_tables) / (THETA + room_customers)
