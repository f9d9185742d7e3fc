"""Cheapest repair of a role sequence by Four-Russians block tables.

A repaired conversation reads ``(s?(ua)+)?`` in role initials. For every place between rows there is a cost
vector: what the rest costs at least when the rows before have been read as nothing, ``s``, ``..u`` or ``..a``.
Less its minimum, such a vector is one of a few dozen, because an insertion leads from every state to the next.
The transition of each vector over every block of ``BLOCK`` row symbols is therefore computed once; a sequence
is read from its end block by block, two lookups a block. Tracing keeps the vectors at the block edges, expands
one block at a time backward into the vectors between its rows, and walks forward through it with the smallest
letter that keeps the cost, so that ties end in the ASCII-least edits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Rows read as nothing, ``s``, ``..u``, ``..a``.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
DELETE, CHANGE = 4, 3
#: Row symbols: 0 must go; 1 to 4 initials s, u, a, another; 5 to 8 the same, truncated; 9 pads a block.
MUST_GO, PAD, SYMBOLS = 0, 9, 10
BLOCK = 4
#: What an insertion or a new role yields in each state.
FORCED = (USER, USER, ASSISTANT, USER)
_FAR = 1 << 20
_KEEPS = {(EMPTY, 1): SYSTEM, (EMPTY, 2): USER, (SYSTEM, 2): USER, (USER, 3): ASSISTANT, (ASSISTANT, 2): USER}


def moves(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """``letter, cost, next state`` of the edits of one row, in ASCII order of the letters."""
    out = [("D", DELETE, state)]
    if symbol != MUST_GO:
        extra, role = (CHANGE, symbol - 4) if symbol > 4 else (0, symbol)
        if (state, role) in _KEEPS:
            out.append(("K", extra, _KEEPS[state, role]))
        out.append(("R", CHANGE + extra, FORCED[state]))
    return out


def _with_insertions(costs: list[int]) -> tuple[int, ...]:
    user = min(costs[USER], CHANGE + costs[ASSISTANT])
    out = list(costs)
    out[USER] = user
    return tuple(min(c, CHANGE + user) if s != USER else user for s, c in enumerate(out))


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The cost vector in front of a row, from the one behind it."""
    if symbol == PAD:
        return after
    return _with_insertions([min(cost + after[to] for _, cost, to in moves(s, symbol)) for s in range(STATES)])


class Tables:
    """All vectors, their transitions over one symbol and over a block of symbols."""

    def __init__(self, block: int = BLOCK):
        end = _with_insertions([0, _FAR, _FAR, 0])
        known, self.vectors, one = {end: 0}, [end], []
        for vector in self.vectors:
            row = []
            for symbol in range(SYMBOLS):
                reached = _before(vector, symbol)
                low = min(reached)
                least = tuple(c - low for c in reached)
                if least not in known:
                    known[least] = len(self.vectors)
                    self.vectors.append(least)
                row.append((known[least], low))
            one.append(row)
        self.block = block
        self.one_to, self.one_add = (np.array([[x[i] for x in row] for row in one]) for i in range(2))
        #: A block's number is its symbols as digits, the first one lowest.
        digits = np.arange(SYMBOLS**block)
        to = np.repeat(np.arange(len(self.vectors))[:, None], len(digits), axis=1)
        add = np.zeros_like(to)
        for place in reversed(range(block)):
            symbol = digits // SYMBOLS**place % SYMBOLS
            add += self.one_add[to, symbol]
            to = self.one_to[to, symbol]
        self.to, self.add = to.astype(np.int32), add.astype(np.int32)
        self.weights = SYMBOLS ** np.arange(block)

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        padded = np.full(-(-len(symbols) // self.block) * self.block, PAD, dtype=np.int64)
        padded[: len(symbols)] = symbols
        return padded.reshape(-1, self.block) @ self.weights

    def through(self, symbols: np.ndarray) -> np.ndarray:
        """The vector in front of ``symbols`` for each vector behind them."""
        at = np.arange(len(self.vectors))
        for number in self.blocks(symbols)[::-1]:
            at = self.to[at, number]
        return at

    def edges(self, symbols: np.ndarray, right: int = 0) -> tuple[list[int], int, int]:
        """The vector behind each block; the vector in front of all and its distance from the normalised one."""
        behind, at, total = [], right, 0
        for number in self.blocks(symbols)[::-1].tolist():
            behind.append(at)
            total += int(self.add[at, number])
            at = int(self.to[at, number])
        return behind[::-1], at, total

    def trace(self, symbols: np.ndarray, right: int = 0, state: int = EMPTY, last: bool = True) -> tuple[str, int, int]:
        """Letters of the cheapest edits from ``state``, their cost, and the state reached.

        Insertions behind the last row belong to what follows unless it is the ``last`` piece.
        """
        behind, _, _ = self.edges(symbols, right)
        letters, spent = [], 0
        for number, edge in enumerate(behind):
            piece = symbols[number * self.block : (number + 1) * self.block].tolist()
            # Expanded backward: the vectors between this block's rows, with their distances.
            inner, at, low = [(edge, 0)], edge, 0
            for symbol in reversed(piece):
                low += int(self.one_add[at, symbol])
                at = int(self.one_to[at, symbol])
                inner.append((at, low))
            inner.reverse()
            for place, symbol in enumerate(piece):
                here, there = (lambda s, v=inner[p]: self.vectors[v[0]][s] + v[1] for p in (place, place + 1))
                while True:
                    left = here(state)
                    choice = [("I", CHANGE, FORCED[state], CHANGE + here(FORCED[state]))]
                    choice += [(a, cost, to, cost + there(to)) for a, cost, to in moves(state, symbol)]
                    letter, cost, state, _ = min(c for c in choice if c[3] == left)
                    letters.append(letter)
                    spent += cost
                    if letter != "I":
                        break
        while last and state in (SYSTEM, USER):
            letters.append("I")
            spent, state = spent + CHANGE, FORCED[state]
        return "".join(letters), spent, state


@lru_cache(maxsize=4)
def tables(block: int = BLOCK) -> Tables:
    """The tables, built once in each process."""
    return Tables(block)
