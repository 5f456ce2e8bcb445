"""Progressive alignment of token sequences into a profile of weighted columns, and the consensus voted from it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: A vote: how many rows cast it, and the latest of them (comparable, later is greater).
Vote = tuple[int, tuple]
#: A column: votes by token; "" is the gap. All columns of a profile hold the votes of all its rows.
Column = dict[str, Vote]

#: Cells of a table of moves held at once; greater ones are halved first (Hirschberg), which finds the same path.
CELLS = 1 << 26
#: Below this many cells plain lists are faster than arrays.
FEW = 512


def _added(column: Column, token: str, vote: Vote) -> None:
    old = column.get(token)
    column[token] = vote if old is None else (old[0] + vote[0], max(old[1], vote[1]))


def _rows(skip: np.ndarray, insert: np.ndarray, sub, first: int, last: int, keep: bool):
    """Least costs after sequence items ``first`` to ``last`` (exclusive) and each number of columns; with ``keep`` also
    the moves: 0 skips a column, 1 pairs, 2 inserts."""
    n = len(skip)
    run = np.concatenate([[0], np.cumsum(skip)])
    cost = run.copy()
    moves = np.zeros((last - first + 1, n + 1), np.int8) if keep else None
    for i in range(first, last):
        down = cost + insert[i]
        pair = down.copy()
        pair[1:] = cost[:-1] + sub(i)
        best = np.minimum(pair, down)
        new = np.minimum.accumulate(best - run) + run
        if keep:
            # leftmost path: skip if a skip reaches the least cost, else pair, else insert
            row = moves[i - first + 1]
            row[:] = np.where(pair <= down, 1, 2)
            row[0] = 2
            row[1:][new[1:] == new[:-1] + skip] = 0
        cost = new
    return cost, moves


def path(skip: Sequence[int], insert: Sequence[int], sub) -> list[int]:
    """The leftmost path of least total cost through n columns and m items, as moves: 0 skips a column (``skip[j]``), 1
    pairs item i with the next column (``sub(i)[j]``), 2 inserts item i as a new column (``insert[i]``).

    Of equally good paths the one that has passed fewer columns wins (backwards: columns are skipped first), so the
    result is one and the same for every way of working it out.
    """
    skip, insert = np.asarray(skip, np.int64), np.asarray(insert, np.int64)
    out: list[int] = []

    def solve(c0: int, c1: int, r0: int, r1: int) -> None:
        part, here = skip[c0:c1], lambda i: sub(i)[c0:c1]
        if (c1 - c0 + 1) * (r1 - r0 + 1) <= CELLS or r1 - r0 < 2:
            _, moves = _rows(part, insert, here, r0, r1, True)
            i, j, back = r1 - r0, c1 - c0, []
            while i or j:
                move = 0 if i == 0 else int(moves[i, j])
                back.append(move)
                i, j = i - (move != 0), j - (move != 2)
            out.extend(reversed(back))
            return
        middle = (r0 + r1) // 2
        ahead, _ = _rows(part, insert, here, r0, middle, False)
        behind, _ = _rows(part[::-1], insert[::-1], lambda i: here(len(insert) - 1 - i)[::-1], len(insert) - r1, len(insert) - middle, False)
        split = c0 + int(np.argmin(ahead + behind[::-1]))
        solve(c0, split, r0, middle)
        solve(split, c1, middle, r1)

    if (len(skip) + 1) * (len(insert) + 1) <= FEW:
        return _small(skip.tolist(), insert.tolist(), sub)
    solve(0, len(skip), 0, len(insert))
    return out


def _small(skip: list[int], insert: list[int], sub) -> list[int]:
    n, m = len(skip), len(insert)
    cost = [[0] * (n + 1)]
    for j in range(n):
        cost[0][j + 1] = cost[0][j] + skip[j]
    for i in range(m):
        paired, above = sub(i), cost[-1]
        row = [above[0] + insert[i]]
        for j in range(n):
            row.append(min(row[j] + skip[j], above[j] + paired[j], above[j + 1] + insert[i]))
        cost.append(row)
    i, j, back = m, n, []
    while i or j:
        if j and cost[i][j] == cost[i][j - 1] + skip[j - 1]:
            back.append(0)
            j -= 1
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + sub(i - 1)[j - 1]:
            back.append(1)
            i, j = i - 1, j - 1
        else:
            back.append(2)
            i -= 1
    return back[::-1]


class Profile:
    """Columns of votes. Values are aligned with it one after the other, and profiles with each other."""

    def __init__(self) -> None:
        self.columns: list[Column] = []
        self.total: Vote | None = None

    @classmethod
    def of(cls, tokens: Sequence[str], vote: Vote) -> Profile:
        made = cls()
        made.columns, made.total = [{t: vote} for t in tokens], vote
        return made

    def merge(self, other: Profile) -> None:
        """Aligns another profile with this one at the least sum over pairs of rows that differ in a column (a gap
        differs from any token), and adds its votes."""
        if self.total is None:
            self.columns, self.total = other.columns, other.total
            return
        mine, theirs = self.total[0], other.total[0]
        gap = lambda column: column.get("", (0,))[0]
        skip = [theirs * (mine - gap(c)) for c in self.columns]
        insert = [mine * (theirs - gap(c)) for c in other.columns]
        places: dict[str, list[tuple[int, int]]] = {}
        for j, column in enumerate(self.columns):
            for token, (votes, _) in column.items():
                places.setdefault(token, []).append((j, votes))
        worst, small = mine * theirs, (len(skip) + 1) * (len(insert) + 1) <= FEW

        def sub(i: int):
            row = [worst] * len(skip) if small else np.full(len(skip), worst, np.int64)
            for token, (votes, _) in other.columns[i].items():
                for j, held in places.get(token, ()):
                    row[j] -= votes * held
            return row

        merged, i, j = [], 0, 0
        for move in path(skip, insert, sub):
            column = dict(self.columns[j]) if move != 2 else {"": self.total}
            for token, vote in (other.columns[i] if move else {"": other.total}).items():
                _added(column, token, vote)
            merged.append(column)
            i, j = i + (move != 0), j + (move != 2)
        self.columns, self.total = merged, (mine + theirs, max(self.total[1], other.total[1]))

    def consensus(self, recency: bool) -> list[str]:
        """The winning token of each column, gaps left out: most rows, then the latest; or, by recency, that of the
        latest row, which is the vote in which each row outweighs all rows before it together."""
        key = (lambda item: (item[1][1], item[1][0], item[0])) if recency else (lambda item: (item[1][0], item[1][1], item[0]))
        return [token for token, _ in (max(c.items(), key=key) for c in self.columns) if token]


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Tokens to be inserted, left out or replaced to turn one sequence into the other."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(t, len(codes)) for t in s]) for s in (a, b))
    cost, _ = _rows(np.ones(len(x), np.int64), np.ones(len(y), np.int64), lambda i: (x != y[i]).astype(np.int64), 0, len(y), False)
    return int(cost[-1])
