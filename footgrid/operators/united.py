"""Capsules of few lines united within a task: what ``polygons.overlay`` does with tables, for many small groups at once.

Edges lie on a grid of integers. They are cut where they meet, in rounds, as ``polygons.noded`` cuts them; of each piece it is counted how many capsules cover its
left and its right, and pieces that the union has on one side only are its boundary. Rows of a batch hold many groups, and arrays hold all of them: nothing is done group by group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of the arrays in which the edges of some groups are compared.
MOST_CELLS = 1 << 20
FAR = 1 << 62


def _rounded(x: np.ndarray) -> np.ndarray:
    """To the nearest number, halves away from zero, as Spark rounds."""
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    return np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def capsules(lines: np.ndarray, width: float, quarter: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and ends of the sides of what lies within ``width`` of each line (x0, y0, x1, y1)."""
    turn = np.arctan2((lines[:, 3] - lines[:, 1]).astype(float), (lines[:, 2] - lines[:, 0]).astype(float))[:, None]
    turns = np.array([math.pi / 2 * i / quarter for i in range(2 * quarter + 1)])
    angle = np.concatenate([turn + (turns - math.pi / 2), turn + (turns + math.pi / 2)], axis=1)
    end = np.repeat([2, 0], len(turns))
    x, y = lines[:, end] + _rounded(width * np.cos(angle)), lines[:, end + 1] + _rounded(width * np.sin(angle))
    sides = np.stack([x, y, np.roll(x, -1, 1), np.roll(y, -1, 1)], axis=2).reshape(-1, 4)
    line = np.repeat(np.arange(len(lines)), 2 * len(turns))
    some = (sides[:, 0] != sides[:, 2]) | (sides[:, 1] != sides[:, 3])
    return line[some], sides[some]


def _pairs(groups: int, of_a: np.ndarray, a: list, of_b: np.ndarray, b: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and of ``b`` of one group whose ranges meet in each dimension. Both: a low and a high for each dimension; rows are sorted by their group."""
    n_a, n_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    order = np.argsort(n_a * n_b, kind="stable")
    order = order[(n_a * n_b)[order] > 0]
    while len(order):
        # From the largest groups on, as many as fit.
        some = order[-max(1, MOST_CELLS // int(n_a[order[-1]] * n_b[order[-1]])) :]
        order = order[: len(order) - len(some)]
        (rows_a, no_a), (rows_b, no_b) = ((first[some, None] + np.arange(w := n[some].max()), np.arange(w) >= n[some, None]) for first, n in ((first_a, n_a), (first_b, n_b)))
        rows_a[no_a] = rows_b[no_b] = 0
        met = ~(no_a[:, :, None] | no_b[:, None, :])
        for (low_a, high_a), (low_b, high_b) in zip(a, b):
            if low_a is not None and high_b is not None:
                met &= low_a[rows_a][:, :, None] <= high_b[rows_b][:, None, :]
            if high_a is not None and low_b is not None:
                met &= low_b[rows_b][:, None, :] <= high_a[rows_a][:, :, None]
        at = np.flatnonzero(met)
        g, at = np.divmod(at, rows_a.shape[1] * rows_b.shape[1])
        i, j = np.divmod(at, rows_b.shape[1])
        yield rows_a[g, i], rows_b[g, j]


def _narrow(x: np.ndarray) -> np.ndarray:
    """As 32 bits where that is enough: compared twice as fast."""
    return x.astype(np.int32) if len(x) and np.abs(x).max() < 1 << 31 else x


def _cuts(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places where pairs of edges meet, strictly inside one of them: number of the pair, whether it is the second edge that is cut there, x, y, and whether they are beside its line."""
    ax, ay, bx, by = p[:, 2] - p[:, 0], p[:, 3] - p[:, 1], q[:, 2] - q[:, 0], q[:, 3] - q[:, 1]
    wx, wy = q[:, 0] - p[:, 0], q[:, 1] - p[:, 1]
    d, aside = ax * by - ay * bx, wx * ay - wy * ax
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (wx * by - wy * bx) / d, aside / d
    one = np.flatnonzero((d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    line = np.flatnonzero((d == 0) & (aside == 0))
    pair = np.concatenate([one, *[line] * 4])
    x = np.concatenate([_rounded(p[one, 0] + t[one] * ax[one]), p[line, 0], p[line, 2], q[line, 0], q[line, 2]])
    y = np.concatenate([_rounded(p[one, 1] + t[one] * ay[one]), p[line, 1], p[line, 3], q[line, 1], q[line, 3]])
    out = []
    for second, of in ((False, p), (True, q)):
        x0, y0, x1, y1 = of[pair].T
        inside = (x >= np.minimum(x0, x1)) & (x <= np.maximum(x0, x1)) & (y >= np.minimum(y0, y1)) & (y <= np.maximum(y0, y1)) & ((x != x0) | (y != y0)) & ((x != x1) | (y != y1))
        off = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) != 0
        out.append((pair[inside], np.full(inside.sum(), second), x[inside], y[inside], off[inside]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _split(ends: np.ndarray, edge: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges cut at places (number of the edge, x, y): the edge that each piece is of, and pieces, in the order of the edges."""
    cut = np.zeros(len(ends), bool)
    cut[edge] = True
    whole, cut = np.flatnonzero(~cut), np.flatnonzero(cut)
    edge, x, y = np.concatenate([cut, cut, edge]), np.concatenate([ends[cut, 0], ends[cut, 2], x]), np.concatenate([ends[cut, 1], ends[cut, 3], y])
    x0, y0, x1, y1 = ends[edge].T
    order = np.lexsort((y, x, (x - x0) * (x1 - x0) + (y - y0) * (y1 - y0), edge))
    edge, x, y = edge[order], x[order], y[order]
    piece = (edge[1:] == edge[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    edge, pieces = np.concatenate([whole, edge[:-1][piece]]), np.concatenate([ends[whole], np.stack([x[:-1], y[:-1], x[1:], y[1:]], axis=1)[piece]])
    order = np.argsort(edge, kind="stable")
    return edge[order], pieces[order]


def _boxes(ends: np.ndarray) -> list:
    """Lows and highs in x and in y."""
    return [(_narrow(np.minimum(ends[:, i], ends[:, i + 2])), _narrow(np.maximum(ends[:, i], ends[:, i + 2]))) for i in (0, 1)]


def noded(groups: int, group: np.ndarray, line: np.ndarray, ends: np.ndarray, most_rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Group and ends of the sides of capsules, cut where they meet. Sides of one capsule meet at their ends only, so these are compared only once they are bent by rounding."""
    bent = np.ones(len(ends), bool)
    for turn in range(most_rounds):
        boxes, rows = _boxes(ends), np.flatnonzero(bent)
        found = []
        for i, j in _pairs(groups, group[rows], [(low[rows], high[rows]) for low, high in boxes], group, boxes):
            i = rows[i]
            # A pair of bent edges is met twice.
            own = (i < j) & (line[i] != line[j]) if not turn else (i != j) & ((i < j) | ~bent[j])
            i, j = i[own], j[own]
            pair, second, x, y, off = _cuts(ends[i], ends[j])
            found.append((np.where(second, j[pair], i[pair]), x, y, off))
        cut, x, y, off = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        if not len(cut):
            return group, ends
        crooked = np.zeros(len(ends), bool)
        crooked[cut[off]] = True
        of, ends = _split(ends, cut, x, y)
        group, line, bent = group[of], line[of], crooked[of]
        if not bent.any():
            return group, ends
    raise ArithmeticError(f"edges still meet after {most_rounds} rounds of cuts")


def union(groups: int, group: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and directed ends of the boundary of what the directed pieces of each group enclose, its inside on the left."""
    x0, y0, x1, y1 = ends.T
    ahead = (x0 < x1) | ((x0 == x1) & (y0 < y1))
    turned = np.where(ahead[:, None], ends, ends[:, [2, 3, 0, 1]])
    order = np.lexsort((*turned.T[::-1], group))
    group, turned, sign = group[order], turned[order], np.where(ahead, 1, -1)[order]
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (turned[1:] != turned[:-1]).any(axis=1)][: len(group)])
    weight = np.add.reduceat(sign, first) if len(first) else sign
    some = weight != 0
    group, own, weight = group[first][some], turned[first][some], weight[some]
    x0, y0, x1, y1 = (2 * own).T
    mx, my = own[:, 0] + own[:, 2], own[:, 1] + own[:, 3]
    counted = []
    # What is above a middle, or just to the right of it: the edges there that it has below.
    at, column, highest = _narrow(mx), (_narrow(x0), _narrow(x1 - 1)), _narrow(np.maximum(y0, y1))
    for i, j in _pairs(groups, group, [(at, at), (_narrow(my), None)], group, [column, (None, highest)]):
        above = (x1[j] - x0[j]) * (my[i] - y0[j]) - (y1[j] - y0[j]) * (mx[i] - x0[j]) < 0
        counted.append((i[above], weight[j[above]]))
    i, w = (np.concatenate(c) for c in zip(*counted)) if counted else (np.zeros(0, np.int64),) * 2
    over = -np.bincount(i, w, len(own)).astype(np.int64)
    upright = own[:, 0] == own[:, 2]
    left, right = over + np.where(upright, weight, 0), over - np.where(upright, 0, weight)
    kept = (left > 0) != (right > 0)
    directed = np.where((left > 0)[:, None], own, own[:, [2, 3, 0, 1]])
    return group[kept], directed[kept]


def widened(batches, keys: list[str], width: float, quarter: int, most_rounds: int):
    """Arrow batches of the boundary (keys, ends) of what lies within ``width`` of the lines of each group. Batches come sorted by group: keys, ends, ``i`` (from 1) and ``n``, a
    row's number in its group and the rows that this has. A group that a batch breaks off is carried on to the next."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        i, n = batch.column("i")[-1].as_py(), batch.column("n")[-1].as_py()
        broken = i if i < n else 0
        whole = batch.num_rows - broken
        if whole <= 0:  # not even one group's end
            rest.append(batch)
            continue
        table = pa.Table.from_batches([*rest, batch.slice(0, whole)]).combine_chunks()
        rest = [batch.slice(whole)] if broken else []
        group = np.cumsum(table.column("i").to_numpy() == 1) - 1
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        lines = np.stack([table.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1)
        origin = lines[first][:, [0, 1, 0, 1]]
        lines = lines - origin[group]
        line, sides = capsules(lines, width, quarter)
        own, ends = union(len(first), *noded(len(first), group[line], line, sides, most_rounds))
        ends = ends + origin[own]
        names = table.select(keys).take(pa.array(first[own]))
        columns = {k: names.column(k).combine_chunks() for k in keys} | {c: pa.array(ends[:, k]) for k, c in enumerate(("x0", "y0", "x1", "y1"))}
        out = pa.table(columns)
        yield from out.to_batches()
