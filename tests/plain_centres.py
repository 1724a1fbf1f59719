"""Centres refined one by one, in order: the brute-force version that the set-based operators are held against."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np

from footgrid.functions.codes import QUEEN
from footgrid.operators.components import local_labels
from footgrid.operators.walk import FAR, ROOT2, relaxed, steps_within
from footgrid.plans.centres import M2_PER_PERSON, MEAN_DENSITY, MOST_BLOB, inner_point


class Refiner:
    """Centres of one plan. Homes are its new cells; walks enter any cell but those of code 0."""

    def __init__(self, plan: np.ndarray, block_m: float, walk_m: float):
        self.plan, self.block, self.walk = plan, block_m, walk_m
        self.built, self.new = np.isin(plan, (2, 3, 4, 5)), np.isin(plan, (2, 3))
        self.limit, self.reach = walk_m / block_m, steps_within(walk_m, block_m)
        self.settlement = local_labels(self.built, True)
        self.homes = np.argwhere(self.new)
        self.fixed = self._points(plan == 5)
        self.fields: dict[tuple[int, int], tuple[int, int, np.ndarray]] = {}

    @staticmethod
    def _points(mask: np.ndarray) -> list[tuple[int, int]]:
        labels = local_labels(mask, True)
        return [p for root in np.unique(labels[labels >= 0]) if (p := inner_point(labels == root))]

    def field(self, at: tuple[int, int]) -> tuple[int, int, np.ndarray]:
        """Walks from a point, in blocks, over a window; kept by point."""
        if at not in self.fields:
            n = self.reach
            r0, c0 = max(0, at[0] - n), max(0, at[1] - n)
            open_ = self.plan[r0 : at[0] + n + 1, c0 : at[1] + n + 1] != 0
            start = np.zeros(open_.shape, bool)
            start[at[0] - r0, at[1] - c0] = True
            s, d = relaxed(start, open_, self.limit)
            self.fields[at] = r0, c0, np.where(s < FAR, s + d * ROOT2, np.inf)
        return self.fields[at]

    def nearest(self, points: Sequence[tuple[int, int]], own_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distance to and index of each cell's nearest point (-1: none); the first wins ties."""
        best, which = np.full(self.plan.shape, np.inf), np.full(self.plan.shape, -1)
        for i, p in enumerate(points):
            r0, c0, f = self.field(p)
            part = (slice(r0, r0 + f.shape[0]), slice(c0, c0 + f.shape[1]))
            closer = f < best[part] - 1e-9
            if own_only:
                closer &= self.settlement[part] == self.settlement[p]
            best[part] = np.where(closer, f, best[part])
            which[part] = np.where(closer, i, which[part])
        return best, which

    def stranded(self, points: Sequence[tuple[int, int]]) -> np.ndarray:
        return self.new & ~np.isfinite(self.nearest(points, False)[0])

    def moved(self, points: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Eight rounds at most of moving each point to the middle of its homes; undone if a home is stranded that was not."""
        out = list(points)
        for _ in range(8):
            which = self.nearest([*self.fixed, *out], True)[1]
            after = []
            for i, p in enumerate(out):
                members = self.new & (which == i + len(self.fixed))
                if not members.any():
                    after.append(p)
                    continue
                r, c = (int(np.round(x.mean())) for x in np.nonzero(members))
                if not (self.new[r, c] and self.settlement[r, c] == self.settlement[p]):
                    r, c = inner_point(members)
                after.append((r, c))
            if after == out:
                break
            out = after
        if (self.stranded([*self.fixed, *out]) & ~self.stranded([*self.fixed, *points])).any():
            return points
        return list(dict.fromkeys(out))

    def filled(self, points: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """While homes are stranded, the one with most stranded homes around it becomes a centre."""
        out = list(points)
        left = self.stranded([*self.fixed, *out])
        while left.any():
            n = self.reach
            sums = np.pad(np.pad(left.astype(np.int64), n).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            w, (rows, cols) = 2 * n + 1, left.shape
            box = sums[w : w + rows, w : w + cols] - sums[:rows, w : w + cols] - sums[w : w + rows, :cols] + sums[:rows, :cols]
            at = np.unravel_index(int(np.argmax(np.where(left, box, -1))), left.shape)
            out.append((int(at[0]), int(at[1])))
            r0, c0, f = self.field(out[-1])
            left[r0 : r0 + f.shape[0], c0 : c0 + f.shape[1]] &= ~np.isfinite(f)
        return out

    def thinned(self, points: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Takes away, in order, each point that no home needs and that isn't its settlement's last. One pass
        does: taking a point away only makes others needed more."""
        cover, parts = np.zeros(self.plan.shape, dtype=np.int64), {}
        for p in [*self.fixed, *points]:
            r0, c0, f = self.field(p)
            parts[p] = (slice(r0, r0 + f.shape[0]), slice(c0, c0 + f.shape[1])), np.isfinite(f)
            cover[parts[p][0]] += parts[p][1]
        anchors = Counter(int(self.settlement[p]) for p in [*self.fixed, *points])
        out = []
        for p in points:
            part, near = parts[p]
            if anchors[int(self.settlement[p])] > 1 and not (self.new[part] & near & (cover[part] == 1)).any():
                cover[part] -= near
                anchors[int(self.settlement[p])] -= 1
            else:
                out.append(p)
        return out

    def refined(self, mode: str) -> list[tuple[int, int]]:
        out = self.filled(self.moved(self._points(self.plan == 3)))
        out = self.moved(out)
        if mode == "minimal":
            out = self.moved(self.thinned(out))
        held = {self.settlement[p] for p in [*self.fixed, *out]}
        for s in np.unique(self.settlement[self.new]):
            if s not in held:
                out.append(inner_point(self.new & (self.settlement == s)))
        return out

    def blobs(self, points: Sequence[tuple[int, int]]) -> np.ndarray:
        """Cells of centres grown from points over built cells, each as large as its homes ask for."""
        every = [*self.fixed, *points]
        which = self.nearest(every, False)[1]
        people = np.bincount(which[self.new & (which >= 0)], minlength=len(every)) * MEAN_DENSITY * self.block**2 / 1e6
        size = np.clip(np.round(people * M2_PER_PERSON / self.block**2), 1, MOST_BLOB).astype(int)[len(self.fixed) :]
        claimed, out = self.plan == 5, np.zeros(self.plan.shape, bool)
        row_major = sorted(QUEEN)
        for i in np.argsort(-size, kind="stable"):
            start = points[i]
            if claimed[start]:
                continue
            claimed[start] = out[start] = True
            queue, n = [start], 1
            while queue and n < size[i]:
                r, c = queue.pop(0)
                for dr, dc in row_major:
                    q = (r + dr, c + dc)
                    if 0 <= q[0] < claimed.shape[0] and 0 <= q[1] < claimed.shape[1] and self.built[q] and not claimed[q] and n < size[i]:
                        claimed[q] = out[q] = True
                        queue.append(q)
                        n += 1
        return out

    def optimised(self, mode: str) -> np.ndarray:
        """The plan with its new centres grown: around all the growth's own centres (grown), or around refined points only."""
        original = self.plan == 3
        points = self._points(original) if mode == "grown" else self.refined(mode)
        centre = self.blobs(points) | (original if mode == "grown" else False)
        return np.where(self.plan == 5, 5, np.where(centre & self.built, 3, np.where(original, 2, self.plan)))


def proximity_seeds(built: np.ndarray, block_m: float, walk_m: float, existing: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Scans in row-major order: a built cell that no centre's disk covers becomes one."""
    n = int(walk_m / block_m)
    dr, dc = np.indices((2 * n + 1, 2 * n + 1)) - n
    disk = dr**2 + dc**2 <= n * n
    covered = np.zeros((built.shape[0] + 2 * n, built.shape[1] + 2 * n), bool)
    for r, c in existing:
        covered[r : r + 2 * n + 1, c : c + 2 * n + 1] |= disk
    out = []
    for r, c in np.argwhere(built):
        if not covered[r + n, c + n]:
            covered[r : r + 2 * n + 1, c : c + 2 * n + 1] |= disk
            out.append((int(r), int(c)))
    return out
