"""Bounded walking distance on the queen's graph, around obstacles.

Lengths are kept as numbers of straight and diagonal steps, so that equal
lengths are equal numbers; metres come last. The bound is inclusive. A source starts at
zero even where it is blocked; blocked cells are never entered."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from footgrid.functions.codes import QUEEN, ROOK
from footgrid.operators.tiles import TILE, grid_of, on_tiles

ROOT2 = float(np.sqrt(2.0))
FAR = 1 << 20


def steps_within(bound: float, block: float) -> int:
    """How many steps a walk within the bound can have."""
    return int(np.floor(bound / block + 1e-9))


@cache
def _lengths(limit: float) -> tuple[np.ndarray, ...]:
    """All lengths up to the limit in order, as straight and diagonal steps, the place of each after one more of either, and a last place for
    those beyond. Two lengths are never equal, so places stand for them."""
    every = sorted((s + d * ROOT2, s, d) for d in range(int(limit / ROOT2) + 1) for s in range(int(limit) + 2) if s + d * ROOT2 <= limit)
    place = {(s, d): i for i, (_, s, d) in enumerate(every)}
    kind = np.min_scalar_type(len(every))
    more = (np.array([*(place.get((s + x, d + y), len(every)) for _, s, d in every), len(every)], kind) for x, y in ((1, 0), (0, 1)))
    return *(np.array([*(x[k] for x in every), FAR], np.int32) for k in (1, 2)), *more


def relaxed(start: np.ndarray, open_: np.ndarray, bound: float, moves=QUEEN) -> tuple[np.ndarray, np.ndarray]:
    """Straight and diagonal steps of the shortest walks from ``start`` over ``open_`` cells, in the last two axes.

    Both ``FAR`` where no walk of length ``bound`` (in blocks) or less ends. Cells hold a length's place among all, small numbers mostly."""
    straight, diagonal, one_straight, one_diagonal = _lengths(bound + 1e-9)
    far = one_straight[-1]
    length = np.where(start, 0, far).astype(far.dtype)
    closed = np.where(open_, 0, far).astype(far.dtype)
    rows, cols = start.shape[-2:]
    while True:
        before = length.copy()
        for dr, dc in moves:
            to = (..., slice(max(0, dr), rows + min(0, dr)), slice(max(0, dc), cols + min(0, dc)))
            of = (..., slice(max(0, -dr), rows + min(0, -dr)), slice(max(0, -dc), cols + min(0, -dc)))
            new = (one_diagonal if dr and dc else one_straight)[length[of]]
            np.minimum(length[to], np.maximum(new, closed[to], out=new), out=length[to])
        if (length == before).all():
            return straight[length], diagonal[length]


def nearest(at: np.ndarray, open_: np.ndarray, bound: float) -> np.ndarray:
    """Number of the place of ``at`` (rows, columns) with the shortest walk to each cell over ``open_`` cells, the first of those with equal walks; ``len(at)`` where
    none is within the bound.

    All places walk at once: what is not the first of the nearest to a cell is not so to the cells beyond it either. A cell holds its length's place and, below it, the number."""
    _, _, *more = _lengths(bound + 1e-9)
    numbers = len(at).bit_length()
    far = (len(more[0]) - 1) << numbers
    kind = np.int32 if far < 1 << 30 else np.int64
    straight, diagonal = (((x.astype(np.int64) - np.arange(len(x))) << numbers).astype(kind) for x in more)
    key, closed = np.full(open_.shape, far, kind), np.where(open_, 0, far).astype(kind)
    key[at[::-1, 0], at[::-1, 1]] = np.arange(len(at))[::-1]  # of those at one place the first
    rows, cols = open_.shape
    while True:
        before = key.copy()
        for dr, dc in QUEEN:
            to = (slice(max(0, dr), rows + min(0, dr)), slice(max(0, dc), cols + min(0, dc)))
            of = (slice(max(0, -dr), rows + min(0, -dr)), slice(max(0, -dc), cols + min(0, -dc)))
            new = (diagonal if dr and dc else straight)[key[of] >> numbers]
            new += key[of]
            np.maximum(new, closed[to], out=new)
            np.minimum(new, far, out=new)
            np.minimum(key[to], new, out=key[to])
        if (key == before).all():
            return np.where(key < far, key & ((1 << numbers) - 1), len(at))


def walk_field(cells: DataFrame, target: Column, blocked: Column, bound_m: float, block_m: float, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """keys, r, c, n_orth, n_diag, dist of the cells that a walk within the bound joins to the nearest target."""
    halo, limit = steps_within(bound_m, block_m), bound_m / block_m
    marked = cells.select(*keys, "r", "c", target.alias("target"), (~blocked).alias("open"))

    def work(rows: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
        start = grid_of(rows, r0, c0, "target", halo, False, bool, tile)
        open_ = grid_of(rows, r0, c0, "open", halo, False, bool, tile)
        s, d = (x[halo : halo + tile, halo : halo + tile] for x in relaxed(start, open_, limit))
        r, c = np.nonzero(s < FAR)
        return pd.DataFrame({"r": r + r0, "c": c + c0, "n_orth": s[r, c], "n_diag": d[r, c]})

    named = "".join(f"{k} {marked.schema[k].dataType.simpleString()}, " for k in keys)
    found = on_tiles(marked, work, named + "r int, c int, n_orth int, n_diag int", halo, keys, tile)
    return found.withColumn("dist", F.lit(float(block_m)) * (F.col("n_orth") + F.col("n_diag") * F.lit(ROOT2)))


def open_walk_field(targets: DataFrame, cells: DataFrame, bound_m: float, block_m: float, tile: int = TILE) -> DataFrame:
    """The same where nothing is blocked, not even places without a cell; targets need no cell either."""
    halo, limit = steps_within(bound_m, block_m), bound_m / block_m
    marked = cells.select("r", "c", F.lit(False).alias("target")).union(targets.select("r", "c", F.lit(True)))

    def work(rows: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
        start = grid_of(rows[rows["target"]], r0, c0, "target", halo, False, bool, tile)
        known = ~grid_of(rows[~rows["target"]], r0, c0, "target", halo, True, bool, tile)
        own = (slice(halo, halo + tile), slice(halo, halo + tile))
        s, d = (x[own] for x in relaxed(start, np.ones_like(start), limit))
        r, c = np.nonzero((s < FAR) & known[own])
        return pd.DataFrame({"r": r + r0, "c": c + c0, "n_orth": s[r, c], "n_diag": d[r, c]})

    found = on_tiles(marked, work, "r int, c int, n_orth int, n_diag int", halo, (), tile)
    return found.withColumn("dist", F.lit(float(block_m)) * (F.col("n_orth") + F.col("n_diag") * F.lit(ROOT2)))


def served_by_area(cells: DataFrame, area: Column, home: Column, blocked: Column, bound_m: float, block_m: float, tile: int = TILE) -> DataFrame:
    """area, served, n_orth, n_diag: for each area (a number; null where a cell is in none) the ``home`` cells within its own
    walk, and the straight and diagonal steps of all their walks.

    A tile walks from each area that has cells in its halo, within their box and the reach about it, and counts its own cells
    only, so that a row for each tile and area is all that is shuffled on."""
    halo, limit = steps_within(bound_m, block_m), bound_m / block_m
    marked = cells.select("r", "c", F.coalesce(area, F.lit(-1)).alias("area"), F.coalesce(home, F.lit(False)).alias("home"), (~blocked).alias("open"))

    def work(rows: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
        open_ = grid_of(rows, r0, c0, "open", halo, False, bool, tile)
        homes = np.zeros_like(open_)
        own = (slice(halo, halo + tile), slice(halo, halo + tile))
        homes[own] = grid_of(rows, r0, c0, "home", halo, False, bool, tile)[own]
        out = []
        for area, group in rows[rows["area"] >= 0].groupby("area"):
            a, b = group["r"].to_numpy() - r0 + halo, group["c"].to_numpy() - c0 + halo
            a0, b0 = max(0, a.min() - halo), max(0, b.min() - halo)
            box = (slice(a0, a.max() + halo + 1), slice(b0, b.max() + halo + 1))
            start = np.zeros_like(open_[box])
            start[a - a0, b - b0] = True
            s, d = relaxed(start, open_[box], limit)
            hit = (s < FAR) & homes[box]
            out.append((area, hit.sum(), s[hit].sum(), d[hit].sum()))
        return pd.DataFrame(out, columns=["area", "served", "n_orth", "n_diag"])

    parts = on_tiles(marked, work, "area long, served long, n_orth long, n_diag long", halo, (), tile)
    return parts.groupBy("area").agg(*[F.sum(k).alias(k) for k in ("served", "n_orth", "n_diag")])


def _windows(rows: pd.DataFrame, r0: int, c0: int, halo: int, limit: float, tile: int, moves=QUEEN, stop_after: int | None = None):
    """Reached cells around each of a tile's own sources, some sources at a time."""
    path = grid_of(rows, r0, c0, "path", halo, False, bool, tile)
    end = grid_of(rows, r0, c0, "end", halo, False, bool, tile)
    source = grid_of(rows, r0, c0, "source", halo, False, bool, tile)[halo : halo + tile, halo : halo + tile]
    at = np.argwhere(source)
    side = 2 * halo + 1
    for first in range(0, len(at), 512):
        part = at[first : first + 512]
        index = (part[:, 0, None, None] + np.arange(side)[None, :, None], part[:, 1, None, None] + np.arange(side)[None, None, :])
        start = np.zeros((len(part), side, side), dtype=bool)
        start[:, halo, halo] = True
        walkable, wanted = path[index], end[index]
        s, d = relaxed(start, walkable, limit, moves)
        reached = s < FAR
        length = np.where(reached, s + d * ROOT2, np.inf)
        # Walked cells look at their neighbours in the order of their own lengths (ties: row by row). A wanted
        # cell counts from the first look at it, whether it is walked on or not.
        turn = np.zeros(length.shape, dtype=np.int64)
        if stop_after is not None:
            order = np.argsort(length.reshape(len(part), -1), axis=1, kind="stable")
            np.put_along_axis(turn.reshape(len(part), -1), order, np.arange(side * side)[None, :], axis=1)
        seen = np.full(length.shape, FAR, dtype=np.int64)
        seen[:, halo, halo] = 0
        for dr, dc in moves:
            to = (slice(None), slice(max(0, dr), side + min(0, dr)), slice(max(0, dc), side + min(0, dc)))
            of = (slice(None), slice(max(0, -dr), side + min(0, -dr)), slice(max(0, -dc), side + min(0, -dc)))
            near = length[of] + (ROOT2 if dr and dc else 1.0) <= limit + 1e-9
            seen[to] = np.minimum(seen[to], np.where(near, turn[of], FAR))
        seen[~wanted] = FAR
        last = np.sort(seen.reshape(len(part), -1), axis=1)[:, stop_after - 1, None, None] if stop_after is not None else FAR
        yield part, (seen < FAR) & (seen <= last)


def _reach_input(cells: DataFrame, source: Column, path: Column, end: Column, keys: Sequence[str]) -> DataFrame:
    return cells.select(*keys, "r", "c", source.alias("source"), path.alias("path"), end.alias("end"))


def reach(cells: DataFrame, source: Column, path: Column, end: Column, bound_m: float, block_m: float, tile: int = TILE, rook: bool = False, stop_after: int | None = None) -> DataFrame:
    """sr, sc, r, c: cells of ``end`` that a walk over ``path`` joins to each source within the bound.

    ``rook``: straight steps only. ``stop_after``: a source's walk ends once it has seen that many cells of ``end`` (a source that
    is one counts; what the last step sees counts whole)."""
    halo, limit = steps_within(bound_m, block_m), bound_m / block_m

    def work(rows: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
        parts = [np.zeros((4, 0), np.int64)]
        for at, hit in _windows(rows, r0, c0, halo, limit, tile, ROOK if rook else QUEEN, stop_after):
            i, a, b = np.nonzero(hit)
            sr, sc = at[i, 0] + r0, at[i, 1] + c0
            parts.append(np.stack([sr, sc, sr + a - halo, sc + b - halo]))
        return pd.DataFrame(np.concatenate(parts, axis=1).T, columns=["sr", "sc", "r", "c"])

    return on_tiles(_reach_input(cells, source, path, end, ()), work, "sr int, sc int, r int, c int", halo, (), tile)


def access_counts(cells: DataFrame, source: Column, path: Column, bound_m: float, block_m: float, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """keys, r, c, acc: how many sources' walks cover each cell that any covers. Tiles add up their own sources' first."""
    halo, limit = steps_within(bound_m, block_m), bound_m / block_m

    def work(rows: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
        total = np.zeros((tile + 2 * halo, tile + 2 * halo), dtype=np.int64)
        for at, hit in _windows(rows, r0, c0, halo, limit, tile):
            i, a, b = np.nonzero(hit)
            np.add.at(total, (at[i, 0] + a, at[i, 1] + b), 1)
        r, c = np.nonzero(total)
        return pd.DataFrame({"r": r + r0 - halo, "c": c + c0 - halo, "acc": total[r, c]})

    named = "".join(f"{k} {cells.schema[k].dataType.simpleString()}, " for k in keys)
    parts = on_tiles(_reach_input(cells, source, path, path, keys), work, named + "r int, c int, acc long", halo, keys, tile)
    return parts.groupBy(*keys, "r", "c").agg(F.sum("acc").alias("acc"))


def green_periphery(cells: DataFrame) -> DataFrame:
    """r, c, state, itx: -1 unbuildable, 1 urban, 2 green with an urban rook neighbour, 0 other green."""
    from footgrid.operators.neighbours import neighbours

    touched = neighbours(cells.select("r", "c", "state"), queen=False).where("n_state > 0").select("r", "c").distinct().withColumn("t", F.lit(True))
    itx = F.when(F.col("state") == -1, -1).when(F.col("state") > 0, 1).when(F.col("t"), 2).otherwise(0)
    return cells.join(touched, ["r", "c"], "left").select("r", "c", "state", itx.alias("itx"))
