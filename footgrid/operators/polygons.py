"""Polygons as sets of edges: noding, validity, overlay, dissolving, outlines.

A polygon is its directed edges (keys, x0, y0, x1, y1) on a grid of integers (``snapped``), its inside on their left.
Everything is a join or an aggregate over edges, keyed by a group (a feature, a pair of features, a
layer), so a polygon may have any number of edges and no task holds a whole one:

* ``noded`` cuts edges where they meet. Edges are dealt to the tiles that they pass through, column by
  column, and only edges of one tile are compared; cut points are rounded to the grid, and rounds go on until nothing is cut.
* ``valid`` keeps, of a feature's pieces, those that it holds an odd number of times (the even-odd rule), and turns them so that the inside is on the left.
* ``overlay`` counts for each piece how many polygons of either side cover the land on its left and on its right, and keeps the pieces
  that the result has on one side only. Counts come from the edges of the piece's own tile and from running sums over tiles.
* ``dissolved`` is what edges without an opposite leave of polygons that only adjoin.
* ``rings`` links edges: of those that leave a place, the next is the first one clockwise from where the last one came, so
  rings never cross; edges near each other are linked to chains at once, and chains by pointer doubling, in as many rounds as the logarithm of their number.

Rings of area over zero are shells, the others holes. A ring may touch itself or others in a point. Parts with an area of zero vanish. Empty tables give no rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from footgrid.functions.storage import kept, kept_and_seen
from footgrid.operators import united

#: Grid steps of a metre.
STEPS = 1000
#: Width of the tiles in which edges are compared, in grid steps.
TILE = 200 * STEPS
#: Rounded cuts can meet an edge that their line missed; this many rounds is more than was ever seen.
MOST_ROUNDS = 8
ENDS = ("x0", "y0", "x1", "y1")
#: Most edges of a group whose capsules are united within a batch; least side of a capsule for that, in grid steps.
MOST_UNITED, LEAST_SIDE = 32, 4


def snapped(edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """Edges in metres as edges on the grid; those of no length are left out."""
    others = [c for c in edges.columns if c not in ENDS]
    return edges.select(*others, *[F.round(F.col(c) * steps).cast("long").alias(c) for c in ENDS]).where("x0 <> x1 OR y0 <> y1")


def _floor(x: Column, size: int) -> Column:
    return F.floor(x / size).cast("long")


def passed_tiles(edges: DataFrame, size: float) -> DataFrame:
    """Each edge once for every tile (``tx``, ``ty``) that it passes: in each column of tiles only the rows between its two heights there."""
    low, high = F.least("x0", "x1"), F.greatest("x0", "x1")
    cols = edges.withColumn("tx", F.explode(F.sequence(_floor(low, size), _floor(high, size))))
    slope = (F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0))
    at = lambda x: F.least(F.greatest(F.col("y0") + slope * (x - F.col("x0")), F.least("y0", "y1")), F.greatest("y0", "y1"))
    a, b = at(F.greatest(low, F.col("tx") * size)), at(F.least(high, (F.col("tx") + 1) * size))
    upright = F.col("x0") == F.col("x1")
    a, b = (F.when(upright, f("y0", "y1")).otherwise(f(a, b)) for f in (F.least, F.greatest))
    # A step more on either side, for what the slope's rounding may lose.
    return cols.withColumn("ty", F.explode(F.sequence(_floor(a - 1, size), _floor(b + 1, size))))


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def _cuts(edges: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """``id``, ``x``, ``y``, ``off``: places strictly inside an edge where another edge of its group meets it, and whether they are beside its line. Pairs without a
    ``bent`` edge are left out: they were compared before.

    Pairs that meet in several tiles are compared in each; only the cuts are dealt on, not the pairs."""
    k = list(keys)
    spread = passed_tiles(edges.select("id", "bent", *k, *ENDS), tile)
    one, two = (spread.select(*k, "tx", "ty", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "bent", *ENDS)]) for p in "pq")
    box = " AND ".join(f"least(p_{a}0, p_{a}1) <= greatest(q_{a}0, q_{a}1) AND least(q_{a}0, q_{a}1) <= greatest(p_{a}0, p_{a}1)" for a in "xy")
    pairs = one.hint("merge").join(two, [*k, "tx", "ty"]).where(f"p_id < q_id AND (p_bent OR q_bent) AND {box}")  # no broadcast: each edge is many rows
    c = F.col
    ax, ay, bx, by = c("p_x1") - c("p_x0"), c("p_y1") - c("p_y0"), c("q_x1") - c("q_x0"), c("q_y1") - c("q_y0")
    wx, wy = c("q_x0") - c("p_x0"), c("q_y0") - c("p_y0")
    d, aside = _cross(ax, ay, bx, by), _cross(wx, wy, ax, ay)
    t, u = _cross(wx, wy, bx, by) / F.nullif(d, F.lit(0)), aside / F.nullif(d, F.lit(0))
    meet = F.struct(F.round(c("p_x0") + t * ax).cast("long").alias("x"), F.round(c("p_y0") + t * ay).cast("long").alias("y"))
    ends = [F.struct(c(f"{e}_x{i}").alias("x"), c(f"{e}_y{i}").alias("y")) for e in "pq" for i in "01"]
    # On one line: each other's ends; else the one place where both are.
    places = F.when((d == 0) & (aside == 0), F.array(*ends)).when(t.between(0, 1) & u.between(0, 1), F.array(meet))
    own = [F.struct(c(f"{e}_id").alias("id"), *[c(f"{e}_{n}").alias(n) for n in ENDS]) for e in "pq"]
    met = pairs.select(F.explode(places).alias("m"), *[o.alias(e) for o, e in zip(own, "pq")]).select("m.*", F.explode(F.array("p", "q")).alias("e")).select("x", "y", "e.*")
    inside = "x BETWEEN least(x0, x1) AND greatest(x0, x1) AND y BETWEEN least(y0, y1) AND greatest(y0, y1)"
    off = _cross(c("x1") - c("x0"), c("y1") - c("y0"), c("x") - c("x0"), c("y") - c("y0")) != 0
    return met.where(f"{inside} AND NOT (x = x0 AND y = y0) AND NOT (x = x1 AND y = y1)").select("id", "x", "y", off.alias("off")).distinct()


def noded(edges: DataFrame, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """The edges, with all their columns, cut where they meet others of their group.

    Pieces of an edge whose cuts all lie on its line meet nothing that it didn't, so a further round is for edges that were bent by rounding, and for what meets them."""
    others = [c for c in edges.columns if c not in ENDS]
    now = edges.withColumn("bent", F.lit(True))
    for _ in range(MOST_ROUNDS):
        # Numbered as they are written, so that numbers stay.
        now = kept(now.withColumn("id", F.monotonically_increasing_id()), "numbered")
        cuts, seen = kept_and_seen(_cuts(now, keys, tile), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("off").cast("long")), F.lit(0)).alias("off"), name="cuts")
        if not seen["n"]:
            return now.drop("id", "bent")
        # The cuts of an edge are gathered; each edge is then split in its own row.
        stops = cuts.groupBy("id").agg(F.collect_list(F.struct("x", "y")).alias("stops"), F.bool_or("off").alias("off"))
        split = now.drop("bent").join(stops, "id", "left")
        far = lambda p: (p["x"] - F.col("x0")) * (F.col("x1") - F.col("x0")) + (p["y"] - F.col("y0")) * (F.col("y1") - F.col("y0"))
        ends = F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in "01"])
        placed = F.transform(F.concat(ends, F.coalesce("stops", F.array().cast("array<struct<x: bigint, y: bigint>>"))), lambda p: F.struct(far(p).alias("along"), p["x"].alias("x"), p["y"].alias("y")))
        line = split.select(*others, F.coalesce("off", F.lit(False)).alias("bent"), F.array_sort(placed).alias("s"))
        steps = F.explode(F.expr("zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> struct(a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1))"))
        now = line.select(*others, "bent", steps.alias("e")).select(*others, "e.*", "bent")
        if not seen["off"]:
            return kept(now.drop("bent"), "noded")
    raise ArithmeticError(f"edges still meet after {MOST_ROUNDS} rounds of cuts")


#: An edge that points right (or up, if it is upright).
_AHEAD = "(x0 < x1 OR x0 = x1 AND y0 < y1)"


def _unordered(pieces: DataFrame, *columns: Column | str) -> DataFrame:
    """Pieces turned to point right (or up), with ``sign``: 1 where that is their own direction, else -1."""
    ahead = F.expr(_AHEAD)
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    return pieces.select(*columns, pick("x0", "x1").alias("x0"), pick("y0", "y1").alias("y0"), pick("x1", "x0").alias("x1"), pick("y1", "y0").alias("y1"), F.when(ahead, 1).otherwise(-1).alias("sign"))


def _depths(edges: DataFrame, keys: Sequence[str], sums: Sequence[str], tile: int) -> DataFrame:
    """Edges (keys, ends, a weight in each of ``sums``), each once, with ``over_*``: how often the edges of their group cover what is just above
    their middle, or just to the right of it where they are upright. Edges point right, or up.

    No path leaves a tile: it goes from the tile's upper left corner along its upper side and down to the middle. The
    corners' own depths are running sums down the left sides of a column of tiles. Coordinates are doubled and made odd, so that no end lies on a
    tile's side; a path that meets an edge exactly on a corner or at its turn passes a hair's breadth below and to the right."""
    k, size = list(keys), 2 * tile
    c = F.col
    odd = edges.select(*k, *sums, *[(2 * c(e) + 1).alias(e) for e in ENDS])
    spread = passed_tiles(odd, size).withColumn("dx", c("x1") - c("x0")).withColumn("dy", c("y1") - c("y0"))
    left, top, bottom = c("tx") * size, (c("ty") + 1) * size, c("ty") * size
    side = lambda x, y: c("dx") * (y - c("y0")) - c("dy") * (x - c("x0"))  # noqa: E731  over zero on the left of the edge
    crosses = (c("x0") < left) & (left < c("x1")) & (side(left, top) > 0) & (side(left, bottom) <= 0)
    nets = spread.where(crosses).groupBy(*k, "tx", "ty").agg(*[(-F.sum(n)).alias(f"net_{n}") for n in sums])
    middle = edges.select(*k, *sums, *ENDS, (c("x0") + c("x1") + 1).alias("mx"), (c("y0") + c("y1") + 1).alias("my"))
    middle = middle.withColumn("tx", _floor(c("mx"), size)).withColumn("ty", _floor(c("my"), size))
    tiles = nets.union(middle.select(*k, "tx", "ty", *[F.lit(0).cast("long") for _ in sums])).groupBy(*k, "tx", "ty").agg(*[F.sum(f"net_{n}").alias(f"net_{n}") for n in sums])
    above = W.partitionBy(*k, "tx").orderBy(c("ty").desc()).rowsBetween(W.unboundedPreceding, -1)
    corners = tiles.select(*k, "tx", "ty", *[F.coalesce(F.sum(f"net_{n}").over(above), F.lit(0)).alias(f"corner_{n}") for n in sums])
    both = middle.withColumnsRenamed({e: f"own_{e}" for e in (*ENDS, *sums)}).join(spread, [*k, "tx", "ty"], "left")
    up = F.when(c("dy") > 0, 1).otherwise(-1)
    past = side(left, top) * up
    along = (F.least("y0", "y1") < top) & (top < F.greatest("y0", "y1")) & ((past > 0) | (past == 0) & (c("dx") * up < 0)) & (side(c("mx"), top) * up <= 0)
    turn = side(c("mx"), top)
    down = (c("x0") <= c("mx")) & (c("mx") < c("x1")) & ((turn > 0) | (turn == 0) & (c("dy") < 0)) & (side(c("mx"), c("my")) < 0)
    step = F.when(along, -up).otherwise(0) - F.when(down, 1).otherwise(0)
    own = [f"own_{e}" for e in (*ENDS, *sums)]
    met = both.groupBy(*k, "tx", "ty", *own).agg(*[F.sum(F.coalesce(step * c(n), F.lit(0))).alias(f"over_{n}") for n in sums])
    found = met.join(corners, [*k, "tx", "ty"])
    return found.select(*k, *[c(f"own_{e}").alias(e) for e in (*ENDS, *sums)], *[(c(f"over_{n}") + c(f"corner_{n}")).alias(f"over_{n}") for n in sums])


def _directed(pieces: DataFrame, inside_left: Column, keys: Sequence[str]) -> DataFrame:
    """Pieces that point right (or up), turned round where the inside is not on their left."""
    pick = lambda a, b: F.when(inside_left, F.col(a)).otherwise(F.col(b))
    return pieces.select(*keys, pick("x0", "x1").alias("x0"), pick("y0", "y1").alias("y0"), pick("x1", "x0").alias("x1"), pick("y1", "y0").alias("y1"))


def valid(edges: DataFrame, keys: Sequence[str] = ("fid",), tile: int = TILE) -> DataFrame:
    """Boundary of what the rings' edges (in either direction) enclose by the even-odd rule, the inside on the left."""
    k = list(keys)
    pieces = _unordered(noded(edges.select(*k, *ENDS), k, tile), *k).groupBy(*k, *ENDS).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    pieces = kept(pieces.withColumn("n", F.lit(1).cast("long")), "pieces")
    over = _depths(pieces, k, ["n"], tile)
    # Of an upright piece it is the right side that was counted.
    return _directed(over, F.pmod(F.col("over_n") + F.expr("CAST(x0 = x1 AS INT)"), F.lit(2)) == 1, k)


#: What is inside, by how many polygons of either side cover a place.
RULES = {"union": "{0}_a + {0}_b > 0", "intersection": "{0}_a > 0 AND {0}_b > 0", "difference": "{0}_a > 0 AND {0}_b = 0"}


def overlay(a: DataFrame, b: DataFrame, how: str, keys: Sequence[str] = ("fid",), tile: int = TILE) -> DataFrame:
    """Boundary of the union, intersection or difference of two sets of valid polygons, group by group. ``a`` and ``b``: keys and directed
    edges; polygons of one side may overlap."""
    k = list(keys)
    both = a.select(*k, *ENDS, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(*k, *ENDS, F.lit(0).alias("a"), F.lit(1).alias("b")))
    pieces = _unordered(noded(both, k, tile), *k, "a", "b")
    own = kept(pieces.groupBy(*k, *ENDS).agg(F.sum(F.col("a") * F.col("sign")).alias("a"), F.sum(F.col("b") * F.col("sign")).alias("b")).where("a <> 0 OR b <> 0"), "pieces")
    over = _depths(own, k, ["a", "b"], tile)
    # Of an upright piece it is the right side that was counted; its inside is on its left.
    at = {s: [f"over_{n} + {f} * {n} AS {s}_{n}" for n in "ab"] for s, f in (("left", "CAST(x0 = x1 AS INT)"), ("right", "(CAST(x0 = x1 AS INT) - 1)"))}
    sides = over.selectExpr(*k, *ENDS, *at["left"], *at["right"])
    left, right = (F.expr(RULES[how].format(s)) for s in ("left", "right"))
    return _directed(sides.where(left != right), left, k)


def meeting_pairs(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """``fid``, ``other``: features of two tables of edges whose boxes meet; boxes are compared tile by tile."""
    boxes = lambda e, n: e.groupBy("fid").agg(F.min(F.least("x0", "x1")).alias(f"{n}x0"), F.min(F.least("y0", "y1")).alias(f"{n}y0"), F.max(F.greatest("x0", "x1")).alias(f"{n}x1"), F.max(F.greatest("y0", "y1")).alias(f"{n}y1"))
    span = lambda n, c: F.sequence(_floor(F.col(f"{n}{c}0"), tile), _floor(F.col(f"{n}{c}1"), tile))
    dealt = [boxes(e, n).withColumn("tx", F.explode(span(n, "x"))).withColumn("ty", F.explode(span(n, "y"))) for e, n in ((a, "a"), (b, "b"))]
    met = dealt[0].join(dealt[1].withColumnRenamed("fid", "other"), ["tx", "ty"]).where("ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1")
    # A pair is taken in the tile that holds the lower corner of what its boxes share.
    first = (_floor(F.greatest("ax0", "bx0"), tile) == F.col("tx")) & (_floor(F.greatest("ay0", "by0"), tile) == F.col("ty"))
    return met.where(first).select("fid", "other")


def clipped(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """Directed edges (fid, other, ends) of what each feature of ``a`` shares with each feature of ``b`` that it meets. Both: fid and directed edges."""
    pairs = kept(meeting_pairs(a, b, tile), "pairs")
    one = a.join(pairs, "fid")
    two = b.withColumnRenamed("fid", "other").join(pairs, "other")
    return overlay(one, two, "intersection", ("fid", "other"), tile)


def cut_out(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """Directed edges (fid, ends) of what is left of each feature of ``a`` without all features of ``b``."""
    pairs = kept(meeting_pairs(a, b, tile), "pairs")
    met = pairs.select("fid").distinct()
    two = b.withColumnRenamed("fid", "other").join(pairs, "other").select("fid", *ENDS)
    apart = a.join(met, "fid", "left_anti").select("fid", *ENDS)
    return overlay(a.join(met, "fid", "left_semi"), two, "difference", ("fid",), tile).union(apart)


def dissolved(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Boundary of polygons (keys, directed edges) that adjoin but don't overlap, edge to edge: what has no opposite."""
    k = list(keys)
    sums = _unordered(edges, *k).groupBy(*k, *ENDS).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return _directed(sums, F.col("sign") > 0, k)


def cell_edges(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Directed edges of cells r, c as squares of side 1 with y = -r (so upwards); the inside on the left."""
    r, c = F.col("r").cast("long"), F.col("c").cast("long")
    sides = ((c, -r - 1, c + 1, -r - 1), (c + 1, -r - 1, c + 1, -r), (c + 1, -r, c, -r), (c, -r, c, -r - 1))
    return cells.select(*keys, F.explode(F.array(*[F.struct(*[v.alias(n) for v, n in zip(s, ENDS)]) for s in sides])).alias("e")).select(*keys, "e.*")


def _next(edges: DataFrame, keys: Sequence[str], span: int) -> DataFrame:
    """``id``, ``after``: for each edge the one that its ring goes on with; ``place``: a number that edges of one group and one square of ``span`` share."""
    k = list(keys)
    angle = lambda a, b: F.atan2((F.col(f"y{b}") - F.col(f"y{a}")).cast("double"), (F.col(f"x{b}") - F.col(f"x{a}")).cast("double"))
    place = F.xxhash64(*k, _floor(F.col("x0"), span), _floor(F.col("y0"), span))
    ends = edges.select(*k, "id", place.alias("place"), F.col("x1").alias("x"), F.col("y1").alias("y"), angle("1", "0").alias("back"))
    starts = edges.select(*k, F.col("id").alias("after"), F.col("x0").alias("x"), F.col("y0").alias("y"), angle("0", "1").alias("out"))
    turn = F.col("back") - F.col("out")
    clockwise = F.when(turn <= 1e-15, turn + 6.283185307179586).otherwise(turn)
    return ends.join(starts, [*k, "x", "y"]).groupBy("id").agg(F.min_by("after", clockwise).alias("after"), F.first("place").alias("place"))


def _chained(batches):
    """Batches of ``id``, ``after`` with each edge's chain (``head``, its first edge, and ``off``, the steps from there), as far as it lies within the batch. A
    head's row has its chain's ``n`` edges, the edge ``to`` which it goes on, and the least number ``low`` on it, ``low_off`` steps along."""
    for rows in batches:
        ids, after = rows["id"].tolist(), rows["after"].tolist()
        step = dict(zip(ids, after))
        entered = {x for x in after if x in step}
        out, seen = [], set()
        # Chains from edges that none of the batch leads to; then rings that lie within it, from their least number.
        for head in (*(x for x in ids if x not in entered), *sorted(entered)):
            if head in seen:
                continue
            chain, x = [], head
            while x in step and x not in seen:
                seen.add(x)
                chain.append(x)
                x = step[x]
            low = min(chain)
            out.append((head, head, 0, len(chain), x, low, chain.index(low)))
            out.extend((y, head, i, None, None, None, None) for i, y in enumerate(chain) if i)
        columns = ["id", "head", "off", "n", "to", "low", "low_off"]
        yield pd.DataFrame({c: pd.array([x[i] for x in out], dtype="Int64") for i, c in enumerate(columns)})


def rings(edges: DataFrame, keys: Sequence[str] = (), span: int = 10 * TILE) -> DataFrame:
    """keys, ``ring``, ``pos`` (from 0), ends: directed edges linked to rings, numbered along each.

    Edges near each other (in a square of ``span``) are dealt together and linked to chains batch by batch; only chains that lead out of their batch are
    linked on by pointer doubling."""
    k = list(keys)
    own = kept(edges.select(*k, *ENDS).withColumn("id", F.monotonically_increasing_id()), "numbered")
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = _next(own, k, span).repartition(n, "place").sortWithinPartitions("place").select("id", "after")
    linked = kept(near.mapInPandas(_chained, "id long, head long, off long, n long, to long, low long, low_off long"), "chains")
    chains = linked.where("n IS NOT NULL").select("id", "to", "low", "low_off", "n")
    whole, steps = chains.where("id = to"), chains.where("id <> to")
    # The least number on each ring: each round looks twice as far ahead.
    now, before = steps.select("id", "to", F.col("low").alias("ring")), None
    now, seen = kept_and_seen(now, F.sum(F.col("ring").cast("decimal(38,0)")).alias("s"), name="rings")
    while seen["s"] != before:
        before = seen["s"]
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"))
        now, seen = kept_and_seen(now.join(ahead, "to").select("id", F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring")), F.sum(F.col("ring").cast("decimal(38,0)")).alias("s"), name="rings")
    # Steps that are left to the chain that holds the ring's first edge, looked up in the same way.
    named = kept(steps.join(now.select("id", "ring"), "id"), "named")
    first = named.where("low = ring").select("ring", F.col("id").alias("first"), "low_off")
    rank = named.drop("low", "low_off").join(first, "ring").select("id", "ring", "low_off", F.when(F.col("to") != F.col("first"), F.col("to")).alias("to"), F.col("n").alias("left"))
    rank, seen = kept_and_seen(rank, F.count("to").alias("n"), name="ranks")
    while seen["n"]:
        ahead = rank.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        rank, seen = kept_and_seen(rank.join(ahead, "to", "left").select("id", "ring", "low_off", F.col("to2").alias("to"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")), F.count("to").alias("n"), name="ranks")
    size = rank.groupBy("ring").agg(F.max("left").alias("size"))
    placed = rank.join(size, "ring").select(F.col("id").alias("head"), "ring", "size", (F.col("size") - F.col("left") - F.col("low_off")).alias("at"))
    placed = placed.union(whole.select("id", F.col("low").alias("ring"), F.col("n").alias("size"), -F.col("low_off")))
    numbered = linked.select("id", "head", "off").join(placed, "head").select("id", "ring", F.pmod(F.col("at") + F.col("off"), F.col("size")).alias("pos"))
    return own.join(numbered, "id").select(*k, "ring", "pos", *ENDS)


def twice_area() -> Column:
    """Twice the area that directed edges enclose, in squares of the grid: an aggregate; exact."""
    x0, y0, x1, y1 = (F.col(c).cast("decimal(19,0)") for c in ENDS)
    return F.sum(x0 * y1 - x1 * y0)


def ring_measures(linked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, ring, ``edges``, ``area2`` (twice the signed area; holes are below zero)."""
    return linked.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("edges"), twice_area().alias("area2"))


def parts(linked: DataFrame, keys: Sequence[str] = ("fid",), strip: int = TILE) -> DataFrame:
    """keys, ring, ``part``: the ring of the shell that each ring bounds with. A hole joins what a ray upwards from its highest place meets first."""
    from footgrid.operators.components import joined_labels

    k = list(keys)
    measures = kept(ring_measures(linked, k), "measures")
    highest = linked.groupBy(*k, "ring").agg(F.max(F.struct(F.col("y0").alias("y"), F.col("x0").alias("x"))).alias("p"))
    holes = measures.where("area2 < 0").select(*k, "ring").join(highest, [*k, "ring"]).select(*k, F.col("ring").alias("hole"), "p.*").withColumn("s", _floor(F.col("x"), strip))
    spread = linked.where("x0 <> x1").select(*k, "ring", *ENDS).withColumn("s", F.explode(F.sequence(_floor(F.least("x0", "x1"), strip), _floor(F.greatest("x0", "x1"), strip))))
    height = F.col("y0") + (F.col("y1") - F.col("y0")) * ((F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    met = holes.join(spread, [*k, "s"]).where("hole <> ring AND x BETWEEN least(x0, x1) AND greatest(x0, x1)").withColumn("h", height).where("h >= y")
    up = met.groupBy("hole").agg(F.min_by("ring", F.struct("h", (F.col("x0") < F.col("x1")).cast("int").alias("away"), "ring")).alias("ring"))
    label = joined_labels(up.select(F.col("hole").alias("a"), F.col("ring").alias("b")))
    named = measures.join(label.withColumnRenamed("node", "ring"), "ring", "left").withColumn("root", F.coalesce("root", "ring"))
    shell = named.where("area2 > 0").groupBy("root").agg(F.min("ring").alias("part"))
    return named.join(shell, "root").select(*k, "ring", "part", "edges", "area2")


def as_features(linked: DataFrame, keys: Sequence[str] = ("fid",), steps: int = STEPS) -> DataFrame:
    """keys, ``rings``: arrays of closed rings of points x, y in metres, without places on a straight line; a row holds one feature."""
    k = list(keys)
    w = W.partitionBy(*k, "ring").orderBy("pos")
    first = W.partitionBy(*k, "ring")
    last = lambda c: F.coalesce(F.lag(c).over(w), F.max_by(c, "pos").over(first))
    bent = linked.withColumn("bx", last("x0")).withColumn("by", last("y0")).where("(x0 - bx) * (y1 - y0) <> (y0 - by) * (x1 - x0)")
    point = F.struct("pos", (F.col("x0") / steps).alias("x"), (F.col("y0") / steps).alias("y"))
    ordered = F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    closed = bent.groupBy(*k, "ring").agg(ordered.alias("p")).select(*k, "ring", F.concat("p", F.slice("p", 1, 1)).alias("p"))
    return closed.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "p"))), lambda r: r["p"]).alias("rings"))


def large_parts(a: DataFrame, keys: Sequence[str], least_m2: float, steps: int = STEPS) -> DataFrame:
    """keys, part, ``area``, ``rings`` (their number): connected parts of directed edges of at least ``least_m2``."""
    found = parts(kept(rings(a, keys), "linked"), keys)
    return found.groupBy(*keys, "part").agg((F.sum("area2") / (2.0 * steps * steps)).alias("area"), F.count(F.lit(1)).alias("rings")).where(F.col("area") >= least_m2)


def capsules(edges: DataFrame, width: float, quarter: int = 8) -> DataFrame:
    """Directed edges of what lies within ``width`` (in grid steps) of each edge, round ends as ``quarter`` sides for each right angle. Keys stay."""
    others = [c for c in edges.columns if c not in ENDS]
    turn = F.atan2((F.col("y1") - F.col("y0")).cast("double"), (F.col("x1") - F.col("x0")).cast("double"))
    at = lambda i, n: F.struct((F.col(f"x{i}") + F.round(width * F.cos(turn + n))).cast("long").alias("x"), (F.col(f"y{i}") + F.round(width * F.sin(turn + n))).cast("long").alias("y"))
    turns = [math.pi / 2 * i / quarter for i in range(2 * quarter + 1)]
    loop = [*(at("1", t - math.pi / 2) for t in turns), *(at("0", t + math.pi / 2) for t in turns)]
    closed = edges.select(*others, F.array(*loop, loop[0]).alias("p"))
    sides = F.expr("zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> struct(a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1))")
    return closed.select(*others, F.explode(sides).alias("e")).select(*others, "e.*").where("x0 <> x1 OR y0 <> y1")


def widened(edges: DataFrame, width: float, keys: Sequence[str] = ("fid",), quarter: int = 8, tile: int = TILE, most: int = MOST_UNITED) -> DataFrame:
    """Boundary of what lies within ``width`` of lines' edges (keys, ends): the union of the capsules of all edges of a group.

    Groups of up to ``most`` edges are united batch by batch, so their lines are shuffled, not their capsules' sides; larger ones are cut and counted as tables.
    Edges without a key belong to no group and are left out."""
    k = list(keys)
    lines = edges.select(*k, *ENDS).dropna(subset=k) if k else edges.select(*ENDS)

    def as_tables(some: DataFrame) -> DataFrame:
        around = capsules(some, width, quarter)
        return overlay(around, around.where("false"), "union", k, tile)

    # Sides must be long enough for rounding to leave a capsule's own apart.
    if not k or 2 * width * math.sin(math.pi / (4 * quarter)) < LEAST_SIDE:
        return as_tables(lines)
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = W.partitionBy(*k).orderBy(*ENDS)
    counted = lines.repartition(n, *k).select("*", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"))
    schema = StructType([f for f in lines.schema if f.name in k] + [StructField(e, LongType()) for e in ENDS])
    small = counted.where(F.col("n") <= most).mapInArrow(lambda batches: united.widened(batches, k, width, quarter, MOST_ROUNDS), schema)
    if lines.groupBy(*k).count().where(F.col("count") > most).isEmpty():
        return small
    return small.union(as_tables(counted.where(F.col("n") > most).drop("i", "n")))


def merged_layer(edges: DataFrame, tile: int = TILE) -> DataFrame:
    """Boundary (ends) of the union of all features (fid, directed edges) of a layer, overlapping or not."""
    layer = edges.select(*ENDS)
    return overlay(layer, layer.where("false"), "union", (), tile)


def polygon_edges(features: DataFrame, key: str = "fid") -> DataFrame:
    """Valid directed edges (key, ends) of the polygons among features with ``rings`` in metres, repaired by the even-odd rule."""
    from footgrid.operators.raster import ring_edges

    return valid(snapped(ring_edges(features.where(F.col("geom_type").contains("Polygon")), key)), (key,))


def repaired(features: DataFrame, key: str = "fid") -> DataFrame:
    """``features`` with valid rings for their polygons; those that enclose nothing are dropped, lines and points stay."""
    own = as_features(kept(rings(polygon_edges(features, key), (key,)), "rings"), (key,))
    polygon = F.col("geom_type").contains("Polygon")
    fixed = features.where(polygon).drop("rings").join(own, key).select(*features.columns)
    return features.where(~polygon).unionByName(fixed)


def extracted(features: DataFrame, area: DataFrame, within: float = 6.0, least_m2: float = 1500.0) -> DataFrame:
    """fid, part, area, rings: the polygons of ``features`` repaired, clipped to an area's (valid edges, fid), thinned so that nothing moves farther than
    ``within`` metres, repaired again, and their connected parts of ``least_m2`` at least."""
    from footgrid.operators.geometry import simplified

    inside = clipped(polygon_edges(features), area).select("fid", *ENDS)
    thin = simplified(as_features(kept(rings(inside, ("fid",)), "rings")).withColumn("geom_type", F.lit("Polygon")), within)
    linked = kept(rings(polygon_edges(thin), ("fid",)), "rings")
    split = parts(linked, ("fid",))
    large = split.groupBy("part").agg((F.sum("area2") / (2.0 * STEPS * STEPS)).cast("double").alias("area")).where(F.col("area") >= least_m2)
    own = linked.join(split.select("ring", "part").join(large, "part"), "ring")
    return as_features(own.select("fid", "part", "area", "ring", "pos", *ENDS), ("fid", "part", "area"))
