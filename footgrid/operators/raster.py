"""Rasterisation of features to cells, seeds, precedence of layers, terrain slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def aligned(bounds: DataFrame, block: float) -> DataFrame:
    """rows, cols, x_min, y_max of the whole cells that cover ``x0, y0, x1, y1`` of all rows."""
    b = bounds.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    low = lambda k: F.floor(F.col(k) / block) * block
    high = lambda k: F.ceil(F.col(k) / block) * block
    return b.select(
        ((high("y1") - low("y0")) / block).cast("long").alias("rows"), ((high("x1") - low("x0")) / block).cast("long").alias("cols"), low("x0").cast("double").alias("x_min"), high("y1").cast("double").alias("y_max")
    )


def dense(spark: SparkSession, rows: int, cols: int, block: float, x_min: float, y_max: float) -> DataFrame:
    """Every cell of a grid with its centre."""
    grid = spark.range(rows * cols).select(F.expr(f"id div {cols}").cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    return grid.select("r", "c", (x_min + (F.col("c") + 0.5) * block).alias("x"), (y_max - (F.col("r") + 0.5) * block).alias("y"))


def burned(edges: DataFrame, block: float, x_min: float, y_max: float, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """keys, r, c of the cells whose centres polygons cover, by scanlines.

    ``edges``: x0, y0, x1, y1 of all rings' edges. Each edge is cut at the rows whose centre lines it
    crosses (its lower end included, its upper one not); a row's crossings, sorted, bound the
    covered stretches two by two."""
    y_low, y_high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first = F.floor((y_max - y_high) / block - 0.5) + 1
    last = F.floor((y_max - y_low) / block - 0.5)
    crossed = edges.where("y0 <> y1").select(*keys, "x0", "y0", "x1", "y1", first.cast("int").alias("a"), last.cast("int").alias("b")).where("a <= b")
    lines = crossed.select("*", F.explode(F.sequence("a", "b")).alias("r"))
    y = y_max - (F.col("r") + 0.5) * block
    at = lines.select(*keys, "r", (F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    w = W.partitionBy(*keys, "r").orderBy("x")
    paired = at.select(*keys, "r", "x", F.lead("x").over(w).alias("x2"), F.row_number().over(w).alias("n")).where("n % 2 = 1 AND x2 IS NOT NULL")
    a, b = F.ceil((F.col("x") - x_min) / block - 0.5), F.ceil((F.col("x2") - x_min) / block - 0.5) - 1
    return paired.select(*keys, "r", a.cast("int").alias("a"), b.cast("int").alias("b")).where("a <= b").select(*keys, "r", F.explode(F.sequence("a", "b")).alias("c")).distinct()


def burned_all_touched(edges: DataFrame, block: float, x_min: float, y_max: float, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """The cells that polygons touch at all: ``burned`` and the cells that an edge passes through."""
    r0, r1 = (F.floor((y_max - F.greatest("y0", "y1")) / block), F.floor((y_max - F.least("y0", "y1")) / block))
    per_row = edges.select(*keys, "x0", "y0", "x1", "y1", F.explode(F.sequence(r0.cast("int"), r1.cast("int"))).alias("r"))
    top, bottom = y_max - F.col("r") * block, y_max - (F.col("r") + 1) * block
    x_at = lambda y: F.when(F.col("y0") == F.col("y1"), F.col("x0")).otherwise(F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    low_y, high_y = F.greatest(bottom, F.least("y0", "y1")), F.least(top, F.greatest("y0", "y1"))
    flat = F.col("y0") == F.col("y1")
    xa = F.when(flat, F.least("x0", "x1")).otherwise(F.least(x_at(low_y), x_at(high_y)))
    xb = F.when(flat, F.greatest("x0", "x1")).otherwise(F.greatest(x_at(low_y), x_at(high_y)))
    span = per_row.select(*keys, "r", F.floor((xa - x_min) / block).cast("int").alias("a"), F.floor((xb - x_min) / block).cast("int").alias("b"))
    passed = span.select(*keys, "r", F.explode(F.sequence("a", "b")).alias("c"))
    return burned(edges, block, x_min, y_max, keys).union(passed).distinct()


def snapshot(cells: DataFrame, layers: DataFrame) -> DataFrame:
    """r, c, state, origin, seed of a grid (r, c) as layers (layer, r, c: cells that ``built``, ``green``, ``unbuildable`` and ``centres`` cover)
    leave it: built land stays built, whatever else lies on it, and only centres on built land are seeds."""
    on = layers.groupBy("r", "c").agg(*[F.coalesce(F.bool_or(F.col("layer") == k), F.lit(False)).alias(k) for k in ("built", "green", "unbuildable", "centres")])
    state = F.when(F.col("built"), 1).when(F.col("unbuildable"), -1).otherwise(0)
    origin = F.when(F.col("built"), 1).when(F.col("green"), 0).otherwise(-1)
    return cells.select("r", "c").join(on, ["r", "c"], "left").select("r", "c", state.alias("state"), origin.alias("origin"), F.coalesce(F.col("built") & F.col("centres"), F.lit(False)).alias("seed"))


def box_edges(boxes: DataFrame) -> DataFrame:
    """The four edges of rectangles pid, x0, y0, x1, y1."""
    corners = [("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0")]
    edges = F.explode(F.array(*[F.struct(*[F.col(k).alias(n) for k, n in zip(e, ("x0", "y0", "x1", "y1"))]) for e in corners]))
    return boxes.select("pid", edges.alias("e")).select("pid", "e.*")


def ring_edges(features: DataFrame, key: str = "fid") -> DataFrame:
    """Edges of the rings (arrays of x, y) in column ``rings``."""
    points = features.select(key, F.explode("rings").alias("ring"))
    pairs = F.explode(F.expr("zip_with(slice(ring, 1, size(ring) - 1), slice(ring, 2, size(ring) - 1), (a, b) -> struct(a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1))"))
    return points.where(F.size("ring") > 1).select(key, pairs.alias("e")).select(key, "e.*")


def point_cells(points: DataFrame, block: float, x_min: float, y_max: float, rows: int, cols: int) -> DataFrame:
    """point_id, r, c of the points that lie in the grid."""
    cells = points.select("point_id", F.floor((y_max - F.col("y")) / block).cast("int").alias("r"), F.floor((F.col("x") - x_min) / block).cast("int").alias("c"))
    return cells.where((F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < cols))


def layered(cells: DataFrame, extent: Column, built: Column, green: Column, unbuildable: Column, built_first: bool = False) -> DataFrame:
    """r, c, state, origin from layers of flags. Later layers overwrite earlier ones (extent, built,
    green, unbuildable); with ``built_first`` neither green nor unbuildable land replaces built cells, and all is cut to the extent."""
    if built_first:
        state = F.when(~extent, -1).when(built, 1).when(unbuildable, -1).otherwise(0)
        origin = F.when(~extent, -1).when(built, 1).when(green & ~unbuildable, 0).otherwise(-1)
    else:
        state = F.when(unbuildable, -1).when(green, 0).when(built, 1).when(extent, 0).otherwise(-1)
        origin = F.when(green, 0).when(built, 1).otherwise(-1)
    return cells.select("r", "c", state.cast("int").alias("state"), origin.cast("int").alias("origin"))


def _nearest(sources: DataFrame, cells: DataFrame, reach: int) -> DataFrame:
    """For each source (ord, r, c): the nearest of ``cells`` by square ring, then squared distance, then place."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = sources.select("ord", "r", "c", F.explode(steps).alias("dr")).select("*", F.explode(steps).alias("dc"))
    near = around.select("ord", (F.col("r") + F.col("dr")).alias("tr"), (F.col("c") + F.col("dc")).alias("tc"), F.greatest(F.abs("dr"), F.abs("dc")).alias("ring"), (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"))
    # A source is (2 reach + 1) squared rows here, which no size by bytes of files shows: never to be broadcast.
    found = near.hint("merge").join(cells.select(F.col("r").alias("tr"), F.col("c").alias("tc")), ["tr", "tc"])
    return found.groupBy("ord").agg(F.min(F.struct("ring", "d2", "tr", "tc")).alias("b")).select("ord", F.col("b.ring").alias("ring"), F.col("b.tr").alias("r"), F.col("b.tc").alias("c"))


def snapped_seeds(seeds: DataFrame, cells: DataFrame, block: float, max_snap: float) -> DataFrame:
    """ord, r, c, status of each seed: kept, snapped (to the nearest buildable cell), dropped, or duplicate
    of an earlier seed on the same cell."""
    found = _nearest(seeds, cells.where("state <> -1"), int(max_snap / block))
    placed = seeds.select("ord").join(found, "ord", "left")
    first = F.row_number().over(W.partitionBy("r", "c").orderBy("ord"))
    status = F.when(F.col("r").isNull(), "dropped").when(first > 1, "duplicate").when(F.col("ring") == 0, "kept").otherwise("snapped")
    return placed.select("ord", "r", "c", status.alias("status"))


def nearest_built(points: DataFrame, built: DataFrame, reach: int) -> DataFrame:
    """ord, r, c of the built cell nearest to each point within ``reach`` rings."""
    return _nearest(points, built, reach).select("ord", "r", "c")


def slopes(heights: DataFrame, block: float) -> DataFrame:
    """r, c, degrees: angle of the gradient, by central differences, one-sided at the edges."""

    def along(line: str, at: str) -> Column:
        w = W.partitionBy(line).orderBy(at)
        before, after, own = F.lag("h").over(w), F.lead("h").over(w), F.col("h")
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), (after - own) / block).when(after.isNull(), (own - before) / block).otherwise((after - before) / (2 * block))

    g = heights.select("r", "c", along("r", "c").alias("gx"), along("c", "r").alias("gy"))
    return g.select("r", "c", F.degrees(F.atan(F.hypot("gx", "gy"))).alias("degrees"))


#: Slopes, in degrees, above which land is told apart.
SLOPE_BANDS = (15, 20, 25, 30)


def steeper(slope: DataFrame, bands: tuple[int, ...] = SLOPE_BANDS) -> DataFrame:
    """r, c, band: the cells steeper than each band."""
    return slope.select("r", "c", "degrees", F.explode(F.array(*[F.lit(b) for b in bands])).alias("band")).where("degrees > band").select("r", "c", "band")


def slope_bands(slope: DataFrame, bands: tuple[int, ...] = SLOPE_BANDS) -> DataFrame:
    """r, band, c_from, c_to: stretches of a row's cells steeper than each band."""
    steep = steeper(slope, bands)
    island = F.col("c") - F.row_number().over(W.partitionBy("r", "band").orderBy("c"))
    return steep.withColumn("i", island).groupBy("r", "band", "i").agg(F.min("c").alias("c_from"), F.max("c").alias("c_to")).select("r", "band", "c_from", "c_to")


def buffered_line_cells(edges: DataFrame, cells: DataFrame, block: float, x_min: float, y_max: float, width: float) -> DataFrame:
    """fid, r, c of the cells whose centres lie within ``width`` of a line's edges (fid, x0, y0, x1, y1).

    Row by row: what lies within ``width`` of an edge is convex, so a row holds one stretch of it, which ends on one of the
    round ends or of the two sides. Only cells of that stretch are made, never the edge's box."""
    r_from, r_to = F.floor((y_max - F.greatest("y0", "y1") - width) / block).cast("int"), F.floor((y_max - F.least("y0", "y1") + width) / block).cast("int")
    y = y_max - (F.col("r") + 0.5) * block
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.hypot(dx, dy)
    half = lambda i: F.sqrt(F.lit(width * width) - (y - F.col(f"y{i}")) * (y - F.col(f"y{i}")))  # noqa: E731  null or not a number off the round end
    ends = [F.when(F.abs(y - F.col(f"y{i}")) <= width, F.col(f"x{i}") + sign * half(i)) for i in "01" for sign in (-1, 1)]

    def side(sign: int) -> Column:
        """Where the row meets the side at the right (or left) hand."""
        ax, ay = F.col("x0") + sign * width * dy / length, F.col("y0") - sign * width * dx / length
        t = (y - ay) / F.nullif(dy, F.lit(0.0))
        return F.when((length > 0) & t.between(0, 1), ax + t * dx)

    at = [*ends, side(1), side(-1)]
    # A file of few bytes is one task, but each edge is many cells: dealt out before they are made.
    edges = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *edges.columns)
    # A hair's breadth more, for what rounding may lose; the distance decides.
    rows = edges.select("*", F.explode(F.sequence(r_from, r_to)).alias("r")).withColumn("a", F.least(*at) - 1e-6 * block).withColumn("b", F.greatest(*at) + 1e-6 * block)
    first, last = F.ceil((F.col("a") - x_min) / block - 0.5).cast("int"), F.floor((F.col("b") - x_min) / block - 0.5).cast("int")
    near = rows.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("c"))
    px = x_min + (F.col("c") + 0.5) * block
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("x0")) * dx + (y - F.col("y0")) * dy) / square)))
    within = F.hypot(px - F.col("x0") - t * dx, y - F.col("y0") - t * dy) <= width
    return near.where(within).select("fid", "r", "c").distinct().hint("merge").join(cells.select("r", "c"), ["r", "c"], "left_semi").select("fid", "r", "c")


def large_enough_extent(grids: DataFrame, walk_m: float) -> DataFrame:
    """``grids`` (rows, cols, block_m) with ``ok``: both sides longer than twice the walk."""
    side = lambda k: F.col(k) * F.col("block_m") > 2 * walk_m
    return grids.withColumn("ok", side("rows") & side("cols"))


def inner_row_points(burned_cells: DataFrame, key: str = "pid") -> DataFrame:
    """A cell inside each polygon: the middle of the widest stretch of its middle row (ties: the first stretch)."""
    rows = burned_cells.groupBy(key).agg(F.floor((F.min("r") + F.max("r")) / 2).cast("int").alias("r"))
    line = burned_cells.join(rows, [key, "r"])
    island = F.col("c") - F.row_number().over(W.partitionBy(key).orderBy("c"))
    spans = line.withColumn("i", island).groupBy(key, "r", "i").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    best = spans.groupBy(key, "r").agg(F.min(F.struct((F.col("a") - F.col("b")).alias("w"), F.col("a"), F.col("b"))).alias("s"))
    return best.select(key, "r", F.floor((F.col("s.a") + F.col("s.b")) / 2).cast("int").alias("c"))


def block_plan(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """r, c, plan of a grid of rectangles ``ord, r0, r1, c0, c1, code`` (ends not included); of several the last counts, none is 0."""
    filled = blocks.select("ord", "code", "c0", "c1", F.explode(F.expr("CASE WHEN r0 < r1 THEN sequence(r0, r1 - 1) END")).alias("r")).select("ord", "code", "r", F.explode(F.expr("CASE WHEN c0 < c1 THEN sequence(c0, c1 - 1) END")).alias("c"))
    last = filled.groupBy("r", "c").agg(F.max_by("code", "ord").alias("code"))
    return cells.select("r", "c").join(last, ["r", "c"], "left").select("r", "c", F.coalesce("code", F.lit(0)).cast("int").alias("plan"))


def overlap_check(a: DataFrame, b: DataFrame, block_m: float, most_m2: float = 1.0) -> DataFrame:
    """overlap_m2, ok: the area of the cells that two layers share, which must be below ``most_m2``."""
    shared = a.select("r", "c").distinct().join(b.select("r", "c").distinct(), ["r", "c"], "left_semi")
    area = (F.count(F.lit(1)) * block_m * block_m).cast("double")
    return shared.agg(area.alias("overlap_m2"), (area < most_m2).alias("ok"))
