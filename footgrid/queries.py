"""The engine's queries over the driver's tables: name to function of (spark, sf_dir).

Grids come from ``sources.bridge``; each query applies one operator, or a few, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from footgrid.functions import codes, params, table_functions, tags
from footgrid.functions.storage import kept
from footgrid.operators import components as comp, geometry, neighbours as nb, polygons, raster, walk
from footgrid.plans import centres, classify, growth, report, score, tiers
from footgrid.sources import bridge, geojson

G = bridge.BLOCK_M
CENTRE_M, GREEN_M, SPAN_M = 800.0, 400.0, 400.0
TIERS_KM2, SHARES = (6000.0, 3000.0, 1000.0), (0.2, 0.3, 0.5)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Sources and rasters


@query
def grid_align(spark, sf_dir):
    return raster.aligned(bridge.boxes(spark, sf_dir), float(G))


@query
def grid_dense(spark, sf_dir):
    rows = bridge.n_rows(spark, sf_dir)
    return raster.dense(spark, rows, bridge.COLUMNS, float(G), 0.0, float(rows * G))


@query
def burn_boxes(spark, sf_dir):
    return raster.burned(raster.box_edges(bridge.boxes(spark, sf_dir)), float(G), 0.0, float(bridge.n_rows(spark, sf_dir) * G))


@query
def burn_all_touched(spark, sf_dir):
    return raster.burned_all_touched(raster.box_edges(bridge.boxes(spark, sf_dir)), float(G), 0.0, float(bridge.n_rows(spark, sf_dir) * G))


def _layers(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = bridge.table(spark, sf_dir, "orders")
    return orders.select(
        F.expr("o_orderkey div 100").cast("int").alias("r"), (k % 100).cast("int").alias("c"), (F.col("o_custkey") % 10 < 8).alias("extent"), (F.col("o_custkey") % 3 == 0).alias("built"),
        (F.col("o_orderpriority") == "1-URGENT").alias("green"), (F.col("o_orderpriority") == "5-LOW").alias("blocked"),
    )


@query
def layer_precedence(spark, sf_dir):
    return raster.layered(_layers(spark, sf_dir), *map(F.col, ("extent", "built", "green", "blocked")))


@query
def layer_precedence_alt(spark, sf_dir):
    return raster.layered(_layers(spark, sf_dir), *map(F.col, ("extent", "built", "green", "blocked")), built_first=True)


@query
def points_to_cells(spark, sf_dir):
    rows = bridge.n_rows(spark, sf_dir)
    e = bridge.table(spark, sf_dir, "events")
    points = e.select(F.col("event_id").alias("point_id"), ((F.col("event_id") * 137 % 12000) - 900).cast("double").alias("x"), (F.col("user_id") * 211 % (rows * G + 500)).cast("double").alias("y"))
    return raster.point_cells(points, float(G), 0.0, float(rows * G), rows, bridge.COLUMNS)


@query
def seed_snap(spark, sf_dir):
    return raster.snapped_seeds(bridge.seeds(spark, sf_dir), bridge.cells(spark, sf_dir), float(G), 300.0)


@query
def nearest_built(spark, sf_dir):
    return raster.nearest_built(bridge.seeds(spark, sf_dir), bridge.cells(spark, sf_dir).where("state = 1"), 8)


def _heights(spark, sf_dir):
    orders = bridge.table(spark, sf_dir, "orders")
    return orders.select(F.expr("o_orderkey div 100").cast("int").alias("r"), (F.col("o_orderkey") % 100).cast("int").alias("c"), (F.col("o_custkey") % 61).cast("double").alias("h"))


@query
def slope_bands(spark, sf_dir):
    return raster.slope_bands(raster.slopes(_heights(spark, sf_dir), 30.0))


@query
def feature_measures(spark, sf_dir):
    """Area and outline of rectangles as rings, with the zone and the query order of their lower corner taken as degrees."""
    xy = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rings = bridge.boxes(spark, sf_dir).withColumn("ring", F.array(xy("x0", "y0"), xy("x1", "y0"), xy("x1", "y1"), xy("x0", "y1"), xy("x0", "y0")))
    lon, lat = F.col("x0") / 50 - 90, F.col("y0") / 400 - 10
    return rings.select("pid", geometry.ring_area(F.col("ring")).alias("area"), geometry.line_length(F.col("ring")).alias("outline"), geometry.utm_epsg(lon, lat).alias("epsg"))


@query
def clip_difference(spark, sf_dir):
    """Cells of green inside the extent and outside built land, in cell space."""
    layers = _layers(spark, sf_dir)
    return geometry.without(geometry.clipped(layers.where("green").select("r", "c"), layers.where("extent")), layers.where("built"))


@query
def barrier_corridors(spark, sf_dir):
    """Cells within 150 m of lines."""
    k, height = F.col("p_partkey"), bridge.n_rows(spark, sf_dir) * G
    lines = bridge.table(spark, sf_dir, "part").select(k.alias("fid"), (k * 37 % 9000).cast("double").alias("x0"), (k * 53 % height).cast("double").alias("y0"), (k * 37 % 9000 + 10 * F.col("p_size")).cast("double").alias("x1"), (k * 53 % height + 7 * F.col("p_size")).cast("double").alias("y1"))
    return raster.buffered_line_cells(lines, bridge.cells(spark, sf_dir), float(G), 0.0, float(height), 150.0)


@query
def elevation_heights(spark, sf_dir):
    """Heights of cells from tiles, some missing; the tile's name is part of the key."""
    from footgrid.sources import dem

    k = F.col("o_orderkey")
    cells = bridge.table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 100").cast("int").alias("r"), (k % 100).cast("int").alias("c"), dem.tile_name((k % 7 - 3).cast("double") + 0.5, (k % 5 - 2).cast("double") + 0.25).alias("tile"), (k % 10).alias("row"), (k % 9).alias("col"))
    key = F.col("p_partkey")
    places = bridge.table(spark, sf_dir, "part").select(dem.tile_name((key % 7 - 3).cast("double"), F.lit(0.0)).alias("tile"), (key % 10).alias("row"), (key % 9).alias("col"), key.cast("double").alias("h"))
    return dem.heights(cells, places.groupBy("tile", "row", "col").agg(F.max("h").alias("h")))


@query
def extent_guard(spark, sf_dir):
    n = F.col("n_nationkey")
    return raster.large_enough_extent(bridge.table(spark, sf_dir, "nation").select(n.alias("id"), (n * 3 + 1).alias("rows"), (40 - n).alias("cols"), F.lit(50.0).alias("block_m")), 400.0)


@query
def inner_row_points(spark, sf_dir):
    boxes = bridge.boxes(spark, sf_dir)
    return raster.inner_row_points(raster.burned(raster.box_edges(boxes), float(G), 0.0, float(bridge.n_rows(spark, sf_dir) * G)))


# Polygons


def _loops(frame: DataFrame, *loops: list[tuple]) -> DataFrame:
    """fid and the edges, in metres, of closed loops of corners (pairs of columns)."""
    sides = [(*a, *b) for loop in loops for a, b in zip(loop, [*loop[1:], loop[0]])]
    edges = F.array(*[F.struct(*[(v if not isinstance(v, (int, float)) else F.lit(v)).cast("double").alias(n) for v, n in zip(e, polygons.ENDS)]) for e in sides])
    return frame.select("fid", F.explode(edges).alias("e")).select("fid", "e.*")


def _square(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def _placed(spark, sf_dir):
    """fid, x, y, s of a place and a size for each part."""
    k = F.col("p_partkey")
    return bridge.table(spark, sf_dir, "part").select(k.alias("fid"), (k * 37 % 9000).alias("x"), (k * 53 % (bridge.n_rows(spark, sf_dir) * G - 600)).alias("y"), (F.col("p_size") * 20).alias("s"))


def _triangles(spark, sf_dir):
    """Right-angled triangles, a corner at the lower left."""
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    return polygons.snapped(_loops(_placed(spark, sf_dir), [(x, y), (x + s, y), (x, y + s)]))


def _supplier_squares(spark, sf_dir):
    """Squares that don't overlap, one for each supplier."""
    k = F.col("s_suppkey")
    at = bridge.table(spark, sf_dir, "supplier").select(k.alias("fid"), (k % 9 * 1000 + 100).alias("x"), (F.expr("s_suppkey div 9") * 1000 + 50).alias("y"), (k % 7 * 50 + 500).alias("s"))
    return polygons.snapped(_loops(at, _square(F.col("x"), F.col("y"), F.col("s"), F.col("s"))))


@query
def valid_rings(spark, sf_dir):
    """Land inside rings that cross themselves: bow-ties, squares that overlap, squares with a spike and a hole."""
    at = _placed(spark, sf_dir)
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    kind = F.col("fid") % 3
    edges = _loops(at.where(kind == 0), [(x, y), (x + s, y + s), (x + s, y), (x, y + s)])
    edges = edges.union(_loops(at.where(kind == 1), _square(x, y, s, s), _square(x + s / 2, y + s / 2, s, s)))
    edges = edges.union(_loops(at.where(kind == 2), [(x, y), (x + s, y), (x + s, y + s / 2), (x + 3 * s, y + s / 2), (x + s, y + s / 2), (x + s, y + s), (x, y + s)], _square(x + s / 4, y + s / 4, s / 2, s / 2)))
    linked = kept(polygons.rings(polygons.valid(polygons.snapped(edges)), ("fid",)), "rings")
    return polygons.ring_measures(linked, ("fid",)).groupBy("fid").agg(F.count(F.lit(1)).alias("rings"), (F.sum("area2") / 2e6).cast("double").alias("area"))


@query
def clip_polygons(spark, sf_dir):
    """What triangles share with squares, pair by pair."""
    shared = polygons.clipped(_triangles(spark, sf_dir), _supplier_squares(spark, sf_dir))
    return shared.groupBy("fid", "other").agg((polygons.twice_area() / 2e6).cast("double").alias("area"))


@query
def cut_polygons(spark, sf_dir):
    """What squares leave of triangles, whole."""
    left = polygons.cut_out(_triangles(spark, sf_dir), _supplier_squares(spark, sf_dir))
    return left.groupBy("fid").agg((polygons.twice_area() / 2e6).cast("double").alias("area"))


@query
def cut_fragments(spark, sf_dir):
    """Connected parts that squares leave of triangles, those worth keeping; no SQL, held against a brute-force version in the tests."""
    left = polygons.cut_out(_triangles(spark, sf_dir), _supplier_squares(spark, sf_dir))
    return polygons.large_parts(left, ("fid",), geometry.LEAST_AREA).select("fid", "area", "rings")


@query
def layer_union(spark, sf_dir):
    """The land that all rectangles cover, overlapping or not, and the length of its outline."""
    layer = polygons.merged_layer(polygons.snapped(raster.box_edges(bridge.boxes(spark, sf_dir)).withColumnRenamed("pid", "fid")))
    length = F.sum(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))) / 1000.0
    return layer.agg((polygons.twice_area() / 2e6).cast("double").alias("area"), length.alias("outline"))


def _outlined(cells, keys=()):
    """keys, root_r, root_c, cells, sides, rings of each connected part (by sides) of cells."""
    k = [*keys, "root"]
    labels = comp.components(cells, False, keys)
    linked = kept(polygons.rings(polygons.dissolved(polygons.cell_edges(labels, k), k), k, 64), "rings")
    found = polygons.ring_measures(linked, k).groupBy(*k).agg((F.sum("area2") / 2).cast("long").alias("cells"), F.sum("edges").alias("sides"), F.count(F.lit(1)).alias("rings"))
    return found.select(*keys, F.shiftright("root", 32).cast("int").alias("root_r"), (F.col("root") % (1 << 32)).cast("int").alias("root_c"), "cells", "sides", "rings")


@query
def built_outlines(spark, sf_dir):
    """Built land as polygons: area, sides and rings (holes too) of each part."""
    return _outlined(bridge.cells(spark, sf_dir).where("state = 1"))


@query
def slope_band_polygons(spark, sf_dir):
    """Land steeper than each band, as polygons."""
    return _outlined(raster.steeper(raster.slopes(_heights(spark, sf_dir), 30.0)), ("band",))


@query
def line_corridors(spark, sf_dir):
    """Area of the polygons within 15 m of lines of two stretches; no SQL, held against a brute-force version in the tests."""
    x, y, s = F.col("x").cast("double"), F.col("y").cast("double"), F.col("s").cast("double")
    ends = [(x, y, x + s, y + s / 2), (x + s, y + s / 2, x + s / 3, y + 2 * s)]
    edges = _placed(spark, sf_dir).select("fid", F.explode(F.array(*[F.struct(*[v.alias(n) for v, n in zip(e, polygons.ENDS)]) for e in ends])).alias("e")).select("fid", "e.*")
    around = polygons.widened(polygons.snapped(edges), 15.0 * polygons.STEPS)
    return around.groupBy("fid").agg(F.round(polygons.twice_area() / 2e6, 1).cast("double").alias("area"))


# Tagged map features


def _tag_text():
    q = lambda k, v: F.concat(F.lit(f'"{k}"=>"'), v if not isinstance(v, str) else F.lit(v), F.lit('"'))
    kind, n = F.col("event_type"), F.col("event_id")
    own = (
        F.when(kind == "view", F.concat(q("highway", "residential"), F.lit(","), q("name", F.concat(F.lit("a, "), n.cast("string")))))
        .when(kind == "click", F.concat(q("building", "yes"), F.lit(","), q("landuse", F.when(n % 2 == 0, "retail").otherwise("industrial"))))
        .when(kind == "signup", F.when(n % 3 == 0, q("railway", "station")).otherwise(q("highway", "bus_stop")))
        .when(kind == "purchase", F.concat(F.lit('"leisure" => "park"'), F.lit(","), q("name", r"the \"green\" one")))
        .otherwise(F.when(n % 2 == 0, q("waterway", "river")).otherwise(F.lit("")))
    )
    return own


@query
def osm_hstore(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), _tag_text().alias("t"), (F.col("user_id") % 5).alias("u"))
    native = F.create_map(F.lit("name"), F.when(F.col("u") > 0, F.concat(F.lit("native "), F.col("u").cast("string"))).otherwise(""), F.lit("highway"), F.lit("track"))
    return e.select("id", F.explode(tags.merged(native, tags.parsed(F.col("t")))))


@query
def osm_route(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events").select("event_id", tags.parsed(_tag_text()).alias("tags"))
    return tags.routed(e).groupBy("dataset", F.coalesce("highway", F.lit("-")).alias("highway")).agg(F.count(F.lit(1)).alias("n"), F.sum(tags.is_barrier(F.col("tags")).cast("long")).alias("barriers"))


#: Tags of which the features of ``osm_route_kinds`` have one each.
KIND_TAGS = (
    ("highway", "bus_stop"), ("highway", "primary_link"), ("highway", "residential"), ("highway", ""), ("railway", "tram"), ("railway", "halt"), ("public_transport", "stop_position"), ("public_transport", "station"),
    ("waterway", "stream"), ("waterway", "dock"), ("natural", "water"), ("natural", "heath"), ("natural", "wetland"), ("landuse", "quarry"), ("landuse", "industrial"), ("landuse", "village_green"), ("landuse", "cemetery"),
    ("landuse", "commercial"), ("leisure", "garden"), ("leisure", "recreation_ground"), ("aeroway", "helipad"), ("military", "yes"), ("building", "yes"),
)


def _kinds(spark, sf_dir):
    """Features with one tag each, of all three kinds, routed."""
    pairs = F.array(*[F.create_map(F.lit(k), F.lit(v)) for k, v in KIND_TAGS])
    kinds = F.array(*map(F.lit, ("point", "line", "polygon")))
    e = bridge.table(spark, sf_dir, "events").select(F.get(pairs, F.col("user_id") % len(KIND_TAGS)).alias("tags"), F.get(kinds, F.col("event_id") % 3).alias("kind"))
    return tags.routed(e, "kind")


@query
def osm_route_kinds(spark, sf_dir):
    """Features by dataset where each dataset takes its own kind of geometry."""
    return _kinds(spark, sf_dir).groupBy("dataset", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def osm_query_text(spark, sf_dir):
    """The map queries of a box for each supplier."""
    k = F.col("s_suppkey")
    south, west = k % 60 + 0.5, k * 7 % 170 + 0.25
    areas = bridge.table(spark, sf_dir, "supplier").select(k.alias("area"), south.cast("double").alias("south"), west.cast("double").alias("west"), (south + 1).cast("double").alias("north"), (west + 1).cast("double").alias("east"))
    return tags.query_texts(areas)


@query
def osm_way_coords(spark, sf_dir):
    from footgrid.sources import osm

    nodes = bridge.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), (F.col("user_id") / 10.0).alias("lon"), (F.col("event_id") / 100.0).alias("lat"))
    # References of the last tenth of the numbers have no node.
    k, n = F.col("o_orderkey"), F.lit(bridge.table(spark, sf_dir, "events").count() * 10 // 9)
    refs = F.array(k % n, (k * 3 + 1) % n, (k * 7 + 2) % n, F.when(k % 2 == 0, k % n).otherwise((k + 5) % n))
    ways = bridge.table(spark, sf_dir, "orders").select(k.cast("string").alias("way_id"), F.transform(refs, lambda x: x.cast("string")).alias("refs"))
    return osm.way_coordinates(ways, nodes).select("way_id", F.size("points").cast("long").alias("n_pts"), osm.is_closed(F.col("points")).alias("closed"))


# Neighbourhoods


@query
def nbr_counts(spark, sf_dir):
    return nb.neighbour_counts(bridge.cells(spark, sf_dir).select("r", "c", "state"), F.col("n_state") == 1)


@query
def ring_runs(spark, sf_dir):
    return nb.ring_runs(bridge.cells(spark, sf_dir).select("r", "c", "state"), F.col("n_state") > 0)


@query
def green_spans(spark, sf_dir):
    return nb.green_spans(bridge.cells(spark, sf_dir)).where("state = 0").drop("state")


@query
def span_admissible(spark, sf_dir):
    return nb.span_admissible(nb.green_spans(bridge.cells(spark, sf_dir)), SPAN_M / G)


@query
def box_sum(spark, sf_dir):
    return nb.box_sum(bridge.cells(spark, sf_dir), (F.col("state") == 1).cast("long"), 3)


@query
def disk_cover(spark, sf_dir):
    return nb.disk_cover(bridge.seeds(spark, sf_dir), bridge.cells(spark, sf_dir), 6)


@query
def components_queen(spark, sf_dir):
    return comp.numbered(comp.components(bridge.cells(spark, sf_dir).where("state = 1"), True)).select("r", "c", "label")


@query
def components_rook(spark, sf_dir):
    return comp.numbered(comp.components(bridge.cells(spark, sf_dir).where("state = 0"), False)).select("r", "c", "label")


@query
def large_components(spark, sf_dir):
    return comp.large_components(bridge.cells(spark, sf_dir).where("state = 0"), 16, False)


@query
def component_sizes(spark, sf_dir):
    labels = comp.numbered(comp.components(bridge.cells(spark, sf_dir).where("state = 1"), True))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.min("r").alias("r_min"), F.min("c").alias("c_min"))


@query
def walk_open(spark, sf_dir):
    f = walk.open_walk_field(bridge.seeds(spark, sf_dir), bridge.cells(spark, sf_dir), CENTRE_M, G)
    return f.withColumn("dist", F.round("dist", 6))


def _seeded(spark, sf_dir):
    seeds = bridge.seeds(spark, sf_dir).select("r", "c").distinct().withColumn("seed", F.lit(True))
    return bridge.cells(spark, sf_dir).join(seeds, ["r", "c"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))


@query
def walk_blocked(spark, sf_dir):
    f = walk.walk_field(_seeded(spark, sf_dir), F.col("seed"), F.col("state") == -1, CENTRE_M, G)
    return f.select("r", "c", "n_orth", "n_diag", F.round("dist", 6).alias("dist"))


@query
def walk_sql(spark, sf_dir):
    """``walk_blocked`` by a table function in SQL."""
    table_functions.registered(spark)
    table_functions.tiled(_seeded(spark, sf_dir), F.col("seed"), F.col("state") != -1, CENTRE_M, G).createOrReplaceTempView("footgrid_tiles")
    return spark.sql(f"SELECT r, c, n_orth, n_diag, round(length * {float(G)}D, 6) AS dist FROM walk_tiles(TABLE(SELECT * FROM footgrid_tiles) PARTITION BY (tr, tc), {CENTRE_M / G}D, 256)")


@query
def block_labels(spark, sf_dir):
    """Built parts within blocks of 16 by 16 cells, by a table function in SQL."""
    table_functions.registered(spark)
    bridge.cells(spark, sf_dir).where("state = 1").selectExpr("r div 16 AS br", "c div 16 AS bc", "r", "c").createOrReplaceTempView("footgrid_blocks")
    return spark.sql("SELECT r, c, first_r, first_c FROM label_tiles(TABLE(SELECT * FROM footgrid_blocks) PARTITION BY (br, bc), true)")


@query
def reach_mask(spark, sf_dir):
    return walk.reach(_seeded(spark, sf_dir), F.col("seed"), F.col("state") == 0, F.col("state") >= 0, 400.0, G)


@query
def green_access(spark, sf_dir):
    cells = walk.green_periphery(bridge.cells(spark, sf_dir))
    acc = walk.access_counts(cells, F.col("itx") == 2, F.col("itx") >= 0, 300.0, G)
    return cells.join(acc, ["r", "c"], "left").select("r", "c", "itx", F.coalesce("acc", F.lit(0)).alias("acc"))


@query
def centre_access(spark, sf_dir):
    cells = _seeded(spark, sf_dir)
    return walk.access_counts(cells, F.col("seed") & (F.col("state") >= 0), F.col("state") >= 0, CENTRE_M, G)


@query
def interior_point(spark, sf_dir):
    return centres.interior_points(comp.components(bridge.cells(spark, sf_dir).where("state = 1"), True)).select(F.shiftright("root", 32).cast("int").alias("root_r"), (F.col("root") % (1 << 32)).cast("int").alias("root_c"), "r", "c")


# Classes, plans, ensembles


@query
def classify_cells(spark, sf_dir):
    cells = bridge.plan(spark, sf_dir)
    origin = F.when(F.col("old_centre"), 2).otherwise(F.col("origin"))
    coded = cells.select("r", "c", codes.animation_class(F.col("state"), origin, F.col("density"), bridge.HIGH, bridge.MEDIUM, bridge.LOW).cast("int").alias("cls"))
    return coded.join(F.broadcast(codes.legend(spark)), "cls").select("r", "c", "cls", "label")  # eleven rows


def _plan(spark, sf_dir):
    """The bridge's plan: coded, with origin and density."""
    grid = bridge.plan(spark, sf_dir)
    coded = classify.state_to_plan(grid, G, SPAN_M, also=("state", "origin", "density", "old_centre"))
    marked = classify.marked_existing(coded, F.col("state") == 2, F.col("old_centre"), F.col("origin") == 1)
    return marked.select("r", "c", "plan", "origin", "density")


@query
def state_to_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("r", "c", "plan")


@query
def existing_fabric(spark, sf_dir):
    return classify.existing_fabric(_seeded(spark, sf_dir), F.col("seed"))


@query
def stage_codes(spark, sf_dir):
    return classify.stage_codes(bridge.cells(spark, sf_dir))


@query
def likelihood_shown(spark, sf_dir):
    return classify.shown_likelihood(growth.likelihood(bridge.members(spark, sf_dir)))


@query
def class_counts(spark, sf_dir):
    return growth.class_counts(bridge.members(spark, sf_dir))


@query
def probability(spark, sf_dir):
    return growth.development_probability(bridge.members(spark, sf_dir))


@query
def likelihood(spark, sf_dir):
    return growth.likelihood(bridge.members(spark, sf_dir))


@query
def tier_draw(spark, sf_dir):
    u = growth.lcg_draw(F.lit(7), F.lit(3), F.col("r"), F.col("c"), F.lit(1))
    return bridge.cells(spark, sf_dir).where("state = 1").select("r", "c", codes.tier_of_draw(u, 0.4, 0.4, *TIERS_KM2).cast("double").alias("tier"))


@query
def prune(spark, sf_dir):
    return classify.pruned(_plan(spark, sf_dir).select("r", "c", "plan"), 12)


@query
def absorb(spark, sf_dir):
    return classify.absorbed(_plan(spark, sf_dir).select("r", "c", "plan"), 6)


# Scores


def _distances(spark, sf_dir):
    return score.distances(_plan(spark, sf_dir), G, CENTRE_M, GREEN_M, SPAN_M)


@query
def coverage(spark, sf_dir):
    return score.coverage(_distances(spark, sf_dir), CENTRE_M, GREEN_M)


@query
def compactness(spark, sf_dir):
    return score.compactness(_plan(spark, sf_dir))


@query
def provision(spark, sf_dir):
    return score.provision(_plan(spark, sf_dir), G, 2850.0)


@query
def efficiency(spark, sf_dir):
    return score.efficiency(_distances(spark, sf_dir), CENTRE_M, GREEN_M)


@query
def transit(spark, sf_dir):
    stops = bridge.stops(spark, sf_dir, "view").union(bridge.stops(spark, sf_dir, "signup")).distinct()
    return score.transit(_plan(spark, sf_dir), stops, G, CENTRE_M, 600.0)


@query
def centre_audit(spark, sf_dir):
    audit = score.centre_audit(_plan(spark, sf_dir), G, GREEN_M)
    return audit.drop("root")


@query
def audit_summary(spark, sf_dir):
    return score.audit_summary(score.centre_audit(_plan(spark, sf_dir), G, GREEN_M))


@query
def weakest5(spark, sf_dir):
    return score.weakest(score.centre_audit(_plan(spark, sf_dir), G, GREEN_M))


def _arranged(spark, sf_dir):
    return tiers.arranged(_distances(spark, sf_dir), SHARES, TIERS_KM2)


def _tiered(spark, sf_dir):
    """The plan is written once: its codes and its walks both read it."""
    plan = kept(_plan(spark, sf_dir), "plan")
    return tiers.tiered_plan(plan, tiers.arranged(score.distances(plan, G, CENTRE_M, GREEN_M, SPAN_M), SHARES, TIERS_KM2), TIERS_KM2)


@query
def arrange_density(spark, sf_dir):
    return _arranged(spark, sf_dir)


@query
def tiered_plan(spark, sf_dir):
    return _tiered(spark, sf_dir)


@query
def tier_breakdown(spark, sf_dir):
    return tiers.breakdown(_tiered(spark, sf_dir), TIERS_KM2, G)


def _member_plans(states):
    """The states of an ensemble's members coded as plans."""
    coded = classify.state_to_plan(states, G, SPAN_M, ("member",), ("state",))
    return coded.select("member", "r", "c", F.when(F.col("state") == 2, 3).otherwise(F.col("plan")).alias("plan"))


def _scored_members(plan):
    return score.coverage(score.distances(plan, G, CENTRE_M, GREEN_M, SPAN_M, ("member",)), CENTRE_M, GREEN_M, ("member",))


def _member_scores(spark, sf_dir):
    return _scored_members(_member_plans(bridge.members(spark, sf_dir)))


@query
def select_member(spark, sf_dir):
    return growth.best_member(_member_scores(spark, sf_dir)).select("member", "access_cost")


@query
def select_placed_member(spark, sf_dir):
    """The member whose plan has the shortest walks once small settlements are gone and centres are placed, all members in one set of jobs;
    no SQL, held against each member alone in the tests."""
    placed = centres.keyed_variants(_member_plans(bridge.members(spark, sf_dir)), "member", ("placed",), G, CENTRE_M, 12)
    return growth.best_member(_scored_members(kept(placed.select("member", "r", "c", "plan"), "placed"))).select("member", "access_cost")


@query
def options_pivot(spark, sf_dir):
    """The scores of three members, taken by a stride of two, side by side."""
    scores = _scored_members(_member_plans(growth.strided(bridge.members(spark, sf_dir), "member", 7, 3)))
    scores = scores.select(F.concat(F.lit("m"), F.col("member").cast("string")).alias("option"), "centre_coverage", "green_coverage", "served_coverage", "access_cost")
    return report.options_pivot(scores, "option", ["centre_coverage", "green_coverage", "served_coverage", "access_cost"], ["m1", "m3", "m5"])


@query
def options_table(spark, sf_dir):
    """Every metric row of the comparison, an option for each region; some metrics are missing."""
    k = F.col("c_custkey")
    joined = bridge.table(spark, sf_dir, "customer").join(bridge.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = joined.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.sum(k % 97).alias("a"), F.sum(k % 89).alias("b"), F.sum(k % 5).alias("d"))
    of = bridge.table(spark, sf_dir, "region").join(sums, F.col("n_regionkey") == F.col("r_regionkey"))
    metrics = of.select(
        F.col("r_name").alias("option"), (F.col("a") * 0.5).alias("population"), F.col("n").alias("built_cells"), F.col("d").alias("n_centres"), (F.col("a") / (F.col("a") + F.col("b"))).alias("served_coverage"),
        (F.col("a") / (F.col("n") * 97)).alias("centre_coverage"), (F.col("b") / (F.col("n") * 89)).alias("green_coverage"), (1 - F.col("a") / (F.col("a") + F.col("b"))).alias("unserved_fraction"),
        (F.col("a") / F.col("n")).alias("centre_access"), F.when(F.col("r_regionkey") != 2, F.col("b") / F.col("n")).alias("green_access"), F.when(F.col("r_regionkey") == 1, F.lit(float("inf"))).otherwise(F.col("a") / 7.0).alias("centre_walk_mean"),
        (F.col("b") * 1.0).alias("green_walk_mean"), (F.col("b") * 10.0 / F.col("a")).alias("centre_m2_per_person"), (F.col("a") * 3.0).alias("green_m2_per_person"), F.col("d").cast("double").alias("centre_efficiency"),
        (F.col("d") / (F.col("n") * 5)).alias("compactness"), (F.col("b") / (F.col("a") + F.col("b"))).alias("transit_coverage"),
    )
    return report.options_table(metrics, "option", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], 1000.0)


@query
def tiers_rollup(spark, sf_dir):
    cells = bridge.cells(spark, sf_dir).where("density > 0")
    tier = F.when(F.col("density") == bridge.HIGH, "high").when(F.col("density") == bridge.MEDIUM, "medium").otherwise("low")
    return cells.rollup(tier.alias("t")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("density"), 4).alias("population")).select(F.coalesce("t", F.lit("total")).alias("tier"), "cells", "population")


@query
def fixed_table(spark, sf_dir):
    rows = bridge.table(spark, sf_dir, "nation").join(bridge.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.col("n_nationkey").alias("n"))
    return report.fixed_table(rows, ["name", "region", "n"], ["name"])


# Parameters


def _documents(spark, sf_dir):
    n = F.col("n_nationkey")
    marker = F.when(n % 6 == 5, "other/9").otherwise(params.MARKER)
    body = F.format_string(
        '{"schema":"%s","name":"%s","grid_size_m":%s,"build_prob":"%s","max_iterations":%s,"ensemble":%s,"unknown_%s":1}',
        marker, F.col("n_name"), (n * 5 + 25).cast("string"), F.when(n % 4 == 0, "often").otherwise("0.25"), (n + 50).cast("string"), F.when(n % 2 == 0, "true").otherwise("false"), (n % 3).cast("string"),
    )
    return bridge.table(spark, sf_dir, "nation").select(n.alias("doc"), F.when(n % 7 == 6, F.lit("[1]")).otherwise(body).alias("body"))


@query
def params_load(spark, sf_dir):
    return params.loaded(_documents(spark, sf_dir))


@query
def params_diff(spark, sf_dir):
    r = bridge.table(spark, sf_dir, "region")
    n = bridge.table(spark, sf_dir, "nation")
    old = r.select(F.col("r_name").alias("key"), (F.col("r_regionkey") * 10).cast("string").alias("value"))
    new = n.select(F.when(F.col("n_nationkey") < 5, F.element_at(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))), F.col("n_nationkey") + 1)).otherwise(F.col("n_name")).alias("key"), (F.col("n_nationkey") * F.when(F.col("n_nationkey") % 2 == 0, 10).otherwise(11)).cast("string").alias("value"))
    return params.changed(old, new)


@query
def preset_expand(spark, sf_dir):
    """A scenario for each customer, with every preset."""
    k = F.col("c_custkey")
    dial = lambda v, name: v.cast("double").alias(name)
    scenarios = bridge.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("scenario"), F.get(F.array(*map(F.lit, params.DISPERSAL)), k % 3).alias("dispersal"), dial(F.lit(0.25), "p_high"), dial(F.lit(0.25), "p_medium"), dial(F.lit(0.5), "p_low"),
        dial(k % 5 * 100 + 600, "centre_walk_m"), dial(F.lit(25), "grid_size_m"), dial(k % 40 * 700 + 3000, "span_m"),
    )
    return params.expanded(scenarios, params.presets(spark))


@query
def density_check(spark, sf_dir):
    n = F.col("n_nationkey")
    rows = bridge.table(spark, sf_dir, "nation").select(n.alias("id"), F.when(n % 5 == 4, "many").otherwise("6000").alias("d_high"), (n * 300).cast("string").alias("d_medium"), F.lit("1000").alias("d_low"), F.lit("0.2").alias("p_high"), F.when(n % 2 == 0, "0.3").otherwise("0.4").alias("p_medium"), F.lit("0.5").alias("p_low"))
    return params.tier_check(rows)


@query
def least_settlements(spark, sf_dir):
    """The smallest settlement of a run for each part."""
    k = F.col("p_partkey")
    dial = lambda v, name: v.cast("double").alias(name)
    runs = bridge.table(spark, sf_dir, "part").select(k.alias("id"), *[dial(F.lit(d), f"d_{t}") for t, d in zip(params.TIERS, TIERS_KM2)], *[dial(F.lit(p), f"p_{t}") for t, p in zip(params.TIERS, (0.25, 0.25, 0.5))], dial(F.col("p_size") * 37, "people"), dial(k % 4 * 25 + 25, "block_m"))
    return params.least_settlements(runs)


@query
def ensemble_presets(spark, sf_dir):
    n = bridge.table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), params.nearest_preset(F.col("n_nationkey") * 5).alias("runs"))


@query
def dataset_catalogue(spark, sf_dir):
    """The datasets in display order, with their features."""
    return tags.catalogue(_kinds(spark, sf_dir))


@query
def run_check(spark, sf_dir):
    n = F.col("n_nationkey")
    return params.run_check(
        bridge.table(spark, sf_dir, "nation").select(
            n.alias("id"), (n - 1).cast("double").alias("block_m"), F.lit(10.0).alias("walk_m"), (n % 9).cast("double").alias("target"), F.lit(0.0).alias("span_m"), (n % 4 / 2.5).alias("build"), F.lit(0.25).alias("p_high"), F.lit(0.25).alias("p_medium"),
            F.when(n % 5 == 0, 0.75).otherwise(0.5).alias("p_low"), F.lit(3.0).alias("d_high"), (n % 3).cast("double").alias("d_medium"), F.lit(1.0).alias("d_low"),
        )
    )


@query
def growth_seed_union(spark, sf_dir):
    stations = bridge.stops(spark, sf_dir, "signup").select((F.col("r") * 100 + F.col("c")).cast("long").alias("ord"), "r", "c")
    return growth.growth_seeds(bridge.seeds(spark, sf_dir), stations)


@query
def frames(spark, sf_dir):
    """Classes of a series of steps, each valid for a year."""
    return growth.frame_counts(bridge.members(spark, sf_dir).withColumnRenamed("member", "step"), 2025)


# Small rules of runs and layers


@query
def snapshot_grid(spark, sf_dir):
    """The grid as four layers of rectangles leave it."""
    names = F.array(*map(F.lit, ("built", "green", "unbuildable", "centres")))
    layers = burn_boxes(spark, sf_dir).select(F.get(names, (F.col("pid") % 4).cast("int")).alias("layer"), "r", "c")
    return raster.snapshot(bridge.cells(spark, sf_dir), layers)


@query
def parameter_lines(spark, sf_dir):
    """The dials of a run for each part, as lines of a report."""
    k, size = F.col("p_partkey"), F.col("p_size")
    dial = lambda v, name: v.cast("double").alias(name)
    isolated = F.get(F.array(F.lit(0.0), F.lit(1e-4), F.lit(0.04), size / 1000), (k % 4).cast("int"))
    runs = bridge.table(spark, sf_dir, "part").select(
        k.alias("id"), dial(k % 4 * 25 + 25, "block_m"), (size * 10).alias("iterations"), dial(F.col("p_retailprice") * 100, "target"), dial(size / 100, "build"), isolated.alias("isolated"), dial(F.lit(600), "walk_m"),
        dial(F.when(k % 3 > 0, k % 3 * 400), "centre_walk_m"), dial(k % 2 * 300, "green_walk_m"), dial(size * 10, "span_m"), *[dial(F.lit(d), f"d_{t}") for t, d in zip(params.TIERS, TIERS_KM2)],
        *[dial(F.lit(p), f"p_{t}") for t, p in zip(params.TIERS, (0.25, 0.25, 0.5))], size.alias("least_cells"), (k % 2 == 0).alias("optimise"), (k % 5 * 10).alias("members"),
    )
    return report.parameter_lines(runs)


@query
def file_lines(spark, sf_dir):
    """A run's files for each order, one a line item."""
    name = F.concat(F.lit("plan_"), F.col("l_partkey"), F.lit(".tif"))
    files = bridge.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("ord"), name.alias("name"), F.concat(F.lit("option "), F.col("l_returnflag")).alias("label"))
    return report.file_lines(files)


@query
def burn_rings(spark, sf_dir):
    """Cells of slanted polygons."""
    k, height = F.col("p_partkey"), bridge.n_rows(spark, sf_dir) * G
    x, y = (k * 37 % 9000) + 0.37, (k * 53 % height) + 0.19
    a, b = F.col("p_size") * 10.0 + 33, F.col("p_size") * 7.0 + 21
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    zero = F.lit(0.0)
    rings = bridge.table(spark, sf_dir, "part").select(k.alias("pid"), F.array(F.array(at(a, zero), at(zero, b), at(-a, zero), at(zero, -b), at(a, zero))).alias("rings"))
    return raster.burned(raster.ring_edges(rings, "pid"), float(G), 0.0, float(height))


@query
def compose_check(spark, sf_dir):
    """What built land and green share, before and after the green is cut."""
    layers = _layers(spark, sf_dir)
    built, green = layers.where("built"), layers.where("green")
    checks = {"raw": green, "cut": geometry.without(green.select("r", "c"), built)}
    one, two = (raster.overlap_check(built, g, float(G)).select(F.lit(k).alias("layer"), "overlap_m2", "ok") for k, g in checks.items())
    return one.union(two)


#: Classes of ways that ``street_filter`` deals out.
WAY_CLASSES = ("residential", "footway", "primary", "path", "cycleway", "tertiary", "steps", "track", "service", "living_street", None)


@query
def street_filter(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events").select(F.get(F.array(*map(F.lit, WAY_CLASSES)), F.col("user_id") % len(WAY_CLASSES)).alias("highway"))
    return tags.streets_shown(e).groupBy("highway").agg(F.count(F.lit(1)).alias("n"))


@query
def input_slots(spark, sf_dir):
    """Layers of the catalogue's datasets by the input that they fill."""
    names = F.array(*map(F.lit, (*tags.ORDER, "extents")))
    n = F.col("n_nationkey")
    layers = bridge.table(spark, sf_dir, "nation").select(F.get(names, n % (len(tags.ORDER) + 1)).alias("dataset"), F.col("n_name").alias("layer"))
    chosen = bridge.table(spark, sf_dir, "region").select(F.get(F.array(*map(F.lit, ("extents", "green", "terrain"))), F.col("r_regionkey")).alias("slot"), F.col("r_name").alias("layer")).where("slot IS NOT NULL")
    return tags.filled_slots(layers, chosen)


@query
def run_names(spark, sf_dir):
    n = F.col("n_nationkey")
    text = F.when(n % 5 == 0, F.concat(F.lit("  "), F.col("n_name"), F.lit(".tif "))).when(n % 5 == 1, F.concat(F.col("n_name"), F.lit("/a"))).when(n % 5 == 2, F.lit(" .tif")).otherwise(F.col("n_name"))
    return bridge.table(spark, sf_dir, "nation").select(n.alias("id"), params.run_name(text).alias("name"))


@query
def selection_progress(spark, sf_dir):
    n = F.col("n_nationkey")
    return bridge.table(spark, sf_dir, "nation").select(n.alias("id"), F.round(params.selection_progress(n % 4, n % 5), 6).alias("percent"))


@query
def crs_guard(spark, sf_dir):
    n = F.col("n_nationkey").cast("double")
    area = (n * 6 - 80, F.lit(0.0), n * 6 - 74, F.lit(84.0))
    box = (F.lit(-3.0), F.lit(40.0), F.when(n != 20, 9.0), F.lit(50.0))
    return bridge.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), params.reference_system_problem(F.col("n_nationkey") % 4 != 1, area, box).alias("problem"))


@query
def block_plan(spark, sf_dir):
    k, rows = F.col("p_partkey").cast("int"), bridge.n_rows(spark, sf_dir)
    blocks = bridge.table(spark, sf_dir, "part").select(k.alias("ord"), (k * 7 % rows).alias("r0"), (k * 7 % rows + F.col("p_size") % 9).alias("r1"), (k * 13 % 100).alias("c0"), (k * 13 % 100 + F.col("p_size") % 6).alias("c1"), (k % 5 + 1).alias("code"))
    return raster.block_plan(bridge.cells(spark, sf_dir), blocks)


@query
def drawn_density(spark, sf_dir):
    return bridge.cells(spark, sf_dir).where("density > 0").select("r", "c", F.round(classify.drawn_per_km2(F.col("density"), float(G)), 6).alias("per_km2"))


@query
def raw_pre_plan(spark, sf_dir):
    """The plan of the best member before any clean-up."""
    best = growth.best_member(_member_scores(spark, sf_dir)).select("member")
    states = bridge.members(spark, sf_dir).join(F.broadcast(best), "member", "left_semi")  # one row
    return classify.raw_plan(states.select("r", "c", "state", "origin"), G, SPAN_M)


@query
def geojson_lines(spark, sf_dir):
    """JSON features of rectangles, snapped; those that collapse are dropped."""
    xy = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0 = F.col("x0") / 7, F.col("y0") / 7
    x1, y1 = F.when(F.col("pid") % 50 == 0, x0 + 0.01).otherwise(F.col("x1") / 7), F.col("y1") / 7
    rings = F.array(F.array(xy(x0, y0), xy(x1, y0), xy(x1, y1), xy(x0, y1), xy(x0, y0)))
    rows = bridge.boxes(spark, sf_dir).select(F.lit("boxes").alias("dataset"), F.col("pid").alias("fid"), F.lit("Polygon").alias("geom_type"), rings.alias("rings"), F.create_map(F.lit("name"), F.col("pid").cast("string")).alias("props"))
    return geojson.as_lines(rows).select("fid", "value")


@query
def reach_rook(spark, sf_dir):
    return walk.reach(_seeded(spark, sf_dir), F.col("seed"), F.col("state") == 0, F.col("state") >= 0, 400.0, G, rook=True)


@query
def reach_first(spark, sf_dir):
    """Walks that end once they have seen three built cells."""
    return walk.reach(_seeded(spark, sf_dir), F.col("seed"), F.col("state") == 0, F.col("state") == 1, 400.0, G, stop_after=3)


@query
def extent_hull(spark, sf_dir):
    """The corners of the convex hull of all rectangles; no SQL, held against a brute-force version in the tests."""
    corners = F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x0", "x1") for y in ("y0", "y1")]))
    return geometry.convex_hull(bridge.boxes(spark, sf_dir).select(corners.alias("p")).select("p.*"))


# Growth and centres


def _run_params():
    return params.Params(block_m=float(G), walk_m=600.0, target=2e5, span_m=200.0, build=0.4, near=0.1, isolated=0.01, shares=(0.2, 0.3, 0.5), iterations=6)


@query
def growth_run(spark, sf_dir):
    return growth.ensemble(growth.template(spark, sf_dir), _run_params(), 11, [0])


@query
def steps_to_target(spark, sf_dir):
    return growth.to_target(growth.ensemble(growth.template(spark, sf_dir), _run_params(), 11, [0, 1]), _run_params().target)


@query
def proximity_seeding(spark, sf_dir):
    return centres.proximity(_plan(spark, sf_dir), G, CENTRE_M)


@query
def growth_ensemble(spark, sf_dir):
    return growth.class_counts(growth.ensemble(growth.template(spark, sf_dir), _run_params(), 11, range(4)).select("member", "r", "c", "state"))


@query
def member_replay(spark, sf_dir):
    return growth.ensemble(growth.template(spark, sf_dir), _run_params(), 11, [2]).select("member", "r", "c", "state", "density")


@query
def refine_placed(spark, sf_dir):
    return centres.refined(_plan(spark, sf_dir), "placed", G, CENTRE_M)


@query
def refine_minimal(spark, sf_dir):
    return centres.refined(_plan(spark, sf_dir), "minimal", G, CENTRE_M)


@query
def grow_centres(spark, sf_dir):
    return centres.grown(_plan(spark, sf_dir), centres.refined(_plan(spark, sf_dir), "placed", G, CENTRE_M), G, CENTRE_M)


@query
def plan_variants(spark, sf_dir):
    return centres.variants(_plan(spark, sf_dir), ("grown", "placed", "minimal"), G, CENTRE_M, 12)
