"""Tags of map features: parsing, merging, routing to datasets, query texts.

The tables below are fixed values of the public map-tagging scheme as this engine routes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AREA, LINE, POINT = ("way", "relation"), ("way",), ("node",)
#: What each dataset is extracted by, in display order: kinds of element, key, accepted values (none listed: any).
SELECTORS: dict[str, tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...]] = {
    "built": ((AREA, "landuse", ("residential", "commercial", "retail")),),
    "green": (
        (AREA, "leisure", ("park", "garden", "recreation_ground", "nature_reserve")),
        (AREA, "landuse", ("grass", "meadow", "forest", "recreation_ground", "village_green")),
        (AREA, "natural", ("wood", "scrub", "grassland", "heath")),
    ),
    "centres": ((AREA, "landuse", ("retail", "commercial")),),
    "industrial": ((AREA, "landuse", ("industrial",)),),
    "streets": ((LINE, "highway", ()),),
    "railways": ((LINE, "railway", ("rail", "light_rail", "subway", "tram")),),
    "stops": ((POINT, "highway", ("bus_stop",)), (POINT, "public_transport", ("stop_position", "platform"))),
    "stations": ((POINT, "railway", ("station", "halt", "tram_stop")), (POINT, "public_transport", ("station",))),
    "unbuildable": (
        (AREA, "natural", ("water",)),
        (AREA, "waterway", ("riverbank", "dock")),
        (AREA, "aeroway", ("aerodrome", "apron", "terminal", "runway", "helipad")),
        (AREA, "landuse", ("military", "quarry", "landfill", "industrial")),
        (AREA, "military", ()),
        (LINE, "highway", ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link")),
        (LINE, "railway", ("rail", "light_rail", "subway", "tram")),
        (LINE, "waterway", ("river", "canal", "stream")),
    ),
}
ORDER = tuple(SELECTORS)
#: Label and kind of geometry of each dataset, in display order.
CATALOGUE = {
    "built": ("Built (residential fabric)", "polygon"), "green": ("Green space", "polygon"), "centres": ("Centres", "polygon"), "industrial": ("Industrial land", "polygon"), "streets": ("Street network", "line"),
    "railways": ("Railways", "line"), "stops": ("Public-transport stops", "point"), "stations": ("Rail / tram stations", "point"), "unbuildable": ("Unbuildable (water, airports, military, industrial)", "polygon"),
}

#: Classes of ways that are for walking or service, not shown among the streets.
WALK_ONLY = ("footway", "path", "cycleway", "steps", "track", "service")
#: The run's input that each dataset fills; those of other datasets are left to the user.
INPUT_SLOTS = {"extents": "extents", "built": "built", "green": "green", "unbuildable": "unbuildable", "centres": "centre_seeds", "stops": "transit_stops", "stations": "stations"}

#: Fixed value: a pair of the format, two quoted texts with an arrow; a backslash keeps what follows it.
_PAIR = r'"((?:[^"\\]|\\.)*)"\s*=>\s*"((?:[^"\\]|\\.)*)"'


def parsed(text: Column) -> Column:
    """Map of an HSTORE text's pairs, with blanks round the arrows or not; escaped quotes and backslashes are undone;
    null and empty texts give an empty map. Of equal keys the last counts."""
    undone = lambda x: F.replace(F.replace(x, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    whole = F.coalesce(text, F.lit(""))
    keys = F.transform(F.regexp_extract_all(whole, F.lit(_PAIR), 1), undone)
    values = F.transform(F.regexp_extract_all(whole, F.lit(_PAIR), 2), undone)
    # By key, the last first: a pair counts if the one before has another key.
    pairs = F.array_sort(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p, i: F.struct(p["k"].alias("k"), (-i).alias("turn"), p["v"].alias("v"))))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p.alias("p"), F.when(i > 0, F.get(pairs, i - 1)["k"]).alias("before"))), lambda x: ~x["p"]["k"].eqNullSafe(x["before"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["p"]["k"].alias("key"), x["p"]["v"].alias("value"))))


def merged(native: Column, other: Column) -> Column:
    """Tags of a feature: those of ``other`` win, non-empty native ones fill gaps."""
    filled = F.map_filter(native, lambda k, v: v.isNotNull() & (v != "") & ~F.map_contains_key(other, k))
    return F.map_concat(filled, other)


def _any(dataset: str, kinds: tuple[str, ...], tags: Column) -> Column:
    """Whether tags meet one of a dataset's selectors of these kinds of element."""
    out = F.lit(False)
    for own, key, values in SELECTORS[dataset]:
        if own == kinds:
            v = F.try_element_at(tags, F.lit(key))
            out = out | (F.coalesce(v.isin(*values), F.lit(False)) if values else v.isNotNull())
    return out


def matches(dataset: str, tags: Column) -> Column:
    """Whether a feature with these tags belongs to a dataset, whatever its geometry."""
    kind = {"polygon": AREA, "line": LINE, "point": POINT}[CATALOGUE[dataset][1]]
    found = _any(dataset, kind, tags)
    return found & (F.try_element_at(tags, F.lit("highway")) != "") if dataset == "streets" else found


def is_barrier(tags: Column) -> Column:
    """Whether a line cannot be walked across."""
    return _any("unbuildable", LINE, tags)


def routed(features: DataFrame, kind: str | None = None) -> DataFrame:
    """Each feature once for every dataset that it matches; streets keep their class.

    ``kind`` names a column with the feature's geometry (``point``, ``line``, or ``polygon`` for closed rings): a feature then
    goes only to datasets of its kind, and lines that are barriers to the unbuildable land too."""
    def wanted(d: str) -> Column:
        own = matches(d, F.col("tags"))
        if kind is None:
            return own
        fits = own & (F.col(kind) == CATALOGUE[d][1])
        return fits | (is_barrier(F.col("tags")) & (F.col(kind) == "line")) if d == "unbuildable" else fits

    found = F.array_compact(F.array(*[F.when(wanted(d), d) for d in ORDER]))
    out = features.withColumn("dataset", F.explode(found))
    return out.withColumn("highway", F.when(F.col("dataset") == "streets", F.try_element_at(F.col("tags"), F.lit("highway"))))


def streets_shown(features: DataFrame) -> DataFrame:
    """Streets without the classes for walking only; features of no class stay."""
    return features.where(~F.coalesce(F.col("highway").isin(*WALK_ONLY), F.lit(False)))


def filled_slots(layers: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """slot, layer: the layer (dataset, layer; of several the last by name) that each input of a run takes. An input that is
    ``chosen`` (slot, layer) already stays as it is, but for the extents."""
    slots = F.create_map(*[F.lit(x) for kv in INPUT_SLOTS.items() for x in kv])
    found = layers.select(F.try_element_at(slots, F.col("dataset")).alias("slot"), "layer").where("slot IS NOT NULL").groupBy("slot").agg(F.max("layer").alias("layer"))
    if chosen is None:
        return found
    both = found.join(chosen.select("slot", F.col("layer").alias("own")), "slot", "full")
    return both.select("slot", F.when(F.col("slot") == "extents", F.coalesce("layer", "own")).otherwise(F.coalesce("own", "layer")).alias("layer"))


def dataset_selectors(dataset: str) -> list[str]:
    """The query selectors of a dataset, in order."""
    test = lambda k, v: f'["{k}"]' if not v else f'["{k}"="{v[0]}"]' if len(v) == 1 else f'["{k}"~"^({"|".join(v)})$"]'
    return [kind + test(key, values) for kinds, key, values in SELECTORS[dataset] for kind in kinds]


def selectors(spark: SparkSession) -> DataFrame:
    """ord, dataset, selector of all datasets: a dimension."""
    rows = [(d, s) for d in ORDER for s in dataset_selectors(d)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, dataset string, selector string")


def query_texts(areas: DataFrame) -> DataFrame:
    """area, dataset, ql for each of ``areas`` (area, south, west, north, east): the query of each dataset, and of all together
    (``all``), each selector once, in order."""
    one = selectors(areas.sparkSession)
    every = one.groupBy("selector").agg(F.min("ord").alias("ord")).select("ord", F.lit("all").alias("dataset"), "selector")
    listed = one.union(every).groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("ord", "selector"))).alias("s"))  # ten rows
    box = F.concat(F.lit("("), F.concat_ws(",", *[F.col(k).cast("string") for k in ("south", "west", "north", "east")]), F.lit(");"))
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("  "), x["selector"], F.col("box"))), "\n")
    both = areas.select("area", box.alias("box")).crossJoin(F.broadcast(listed))
    return both.select("area", "dataset", F.concat(F.lit("[out:xml][timeout:60];\n(\n"), body, F.lit("\n);\n(._;>;);\nout body;\n")).alias("ql"))


def catalogue(routed_features: DataFrame) -> DataFrame:
    """ord, dataset, label, kind, n of all datasets in display order, with the features that were routed to each."""
    spark = routed_features.sparkSession
    known = spark.createDataFrame([(i, d, *CATALOGUE[d]) for i, d in enumerate(ORDER)], "ord int, dataset string, label string, kind string")
    counts = routed_features.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "dataset", "left").select("ord", "dataset", "label", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
