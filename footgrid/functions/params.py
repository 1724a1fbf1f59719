"""Parameter documents: reading with coercion, differences, presets, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the schema marker of a parameter document.
MARKER = "walk-growth-params/1"
#: Fields by type.
DOUBLES = ("grid_size_m", "target_population", "build_prob", "centre_walk_m", "green_walk_m", "centre_m2_per_person", "min_settlement_pop", "min_green_span_m")
INTEGERS = ("max_iterations", "random_seed", "ensemble_runs")
BOOLEANS = ("optimise_centres", "ensemble")
STRINGS = ("name", "notes", "crs", "dispersal")
TIERS = ("high", "medium", "low")
#: Probability of an isolated centre by dispersal.
DISPERSAL = {"off": 0.0, "moderate": 1e-4, "aggressive": 0.04}
ENSEMBLE_PRESETS = (10, 50, 100)


@dataclass(frozen=True)
class Params:
    """Dials of a growth run, checked and converted to blocks."""

    block_m: float = 100.0
    walk_m: float = 600.0
    target: float = 1e6
    span_m: float = 100.0
    build: float = 0.6
    near: float = 0.1
    isolated: float = 0.0
    threshold: float = 0.8
    shares: tuple[float, float, float] = (0.4, 0.4, 0.2)
    densities_km2: tuple[float, float, float] = (6000.0, 3000.0, 1000.0)
    iterations: int = 25

    def __post_init__(self):
        if not self.block_m > 0:
            raise ValueError("the block must be positive")
        if self.walk_m < self.block_m:
            raise ValueError("the walk must be one block at least")
        if self.span_m < 0 or self.target <= 0:
            raise ValueError("the span must not be negative, and the target positive")
        if any(not 0 <= p <= 1 for p in (self.build, self.near, self.isolated, self.threshold, *self.shares)):
            raise ValueError("probabilities and shares lie between 0 and 1")
        if round(sum(self.shares), 2) != 1:
            raise ValueError("shares must sum to 1")
        high, medium, low = self.densities_km2
        if not high > medium > low > 0:
            raise ValueError("densities must fall from high to low and be positive")

    @property
    def per_block(self) -> tuple[float, float, float]:
        return tuple(d * self.block_m**2 / 1e6 for d in self.densities_km2)

    @property
    def mean_density_km2(self) -> float:
        return sum(p * d for p, d in zip(self.shares, self.densities_km2))

    def least_cells(self, people: float) -> int:
        """Cells of the smallest settlement worth keeping."""
        return max(1, round(people / (self.mean_density_km2 * self.block_m**2 / 1e6)))


def loaded(documents: DataFrame) -> DataFrame:
    """doc, key, value (text), status of each field of JSON documents ``doc``, ``body``: ``ok``,
    ``malformed`` (skipped), ``ignored`` (unknown); a document without the marker or that is no JSON object has
    one row of status ``error``."""
    fields = F.from_json("body", "map<string,string>")
    rows = documents.select("doc", fields.alias("m"))
    good = F.coalesce(F.try_element_at("m", F.lit("schema")) == MARKER, F.lit(False))
    errors = rows.where(~good).select("doc", F.lit("schema").alias("key"), F.lit(None).cast("string").alias("value"), F.lit("error").alias("status"))
    flat = rows.where(good).select("doc", F.explode("m")).where("key <> 'schema'")
    number = F.expr("try_cast(value AS double)")
    known = F.col("key").isin(*DOUBLES, *INTEGERS, *BOOLEANS, *STRINGS)
    value = (
        F.when(F.col("key").isin(*DOUBLES), number.cast("string")).when(F.col("key").isin(*INTEGERS), F.expr("try_cast(try_cast(value AS double) AS bigint)").cast("string"))
        # Truth as a scripting language has it: any text but an empty one, any number but 0.
        .when(F.col("key").isin(*BOOLEANS), F.when(F.col("value").isin("false", "0", ""), "false").otherwise("true")).when(F.col("key").isin(*STRINGS), F.col("value"))
    )
    status = F.when(~known, "ignored").when(value.isNull(), "malformed").otherwise("ok")
    return flat.select("doc", "key", F.when(status == "ok", value).alias("value"), status.alias("status")).union(errors)


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, old, new of the values that differ between two tables key, value."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "key", "full")
    return both.where("NOT (old <=> new)").select("key", "old", "new")


def nearest_preset(runs: Column) -> Column:
    """The ensemble size preset nearest to a number of runs; ties: the smaller."""
    return F.array_min(F.array(*[F.struct(F.abs(runs - p).alias("d"), F.lit(p).alias("p")) for p in ENSEMBLE_PRESETS]))["p"]


#: Presets and the dials that each one sets.
PRESETS = {
    "baseline": {},
    "walk400": {"centre_walk_m": 400.0},
    "walk1600": {"centre_walk_m": 1600.0},
    "compact": {"dispersal": "off"},
    "dispersed": {"dispersal": "aggressive"},
    "denser": {"shares": (0.5, 0.3, 0.2)},
    "fewest": {"centre_mode": "minimal"},
}
#: Fixed value: how centres are placed where no preset says otherwise.
CENTRE_MODE = "placed"


def presets(spark: SparkSession) -> DataFrame:
    """preset, and o_dispersal, o_shares, o_centre_walk_m, o_centre_mode: null where it leaves a dial as it is."""
    rows = [(k, v.get("dispersal"), v.get("shares"), v.get("centre_walk_m"), v.get("centre_mode")) for k, v in PRESETS.items()]
    return spark.createDataFrame(rows, "preset string, o_dispersal string, o_shares array<double>, o_centre_walk_m double, o_centre_mode string")


def expanded(scenarios: DataFrame, overrides: DataFrame) -> DataFrame:
    """scenario, preset, dispersal, p_high, p_medium, p_low, centre_walk_m, centre_mode, p_isolated, block_m for every scenario
    (with its dispersal, shares, centre_walk_m, grid_size_m, span_m) and preset. Where a scenario's dispersal is off already, a preset ``moderate``
    stands for ``compact``. Previews have at most 150 cells a side."""
    every = scenarios.crossJoin(F.broadcast(overrides))  # seven presets
    swap = (F.col("preset") == "compact") & (F.col("dispersal") == "off")
    isolated = F.create_map(*[F.lit(x) for kv in DISPERSAL.items() for x in kv])[F.col("dispersal")]
    share = lambda i, k: F.coalesce(F.get("o_shares", F.lit(i)), k).alias(k)
    out = every.select(
        "scenario", F.when(swap, "moderate").otherwise(F.col("preset")).alias("preset"), F.when(swap, "moderate").otherwise(F.coalesce("o_dispersal", "dispersal")).alias("dispersal"),
        *[share(i, k) for i, k in enumerate(("p_high", "p_medium", "p_low"))], F.coalesce("o_centre_walk_m", "centre_walk_m").alias("centre_walk_m"), F.coalesce("o_centre_mode", F.lit(CENTRE_MODE)).alias("centre_mode"),
        preview_block(F.col("grid_size_m"), F.col("span_m")).alias("block_m"),
    )
    return out.withColumn("p_isolated", isolated)


def least_settlements(runs: DataFrame) -> DataFrame:
    """id, mean_km2, least_cells: the mean density of three tiers (d_*) by their shares (p_*), and the cells that ``people`` fill at it on blocks
    of ``block_m``, rounded, at least one: the smallest settlement worth keeping."""
    mean = F.col("p_high") * F.col("d_high") + F.col("p_medium") * F.col("d_medium") + F.col("p_low") * F.col("d_low")
    cells = F.greatest(F.lit(1), F.bround(F.col("people") / (mean * F.col("block_m") * F.col("block_m") / 1e6)).cast("long"))
    return runs.select("id", F.round(mean, 6).alias("mean_km2"), cells.cast("long").alias("least_cells"))


def tier_check(rows: DataFrame) -> DataFrame:
    """id, message, total, mean of texts of three densities (d_*) and three shares (p_*)."""
    n = {k: F.expr(f"try_cast({k} AS double)") for k in ("d_high", "d_medium", "d_low", "p_high", "p_medium", "p_low")}
    missing = F.lit(False)
    for v in n.values():
        missing = missing | v.isNull()
    total = n["p_high"] + n["p_medium"] + n["p_low"]
    mean = n["p_high"] * n["d_high"] + n["p_medium"] * n["d_medium"] + n["p_low"] * n["d_low"]
    falling = (n["d_high"] > n["d_medium"]) & (n["d_medium"] > n["d_low"]) & (n["d_low"] > 0)
    message = F.when(missing, "not a number").when(~falling, "densities must fall").when(F.abs(total - 1) > 1e-3, "shares must sum to 1").otherwise("")
    return rows.select("id", message.alias("message"), F.when(~missing, F.round(total, 6)).alias("total"), F.when(~missing, F.round(mean, 6)).alias("mean"))


def run_check(rows: DataFrame) -> DataFrame:
    """id, problem of parameter rows (block_m, walk_m, target, span_m, build, p_high, p_medium, p_low, d_high, d_medium, d_low):
    the first rule that a run's ``Params`` would reject, or an empty text."""
    c = F.col
    outside = lambda *names: F.exists(F.array(*map(c, names)), lambda x: (x < 0) | (x > 1))
    rules = (
        (~(c("block_m") > 0), "block"), (c("walk_m") < c("block_m"), "walk"), ((c("span_m") < 0) | (c("target") <= 0), "span or target"), (outside("build", "p_high", "p_medium", "p_low"), "probability"),
        (F.bround(c("p_high") + c("p_medium") + c("p_low"), 2) != 1, "shares"), (~((c("d_high") > c("d_medium")) & (c("d_medium") > c("d_low")) & (c("d_low") > 0)), "densities"),
    )
    problem = F.lit("")
    for bad, name in reversed(rules):
        problem = F.when(bad, name).otherwise(problem)
    return rows.select("id", problem.alias("problem"))


def preview_block(block_m: Column, span_m: Column, most: int = 150) -> Column:
    """Metres a cell of a preview: the run's own, or the multiple of five at which the longer side has ``most`` cells at most."""
    return F.greatest(block_m, F.ceil(span_m / most / 5) * 5.0)


def run_name(text: Column) -> Column:
    """A run's name without blanks around it and the raster's suffix; null where it is empty or holds what a file's name can't."""
    name = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\.tif$", "")
    return F.when((name != "") & ~name.rlike(r'[/\\:*?"<>|]'), name)


def next_folder(base: str, used: set[str]) -> str:
    """``base``, or the first of ``base_2``, ``base_3``, ... that no run has used."""
    name, n = base, 1
    while name in used:
        n += 1
        name = f"{base}_{n}"
    return name


def selection_progress(done: Column, total: Column) -> Column:
    """Percent of a run after ``done`` of ``total`` candidates: the selection takes what is between 40 and 99."""
    return 40.0 + 59.0 * done / F.greatest(total, F.lit(1))


def reference_system_problem(projected: Column, area: tuple[Column, Column, Column, Column], extents: tuple[Column, Column, Column, Column]) -> Column:
    """Why a coordinate system can't be used: it isn't projected, or its area of use misses the extents (boxes of degrees:
    xmin, ymin, xmax, ymax; unknown ones are let through). Empty where it can."""
    from footgrid.operators.geometry import overlaps

    meets = F.coalesce(overlaps(area, extents), F.lit(True))
    return F.when(~F.coalesce(projected, F.lit(False)), "not projected").when(~meets, "outside").otherwise("")
