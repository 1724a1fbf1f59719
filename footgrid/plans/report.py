"""Comparison tables as rows of text and as pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def percent(v: Column) -> Column:
    """A share as whole percent (half to even); ``-`` for null."""
    return F.coalesce(F.concat(F.bround(100 * v).cast("long").cast("string"), F.lit("%")), F.lit("-"))


def number(v: Column) -> Column:
    """A whole number with thousands apart; ``-`` for null."""
    return F.coalesce(F.format_number(F.bround(v).cast("long"), 0), F.lit("-"))


def options_pivot(metrics: DataFrame, option: str, names: list[str], options: list[str]) -> DataFrame:
    """metric, and a column for each option: the metrics of each option side by side."""
    long = metrics.unpivot([option], names, "metric", "value")
    return long.groupBy("metric").pivot(option, options).agg(F.first("value"))


#: Rows of the comparison in order: label, format (``pct`` or ``num``) and metric.
OPTION_ROWS = (
    ("population accommodated", "num", "population"),
    ("share of target", "pct", "share"),
    ("built cells (incl. existing)", "num", "built_cells"),
    ("mixed-use centre areas", "num", "n_centres"),
    ("served coverage (centre AND green)", "pct", "served_coverage"),
    ("centre coverage", "pct", "centre_coverage"),
    ("green coverage", "pct", "green_coverage"),
    ("unserved homes", "pct", "unserved_fraction"),
    ("avg walk to a centre (m)", "num", "centre_access"),
    ("avg walk to green (m)", "num", "green_access"),
    ("mean walk, served homes: centre (m)", "num", "centre_walk_mean"),
    ("mean walk, served homes: green (m)", "num", "green_walk_mean"),
    ("m2 mixed-use centre / person", "num", "centre_m2_per_person"),
    ("m2 walkable green / person", "num", "green_m2_per_person"),
    ("homes served per centre area", "num", "centre_efficiency"),
    ("compactness", "pct", "compactness"),
    ("transit coverage (reported only)", "pct", "transit_coverage"),
    ("avg walk to a stop (m)", "num", "transit_access"),
)


def options_table(metrics: DataFrame, option: str, options: list[str], target: float) -> DataFrame:
    """ord, metric, and a text column for each option (a row of ``metrics``). Metrics that are missing, null or infinite
    are ``-``, so the rows stay the same; the two of transit are there only if ``transit_coverage`` is."""
    own = metrics.withColumn("share", F.col("population") / target if target else F.lit(None).cast("double"))
    rows = OPTION_ROWS if "transit_coverage" in metrics.columns else OPTION_ROWS[:-2]

    def text(kind: str, name: str) -> Column:
        v = F.col(name).cast("double") if name in own.columns else F.lit(None).cast("double")
        v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        return percent(v) if kind == "pct" else number(v)

    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(label).alias("metric"), text(kind, name).alias("value")) for i, (label, kind, name) in enumerate(rows)])
    long = own.select(F.col(option).alias("option"), F.explode(cells).alias("x")).select("option", "x.*")
    return long.groupBy("ord", "metric").pivot("option", options).agg(F.first("value"))


def fixed_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """line_no, line: a table in columns as wide as their longest entry, the first to the left and the others to the right.

    ``rows`` is a report, whose length is that of a page."""
    texts = rows.select(*order, *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in columns if c not in order])
    widths = texts.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"w_{c}") for c in columns])
    pad = lambda c, i, text: (F.rpad if i == 0 else F.lpad)(text, F.col(f"w_{c}"), F.lit(" "))
    line = lambda of: F.rtrim(F.concat_ws("  ", *[pad(c, i, of(c)) for i, c in enumerate(columns)]))
    numbered = texts.agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("all")).select(F.posexplode("all").alias("n", "x")).select((F.col("n") + 2).alias("line_no"), "x.*")
    head = widths.select(F.lit(0).alias("line_no"), line(lambda c: F.lit(c)).alias("line"))
    total = sum((F.col(f"w_{c}") for c in columns), F.lit(2 * (len(columns) - 1)))
    rule = widths.select(F.lit(1).alias("line_no"), F.repeat(F.lit("-"), total.cast("int")).alias("line"))
    body = numbered.crossJoin(F.broadcast(widths)).select("line_no", line(lambda c: F.col(c)).alias("line"))
    return head.union(rule).union(body)


#: What the dispersal dial is called in reports.
DISPERSAL_LABELS = {"off": "No new settlements", "moderate": "Some new settlements", "aggressive": "Many new settlements"}


def share_of_target(population: Column, target: float) -> Column:
    """Residents as a share of the target, as text."""
    return F.concat(number(population), F.lit(" ("), percent(population / target), F.lit(" of target)"))


def header_lines(run: DataFrame) -> DataFrame:
    """line_no, line of a report's head, from one row: name, dispersal, runs, target, at (a timestamp)."""
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in DISPERSAL_LABELS.items() for x in kv])[F.col("dispersal")], F.col("dispersal"))
    lines = F.array(
        F.concat(F.lit("Scenario: "), F.coalesce("name", F.lit("-"))), F.concat(F.lit("Written: "), F.date_format("at", "yyyy-MM-dd HH:mm")), F.concat(F.lit("Dispersal: "), label),
        F.concat(F.lit("Runs: "), number(F.col("runs"))), F.concat(F.lit("Target population: "), number(F.col("target"))),
    )
    return run.select(F.posexplode(lines).alias("line_no", "line"))


#: Labels of the parameter lines in order, and the words for usual probabilities of an isolated centre.
PARAMETER_LABELS = (
    "Grid size", "Max iterations", "Target population", "Build probability", "Dispersed development", "Centre walk", "Green walk", "Min green span", "Density", "Min settlement", "Optimise centres", "Ensemble",
)
DISPERSED = {0.0: "Off", 0.0001: "Moderate", 0.04: "Aggressive"}


def _plain(v: Column) -> Column:
    """A number with at most six decimals, without trailing zeros."""
    return F.when(v.isNotNull(), F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", ""))


def parameter_lines(runs: DataFrame) -> DataFrame:
    """id, line_no, line: the dials of each run, one to a line.

    ``runs``: id, block_m, iterations, target, build, isolated, walk_m, centre_walk_m and green_walk_m (null or 0: ``walk_m``), span_m, d_ and p_ of
    high, medium and low, least_cells, optimise, members. A null dial is ``-``."""
    mean = sum((F.col(f"p_{t}") * F.col(f"d_{t}") for t in ("high", "medium", "low")), F.lit(0.0))
    people = F.col("least_cells") * mean * (F.col("block_m") * F.col("block_m")) / 1e6
    metres = lambda v: F.concat(F.bround(v).cast("long").cast("string"), F.lit(" m"))
    walk = lambda k: metres(F.coalesce(F.when(F.col(k) != 0, F.col(k)), F.col("walk_m")))
    tier = lambda name, t: F.concat(F.lit(f"{name} "), number(F.col(f"d_{t}")), F.lit(" ("), percent(F.col(f"p_{t}")), F.lit(")"))
    isolated = F.create_map(*[F.lit(x) for kv in DISPERSED.items() for x in kv])[F.round("isolated", 4)]
    values = (
        metres(F.col("block_m")), F.col("iterations").cast("string"), number(F.col("target")), _plain(F.col("build")), F.coalesce(isolated, _plain(F.col("isolated"))), walk("centre_walk_m"), walk("green_walk_m"),
        metres(F.col("span_m")), F.concat(F.concat_ws(", ", tier("high", "high"), tier("med", "medium"), tier("low", "low")), F.lit(" /km²; mean "), number(mean)),
        F.concat(F.lit("~"), number(people), F.lit(" people ("), F.col("least_cells").cast("string"), F.lit(" cells)")), F.when(F.col("optimise"), "on").when(~F.col("optimise"), "off"), F.concat(F.col("members").cast("string"), F.lit(" run(s)")),
    )
    lines = F.array(*[F.concat(F.lit(f"  {label:<22}: "), F.coalesce(v, F.lit("-"))) for label, v in zip(PARAMETER_LABELS, values)])
    return runs.select("id", F.posexplode(lines).alias("line_no", "line"))


def file_lines(files: DataFrame) -> DataFrame:
    """run, line_no, line: the files (run, ord, name, label) of each run, names as wide as the run's longest; the report itself is to be one of
    them. Lines are in the order of ``ord``, then of names; a null name is ``-``, a null label empty."""
    files = files.withColumn("name", F.coalesce("name", F.lit("-")))
    widths = files.groupBy("run").agg(F.max(F.length("name")).alias("width"))
    line_no = F.row_number().over(W.partitionBy("run").orderBy("ord", "name", "label")) - 1
    return files.join(widths, "run").select("run", line_no.alias("line_no"), F.concat(F.lit("  "), F.rpad("name", F.col("width"), F.lit(" ")), F.lit("  "), F.coalesce("label", F.lit(""))).alias("line"))


def audit_sentence(summary: DataFrame) -> DataFrame:
    """One line on all centre areas."""
    n = lambda c: number(F.col(c))
    text = F.concat(n("n"), F.lit(" centre areas ("), n("n_new"), F.lit(" new) serve between "), n("served_min"), F.lit(" and "), n("served_max"), F.lit(" homes, the middle one "), n("served_median"), F.lit("."))
    return summary.select(F.lit(0).alias("line_no"), text.alias("line"))


def cleanup_delta(raw: DataFrame, options: DataFrame) -> DataFrame:
    """option, removed: built cells that an option has fewer than the raw growth (one row)."""
    return options.crossJoin(F.broadcast(raw.select(F.col("built_cells").alias("raw")))).select("option", (F.col("raw") - F.col("built_cells")).alias("removed"))


def option_record(label: Column, short: Column, metrics: Column, n_centres: Column, tiers: Column | None = None) -> Column:
    """An option's entry: its label, its column's header, its metrics, its centres and, if a tiered plan was written, its tiers."""
    rest = tiers if tiers is not None else F.lit(None).cast("string")
    return F.struct(label.alias("label"), short.alias("short"), metrics.alias("metrics"), n_centres.alias("n_centres"), rest.alias("tiers"))
