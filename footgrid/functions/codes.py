"""State, plan and animation codes, their legends, and rings of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Cell states.
UNBUILDABLE, GREEN, BUILT, CENTRE = -1, 0, 1, 2
#: Plan codes.
PLAN_NONE, PLAN_GREEN, PLAN_BUILT, PLAN_CENTRE, PLAN_OLD_BUILT, PLAN_OLD_CENTRE = range(6)
BUILT_CODES, CENTRE_CODES = (2, 3, 4, 5), (3, 5)
#: Labels of the animation classes.
CLASS_LABELS = {
    0: "nature", 1: "new low", 2: "new medium", 3: "new high", 4: "centre low", 5: "centre medium", 6: "centre high",
    7: "existing built", 8: "fixed green", 9: "existing centre", 255: "no data",
}
#: Fixed values: (row, column) steps around a cell, in ring order; rows grow downwards.
QUEEN = ((1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1))
ROOK = ((1, 0), (0, 1), (-1, 0), (0, -1))


def ring(queen: bool = True) -> Column:
    """Array of neighbour steps: slot ``i``, ``dr``, ``dc``."""
    steps = QUEEN if queen else ROOK
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (dr, dc) in enumerate(steps)])


def legend(spark: SparkSession) -> DataFrame:
    """Animation class and label, a dimension of eleven rows."""
    return spark.createDataFrame(list(CLASS_LABELS.items()), "cls int, label string")


def animation_class(state: Column, origin: Column, density: Column, high: float, medium: float, low: float) -> Column:
    """Class of a cell: where it comes from counts first, then its state and the tier that its density equals."""
    close = lambda t: F.abs(density - F.lit(t)) <= 1e-8 + 1e-5 * abs(t)
    tier = lambda base: F.when(close(low), base + 1).when(close(medium), base + 2).when(close(high), base + 3).otherwise(255)
    return (
        F.when(origin == 1, 7).when(origin == 0, 8).when(origin == 2, 9)
        .when(state == GREEN, 0).when(state == BUILT, tier(0)).when(state == CENTRE, tier(3)).otherwise(255)
    )


def tier_of_draw(u: Column, p_high: float, p_medium: float, high: float, medium: float, low: float) -> Column:
    """Inverse of the distribution over the three tiers."""
    return F.when(u < p_high, high).when(u < p_high + p_medium, medium).otherwise(low)
