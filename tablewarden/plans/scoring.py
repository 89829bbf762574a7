"""Likelihood counts of candidates against a model, without comparing every candidate with every
training row.

For a candidate (t1, t2), among model rows with the same features, `p_dt` counts those with
T1 <= t2 and `p_dot` those with T1 <= t1 and T2 >= t2. The first is a running sum. The second is a
count over a quadrant: model rows are numbered by T1, the prefix of rows with T1 <= t1 is cut into
blocks whose lengths are powers of two, and in each block a running sum over T2 gives the count.
Rows appear once per power of two, so the work is n log n whatever the sizes of the feature groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.operators.joins import BROADCAST_ROWS, with_group_totals
from tablewarden.operators.ordered import GROUP_LIMIT, running_sums

POINT, PREFIX, WHOLE = 0, 1, 2


def likelihood_counts(
    candidates: DataFrame,
    model: DataFrame,
    features: list[str],
    thetas: tuple[str, str],
    model_thetas: tuple[str, str] | None = None,
    larger_is_extreme: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """(features, thetas, p_dt, p_dot) for the distinct (features, thetas) of the candidates.

    With `larger_is_extreme` all comparisons are the other way round. The model carries the number
    of training columns behind each of its rows in `w`. Both inputs should be stage tables.
    """
    sign = -1.0 if larger_is_extreme else 1.0

    def coordinate(name: str) -> Column:
        return F.lit(0.0) + F.lit(sign) * F.col(name)  # the sum keeps zero unsigned

    m1, m2 = model_thetas or thetas
    queries = candidates.groupBy(
        *features, coordinate(thetas[0]).alias("a"), coordinate(thetas[1]).alias("b")
    ).agg(F.lit(1).alias("_one")).drop("_one")
    # Only as a counted broadcast: a shuffle by the features would gather a hot group for the
    # aggregation behind it.
    seen = candidates.select(*features).distinct()
    if seen.count() <= BROADCAST_ROWS:
        model = model.join(F.broadcast(seen), features, "left_semi")
    points = (
        model.groupBy(*features, coordinate(m1).alias("a"), coordinate(m2).alias("b"))
        .agg(F.sum("w").alias("w"))
    )
    zero = F.lit(0).cast("long")
    events = (
        points.select(*features, "a", "b", "w", F.col("a").alias("at"), F.lit(POINT).alias("kind"))
        .unionByName(
            queries.select(
                *features, "a", "b", zero.alias("w"), F.col("a").alias("at"), F.lit(PREFIX).alias("kind")
            )
        )
        .unionByName(
            queries.select(
                *features, "a", "b", zero.alias("w"), F.col("b").alias("at"), F.lit(WHOLE).alias("kind")
            )
        )
    )
    sizes = events.groupBy(*features).agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.agg(F.max("c")).first()[0] or 0

    # Below, every row is repeated once per level inside its group.
    limit = GROUP_LIMIT // 16 if limit is None else limit
    is_point = (F.col("kind") == POINT).cast("long")
    order = [F.col(c) for c in ("at", "kind", "a", "b")]
    placed = running_sums(
        events, features, order, {"below": is_point, "weight": F.col("w")}, largest, limit
    )
    below_all = placed.filter(F.col("kind") == WHOLE).select(
        *features, "a", "b", F.col("weight").alias("p_dt")
    )

    # Points numbered r belong to block r >> level of every level whose block ends within the group;
    # a prefix of c points is the blocks (c >> level) - 1 of the levels whose bit is set in c.
    numbered = placed.filter(F.col("kind") != WHOLE)
    numbered = with_group_totals(
        numbered, features, {"total": F.sum(is_point)}, F.col("below"), largest, limit
    )
    levels = F.sequence(F.lit(0), F.lit(40))
    r, c, total = F.col("below") - 1, F.col("below"), F.col("total")

    def shift(x: Column, level: Column) -> Column:
        return F.call_function("shiftright", x, level)

    def block(level: Column) -> Column:
        return F.when(F.col("kind") == POINT, shift(r, level)).otherwise(shift(c, level) - 1)

    def used(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        return F.when(F.col("kind") == POINT, (shift(r, level) + 1) * size <= total).otherwise(
            shift(c, level) % 2 == 1
        )

    blocks = F.transform(
        F.filter(levels, used), lambda x: F.struct(x.alias("level"), block(x).alias("block"))
    )
    spread = numbered.select(
        *features, "a", "b", "w", "kind", (F.lit(0.0) - F.col("b")).alias("down"), F.inline(blocks)
    )
    order = [F.col(x) for x in ("down", "kind", "a", "b")]
    above = running_sums(
        spread, [*features, "level", "block"], order, {"weight": F.col("w")}, largest, limit
    )
    quadrant = (
        above.filter(F.col("kind") == PREFIX)
        .groupBy(*features, "a", "b")
        .agg(F.sum("weight").alias("p_dot"))
    )
    counted = below_all.join(quadrant, [*features, "a", "b"], "left")
    return counted.select(
        *features,
        (F.lit(0.0) + F.lit(sign) * F.col("a")).alias(thetas[0]),
        (F.lit(0.0) + F.lit(sign) * F.col("b")).alias(thetas[1]),
        "p_dt",
        F.coalesce("p_dot", F.lit(0).cast("long")).alias("p_dot"),
    )
