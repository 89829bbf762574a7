"""Smallest pairwise edit distance of a column, before and after dropping one row of the closest pair.

Only distinct texts matter, as equal ones are ignored. Three exact ways share the work, so that no
column of any size is compared all with all:

* short columns (up to SHORT_COLUMN texts of SHORT_CHARS characters together): compared inside one
  row, as an array of bounded length;
* distance 1 in longer columns: texts one edit apart share a text with one character left out, so
  grouping these variants finds them with a number of rows linear in the texts. A group is as large
  as the alphabet times the length at most, and three of its members stand for all of its pairs.
  Long texts group on hashes of the variants, so a variant takes 16 bytes rather than the text's.
  The first rows of a column are grouped first: a pair among them is the first of the column unless
  a text before it has a partner further down, which the few such texts tell;
* what is still open then: a bound from the shortest texts and from neighbours in sorted order, and
  a grid join on the length and on the distances to two pivot texts, which cannot differ by more
  than the bound. Cells are cut into blocks, and a task compares blocks of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.buckets import token_length_range
from tablewarden.functions.text import mean_difference_length
from tablewarden.operators.closest import closest_in_columns
from tablewarden.operators.joins import BROADCAST_ROWS, attach, fits_broadcast, json_bytes
from tablewarden.operators.profile import COLUMN_KEY
from tablewarden.operators.variants import variant_rows
from tablewarden.session import ship_package, stage

SHORT_COLUMN = 64
SHORT_CHARS = 8_192
# Longer texts must share a half with another text before their variants are built.
LONG_TEXT = 64
# Rows of a column whose texts are grouped first, and texts before their first pair that are looked for further down.
LEAD_ROWS = 20_000
EARLY_TEXTS = 256
# Pivots are cut to this many characters, and distances to them are counted up to twice as many.
PIVOT_CHARS = 64
# Texts of a block of a grid cell, and pairs of texts that a task compares on average.
BLOCK_TEXTS = 256
TASK_PAIRS = 4_000_000
# Our choice: groups of characters whose numbers are compared before the texts are.
LETTER_GROUPS = ("eaiou", "tnsrhl", "0123", "456789")


# ---- short columns -------------------------------------------------------------------------------


def _short_columns(values: DataFrame) -> DataFrame:
    """Closest pair and distances without i and without j, compared inside one row per column by tasks."""
    # Comparing is heavy for few bytes, so the partitions must not be merged by their size.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = values.repartition(tasks, *COLUMN_KEY).groupBy(*COLUMN_KEY).agg(
        F.sort_array(F.collect_list(F.struct(F.col("first_row").alias("r"), "text", "n"))).alias("v")
    )

    ship_package(values.sparkSession)
    listed = gathered.select(*COLUMN_KEY, "v", F.col("v.text").alias("texts"))
    kept = [listed.schema[c] for c in (*COLUMN_KEY, "v")]
    schema = T.StructType(
        [
            *kept,
            T.StructField("at_i", T.IntegerType()),
            T.StructField("at_j", T.IntegerType()),
            T.StructField("d", T.LongType()),
            T.StructField("without_i", T.LongType()),
            T.StructField("without_j", T.LongType()),
        ]
    )
    best = listed.mapInArrow(closest_in_columns, schema)

    def left(end: str) -> Column:
        without = F.col(f"without_{end}")
        return F.when(F.col(f"v{end}.n") > 1, F.col("d")).when(without >= 0, without)

    return (
        best.withColumn("vi", F.get("v", F.col("at_i")))
        .withColumn("vj", F.get("v", F.col("at_j")))
        .select(
            *COLUMN_KEY,
            "d",
            F.col("vi.r").alias("i"),
            F.col("vj.r").alias("j"),
            F.col("vi.text").alias("text_i"),
            F.col("vj.text").alias("text_j"),
            left("i").alias("d_i"),
            left("j").alias("d_j"),
        )
    )


# ---- distance 1 ----------------------------------------------------------------------------------


def _halves(texts: DataFrame, *fields: str) -> DataFrame:
    """(fields, half): hashes of the first and the second half of every text, cut for either length.

    One edit leaves one half as it is. `m` is the length of the shorter text of a pair.
    """
    length = F.length("text")
    return texts.select(
        *fields, F.col("text").alias("_cut"), F.explode(F.array(length, length - 1)).alias("m")
    ).select(
        *fields,
        F.inline(
            F.array(
                F.struct(
                    F.xxhash64("m", F.lit("first"), F.substring("_cut", 1, F.floor(F.col("m") / 2).cast("int"))).alias("half")
                ),
                F.struct(
                    F.xxhash64(
                        "m",
                        F.lit("second"),
                        F.right("_cut", (F.col("m") - F.floor(F.col("m") / 2)).cast("int")),
                    ).alias("half")
                ),
            )
        ),
    )


def _with_close_half(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Texts that share their first or second half with another one."""
    halves = _halves(texts, *keys, "first_row")
    shared = (
        halves.groupBy(*keys, "half").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)
    )
    close = (
        halves.join(shared.select(*keys, "half"), [*keys, "half"], "left_semi")
        .select(*keys, "first_row")
        .distinct()
    )
    return texts.join(close, [*keys, "first_row"], "left_semi")


def _short_variants(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_row, long, gap, rest, centre) of every text, as `variant_rows` has them."""
    position = F.sequence(F.lit(1), F.length("text"))

    def left_out(p: Column) -> Column:
        return F.concat(F.substring(F.col("text"), F.lit(1), p - 1), F.substring(F.col("text"), p + 1, F.length("text")))

    gaps = F.when(
        F.length("text") > 0,
        F.transform(position, lambda p: F.struct(p.alias("gap"), left_out(p).alias("rest"))),
    ).otherwise(F.array().cast("array<struct<gap:int,rest:string>>"))
    variants = texts.withColumn("gaps", gaps)
    swaps = variants.select(*keys, "first_row", F.inline("gaps")).withColumn("centre", F.lit(False))
    # Gap 0 marks a lost character; leaving out either of two equal neighbours is the same loss.
    losses = variants.select(
        *keys,
        "first_row",
        F.explode(F.array_distinct(F.transform("gaps", lambda g: g["rest"]))).alias("rest"),
    ).select(*keys, "first_row", F.lit(0).alias("gap"), "rest", F.lit(False).alias("centre"))
    centres = texts.select(
        *keys,
        "first_row",
        F.lit(0).alias("gap"),
        F.col("text").alias("rest"),
        F.lit(True).alias("centre"),
    )
    return reduce(DataFrame.unionByName, [swaps, losses, centres]).select(
        *keys, "first_row", F.lit(False).alias("long"), "gap", F.col("rest").cast("binary").alias("rest"), "centre"
    )


def _long_variants(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The same with hashes in place of the texts."""
    ship_package(texts.sparkSession)
    # Few bytes each, but as many rows as characters.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = texts.select(*keys, "first_row", "text").repartition(tasks, *keys, "first_row")
    fields = [kept.schema[k] for k in [*keys, "first_row"]]
    schema = T.StructType(
        [
            *fields,
            T.StructField("gap", T.IntegerType()),
            T.StructField("rest", T.BinaryType()),
            T.StructField("centre", T.BooleanType()),
        ]
    )
    return kept.mapInArrow(variant_rows(keys), schema).withColumn("long", F.lit(True))


def adjacent_pairs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j) with i < j: pairs at distance 1, at most three per group of variants.

    A group holds either the texts that differ in one given position, all one apart, or a text with
    those that have one character more, each one apart from it. Its three (or the centre and two)
    earliest rows contain its first pair, and a pair without any given row if the group has one.
    """
    variants = _short_variants(texts.filter(F.length("text") <= LONG_TEXT), keys)
    # Texts of exactly LONG_TEXT characters are also the partners of longer ones.
    edge = texts.filter(F.length("text") >= LONG_TEXT)
    if not edge.filter(F.length("text") > LONG_TEXT).isEmpty():
        long = stage(_with_close_half(edge, keys), "long_texts")
        if not long.isEmpty():
            variants = variants.unionByName(_long_variants(long, keys))
    groups = (
        variants.groupBy(*keys, "long", "gap", "rest")
        .agg(
            F.sort_array(F.collect_list(F.when(~F.col("centre"), F.col("first_row")))).alias("rows"),
            F.max(F.when(F.col("centre"), F.col("first_row"))).alias("hub"),
        )
    )

    def pair(a: Column, b: Column) -> Column:
        return F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))

    r = [F.get("rows", F.lit(p)) for p in range(3)]
    hub = F.col("hub")
    pairs = F.when(
        F.col("gap") > 0, F.array(pair(r[0], r[1]), pair(r[0], r[2]), pair(r[1], r[2]))
    ).otherwise(F.array(pair(hub, r[0]), pair(hub, r[1])))
    many = (F.size("rows") > 1) | ((F.col("gap") == 0) & hub.isNotNull() & (F.size("rows") > 0))
    # least and greatest skip NULL, so a pair with a missing member has i = j.
    return (
        groups.filter(many & ((F.col("gap") > 0) | hub.isNotNull()))
        .select(*keys, F.inline(pairs))
        .filter(F.col("i") < F.col("j"))
    )


# ---- larger distances ----------------------------------------------------------------------------


def _upper_bounds(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bound, _extent): a distance that some pair is within, whichever one text is left out.

    Two of the three shortest texts are no further apart than the longest of them is long.
    Neighbours in two sorted orders, looked at inside partitions only, are compared within that
    bound; a text is in two pairs of an order, so the third smallest distance of an order holds.
    """
    by_length = Window.partitionBy(*keys).orderBy("length")
    # As many rows as different lengths; texts may share a length.
    lengths = texts.groupBy(*keys, F.length("text").alias("length")).agg(
        F.count(F.lit(1)).alias("c"), (F.max("first_row") + 1).alias("row")
    )
    starts = stage(
        lengths.withColumn("upto", F.sum("c").over(by_length))
        .groupBy(*keys)
        .agg(
            F.coalesce(F.min(F.when(F.col("upto") >= 3, F.col("length"))), F.max("length")).alias("start"),
            F.max("row").alias("_extent"),
            F.max("upto").alias("texts"),
        )
        .filter(F.col("texts") > 1)
        .drop("texts"),
        "starts",
    )
    found = []
    for order in (F.col("text"), F.reverse("text")):
        ranged = texts.withColumn("_order", order).repartitionByRange(
            *[F.col(k) for k in keys], F.col("_order")
        )
        before = Window.partitionBy(*keys, "_part").orderBy("_order")
        found.append(
            ranged.withColumn("_part", F.spark_partition_id())
            .withColumn("_before", F.lag("text").over(before))
            .filter(F.col("_before").isNotNull())
            .select(*keys, "first_row", "text", "_before")
        )
    both = found[0].withColumn("_in", F.lit(0)).unionByName(found[1].withColumn("_in", F.lit(1)))
    smallest = Window.partitionBy(*keys, "_in").orderBy("d")
    near = (
        attach(both, starts, keys, F.col("first_row"), "_extent", 1, limit=0)
        .select(*keys, "_in", F.expr("levenshtein(text, _before, start)").alias("d"))
        .filter(F.col("d") >= 0)
        .withColumn("rank", F.row_number().over(smallest))
        .filter(F.col("rank") <= 3)  # taken before the shuffle as well
        .groupBy(*keys, "_in")
        .agg(F.max(F.when(F.col("rank") == 3, F.col("d"))).alias("d"))
        .groupBy(*keys)
        .agg(F.min("d").alias("d"))
    )
    return starts.join(near, keys, "left").select(
        *keys, F.coalesce("d", "start").alias("bound"), "_extent"
    )


def _placed(texts: DataFrame, summary: DataFrame, keys: list[str], largest: int) -> DataFrame:
    """Texts with what cannot differ by more than the bound between texts within it: length (c0),
    distances to two pivots (c1, c2) and numbers of characters of some groups (c3, ...)."""
    # Never joined on the keys alone: the comparisons of a column have to spread over its cells.
    joined = attach(texts, summary, keys, F.col("first_row"), "_extent", largest, limit=0)
    far = 2 * PIVOT_CHARS

    def distance(pivot: str) -> Column:
        # Cut off at `far`, a distance still differs by no more than the whole one.
        d = F.expr(f"levenshtein(text, {pivot}, {far})")
        return F.when(d < 0, far).otherwise(d)

    groups = [
        F.length("text") - F.length(F.translate("text", letters, "")) for letters in LETTER_GROUPS
    ]
    return joined.select(
        *keys,
        "first_row",
        "text",
        "bound",
        F.length("text").alias("c0"),
        distance("p1").alias("c1"),
        distance("p2").alias("c2"),
        *[c.alias(f"c{k}") for k, c in enumerate(groups, 3)],
    )


def closest_pairs(
    texts: DataFrame, keys: list[str], largest: int, block_texts: int | None = None
) -> DataFrame:
    """(keys, d, i, j, d_i, d_j): the smallest distance, its first pair of rows, and the smallest
    distances of pairs without i and without j (NULL if there is none).

    Exact: texts within the bound differ by at most the bound in length and in their distance to
    any pivot, so they lie in the same or in adjacent cells of a grid of that width. A cell is cut
    into blocks of about `block_texts` texts by their row hashes; each pair of blocks of two
    neighbouring cells is a join key of its own, so no task has a whole hot cell to compare. Of each
    only three pairs go on: the closest, and the closest without either of its rows. Whatever row is
    left out in the end, the closest pair without it is among them.
    """
    spark = texts.sparkSession
    block_texts = BLOCK_TEXTS if block_texts is None else block_texts
    pivots = texts.groupBy(*keys).agg(
        F.min(F.left("text", F.lit(PIVOT_CHARS))).alias("p1"),
        F.max(F.left("text", F.lit(PIVOT_CHARS))).alias("p2"),
    )
    summary = stage(pivots.join(_upper_bounds(texts, keys), keys), "bounds")
    width = F.col("bound") + 1
    axes = ["c0", "c1", "c2"]
    grid = [f"g_{a}" for a in axes]
    cells = stage(
        _placed(texts, summary, keys, largest).select(
            "*", *[F.floor(F.col(a) / width).alias(g) for a, g in zip(axes, grid, strict=True)]
        ),
        "cells",
    )
    # Blocks of every cell, and the cells next to it that exist, one of two opposite ones.
    sizes = cells.groupBy(*keys, *grid).agg(F.count(F.lit(1)).alias("n"))
    sizes = stage(sizes.withColumn("blocks", F.ceil(F.col("n") / block_texts)), "cell_sizes")
    steps = [
        (x, y, z)
        for x in (-1, 0, 1)
        for y in (-1, 0, 1)
        for z in (-1, 0, 1)
        if (x, y, z) >= (0, 0, 0)
    ]
    moves = F.array(
        *[F.struct(*[F.lit(s).alias(f"s_{a}") for s, a in zip(step, axes, strict=True)]) for step in steps]
    )
    there = [f"t_{a}" for a in axes]
    neighbours = (
        sizes.select("*", F.inline(moves))
        .select(*keys, *grid, "n", "blocks", *[(F.col(g) + F.col(f"s_{a}")).alias(t) for g, a, t in zip(grid, axes, there, strict=True)])
        .join(
            sizes.select(
                *keys,
                *[F.col(g).alias(t) for g, t in zip(grid, there, strict=True)],
                F.col("n").alias("n_there"),
                F.col("blocks").alias("blocks_there"),
            ),
            [*keys, *there],
        )
    )
    neighbours = stage(neighbours, "neighbours")
    pairs = neighbours.agg(F.sum(F.col("n").cast("double") * F.col("n_there"))).first()[0] or 0.0
    # Given by number, so that partitions of few bytes and many pairs are not merged.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(pairs // TASK_PAIRS) + 1)

    def block(blocks: Column) -> Column:
        return F.pmod(F.xxhash64("first_row"), blocks)

    def numbers(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    # A text goes to every block of every neighbouring cell, spread by its own row before the join
    # with the short list of its cell's neighbours, which adaptive execution may split.
    task_key = [*keys, *grid, *there, "_b", "_bt"]
    fields = ["first_row", "text", "bound", *[f"c{k}" for k in range(3 + len(LETTER_GROUPS))]]
    left = (
        cells.join(neighbours, [*keys, *grid])
        .withColumn("_b", block(F.col("blocks")))
        .withColumn("_bt", numbers("blocks_there"))
        .select(*task_key, *[F.col(f).alias(f"{f}_a") for f in fields])
        .repartition(tasks, *task_key)
    )
    right = (
        cells.withColumnsRenamed(dict(zip(grid, there, strict=True)))
        .join(neighbours, [*keys, *there])
        .withColumn("_bt", block(F.col("blocks_there")))
        .withColumn("_b", numbers("blocks"))
        .select(*task_key, *fields)
        .repartition(tasks, *task_key)
    )
    same_cell = reduce(lambda x, y: x & y, [F.col(g) == F.col(t) for g, t in zip(grid, there, strict=True)])
    apart = [F.abs(F.col(f) - F.col(f"{f}_a")) for f in fields if f[0] == "c"]
    near = reduce(lambda x, y: x & y, [d <= F.col("bound") for d in apart])
    # One edit takes a character from one group and adds it to another at most.
    near &= reduce(lambda x, y: x + y, apart[3:]) <= 2 * F.col("bound")
    compared = (
        left.join(right, task_key)
        .filter(near & (~same_cell | (F.col("first_row_a") < F.col("first_row"))))
        .select(
            *task_key,
            F.struct(
                F.expr("levenshtein(text_a, text, bound)").cast("long").alias("d"),
                F.least("first_row_a", "first_row").alias("i"),
                F.greatest("first_row_a", "first_row").alias("j"),
            ).alias("p"),
        )
        .filter(F.col("p.d") >= 0)  # -1 stands for more than the bound
        .withColumn("top", F.min("p").over(Window.partitionBy(*task_key)))
    )

    def without(end: str) -> Column:
        dropped = F.col(f"top.{end}")
        return F.min(F.when((F.col("p.i") != dropped) & (F.col("p.j") != dropped), F.col("p")))

    leading = compared.groupBy(*task_key).agg(
        F.min("p").alias("top"), without("i").alias("without_i"), without("j").alias("without_j")
    )
    leading = stage(
        leading.select(*keys, F.explode(F.array_compact(F.array("top", "without_i", "without_j"))).alias("p")),
        "leading",
    )
    best = leading.groupBy(*keys).agg(F.min("p").alias("top"), (F.max("p.i") + 1).alias("_extent"))
    return (
        attach(leading, best, keys, F.col("p.i"), "_extent", largest)
        .groupBy(*keys)
        .agg(
            F.min("top").alias("top"),
            without("i")["d"].alias("d_i"),
            without("j")["d"].alias("d_j"),
        )
        .select(*keys, "top.*", "d_i", "d_j")
    )


# ---- long columns --------------------------------------------------------------------------------


def _clear_of(end: str, best: str) -> Column:
    """Aggregate: whether a pair does without an end of the best one."""
    return F.bool_or((F.col("i") != F.col(f"{best}.{end}")) & (F.col("j") != F.col(f"{best}.{end}")))


def _partners_below(early: DataFrame, rest: DataFrame) -> DataFrame:
    """(key, i, j): pairs at distance 1 of the few early texts with all texts of later rows."""
    columns = F.broadcast(early.select(*COLUMN_KEY).distinct())
    halves = _halves(early.withColumnRenamed("first_row", "i"), *COLUMN_KEY, "i", "text").withColumnRenamed("text", "_early")
    return (
        _halves(rest.join(columns, COLUMN_KEY, "left_semi"), *COLUMN_KEY, "first_row", "text")
        .join(F.broadcast(halves), [*COLUMN_KEY, "half"])
        .filter(F.expr("levenshtein(text, _early, 1)") == 1)
        .select(*COLUMN_KEY, "i", F.col("first_row").alias("j"))
        .distinct()
    )


def leading_pairs(values: DataFrame, extents: DataFrame, largest: int, lead_rows: int, early_texts: int) -> DataFrame:
    """(key, i, j) with i < j: pairs at distance 1 as `adjacent_pairs` has them, or fewer of a column:
    its first pair, one without i and one without j, if all three are known without the others.

    Among the first rows of a column all pairs are found. No earlier pair has both rows there, so only
    texts before the first pair's i can have one, with a text of a later row. Columns where that leaves
    something open, or has too many texts to look for, are grouped as a whole.
    """
    further = stage(extents.filter(F.col("_extent") > lead_rows), "further")
    if further.isEmpty():
        return adjacent_pairs(values, COLUMN_KEY)
    lead = values.filter(F.col("first_row") < lead_rows)
    pairs = stage(adjacent_pairs(lead, COLUMN_KEY), "lead_pairs")
    first = pairs.groupBy(*COLUMN_KEY).agg(F.min(F.struct("i", "j")).alias("p"))
    first = stage(first.join(further.select(*COLUMN_KEY), COLUMN_KEY, "left_semi"), "lead_first")
    before = (
        lead.join(first, COLUMN_KEY).filter(F.col("first_row") < F.col("p.i")).select(*COLUMN_KEY, "first_row", "text")
    )
    counts = before.groupBy(*COLUMN_KEY).agg(F.count(F.lit(1)).alias("c"))
    many = stage(counts.filter(F.col("c") > early_texts).select(*COLUMN_KEY), "many_early")
    early = stage(before.join(many, COLUMN_KEY, "left_anti"), "early")
    rows, size = early.agg(F.count(F.lit(1)), json_bytes(early)).first()
    if not fits_broadcast(rows, size):
        many = many.union(early.select(*COLUMN_KEY)).distinct()
    elif rows:
        rest = values.filter(F.col("first_row") >= lead_rows)
        pairs = stage(pairs.unionByName(_partners_below(early, rest)), "known_pairs")
    best = pairs.groupBy(*COLUMN_KEY).agg(F.min(F.struct("i", "j")).alias("p"))
    known = (
        pairs.join(best, COLUMN_KEY)
        .groupBy(*COLUMN_KEY)
        .agg(_clear_of("i", "p").alias("one_i"), _clear_of("j", "p").alias("one_j"))
        .filter("one_i AND one_j")
        .join(many, COLUMN_KEY, "left_anti")
    )
    unknown = stage(further.join(known, COLUMN_KEY, "left_anti"), "unknown")
    if unknown.isEmpty():
        return pairs
    whole = attach(values, unknown, COLUMN_KEY, F.col("first_row"), "_extent", largest, how="left_semi")
    rest = pairs.join(unknown.select(*COLUMN_KEY), COLUMN_KEY, "left_anti")
    return rest.unionByName(adjacent_pairs(stage(whole, "unknown_texts"), COLUMN_KEY))


def _long_columns(
    values: DataFrame, largest: int, lead_rows: int | None = None, early_texts: int | None = None
) -> DataFrame:
    """The same fields as `_short_columns`, for columns with any number of distinct texts."""
    lead_rows = LEAD_ROWS if lead_rows is None else lead_rows
    early_texts = EARLY_TEXTS if early_texts is None else early_texts
    extents = stage(values.groupBy(*COLUMN_KEY).agg((F.max("first_row") + 1).alias("_extent")), "extents")
    adjacent = stage(leading_pairs(values, extents, largest, lead_rows, early_texts), "adjacent")
    first = adjacent.groupBy(*COLUMN_KEY).agg(F.min(F.struct("i", "j")).alias("p"))
    settled = first.select(
        *COLUMN_KEY, F.lit(1).cast("long").alias("d"), F.col("p.i").alias("i"), F.col("p.j").alias("j"),
        F.lit(None).cast("long").alias("d_i"), F.lit(None).cast("long").alias("d_j"), F.lit(False).alias("searched"),
    )
    beyond = stage(extents.join(settled.select(*COLUMN_KEY), COLUMN_KEY, "left_anti"), "beyond")
    if beyond.isEmpty():
        closest = stage(settled, "closest")
    else:
        apart = attach(values, beyond, COLUMN_KEY, F.col("first_row"), "_extent", largest, how="left_semi")
        found = closest_pairs(stage(apart, "apart"), COLUMN_KEY, largest)
        closest = stage(settled.unionByName(found.withColumn("searched", F.lit(True))), "closest")

    # Texts and counts of both rows: (key, first_row) identifies a text, so this join has no hot key.
    wanted = closest.select(*COLUMN_KEY, F.explode(F.array("i", "j")).alias("first_row"))
    if closest.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    both = stage(values.join(wanted, [*COLUMN_KEY, "first_row"], "left_semi"), "both_ends")

    def end(name: str) -> DataFrame:
        return both.select(
            *COLUMN_KEY,
            F.col("first_row").alias(name),
            F.col("text").alias(f"text_{name}"),
            F.col("n").alias(f"n_{name}"),
        )

    known = closest.join(end("i"), [*COLUMN_KEY, "i"]).join(end("j"), [*COLUMN_KEY, "j"])
    # A pair at distance 1 that does not touch the dropped row settles the second distance.
    ends = closest.select(*COLUMN_KEY, F.col("i").alias("bi"), F.col("j").alias("bj"))
    sized = ends.join(
        adjacent.groupBy(*COLUMN_KEY).agg((F.max("i") + 1).alias("_extent")), COLUMN_KEY
    )
    others = (
        attach(adjacent, sized, COLUMN_KEY, F.col("i"), "_extent", largest)
        .groupBy(*COLUMN_KEY)
        .agg(
            F.bool_or((F.col("i") != F.col("bi")) & (F.col("j") != F.col("bi"))).alias("one_i"),
            F.bool_or((F.col("i") != F.col("bj")) & (F.col("j") != F.col("bj"))).alias("one_j"),
        )
    )

    def second(end_name: str) -> Column:
        return (
            F.when(F.col(f"n_{end_name}") > 1, F.col("d"))
            .when(F.col(f"one_{end_name}"), F.lit(1).cast("long"))
            .otherwise(F.col(f"d_{end_name}"))
        )

    partial = stage(
        known.join(others, COLUMN_KEY, "left").select(
            *COLUMN_KEY,
            "d",
            "i",
            "j",
            "text_i",
            "text_j",
            second("i").alias("d_i"),
            second("j").alias("d_j"),
            "searched",
        ),
        "spelling",
    )
    # Where all pairs at distance 1 have the dropped row, the column is searched without it.
    open_ends = partial.filter("NOT searched").select(
        *COLUMN_KEY,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("i").alias("end"), F.col("i").alias("dropped"), F.col("d_i").alias("known")),
                    F.struct(F.lit("j").alias("end"), F.col("j").alias("dropped"), F.col("d_j").alias("known")),
                ),
                lambda e: e["known"].isNull(),
            )
        ).alias("e"),
    ).select(*COLUMN_KEY, "e.end", "e.dropped")
    partial = partial.drop("searched")
    if open_ends.isEmpty():
        return partial
    left = attach(
        values, open_ends.join(extents, COLUMN_KEY), COLUMN_KEY, F.col("first_row"), "_extent", largest
    ).filter(F.col("first_row") != F.col("dropped"))
    left = stage(left.select(*COLUMN_KEY, "end", "first_row", "text"), "left_out")
    again = closest_pairs(left, [*COLUMN_KEY, "end"], largest)
    found = again.groupBy(*COLUMN_KEY).agg(
        F.max(F.when(F.col("end") == "i", F.col("d"))).alias("found_i"),
        F.max(F.when(F.col("end") == "j", F.col("d"))).alias("found_j"),
    )
    return (
        partial.join(found, COLUMN_KEY, "left")
        .withColumn("d_i", F.coalesce("d_i", "found_i"))
        .withColumn("d_j", F.coalesce("d_j", "found_j"))
        .drop("found_i", "found_j")
    )


# ---- measure -------------------------------------------------------------------------------------


def spelling_pairs(
    values: DataFrame, profiled: DataFrame, largest: int, short: int | None = None
) -> DataFrame:
    """(key, d, i, j, text_i, text_j, d_i, d_j): closest pair, and the distance left without i or j.

    `largest` is the largest number of distinct texts of a column.
    """
    short = SHORT_COLUMN if short is None else short
    texts = values.select(*COLUMN_KEY, "text", "n", "first_row")
    chars = stage(texts.groupBy(*COLUMN_KEY).agg(F.sum(F.length("text")).alias("chars")), "chars")
    if largest <= short and chars.filter(F.col("chars") > SHORT_CHARS).isEmpty():
        return _short_columns(texts)
    is_short = (F.col("n_texts") <= short) & (F.col("chars") <= SHORT_CHARS)
    size = profiled.join(chars, COLUMN_KEY).select(*COLUMN_KEY, "n_rows", is_short.alias("is_short"))
    # One pass over the texts, split by the flag.
    flagged = stage(
        attach(texts, size, COLUMN_KEY, F.col("first_row"), "n_rows", largest), "flagged"
    )
    few = flagged.filter("is_short").drop("is_short")
    many = flagged.filter("NOT is_short").drop("is_short")
    return _short_columns(few).unionByName(_long_columns(many, largest))


def spelling_measures(
    values: DataFrame,
    profiled: DataFrame,
    largest: int,
    double_bucket: bool = False,
    short: int | None = None,
) -> DataFrame:
    """One row per column with a closest pair whose token sets differ.

    mpd, mpd_p (Infinity where no pair is left) and the suspect row: j if dropping it leaves the
    larger distance, else i. `double_bucket` applies the token-length buckets twice.
    """
    pairs = spelling_pairs(values, profiled, largest, short)
    infinite = F.lit(float("inf"))
    left_i = F.coalesce(F.col("d_i").cast("double"), infinite)
    left_j = F.coalesce(F.col("d_j").cast("double"), infinite)
    length = mean_difference_length(F.col("text_i"), F.col("text_j"))
    bucket = token_length_range(length)
    measured = pairs.withColumn("length", length).filter(F.col("length") > 0)
    features = profiled.select(*COLUMN_KEY, "base_type", "d_type", "rows_range")
    return measured.join(features, COLUMN_KEY).select(
        *COLUMN_KEY,
        "base_type",
        "d_type",
        "rows_range",
        (token_length_range(bucket) if double_bucket else bucket).alias("range_mpd"),
        F.col("d").cast("double").alias("mpd"),
        F.greatest(left_i, left_j).alias("mpd_p"),
        F.when(left_j > left_i, F.col("j")).otherwise(F.col("i")).alias("suspect_row"),
        "i",
        "j",
    )
