"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, in a shuffled order that depends on their ids alone, are one stream of
words, cut into blocks of equal size. The schedule is a sequence of slots: golden-ratio points, mapped
through the cumulative shares of the sources, say whose block comes next, so every stretch of the
mix has nearly the target shares. A source's slots are ranked and joined with its blocks; after the
last block its stream begins again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import WORD
from tablewarden.operators.ordered import running_sums
from tablewarden.session import stage

# Golden ratio less one as a fraction of 2^31, odd, so that 2^31 slots meet every fraction once.
GOLDEN, TURN = 1327217885, 1 << 31
# A source is summed up in chunks of so many documents, and its slots ranked in stretches of so many;
# of larger tables in this many chunks, so that chunks and their number grow alike.
CHUNK, CHUNKS = 256, 65_536


@dataclass
class Mix:
    """places: _row, _id, _hash (of the text), source, size, first (words of its source before it); targets: one row per
    source; slots: position, source, rank, start and words (what it takes of its block)."""

    places: DataFrame
    targets: DataFrame
    slots: DataFrame


def source_targets(sizes: DataFrame, weights: list[int], share: float, ceiling: float) -> DataFrame:
    """source, source_size, target of every source in `sizes` (source, source_size).

    Sources in order of code points, null last, weigh `weights` in turn. They share `share` times all
    words; a target stops at `ceiling` times its source's size and the rest is shared again by weight.
    The outcome has one level: each target is the smaller of its ceiling and level times weight, and
    sorted by ceiling over weight, the sources below the level come first. Running sums find it.
    """
    n = sizes.count()
    one = F.lit(1).cast("long")
    ranked = running_sums(sizes, [], [F.col("source").asc_nulls_last()], {"_rank": one}, n)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.get(turn, ((F.col("_rank") - 1) % len(weights)).cast("int")))
    ranked = ranked.withColumn("_cap", ceiling * F.col("source_size"))
    ranked = stage(ranked.withColumn("_at", F.col("_cap") / F.col("_w")), "ranked")
    totals = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    whole, weight = share * (totals[0] or 0), totals[1] or 0.0
    summed = running_sums(
        ranked, [], [F.col("_at"), F.col("_rank")], {"_caps": F.col("_cap"), "_ws": F.col("_w")}, n
    )
    # A source is at its ceiling if the level that is left over for it and those above reaches it.
    left_w = F.lit(weight) - F.col("_ws") + F.col("_w")
    level = (F.lit(whole) - F.col("_caps") + F.col("_cap")) / left_w
    capped = summed.where(F.col("_at") <= level)
    sums = capped.agg(F.coalesce(F.sum("_cap"), F.lit(0.0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    rest = (whole - sums[0]) / (weight - sums[1]) if weight - sums[1] > 1e-9 else float("inf")
    return ranked.select(
        "source", "source_size", F.least("_cap", F.lit(rest) * F.col("_w")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    ceiling: float = 2.0,
    block: int = 2048,
    source: str = "source",
    chunk: int | None = None,
) -> Mix:
    """Places of all documents, targets, and the schedule, each written down.

    Sizes are words; null and empty texts have none and are never taken. The order within a source is
    that of the md5 of the id as text; ids alike are ordered by size, and rows alike in both are
    interchangeable. Null sources are a source. Takes are whole words, so a source's sum is its
    target rounded. No documents give no rows.
    """
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"),
        F.xxhash64("text").alias("_hash"),
    )
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    sizes = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    targets = stage(source_targets(sizes.drop("n"), weights, share, ceiling), "targets")

    # Running words within a source: inside chunks of its order, lifted by the sums of earlier chunks.
    chunk = chunk or max(CHUNK, (sizes.agg(F.sum("n")).first()[0] or 0) // CHUNKS)
    counts = sizes.select(F.col("source").alias("_source"), F.ceil(F.col("n") / chunk).alias("_chunks"))
    head = F.conv(F.substring("_order", 1, 7), 16, 10).cast("long")
    cut = rows.join(counts, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_chunk", F.floor(head * F.col("_chunks") / (1 << 28))
    )
    inside = Window.partitionBy("source", "_chunk").orderBy("_order", "_id", "size", "_row")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    lifts = stage(
        cut.groupBy("source", "_chunk")
        .agg(F.sum("size").alias("_s"))
        .select("source", "_chunk", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_lift")),
        "lifts",
    )
    local = cut.withColumn("_in", F.coalesce(F.sum("size").over(before), F.lit(0)))
    same = local.source.eqNullSafe(lifts.source) & (local._chunk == lifts._chunk)
    places = stage(
        local.join(lifts, same).select("_row", "_id", "_hash", local.source, "size", (F.col("_in") + F.col("_lift")).alias("first")),
        "places",
    )
    return Mix(places, targets, _schedule(targets, block, chunk))


def _schedule(targets: DataFrame, block: int, chunk: int) -> DataFrame:
    """Slots of all sources, in the order of the mix.

    A source needs as many slots as take its target. Points are drawn as many as there are needed
    slots; if they give a source too few, which can be some at most, the missing ones follow at the
    end, and those too many are left out.
    """
    spark = targets.sparkSession
    words = F.round("target").cast("long")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    turns = F.floor(words / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    rest = words - turns * F.col("source_size")
    need = (turns * blocks + F.ceil(rest / block)).cast("long")
    needs = targets.select("source", "source_size", words.alias("words"), blocks.alias("blocks"), need.alias("need"))
    needs = stage(needs.where("need > 0"), "needs")
    n = needs.count()
    total = needs.agg(F.sum("need")).first()[0] or 0
    shares = running_sums(needs, [], [F.col("source").asc_nulls_last()], {"_to": F.col("need")}, n)
    # Where each source's share of the circle begins and ends, in whole steps of the points.
    shares = shares.select(
        "source",
        F.floor((F.col("_to") - F.col("need")) * F.lit(float(TURN)) / max(1, total)).alias("_lo"),
        F.floor(F.col("_to") * F.lit(float(TURN)) / max(1, total)).alias("_hi"),
    )
    cells = 4096
    step = TURN // cells
    shares = stage(
        shares.where("_hi > _lo").withColumn(
            "_cell", F.explode(F.sequence(F.floor(F.col("_lo") / step), F.floor((F.col("_hi") - 1) / step)))
        ),
        "shares",
    )
    points = spark.range(total).select(
        F.col("id").alias("position"), (((F.col("id") % TURN) * GOLDEN + TURN // 2) % TURN).alias("_u")
    )
    points = points.withColumn("_cell", F.floor(F.col("_u") / step))
    drawn = stage(
        points.join(shares, "_cell").where("_u >= _lo AND _u < _hi").select("position", "source"), "drawn"
    )
    piece = F.floor(F.col("position") / chunk)
    earlier = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    lifts = stage(
        drawn.groupBy("source", piece.alias("_piece"))
        .count()
        .select("source", "_piece", "count", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_lift")),
        "ranks",
    )
    local = drawn.withColumn("_piece", piece).withColumn(
        "_in", F.row_number().over(Window.partitionBy("source", "_piece").orderBy("position")) - 1
    )
    same = local.source.eqNullSafe(lifts.source) & (local._piece == lifts._piece)
    ranked = local.join(lifts, same).select("position", local.source, (F.col("_in") + F.col("_lift")).alias("rank"))
    given = lifts.groupBy("source").agg(F.sum("count").alias("_given"))
    short = needs.join(given, needs.source.eqNullSafe(given.source), "left").select(
        needs.source, F.coalesce("_given", F.lit(0)).alias("_given"), "need"
    )
    missing = short.where("_given < need").select(
        F.lit(total).cast("long").alias("position"),
        "source",
        F.explode(F.sequence(F.col("_given"), F.col("need") - 1)).alias("rank"),
    )
    slots = ranked.union(missing)
    joined = slots.join(needs, slots.source.eqNullSafe(needs.source)).where("rank < need")
    turn = F.floor(F.col("rank") / F.col("blocks"))
    start = (F.col("rank") % F.col("blocks")) * block
    full = F.least(F.lit(block).cast("long"), F.col("source_size") - start)
    taken_before = turn * F.col("source_size") + start
    return stage(
        joined.select(
            "position", slots.source, "rank", start.alias("start"),
            F.least(full, F.col("words") - taken_before).alias("words"),
        ),
        "slots",
    )


def mixed_pieces(mix: Mix, block: int = 2048) -> DataFrame:
    """The mix itself: for each slot the stretches of documents in its block.

    position, rank, source, _row, from_word (of the document) and words.
    """
    docs = mix.places.where("size > 0").withColumn(
        "_block",
        F.explode(
            F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))
        ),
    )
    slots = mix.slots.where("words > 0").withColumn("_block", F.floor(F.col("start") / block))
    same = docs.source.eqNullSafe(slots.source) & (docs._block == slots._block)
    low = F.greatest("first", "start")
    high = F.least(F.col("first") + F.col("size"), F.col("start") + F.col("words"))
    return (
        docs.join(slots, same)
        .select(
            "position", "rank", docs.source, "_row", (low - F.col("first")).alias("from_word"), (high - low).alias("words")
        )
        .where("words > 0")
    )


def taken_words(mix: Mix, block: int = 2048) -> DataFrame:
    """Places with `taken`, the words the mix takes of each document, repeats counted."""
    taken = stage(mixed_pieces(mix, block).groupBy("_row").agg(F.sum("words").alias("taken")), "taken")
    return mix.places.join(taken, "_row", "left").withColumn(
        "taken", F.coalesce("taken", F.lit(0)).cast("long")
    )


def mixed_documents(mix: Mix, block: int = 2048) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    targets = mix.targets.withColumnRenamed("source", "_source")
    return (
        taken_words(mix, block)
        .join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")
    )


def repeat_mixed(docs: DataFrame, weights: list[int], share: float = 1.5, ceiling: float = 2.0, block: int = 2048) -> DataFrame:
    """The documents of the mix with their own columns: one row for each reading of a document.

    A reading that the mix ends within, one of each source at most, counts if half of it is taken.
    Rows alike in id and text are read equally often. Documents the mix takes no words of go.
    """
    words = taken_words(mix_sources(docs, weights, share, ceiling, block), block)
    readings = (
        words.where("taken > 0")
        .groupBy(F.col("_id").alias("_read"), F.col("_hash").alias("_read_hash"))
        .agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("_times"))
        .where("_times > 0")
    )
    readings = stage(readings, "readings")
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_read")) & (F.col("_hash") == F.col("_read_hash"))
    return (
        rows.join(readings, same)
        .withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select("_doc.*")
    )
