"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a table of prime size in an order of its own: an offset, then steps
of a constant skip, which meets all slots as the size is prime. Shards take turns claiming the first
slot of their order that is free, so their numbers of slots differ by one at most, and a shard
more or less moves few slots between the others. A key's slot is its hash; its shard is the slot's.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Slots of a table at most: what is broadcast has this bound.
MOST_SLOTS = 1_000_003


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard, from two parts of the md5 of its name."""
    digest = md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def fill_table(shards: list[str], slots: int) -> list[int]:
    """Index of the shard that owns each slot; `slots` must be a prime of at least the shards."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    if slots > MOST_SLOTS or slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, at least that of the shards")
    orders = [preference(s, slots) for s in shards]
    owner, turn = [-1] * slots, [0] * len(shards)
    left = slots
    while left:
        for k, (offset, skip) in enumerate(orders):
            while owner[at := (offset + turn[k] * skip) % slots] >= 0:
                turn[k] += 1
            owner[at] = k
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 15 hex digits of the md5 of its text; null keys hash as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots).cast("int")


def table_frame(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill_table(shards, slots))), "_slot int, _shard int")


def assign_shards(docs: DataFrame, shards: list[str], slots: int, key: str = "doc_id") -> DataFrame:
    """`docs` with slot and shard (its index in `shards`), by a broadcast join on the slot.

    Columns of these names are replaced, others stay. Null keys share the slot of the empty text,
    repeated rows share theirs; an empty table gives no rows. Nothing is shuffled.
    """
    table = F.broadcast(table_frame(docs.sparkSession, shards, slots))
    rows = docs.drop("slot", "shard").select(F.struct("*").alias("_doc"), slot_of(F.col(key), slots).alias("_at"))
    return rows.join(table, F.col("_at") == F.col("_slot")).select(
        "_doc.*", F.col("_at").alias("slot"), F.col("_shard").alias("shard")
    )


def write_shards(docs: DataFrame, shards: list[str], slots: int, path: str, key: str = "doc_id", files: int = 1) -> None:
    """One folder per shard, of `files` files each: rows of a shard are dealt by slot and hash."""
    placed = assign_shards(docs, shards, slots, key)
    salt = F.pmod(F.xxhash64(key), F.lit(files))
    placed.repartition(len(shards) * files, "shard", salt).write.partitionBy("shard").mode("overwrite").parquet(path)
