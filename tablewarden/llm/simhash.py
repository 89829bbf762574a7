"""SimHash near-duplicates by pigeonhole blocks.

Two fingerprints that differ in at most `bits` of 64 bits agree in all but `bits` of the blocks they
are cut into. A key is a choice of blocks left after leaving out `bits` of them, so close pairs
share a key. Rows with equal keys meet, and their Hamming distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tablewarden.llm.common import as_bytes, give_back, slices
from tablewarden.llm.components import components
from tablewarden.session import ship_package, stage

SEED = 42
# Fingerprints of one key that meet at once; a key with more is dealt out as pairs of parts.
PART = 512


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hash_of = xxhash.xxh64_intdigest
    h = np.array([hash_of(g, SEED) for g in grams], "<u8")
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(h), 255):
        bits = np.unpackbits(h[k : k + 255].view(np.uint8), bitorder="little").reshape(-1, 64)
        set_bits += bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def fingerprint_column(text: str, shingle: int = 3):
    """64-bit fingerprint as a long. Only A-Z are lowered; words end at ASCII white space."""

    @arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [fingerprint(t, shingle) for part in slices(texts, texts) for t in as_bytes(part)]
            yield pa.array(np.array(found, np.uint64).view(np.int64))
        give_back()

    return of(text)


def blocks_for(fingerprints: int, bits: int) -> int:
    """Blocks to cut into: so many that keys of unrelated fingerprints are rarely equal.

    A key has about 64 * (blocks - bits) / blocks bits; more blocks make longer keys and more of
    them. This chooses a plan, not a result.
    """
    blocks = bits + 2
    while 64 * (blocks - bits) // blocks < max(20, int(fingerprints).bit_length() + 2) and blocks < bits + 5:
        blocks += 1
    return blocks


def block_keys(fp: str, blocks: int, bits: int):
    """Array of (which blocks, their bits), one for each choice of the blocks that must agree."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    keys = []
    for k, left in enumerate(combinations(masks, blocks - bits)):
        mask = sum(left)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(k).alias("k"), F.col(fp).bitwiseAND(F.lit(signed)).alias("b")))
    return F.array(*keys)


def _forest(node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of `node` that tie together what all its links tie together, one per node at most."""
    label = np.arange(len(node))
    for k in range(0, len(node), 256):
        far = np.bitwise_count(node[k : k + 256, None] ^ node[None, :])
        i, j = np.nonzero(far <= bits)
        i = i + k
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    tied = np.flatnonzero(label != np.arange(len(node)))
    return node[tied], node[label[tied]]


def _links(bits: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; a unit that runs on into the next batch waits for the rest."""
        waiting: list[np.ndarray] = []

        def done(rows: np.ndarray):
            cuts = np.flatnonzero(np.any(rows[1:, :4] != rows[:-1, :4], axis=1)) + 1
            a, b = [], []
            for unit in np.split(rows, cuts):
                if len(unit) > 1:
                    x, y = _forest(np.unique(unit[:, 4]).view(np.uint64), bits)
                    a.append(x)
                    b.append(y)
            if a:
                a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = np.stack([np.asarray(c, np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            rows = np.concatenate([*waiting, rows])
            last = int(np.flatnonzero(np.any(rows[:, :4] != rows[-1, :4], axis=1))[-1] + 1) if np.any(rows[0, :4] != rows[-1, :4]) else 0
            waiting = [rows[last:]]
            if last:
                yield from done(rows[:last])
        if waiting:
            yield from done(waiting[0])

    return links


def close_fingerprints(prints: DataFrame, bits: int = 3, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that connect whatever links at `bits` or fewer bits connect.

    `prints` has distinct fingerprints in `fp`. Keys that one fingerprint has alone are dropped by
    count. A key with many fingerprints is cut into parts by a hash, and each pair of parts is a unit
    of work of bounded size; a unit returns a spanning forest of its links, never all pairs.
    """
    ship_package(prints.sparkSession)
    blocks = blocks or blocks_for(prints.count(), bits)
    keyed = prints.select("fp", F.explode(block_keys("fp", blocks, bits)).alias("key")).select("fp", "key.*")
    sizes = stage(keyed.groupBy("k", "b").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
    parts = F.ceil(F.col("n") / PART).cast("int")
    meet = (
        keyed.join(sizes, ["k", "b"])
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("k", "b", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp")
    )
    units = meet.repartition("k", "b", "p", "q").sortWithinPartitions("k", "b", "p", "q")
    as_long = units.select(*[F.col(c).cast("long") for c in ("k", "b", "p", "q", "fp")])
    return as_long.mapInArrow(_links(bits), "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, bits: int = 3, blocks: int | None = None) -> DataFrame:
    """`fp`, `root` (one fingerprint for each group) and `component` (smallest id of the group, null if all its ids are) by fingerprint.

    Works on distinct fingerprints, so exact copies cost nothing after the first aggregate. Texts
    without words have fingerprint zero and link like others; repeated rows and rows with null ids
    share the group of their text; an empty table gives no rows.
    """
    prints = stage(docs.groupBy("_fp").agg(F.min("_id").alias("first")).select(F.col("_fp").alias("fp"), "first"), "prints")
    linked = components(close_fingerprints(prints.select("fp"), bits, blocks))
    rooted = stage(
        prints.join(linked, prints.fp == linked.node, "left").select(
            "fp", "first", F.coalesce("component", "fp").alias("root")
        ),
        "rooted",
    )
    least = stage(rooted.groupBy("root").agg(F.min("first").alias("component")), "least")
    return stage(rooted.join(least, "root").select("fp", "root", "component"), "groups")


def fingerprinted(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(_id, _fp, _text_hash) of every row, written down: texts are read and hashed once."""
    ship_package(docs.sparkSession)
    return stage(
        docs.select(
            F.col("doc_id").alias("_id"),
            fingerprint_column("text", shingle).alias("_fp"),
            F.xxhash64("text").alias("_text_hash"),
        ),
        "fingerprints",
    )


def simhash_dedup(docs: DataFrame, shingle: int = 3, bits: int = 3, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of `docs`."""
    rows = fingerprinted(docs, shingle)
    groups = simhash_groups(rows, shingle, bits, blocks)
    return rows.join(groups, rows._fp == groups.fp).select(
        F.col("_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_first(docs: DataFrame, shingle: int = 3, bits: int = 3, blocks: int | None = None) -> DataFrame:
    """One row of each group, with its columns: the smallest id, then the smallest text hash.

    Rows with null ids come last in their group. Rows alike in id and text are one document, and one
    of them stays.
    """
    rows = fingerprinted(docs, shingle)
    return first_rows(docs, rows, simhash_groups(rows, shingle, bits, blocks))


def first_rows(docs: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """What keep_first keeps of `docs`: `rows` are (_id, _fp, _text_hash) of them, `groups` (fp, root)."""
    order = F.struct(F.col("_id").isNull().alias("last"), "_id", "_text_hash")
    firsts = (
        rows.join(groups, rows._fp == groups.fp)
        .select("root", order.alias("o"))
        .groupBy("root")
        .agg(F.min("o").alias("o"))
    )
    firsts = stage(firsts.select(F.col("o._id").alias("_keep"), F.col("o._text_hash").alias("_keep_hash")), "firsts")
    marked = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    kept = marked.join(firsts, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_hash") == F.col("_keep_hash")), "left_semi")
    alike = rows.groupBy("_id", "_text_hash").count().where("count > 1")
    if not alike.join(firsts, alike._id.eqNullSafe(firsts._keep) & (alike._text_hash == firsts._keep_hash), "left_semi").isEmpty():
        kept = kept.dropDuplicates(["_id", "_hash"])
    return kept.select("_row.*")
