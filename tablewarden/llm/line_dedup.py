"""Line dedup by deletion neighbourhoods.

Two lines are within one edit if they are equal, if they become equal when each loses the character
at the same place, or if one becomes the other by losing one. So each line emits hashed keys: itself,
itself without each character, and the same with the gap's place kept. Lines with equal keys meet at
the earliest of them, and the edit distance of both texts is verified.

Lines that no other line can be near to emit nothing: cut into parts, a line shares all parts but
one with any line within one edit, so a first pass with a few hashes per line finds those that do.
It also tells in which part the gap must lie, so that only places in such parts emit a key.

A line is known by 128 bits of XXH3. Keys of lines with gaps are sums of powers, which hold for every
place at once; they only say which texts to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import pieces, slices, spans, tidied
from tablewarden.llm.rolling import Rolling, mix
from tablewarden.session import ship_package, stage

PARTS = 4
# Characters that a task hashes at once.
HELD = 1 << 18
# Rows up to which a stage table of known size is broadcast; they are of a few numbers each.
BROADCAST_ROWS = 100_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, and where each starts."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4"), spans(np.array([len(t) for t in texts], np.int64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _line_rows(edits: int, least_chars: int):
    """Per document row: its lines with words as (line, h1, h2, near_keys)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, b.column(2), HELD)):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for low, high in pieces(texts, len, HELD):
                codes, starts = _codes(texts[low:high])
                if not len(codes):
                    continue
                docs = np.searchsorted(starts, np.flatnonzero(codes == 10), side="right") - 1
                ends = np.concatenate([np.flatnonzero(codes == 10), starts[1:]])
                owner = np.concatenate([docs, np.arange(high - low)])
                # A text's end is the place of a line break that begins the next text: order by text first.
                order = np.lexsort((ends, owner))
                ends, owner = ends[order], owner[order]
                first = np.concatenate([[True], owner[1:] != owner[:-1]])
                begins = np.where(first, starts[owner], np.concatenate([[0], ends[:-1] + 1]))
                number = np.arange(len(ends)) - np.maximum.accumulate(np.where(first, np.arange(len(ends)), 0))
                blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
                inked = np.concatenate([[0], np.cumsum(~blank)])
                on = inked[ends] > inked[begins]
                begins, ends, owner, number = begins[on], ends[on], owner[on], number[on]
                digests = b"".join(xxhash.xxh3_128_digest(x) for t in texts[low:high] for x in t.encode().split(b"\n"))
                names = np.frombuffer(digests, "<i8").reshape(-1, 2)[on]
                keys = _part_keys(Rolling(codes), begins, ends) if edits else np.zeros((len(begins), 0), np.uint64)
                long = ends - begins >= max(1, least_chars)
                offsets = np.concatenate([[0], np.cumsum(np.where(long, keys.shape[1], 0))]).astype(np.int32)
                at = pa.array(owner + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(number.astype(np.int32)),
                        pa.array(np.ascontiguousarray(names[:, 0])),
                        pa.array(np.ascontiguousarray(names[:, 1])),
                        pa.ListArray.from_arrays(pa.array(offsets), _signed(keys[long].reshape(-1))),
                    ],
                    ["_id", "_hash", "line", "h1", "h2", "keys"],
                )

    return rows


def _part_keys(hashes: Rolling, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each line and each part left out, the hash of the rest; parts are those of the shorter
    line of a pair, which has the line's length or one less."""
    keys = []
    size = ends - begins
    for m in (size, size - 1):
        for k in range(PARTS):
            head = hashes.of(begins, begins + m * k // PARTS)
            tail = hashes.of(ends - (m - m * (k + 1) // PARTS), ends)
            keys.append(mix(mix(head + np.uint64(k)) + tail * np.uint64(3) + m.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.stack(keys, axis=1)


def _gaps(mask: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a gap can be, from the parts left out that a line shares with another: to lose the
    character that one of its length has changed, and to become a line that is one shorter."""
    changed, lost = np.zeros(len(place), bool), np.zeros(len(place), bool)
    for k in range(PARTS):
        low, high = size * k // PARTS, size * (k + 1) // PARTS
        changed |= (mask >> k & 1 == 1) & (place >= low) & (place < high)
        low, high = (size - 1) * k // PARTS, (size - 1) * (k + 1) // PARTS
        lost |= (mask >> (PARTS + k) & 1 == 1) & (place >= low) & (place <= high)
    return changed, lost


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed keys of each line: whole, without a character, and the same with the gap's place."""
    for batch in (part for b in batches for part in slices(b, b.column(2), HELD // 4)):
        texts, masks = batch.column(2).to_pylist(), batch.column(3).to_numpy()
        for low, high in pieces(texts, len, HELD // 4):
            codes, starts = _codes(texts[low:high])
            owner = np.repeat(np.arange(high - low), np.diff(starts))
            at = np.arange(len(codes))
            a, b = starts[:-1][owner], starts[1:][owner]
            changed, lost = _gaps(masks[low:high][owner], at - a, b - a)
            either = changed | lost
            at, a, b, owner, changed, lost = (x[either] for x in (at, a, b, owner, changed, lost))
            out = []
            for h, salt in ((Rolling(codes), np.uint64(1)), (Rolling(codes, 1), np.uint64(5))):
                # A polynomial hash of head and tail joined: the tail moves up by the head's length.
                shift = h.inverse[a] * h.powers[at]
                cut = h.of(a, at) + h.of(at + 1, b) * shift
                place = (at - a).astype(np.uint64)
                size = (b - a).astype(np.uint64)
                whole = mix(h.of(starts[:-1], starts[1:]) + np.diff(starts).astype(np.uint64) * salt)
                gone = mix(cut + (size - np.uint64(1)) * salt)
                gap = mix(gone ^ mix(place + np.uint64(77) * salt))
                out.append(np.concatenate([whole, gone[lost], gap[changed]]))
            kind = np.repeat(np.array([0, 1, 2], np.int8), [high - low, lost.sum(), changed.sum()])
            who = pa.array(np.concatenate([np.arange(high - low), owner[lost], owner[changed]]) + low)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(who), batch.column(1).take(who), pa.array(kind), _signed(out[0]), _signed(out[1])],
                ["h1", "h2", "kind", "k1", "k2"],
            )


def line_table(docs: DataFrame, edits: int, least_chars: int) -> DataFrame:
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text"))
    return rows.mapInArrow(
        tidied(_line_rows(edits, least_chars)),
        f"_id {kind}, _hash long, line int, h1 long, h2 long, keys array<long>",
    )


def _first(prefix: str = ""):
    """Order of occurrences: by id, null last, then the text's hash, then the line."""
    return F.struct(F.col("_id").isNull().alias("last"), "_id", "_hash", "line")


def dropped_lines(docs: DataFrame, edits: int = 1, least_chars: int = 20) -> DataFrame:
    """_id, _hash (of the text) and line number of every line to drop.

    A line goes if an equal line, or one of another text within `edits` (0 or 1) edits, occurs
    earlier, whether that one stays itself or not. Lines without words stay. Lines of fewer than
    `least_chars` characters are compared for equality only: in a short line one letter is another
    word. Equality is that of 128-bit hashes; an edit distance is verified on the texts. Memory is
    about 60 bytes for each character of the longest text, or of HELD characters.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    lines = stage(line_table(docs, edits, least_chars), "lines")
    firsts = stage(lines.groupBy("h1", "h2").agg(F.min(_first()).alias("first"), F.count("*").alias("n")), "firsts")
    again = firsts.where("n > 1").select("h1", "h2", "first", F.lit(False).alias("near"))
    if edits:
        near = stage(_near_lines(docs, lines, firsts), "near")
        again = (
            again.join(near.withColumn("_near", F.lit(True)), ["h1", "h2"], "full")
            .select("h1", "h2", "first", F.coalesce("_near", F.lit(False)).alias("near"))
        )
    again = stage(again, "again")
    return lines.join(again, ["h1", "h2"]).where(F.col("near") | (_first() != F.col("first"))).select("_id", "_hash", "line")


def _near_lines(docs: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2) of lines with an earlier line of another text within one edit."""
    keyed = lines.where(F.size("keys") > 0).select("h1", "h2", F.posexplode("keys").alias("part", "key"))
    shared = stage(
        keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("key"), "shared"
    )
    wanted = keyed.join(shared, "key", "left_semi").groupBy("h1", "h2").agg(F.bit_or(F.expr("shiftleft(1, part)")).alias("mask"))
    wanted = stage(wanted.join(firsts, ["h1", "h2"]).select("h1", "h2", "mask", "first"), "wanted")
    n = wanted.count()
    # Texts of the lines, from their first occurrences.
    places = stage(
        wanted.groupBy("first._id", "first._hash").agg(F.collect_list(F.struct("h1", "h2", "mask", F.col("first.line").alias("line"))).alias("at")),
        "places",
    )
    places = places.select(F.col("_id").alias("_in"), F.col("_hash").alias("_in_hash"), "at")
    if n <= BROADCAST_ROWS:
        places = F.broadcast(places)
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.split("text", "\n").alias("all"))
    found = rows.join(places, F.col("_id").eqNullSafe(F.col("_in")) & (F.col("_hash") == F.col("_in_hash")))
    texts = (
        found.select("all", F.explode("at").alias("p"))
        .select("p.h1", "p.h2", "p.mask", F.get("all", F.col("p.line")).alias("text"))
        # Rows alike in id and text are one document.
        .dropDuplicates(["h1", "h2"])
    )
    texts = stage(texts, "texts")
    variants = texts.select("h1", "h2", "text", "mask").mapInArrow(tidied(_variants), "h1 long, h2 long, kind byte, k1 long, k2 long")
    variants = variants.join(wanted.drop("mask"), ["h1", "h2"]).select(
        "k1", "k2", "kind", (F.col("kind") == 0).alias("whole"), F.struct("first", "h1", "h2").alias("o")
    )
    # Gap keys hold lines that differ in one letter; other keys hold one whole line and longer ones.
    met = variants.groupBy("k1", "k2").agg(
        F.min("o").alias("least"),
        F.min(F.when(F.col("whole"), F.col("o"))).alias("short"),
        F.count("*").alias("n"),
    )
    met = stage(met.where("n > 1"), "met")
    joined = variants.join(met, ["k1", "k2"])
    # Longer lines of a key are each within one edit of the whole one, but not of each other: they
    # meet that one, and it meets the earliest of them. Without a whole line they meet by gap keys.
    hub = (
        F.when(F.col("whole") | (F.col("kind") == 2), F.col("least"))
        .otherwise(F.col("short"))
    )
    pairs = joined.select("o", hub.alias("hub")).where("hub < o").select(
        F.col("o.h1").alias("h1"), F.col("o.h2").alias("h2"), F.col("hub.h1").alias("g1"), F.col("hub.h2").alias("g2")
    )
    other = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("text").alias("hub_text"))
    checked = pairs.distinct().join(texts.drop("mask"), ["h1", "h2"]).join(other, ["g1", "g2"])
    return checked.where(F.levenshtein("text", "hub_text", 1) >= 0).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, edits: int = 1, least_chars: int = 20) -> DataFrame:
    """`docs` with lines dropped from their texts, and _n_lines and _n_dropped.

    The text of a document that loses all its lines is empty; null texts stay null. Rows alike in id
    and text count as one document and all keep the same lines. Other columns stay as they are; an
    empty table gives no rows.
    """
    drops = (
        dropped_lines(docs, edits, least_chars)
        .distinct()
        .groupBy(F.col("_id").alias("_in"), F.col("_hash").alias("_in_hash"))
        .agg(F.collect_list("line").alias("_drop"))
    )
    drops = stage(drops, "drops")
    own = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"),
        F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_hash"),
        F.col("text").alias("_text"),
    )
    same = F.col("_id").eqNullSafe(F.col("_in")) & (F.col("_hash") == F.col("_in_hash"))
    joined = rows.join(drops, same, "left").withColumn("_lines", F.split("_text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    left = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    )
    return joined.select(
        *[(left.alias("text") if c == "text" else F.col(f"_doc.`{c}`").alias(c)) for c in own],
        F.coalesce(F.when(F.col("_text").isNotNull(), F.size("_lines")), F.lit(0)).cast("long").alias("_n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_n_dropped"),
    )
