"""Removal of long repeated substrings, by blockwise suffix sorting with a difference cover.

What is asked of every suffix is whether an earlier one has the same first `length` bytes. Suffixes are
dealt into buckets: each window of `length` bytes has an anchor, its smallest hashed gram, which equal
windows share. Most anchors occur once, and no window of theirs repeats. Of the others, stretches of
windows that are equal as a whole are settled by their hash; where an anchor has different
stretches, its bucket of suffixes is sorted, in blocks of bounded size.

In a block, positions whose remainder is in a difference cover are ranked first, by as many bytes as
every window is sure to have from there. Two windows then are equal if and only if, at a place that
both reach in the cover, ranks are equal, and the few bytes before and after are. So long ties are
settled by one rank, and no suffix is compared over its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import as_bytes, pieces, slices, spans
from tablewarden.llm.rolling import Rolling, mix
from tablewarden.session import ship_package, stage

# Differences of members meet every remainder modulo 13.
PERIOD, COVER = 13, np.array([0, 1, 3, 9])
GRAM = 24
# Bytes of text hashed at once; bytes of the stretches sorted at once; windows of one bucket beyond
# which it is dealt out by what the windows of STEP neighbouring places have in common.
CHUNK, BLOCK, BUCKET, STEP = 1 << 18, 1 << 19, 1 << 13, 8


def _runs(codes: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """Stretches of consecutive windows with one anchor.

    `starts` bound the texts in `codes`. Returns arrays: first window of the stretch, number of
    windows, place of the anchor, and hashes of the anchor and of the stretch.
    """
    hashes = Rolling(codes)
    span = length - gram + 1
    if len(codes) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = mix(hashes.grams(gram))
    # The leftmost gram of the smallest hash: low bits, always as many, are traded for the place.
    bits = np.uint64(2 * CHUNK - 1)
    packed = (grams & ~bits) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    if width < span:
        packed = np.minimum(packed[: len(packed) - (span - width)], packed[span - width :])
    anchor = (packed & bits).astype(np.int64)
    n = len(anchor)
    owner_ends = starts[1:]
    valid = np.zeros(n + 1, np.int64)
    long = np.diff(starts) >= length
    np.add.at(valid, np.minimum(starts[:-1][long], n), 1)
    np.add.at(valid, np.minimum(owner_ends[long] - length + 1, n), -1)
    valid = np.cumsum(valid[:-1]) > 0
    begins = valid & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]])
    first = np.flatnonzero(begins)
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    number = np.add.reduceat(valid.astype(np.int64), first)
    place = anchor[first]
    whole = mix(hashes.of(first, first + number + length - 1) ^ mix((number << 32 | (place - first)).astype(np.uint64)))
    return first, number, place, grams[place], whole


def _stretches(length: int, gram: int):
    """Stretches of every text; of those equal within what is hashed at once only the earliest.

    Rows (anchor, whole, _id, _hash, start, number); later equal ones carry a null anchor: they are
    removed whatever else is found.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, b.column(2), 2 * CHUNK)):
            texts = as_bytes(batch.column(2))
            hashes = np.asarray(batch.column(1), np.int64)
            # Long texts in slices that overlap by a window less one byte.
            parts = [(i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - length + 1), CHUNK)]
            size = lambda p: min(CHUNK + length - 1, len(texts[p[0]]) - p[1])
            for low, high in pieces(parts, size, CHUNK):
                some = parts[low:high]
                cut = [texts[i][a : a + size((i, a))] for i, a in some]
                codes = np.frombuffer(b"".join(cut), np.uint8)
                starts = spans(np.array([len(c) for c in cut], np.int64))
                first, number, _, anchor, whole = _runs(codes, starts, length, gram)
                if not len(first):
                    continue
                part = np.searchsorted(starts, first, side="right") - 1
                doc = np.array([i for i, _ in some])[part]
                start = first - starts[part] + np.array([a for _, a in some])[part]
                ids = batch.column(0).take(pa.array(doc))
                rank = _ranks(ids)
                order = np.lexsort((start, hashes[doc], rank, whole, anchor))
                same = (anchor[order][1:] == anchor[order][:-1]) & (whole[order][1:] == whole[order][:-1])
                again, twice = np.zeros(len(first), bool), np.zeros(len(first), bool)
                again[order[1:][same]] = True
                # Rows alike in id and text are one document.
                alike = [x[order][1:] == x[order][:-1] for x in (rank, hashes[doc], start)]
                twice[order[1:][same & alike[0] & alike[1] & alike[2]]] = True
                batch_out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64), mask=again),
                        pa.array(whole.view(np.int64)),
                        ids,
                        pa.array(hashes[doc]),
                        pa.array(start),
                        pa.array(number.astype(np.int16)),
                    ],
                    ["anchor", "whole", "_id", "_hash", "start", "number"],
                )
                yield batch_out.filter(pa.array(~twice)) if twice.any() else batch_out

    return rows


def _ranks(ids: pa.Array) -> np.ndarray:
    """Order of ids, null last."""
    return np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense"), np.int64)


def _words(codes: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """`count` bytes from each place as rows of 8-byte numbers, the last one cut to size."""
    columns = []
    for k in range(0, count, 8):
        n = min(8, count - k)
        x = np.zeros(len(at), np.uint64)
        for j in range(n):
            x = (x << np.uint64(8)) | codes[at + (k + j)]
        columns.append(x)
    return np.stack(columns, axis=1)


def _dense(columns: np.ndarray) -> np.ndarray:
    """Equal rows get equal numbers, in the order of the rows."""
    order = np.lexsort(columns.T[::-1])
    moved = columns[order]
    new = np.concatenate([[False], np.any(moved[1:] != moved[:-1], axis=1)])
    out = np.empty(len(columns), np.int64)
    out[order] = np.cumsum(new)
    return out


def earlier_windows(codes: np.ndarray, windows: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether a window has an equal one of smaller `order`.

    `windows` are places in `codes`, each with `length` bytes; of equal ones that tie, none counts.
    """
    reach = length - (PERIOD - 1)
    covered = np.zeros(PERIOD, bool)
    covered[COVER] = True
    # Cover samples that some window needs, ranked by the bytes all windows have from there.
    offsets = np.arange(PERIOD)
    hits = covered[(windows[:, None] + offsets) % PERIOD]
    sample = np.zeros(len(codes) + PERIOD, bool)
    sample[(windows[:, None] + offsets)[hits]] = True
    places = np.flatnonzero(sample)
    rank = np.zeros(len(sample), np.int64)
    rank[places] = _dense(_words(codes, places, reach))
    found = np.zeros(len(windows), bool)
    for d in range(PERIOD):
        here = np.flatnonzero(hits[:, d])
        if not len(here):
            continue
        w = windows[here]
        key = [rank[w + d][:, None].astype(np.uint64)]
        if d:
            key.append(_words(codes, w, d))
        if PERIOD - 1 - d:
            key.append(_words(codes, w + d + reach, PERIOD - 1 - d))
        group = _dense(np.concatenate(key, axis=1))
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, order[here])
        found[here] |= order[here] > least[group]
    return found


def _sort_blocks(length: int):
    """Rows come sorted by bucket; whole buckets fill a block. Returns the bytes to remove."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(block: pa.Table) -> pa.RecordBatch:
            texts = block["text"].to_pylist()
            starts = spans(np.array([len(t) for t in texts], np.int64))
            codes = np.frombuffer(b"".join(texts), np.uint8)
            number = np.asarray(block["number"], np.int64)
            within = np.arange(number.sum()) - np.repeat(spans(number)[:-1], number)
            windows = np.repeat(starts[:-1], number) + within
            # Order of the windows: document, then place.
            doc = np.lexsort((np.asarray(block["_hash"]), _ranks(block["_id"].combine_chunks())))
            ids, hashes = _ranks(block["_id"].combine_chunks()), np.asarray(block["_hash"])
            step = (ids[doc][1:] != ids[doc][:-1]) | (hashes[doc][1:] != hashes[doc][:-1])
            rank = np.empty(len(doc), np.int64)
            rank[doc] = np.concatenate([[0], np.cumsum(step)])
            at = np.repeat(np.asarray(block["start"], np.int64), number) + within
            order = _dense(np.stack([np.repeat(rank, number), at], axis=1))
            gone = np.flatnonzero(earlier_windows(codes, windows, order, length))
            row = np.repeat(np.arange(len(texts)), number)[gone]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (gone[1:] != gone[:-1] + 1)]) if len(gone) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(gone)]]) - 1 if len(first) else first
            who = pa.array(row[first])
            return pa.RecordBatch.from_arrays(
                [
                    block["_id"].combine_chunks().take(who),
                    block["_hash"].combine_chunks().take(who),
                    pa.array(at[gone[first]]),
                    pa.array(at[gone[last]] + length),
                ],
                ["_id", "_hash", "low", "high"],
            )

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            bucket = np.stack([np.asarray(table["anchor"]), np.asarray(table["part"])], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero(np.any(bucket[1:] != bucket[:-1], axis=1)) + 1])
            weights = np.add.reduceat(np.asarray(pc.binary_length(table["text"]), np.int64), cuts)
            # The last bucket may go on in the next batch.
            done = 0
            for a, b in pieces(weights[:-1].tolist(), int, BLOCK):
                yield settle(table.slice(cuts[a], cuts[b] - cuts[a]))
                done = cuts[b]
            held = table.slice(done).combine_chunks().to_batches()
        if held:
            yield settle(pa.Table.from_batches(held))

    return rows


def _deal_large(length: int, gram: int):
    """Stretches of large buckets, cut where a window's distance to its anchor passes a multiple of STEP.

    Windows of one piece share all but a few bytes, whose hash is the new part of the bucket: equal
    windows have it in common. Of pieces of a batch that are equal as a whole only the earliest goes
    on; the others are gone.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, b.column(5), CHUNK)):
            all_texts = batch.column(5).to_pylist()
            for low, high in pieces(all_texts, len, CHUNK):
                texts, some = all_texts[low:high], batch.slice(low, high - low)
                starts = spans(np.array([len(t) for t in texts], np.int64))
                codes = np.frombuffer(b"".join(texts), np.uint8)
                number = np.asarray(some.column(4), np.int64)
                # Each text is one stretch, so it has one anchor.
                place = _runs(codes, starts, length, gram)[2]
                row = np.repeat(np.arange(len(texts)), number)
                within = np.arange(number.sum()) - np.repeat(spans(number)[:-1], number)
                group = (place[row] - starts[row] - within) // STEP
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (group[1:] != group[:-1])]))
                count = np.diff(np.concatenate([first, [len(row)]]))
                row, group, within = row[first], group[first], within[first]
                begin = starts[row] + within
                core = place[row] - group * STEP
                hashes = Rolling(codes)
                part = mix(hashes.of(core, core + length - STEP + 1) + group.astype(np.uint64))
                whole = mix(hashes.of(begin, begin + count + length - 1) ^ mix((count << 32 | (core - begin + STEP)).astype(np.uint64)))
                at = pa.array(row)
                ids, doc = some.column(1).take(at), np.asarray(some.column(2), np.int64)[row]
                start = np.asarray(some.column(3), np.int64)[row] + within
                anchor = np.asarray(some.column(0), np.int64)[row]
                rank = _ranks(ids)
                order = np.lexsort((start, doc, rank, whole, part, anchor))
                same, twin = np.ones(len(row) - 1, bool), np.ones(len(row) - 1, bool)
                for x in (whole, part, anchor):
                    same &= x[order][1:] == x[order][:-1]
                for x in (start, doc, rank):
                    twin &= x[order][1:] == x[order][:-1]
                gone = np.zeros(len(row), bool)
                gone[order[1:][same]] = True
                stay = np.ones(len(row), bool)
                stay[order[1:][same & twin]] = False
                text = [None if g else texts[r][w : w + c + length - 1] for g, r, w, c in zip(gone.tolist(), row.tolist(), within.tolist(), count.tolist())]
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor), _signed(part), ids, pa.array(doc), pa.array(start),
                        pa.array(count.astype(np.int16)), pa.array(text, pa.binary()), pa.array(gone),
                    ],
                    ["anchor", "part", "_id", "_hash", "start", "number", "text", "gone"],
                )
                yield out.filter(pa.array(stay))

    return rows


def _single_windows(pieces_: DataFrame, length: int) -> DataFrame:
    """Spans of the windows of `pieces_` that also start earlier: windows meet by their bytes.

    Equal windows have equal anchors and parts, so none has an equal one in another bucket. The
    earliest of each is an aggregate, so a bucket may be of any size.
    """
    each = pieces_.withColumn("w", F.explode(F.sequence(F.lit(0), F.col("number").cast("int") - 1)))
    start = F.col("start") + F.col("w")
    windows = stage(
        each.select(
            F.substring("text", F.col("w") + 1, F.lit(length)).alias("window"),
            F.struct(F.col("_id").isNull().alias("last"), "_id", "_hash", start.alias("start")).alias("o"),
        ),
        "windows",
    )
    firsts = windows.groupBy("window").agg(F.min("o").alias("first"), F.max("o").alias("end"))
    firsts = stage(firsts.where("first != end").select("window", "first"), "firsts")
    later = windows.join(firsts, "window").where("o != first")
    return later.select("o._id", "o._hash", F.col("o.start").alias("low"), (F.col("o.start") + length).alias("high"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _cut_out(docs: DataFrame, wanted: DataFrame, length: int, text: str = "_text") -> DataFrame:
    """Bytes of stretches: `wanted` rows (_id, _hash, start, number, ...) joined with their texts."""
    w = wanted.withColumnRenamed("_id", "_in").withColumnRenamed("_hash", "_in_hash")
    rows = docs.join(w, F.col("_id").eqNullSafe(F.col("_in")) & (F.col("_hash") == F.col("_in_hash")))
    return rows.withColumn(
        "text", F.substring(F.col(text).cast("binary"), F.col("start").cast("int") + 1, F.col("number") + length - 1)
    ).drop("_in", "_in_hash", text)


def _found(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Each stretch whose anchor occurs again: whether it is settled, and what it needs otherwise."""
    ship_package(docs.sparkSession)
    kind = docs.schema["_id"].dataType.simpleString()
    schema = f"anchor long, whole long, _id {kind}, _hash long, start long, number short"
    runs = docs.select("_id", "_hash", "_text").mapInArrow(_stretches(length, gram), schema)
    place = F.coalesce("anchor", F.xxhash64("_id", "_hash", "start"))
    dealt = runs.repartition(place).sortWithinPartitions(
        "anchor", "whole", F.col("_id").isNull(), "_id", "_hash", "start"
    )
    return dealt.mapInArrow(
        _settle_equal, f"anchor long, _id {kind}, _hash long, start long, number short, gone boolean"
    )


def _settle_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, stretch and order. The first of equal stretches stands for them.

    Returns later ones as gone, and first ones if their anchor has another stretch. A bucket may be
    of any size: what is remembered between batches is its last row and whether it was returned.
    """
    carry: pa.RecordBatch | None = None  # one first row whose anchor has no other stretch so far
    before: tuple | None = None  # anchor and stretch of the last row
    shown = False  # whether the anchor of the last row is known to have two stretches
    for batch in batches:
        if not batch.num_rows:
            continue
        null = np.asarray(batch.column(0).is_null())
        anchor = np.asarray(batch.column(0).fill_null(0), np.int64)
        whole = np.asarray(batch.column(1), np.int64)
        n = len(anchor)
        prior_a = np.concatenate([[before[0] if before else 0], anchor[:-1]])
        prior_w = np.concatenate([[before[1] if before else 0], whole[:-1]])
        same_a = (anchor == prior_a) & ~null & ~np.concatenate([[before is None or before[2]], null[:-1]])
        equal = same_a & (whole == prior_w)
        first = ~null & ~equal
        # Rows alike in id and text are one document.
        place = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)]
        twin = np.ones(n, bool)
        for k, x in enumerate(place):
            twin &= np.concatenate([[before is not None and _same(before[3 + k], x[0])], _alike(x)])
        equal_twin = equal & twin
        # First rows whose anchor began before them, and those whose anchor goes on with another.
        later = first & same_a
        bucket = np.cumsum(~same_a)
        many = np.zeros(bucket[-1] + 1, bool)
        many[bucket[later]] = True
        if same_a[0] and shown:
            many[0] = True
        keep = first & many[bucket]
        out = []
        if carry is not None and same_a[0] and many[0]:
            out.append(carry)
        gone = null | (equal & ~equal_twin)
        pick = np.flatnonzero(keep | gone)
        parts = [batch.column(0), *batch.columns[2:]]
        names = ["anchor", "_id", "_hash", "start", "number", "gone"]
        taken = [c.take(pa.array(pick)) for c in parts]
        out.append(pa.RecordBatch.from_arrays([*taken, pa.array(gone[pick])], names))
        yield from (x for x in out if x.num_rows)
        if same_a[0] and bucket[-1] == 0:
            shown = bool(many[0])
            carry = None if shown else carry
        else:
            shown = bool(many[bucket[-1]]) and not null[-1]
            lone = np.flatnonzero(first & (bucket == bucket[-1]))
            carry = None
            if len(lone) and not shown:
                at = pa.array(lone[:1])
                carry = pa.RecordBatch.from_arrays([*[c.take(at) for c in parts], pa.array([False])], names)
        before = (int(anchor[-1]), int(whole[-1]), bool(null[-1]), *(x[-1] for x in place))


def _same(a, b) -> bool:
    """Equal, or both null."""
    return bool(a == b) or (a != a and b != b) or (a is None and b is None)


def _alike(x: np.ndarray) -> np.ndarray:
    same = x[1:] == x[:-1]
    if x.dtype.kind in "fO":
        missing = np.array([v is None or v != v for v in x])
        same = same | (missing[1:] & missing[:-1])
    return same.astype(bool)


def removed_spans(docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """(_id, _hash, low, high): bytes covered by a window of `length` bytes that also starts earlier.

    `docs` has _id, _hash (of the text) and _text. Spans may overlap. Earlier is a smaller id, null
    last, then a smaller hash of the text, then an earlier place; rows alike in id and text are one
    document. Shorter texts have no window. No span is left out, however often it occurs.
    """
    kind = docs.schema["_id"].dataType.simpleString()
    found = stage(_found(docs, length, gram), "stretches")
    settled = found.where("gone").select("_id", "_hash", F.col("start").alias("low"), (F.col("start") + F.col("number") + (length - 1)).alias("high"))
    open_ = found.where("NOT gone").drop("gone")
    large = stage(
        open_.groupBy("anchor").agg(F.sum("number").alias("n")).where(F.col("n") > BUCKET), "large"
    ).withColumnRenamed("anchor", "_a")
    wanted = open_.join(large, F.col("anchor") == F.col("_a"), "left").drop("_a")
    cut = _cut_out(docs, wanted, length)
    usual = cut.where("n IS NULL").select("anchor", F.lit(0).cast("long").alias("part"), "_id", "_hash", "start", "number", "text")
    dealt = cut.where("n IS NOT NULL").select("anchor", "_id", "_hash", "start", "number", "text")
    dealt = dealt.mapInArrow(
        _deal_large(length, gram),
        f"anchor long, part long, _id {kind}, _hash long, start long, number short, text binary, gone boolean",
    )
    dealt = stage(dealt, "dealt")
    settled = settled.union(
        dealt.where("gone").select("_id", "_hash", F.col("start").alias("low"), (F.col("start") + F.col("number") + (length - 1)).alias("high"))
    )
    left = dealt.where("NOT gone").drop("gone")
    still = stage(
        left.groupBy("anchor", "part").agg(F.sum("number").alias("n")).where(F.col("n") > BUCKET).drop("n"), "still"
    )
    if not still.isEmpty():
        settled = settled.union(_single_windows(left.join(still, ["anchor", "part"], "left_semi"), length))
        left = left.join(still, ["anchor", "part"], "left_anti")
    blocks = usual.union(left).repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    sorted_ = blocks.mapInArrow(_sort_blocks(length), f"_id {kind}, _hash long, low long, high long")
    return settled.union(sorted_)


def _merge(spans_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans_):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in slices(b, b.column(1))):
        out: list[list] = [[], [], [], [], []]
        texts = batch.column(1).to_pylist()
        for text, low, high in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            text = text or b""
            runs = _merge(list(zip(low or [], high or [])))
            ends = [0, *[x for run in runs for x in run], len(text)]
            left = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
            for column, x in zip(out, (len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left)):
                column.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def dedup_substrings(docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of every row.

    Null texts count as empty and lose nothing; repeated rows each get the result of their text; an
    empty table gives no rows; other columns are not read. What stays may not be valid UTF-8, as a
    span may begin or end inside a character.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"))
    merged = (
        removed_spans(texts, length, gram)
        .groupBy(F.col("_id").alias("_in"), F.col("_hash").alias("_in_hash"))
        .agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    )
    merged = stage(merged, "spans")
    joined = texts.join(merged, F.col("_id").eqNullSafe(F.col("_in")) & (F.col("_hash") == F.col("_in_hash")), "left")
    rows = joined.select("_id", F.col("_text").cast("binary").alias("text"), "low", "high")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _remaining, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
