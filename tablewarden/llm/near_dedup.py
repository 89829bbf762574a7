"""Near-duplicates by the Jaccard similarity of word shingles, exact by prefix filtering.

Put all shingles in one order, whatever it is. Two sets of similarity 4/5 or more then share one of
their first shingles: of n, the first n - ceil(4n/5) + 1. So these are the keys at which texts meet,
and the similarity of the pairs that met is verified on the words. The order puts shingles of
often-hit hash buckets last, so that a passage of very many texts is rarely a key.

A pair need only be found at the first key that it shares. There the shingles before the key are in one
of the two sets alone, so sets of n and m shingles, the key at places i and j, share n - i or m - j at
most, and need 4(n + m)/9: hence m <= (5n - 9i)/4 and n <= (5m - 9j)/4. In a pair the set that is not
the larger one has the key among its first ninth. Texts that share a passage and too little else for
a similarity of 4/5 have rarer shingles than the passage's in that ninth, and make no pairs.

Fingerprints of single bits cannot say as much: at similarity 4/5 two of them differ in about 15 of
100 bits, more than blocks that must agree can leave out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import as_bytes, slices, spans, tidied
from tablewarden.llm.components import components
from tablewarden.llm.rolling import Rolling, mix
from tablewarden.llm.simhash import fingerprinted, first_rows, simhash_groups
from tablewarden.session import ship_package, stage

# Buckets of shingle hashes that are counted, by their highest bits.
BUCKET_BITS = 16
# Bytes of text hashed at once, and of the texts of pairs verified at once.
HELD = 1 << 20
# Bytes of a word from which on it is hashed by itself.
LONG_WORD = 256
MET = ["key", "fp", "n", "most"]
MET_TYPE = ", ".join(f"{c} long" for c in MET)


def _shingles(texts: list[bytes], width: int, repeats: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of every text, sorted by text.

    Only A-Z are lowered; words end at ASCII white space. Texts of fewer words have one shingle of
    all their words, texts without words none. With `repeats` the second time that a shingle occurs
    in a text is another element, the third one yet another: sets then count shingles.
    """
    codes = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    starts = spans(np.array([len(t) + 1 for t in texts], np.int64))
    inked = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    change = np.flatnonzero(np.diff(np.concatenate([[False], inked, [False]]).astype(np.int8)))
    begins, ends = change[::2], change[1::2]
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = mix(Rolling(codes).of(begins, ends) + (ends - begins).astype(np.uint64))
    # A sum of powers modulo 2^64 is equal for some unequal words of 512 letters and more.
    for i in np.flatnonzero(ends - begins > LONG_WORD).tolist():
        word[i] = xxhash.xxh3_64_intdigest(codes[begins[i] : ends[i]].tobytes())
    text = np.searchsorted(starts, begins, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    count = np.diff(np.concatenate([first, [len(text)]]))
    left = np.repeat(first + count, count) - np.arange(len(text))
    size = np.minimum(np.repeat(count, count), width)
    at = np.flatnonzero(left >= size)
    owner = text[at]
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        on = size[at] > k
        h[on] = mix(h[on] * np.uint64(3) + word[at[on] + k])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    if repeats:
        again = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        return owner, np.where(new, h, mix(h + again.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return owner[new], h[new]


def _sets(owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and size of the set of every text; the empty set has 0 and 0."""
    size = np.bincount(owner, minlength=texts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    edge = spans(size)
    return np.where(size > 0, mix(sums[edge[1:]] - sums[edge[:-1]] + size.astype(np.uint64)), np.uint64(0)), size


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _read(width: int, repeats: bool):
    """(_id, _text_hash, fp, n) of every row, then (bucket, hits) of the shingles of the partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_text_hash", "fp", "n", "bucket", "hits"]
        hits = np.zeros(1 << BUCKET_BITS, np.int64)
        kind = None
        for batch in (part for b in batches for part in slices(b, b.column(2), HELD)):
            kind = batch.column(0).type
            owner, h = _shingles(as_bytes(batch.column(2)), width, repeats)
            fp, size = _sets(owner, h, batch.num_rows)
            hits += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(hits))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _signed(fp), pa.array(size), none.cast(pa.int32()), none], names
            )
        at = np.flatnonzero(hits)
        if len(at):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(at), kind), none, none, none, pa.array(at.astype(np.int32)), pa.array(hits[at])], names
            )

    return rows


def _prefixes(width: int, hits: np.ndarray, repeats: bool):
    """(key, fp, n, most): the first shingles of every text, those of the least hit buckets.

    `most` is the size of the largest set that can be alike and first shares this shingle. Where a
    second column names groups of texts, keys of different groups are different.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, b.column(0), HELD)):
            owner, h = _shingles(as_bytes(batch.column(0)), width, repeats)
            fp, size = _sets(owner, h, batch.num_rows)
            order = np.lexsort((h, hits[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], owner))
            place = np.arange(len(h)) - spans(size)[:-1][owner]
            on = place <= size[owner] - (4 * size[owner] + 4) // 5
            # Owners are sorted already, so only the hashes move.
            keys, who = h[order][on], owner[on]
            if batch.num_columns > 1:
                keys = mix(keys ^ mix(np.asarray(batch.column(1), np.int64).view(np.uint64))[who])
            most = (5 * size[who] - 9 * place[on]) // 4
            yield pa.RecordBatch.from_arrays([_signed(keys), _signed(fp[who]), pa.array(size[who]), pa.array(most)], MET)

    return rows


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and set; those of keys with two sets or more, each once."""
    held, names, met_before = None, None, False

    def out(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in rows.T], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(c, np.int64) for c in batch.columns], axis=1)
        names = batch.schema.names
        rows = rows if held is None else np.concatenate([held, rows])
        rows = rows[np.concatenate([[True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)])]
        same = rows[1:, 0] == rows[:-1, 0]
        met = np.concatenate([[met_before], same])
        yield out(rows[:-1][met[:-1] | same])
        held, met_before = rows[-1:], bool(met[-1])
    if met_before:
        yield out(held)


def _all_grams(text: bytes, width: int) -> Iterable[bytes]:
    words = text.lower().split()
    return map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) > width else [b" ".join(words)]


def _alike(width: int, repeats: bool):
    kind, size = (Counter, Counter.total) if repeats else (set, len)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, b.column(2), HELD)):
            hub, known = None, kind()
            stay = []
            for one, other in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                if one != hub:
                    hub, known = one, kind(_all_grams(one, width))
                grams = kind(_all_grams(other, width))
                stay.append(9 * size(known & grams) >= 4 * (size(known) + size(grams)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(stay))

    return rows


def _verified(pairs: DataFrame, texts: DataFrame, width: int, repeats: bool) -> DataFrame:
    one = texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    return stage(both.mapInArrow(tidied(_alike(width, repeats)), "a long, b long"), "alike")


def _fits(one: str, other: str):
    """Sets of these sizes can have a similarity of 4/5 if the key is the first that both have."""
    return (F.col(f"{one}.n") <= F.col(f"{other}.most")) & (F.col(f"{other}.n") <= F.col(f"{one}.most"))


def _left_apart(met: DataFrame) -> DataFrame:
    """(a, b) of sets of different roots that fit at a key; `met` has a column root beside those of MET.

    The smaller set of a pair, the one with the smaller fp where sizes are equal, has the key among its
    first ninth. Only such rows are paired, with sets of their band of sizes or the next; bands grow by
    4/3, so that sizes that fit are never two bands apart.
    """
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3)))
    row = F.struct("fp", "n", "most", "root")
    small = met.where("most >= n").select("key", row.alias("s"), F.explode(F.array(band, band + 1)).alias("band"))
    both = small.join(met.select("key", row.alias("l"), band.alias("band")), ["key", "band"])
    ordered = (F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.fp") < F.col("l.fp")))
    both = both.where((F.col("s.root") != F.col("l.root")) & ordered & _fits("s", "l"))
    return both.select(F.least("s.fp", "l.fp").alias("a"), F.greatest("s.fp", "l.fp").alias("b")).distinct()


def _tied_by(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets as pairs of what the sets are `known` as."""
    ends = [known.select(F.col("fp").alias(end), F.col("known").alias(f"known_{end}")) for end in ("a", "b")]
    return pairs.join(ends[0], "a").join(ends[1], "b").select(F.col("known_a").alias("a"), F.col("known_b").alias("b"))


def near_pairs(docs: DataFrame, rows: DataFrame, hits: np.ndarray, width: int, known: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of sets that tie together what all pairs of similarity 4/5 or more tie together.

    First each set of a key is compared with one of the key, another one for each key; then all pairs
    of a key that fit and that these have left apart are. No pair is left out, however many meet at a key.

    With `known` as (fp, known) only texts of the same `meet` of `docs` are compared, and sets of
    the same `known` are tied already; sets then count repeated shingles, and so does the similarity.
    """
    repeats = known is not None
    keyed = docs.select("text", "meet") if repeats else docs.select("text")
    keys = keyed.mapInArrow(tidied(_prefixes(width, hits, repeats)), MET_TYPE)
    dealt = keys.repartition("key").sortWithinPartitions("key", "fp")
    met = stage(dealt.mapInArrow(tidied(_meeting), MET_TYPE), "met")
    wanted = stage(met.select("fp").distinct(), "wanted")
    firsts = rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(
        F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_text_hash")).alias("o")
    )
    firsts = stage(firsts.select("fp", F.col("o._id").alias("_in"), F.col("o._text_hash").alias("_in_hash")), "firsts")
    marked = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    texts = marked.join(firsts, F.col("_id").eqNullSafe(F.col("_in")) & (F.col("_hash") == F.col("_in_hash")))
    # Rows alike in id and text are one document.
    texts = stage(texts.select("fp", "text").dropDuplicates(["fp"]), "texts")
    met = met.join(known, "fp") if repeats else met.withColumn("known", F.col("fp"))
    # A set that has the key late is alike with smaller ones only: no hub if there is another.
    order = F.struct(F.expr("most < n").alias("late"), F.xxhash64("key", "fp").alias("x"), "fp", "n", "most", "known")
    hubs = stage(met.groupBy("key").agg(F.min(order).alias("hub")), "hubs")
    tried = met.alias("met").join(hubs, "key").where((F.col("known") != F.col("hub.known")) & _fits("met", "hub"))
    tried = tried.select(F.least("fp", "hub.fp").alias("a"), F.greatest("fp", "hub.fp").alias("b")).distinct()
    tried = stage(tried, "tried")
    near = _verified(tried, texts, width, repeats)
    tied = components(_tied_by(near, known) if repeats else near)
    apart = stage(met.join(tied, met.known == tied.node, "left").select(*MET, F.coalesce("component", "known").alias("root")), "apart")
    mixed = apart.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max(F.expr("most >= n")).alias("early"))
    mixed = stage(mixed.where("x != y AND early").select("key"), "mixed")
    rest = _left_apart(stage(apart.join(mixed, "key", "left_semi"), "apart"))
    rest = stage(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    return near.union(_verified(rest, texts, width, repeats))


def _shingle_sets(docs: DataFrame, width: int, repeats: bool) -> tuple[DataFrame, np.ndarray]:
    """(_id, _text_hash, fp) of every row, and how often the buckets of shingle hashes are hit."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_hash"), "text").mapInArrow(
        tidied(_read(width, repeats)), f"_id {kind}, _text_hash long, fp long, n long, bucket int, hits long"
    )
    read = stage(read, "sets")
    hits = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, n in read.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("hits")).collect():
        hits[bucket] = n
    return read.where("bucket IS NULL").select("_id", "_text_hash", "fp"), hits


def near_groups(docs: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(_id, _text_hash, _fp) of every row, where _fp stands for its set, and (fp, root) of every set."""
    ship_package(docs.sparkSession)
    rows, hits = _shingle_sets(docs, width, False)
    tied = components(near_pairs(docs, rows, hits, width))
    sets = stage(rows.select("fp").distinct(), "distinct")
    groups = sets.join(tied, sets.fp == tied.node, "left").select("fp", F.coalesce("component", "fp").alias("root"))
    return rows.withColumnRenamed("fp", "_fp"), stage(groups, "groups")


def keep_first(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of each group, with its columns: the smallest id, then the smallest text hash.

    Texts are linked if the Jaccard similarity of their sets of `width`-word shingles is 4/5 or more;
    groups are what links connect. Texts without words are one group. Rows with null ids come last in
    their group; rows alike in id and text are one document. Sets equal by a 64-bit hash are equal;
    the similarity of others is verified on the words. An empty table gives no rows.
    """
    return first_rows(docs, *near_groups(docs, width))


def print_links(docs: DataFrame, rows: DataFrame, sets: DataFrame, width: int, bits: int) -> DataFrame:
    """(a, b): roots of `sets` tied by two texts of one SimHash group that are alike with repeats counted.

    `rows` and `sets` are those of near_groups. Of every SimHash group with more than one root all
    texts are taken, each as a set that counts its shingles, and near_pairs ties these by every pair
    in the group, whatever their number of bits apart: a text need not be like the first one. A group
    of one root has nothing to tie.
    """
    prints = fingerprinted(docs, width)
    tied = simhash_groups(prints, width, bits)
    of_row = prints.join(tied, prints._fp == tied.fp)
    of_row = of_row.select(F.col("_id").alias("_in"), F.col("_text_hash").alias("_in_hash"), F.col("root").alias("meet")).distinct()
    met = rows.join(sets, rows._fp == sets.fp).select("_id", "_text_hash", F.col("root").alias("known")).distinct()
    met = met.join(of_row, F.col("_id").eqNullSafe(F.col("_in")) & (F.col("_text_hash") == F.col("_in_hash")))
    met = stage(met.select("_in", "_in_hash", "meet", "known"), "print_sets")
    mixed = stage(met.groupBy("meet").agg(F.min("known").alias("x"), F.max("known").alias("y")).where("x != y").select("meet"), "mixed")
    chosen = stage(met.join(mixed, "meet", "left_semi"), "chosen")
    marked = docs.select("doc_id", F.xxhash64("text").alias("_hash"), "text")
    few = marked.join(chosen, F.col("doc_id").eqNullSafe(F.col("_in")) & (F.col("_hash") == F.col("_in_hash")))
    # Rows alike in id and text are one document.
    few = stage(few.select("doc_id", "_hash", "text", "meet", "known").dropDuplicates(["doc_id", "_hash"]), "few")
    counted, hits = _shingle_sets(few, width, True)
    known = counted.join(few, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_text_hash") == F.col("_hash")))
    known = stage(known.groupBy("fp").agg(F.min("known").alias("known")), "known")
    return _tied_by(near_pairs(few, counted, hits, width, known), known)


def keep_first_linked(docs: DataFrame, width: int = 5, bits: int = 3) -> DataFrame:
    """What keep_first keeps where SimHash links texts too: groups are what links of either kind connect.

    SimHash counts a shingle as often as it occurs, so it finds texts that repeat the same and have
    other rests, whose sets are unlike; sets find edited texts whose fingerprints differ in too many
    bits. Fingerprints are of `width`-word shingles and link at `bits` or fewer bits; any two texts of
    a SimHash group are tied if their shingles, repeats counted, have a similarity of 4/5 or more.
    Nulls, repeated rows and empty tables are as in keep_first.
    """
    rows, sets = near_groups(docs, width)
    joined = components(print_links(docs, rows, sets, width, bits))
    groups = sets.join(joined, sets.root == joined.node, "left").select("fp", F.coalesce("component", "root").alias("root"))
    return first_rows(docs, rows, stage(groups, "groups"))
