"""Vectors, packing, mixing, shards and the learnt classifier."""

import glob
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewarden.llm import bestfit, embedding_dedup, factor_quality, mixing, packing, quality_trees, queries, sharding, token_matrix
from tablewarden.llm.tokens import encoder
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def brute_links(rows, threshold=0.95):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[k] = np.array(v, float) / max(map(abs, v))
    sets, n = brute.Sets(), Counter()
    for a in good:
        for b in good:
            x, y = good[a], good[b]
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[a] += 1
                n[b] += 1
                sets.tie(rows[a][0], rows[b][0])
    return [(i, n[k], i if i is None else sets.root(i), i is not None and sets.root(i) == i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("tile", [4096, 40])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, tile, kind):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(12, 24))
    rows = [(int(k), [float(np.float32(c)) for c in base[k % 12] * draw.uniform(0.5, 3) + draw.normal(0, 0.18, 24)]) for k in range(150)]
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [1.0, None]), (504, [float("nan")] * 24), (505, [float("inf")] + [1.0] * 23)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (7, rows[7][1]), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, [1e-30] * 24)]
    if kind == "double":
        rows += [(509, [1e300] * 24), (510, [2e-300] * 24)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, row string, links int")
    found = embedding_dedup.link_vectors(df.repartition(3), tile=tile)
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute_links(rows))
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


def test_quantised_bounds_hold():
    draw = np.random.default_rng(4)
    u = draw.normal(size=(200, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    code, scale, length, err = embedding_dedup.quantise(u)
    near = embedding_dedup.products(code, code) * scale[:, None] * scale
    bound = length[:, None] * err + err[:, None] * length + err[:, None] * err
    assert (np.abs(near - u @ u.T) <= bound + 1e-9).all()
    wide = draw.integers(-127, 128, (5, 3000)).astype(np.int8)
    assert (embedding_dedup.products(wide, wide) == wide.astype(int) @ wide.T.astype(int)).all()


def test_token_ids_are_those_of_the_file(documents):
    tokenizer, ranks = queries.vocabulary()
    whole, encode = Tokenizer.from_file(tokenizer), encoder(tokenizer, ranks)
    texts = [r.text or "" for r in documents.collect()]
    texts += ["a\nb c", "\n a", "x  y", "it's we'll\tnot ", "tab\tin word", "né e 12 3.4%\r\nz", "a 　b"]
    texts += [f"a{blank}b" for blank in "\x1c\x85\xa0\u2003\u3000\r\x0b"] + [f"a{blank} b" for blank in "\t\x1f\u2028"] + ["\u205fa", "a\u1680"]
    for t, ids in zip(texts, encode(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert list(encode(pa.array([None, ""], pa.string()))) == [b"", b""]


@pytest.mark.parametrize("group", [packing.GROUP, 20])
def test_packing(spark, documents, group):
    tokenizer, ranks = queries.vocabulary()
    whole, capacity = Tokenizer.from_file(tokenizer), 256
    pieces = packing.document_pieces(documents, capacity, tokenizer, ranks)
    packed = packing.pack(pieces, capacity, group=group).collect()
    expected = Counter()
    for doc in documents.collect():
        ids = np.array([*whole.encode(doc.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            expected[doc.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == expected
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= capacity
    lengths = np.array([r.length for r in packed])
    bound = bestfit.bin_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    assert bound <= len(bins) <= bound * 1.02 + 1


def test_packing_other_tables(spark, nothing):
    tokenizer, ranks = queries.vocabulary()
    assert packing.pack(packing.document_pieces(nothing, 64, tokenizer, ranks), 64).count() == 0
    odd = spark.createDataFrame([(1, None, "a", 5), (2, 0, "b", 6), (2, 10, "b", 6), (2, 10, "b", 6)], "k int, length int, _row string, sequence_id int")
    rows = packing.pack(odd, 10).collect()
    assert sorted(len([r for r in rows if r.sequence_id == s]) for s in {r.sequence_id for r in rows}) in ([1, 3], [2, 2], [1, 1, 2])
    assert {r._row for r in rows} == {"a", "b"}


def optimum(lengths, capacity):
    """Fewest bins, by trying."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= lengths[k]}):
            rest = list(rooms)
            rest.remove(r)
            place(k + 1, [*rest, r - lengths[k]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_best_fit_and_bounds():
    draw = np.random.default_rng(8)
    for _ in range(60):
        capacity = int(draw.integers(5, 40))
        lengths = draw.integers(1, capacity + 1, draw.integers(1, 9))
        bins, offsets, made = bestfit.best_fit_decreasing(lengths, capacity)
        rooms, expected = [], []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in rooms if r >= lengths[i]]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - lengths[i])
        assert made == len(rooms)
        assert sorted(capacity - np.bincount(bins, lengths)) == sorted(rooms)
        best = optimum(lengths.tolist(), capacity)
        assert -(-lengths.sum() // capacity) <= bestfit.bin_bound(np.bincount(lengths, minlength=capacity + 1), capacity) <= best <= made
    half = bestfit.bin_bound(np.bincount([6] * 7, minlength=11), 10)
    assert half == 7


def test_token_matrix_round_trip(documents, nothing, tmp_path):
    tokenizer, ranks = queries.vocabulary()
    whole, capacity = Tokenizer.from_file(tokenizer), 128
    matrix = token_matrix.token_matrix(documents, capacity, tokenizer, ranks, window=1 << 12)
    token_matrix.write_matrix(matrix, str(tmp_path / "m"))
    found = defaultdict(list)
    for r in documents.sparkSession.read.parquet(str(tmp_path / "m")).collect():
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == capacity
        assert [s.length for s in r.segments] == np.diff(r.cu_seqlens).tolist()
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            found[s.doc_id].append((s.start, ids[a:b].tolist()))
        assert not ids[r.cu_seqlens[-1] :].any() and not places[r.cu_seqlens[-1] :].any()
    expected = defaultdict(list)
    for d in documents.collect():
        ids = [*whole.encode(d.text or "", add_special_tokens=False).ids, 0]
        expected[d.doc_id] += [(k, ids[k : k + capacity]) for k in range(0, len(ids), capacity)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert token_matrix.digest(token_matrix.token_matrix(nothing, 64, tokenizer, ranks)).count() == 0


def check_mix(rows, weights=(5, 2, 1)):
    """`rows`: source, doc_id, size, source_size, target, taken."""
    sizes = Counter()
    for s, _, size, *_ in rows:
        sizes[s] += size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s] + 1e-9}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        rest -= sum(2 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    taken = Counter()
    for s, _, size, source_size, t, took in rows:
        taken[s] += took
        assert source_size == sizes[s] and abs(t - target[s]) < 1e-6 * max(1, t) and 0 <= took <= 2 * size
    for s in order:
        assert abs(taken[s] - target[s]) <= 1


@pytest.mark.parametrize("chunk", [None, 3])
def test_mixing(documents, chunk):
    mix = mixing.mix_sources(documents, [5, 2, 1], block=64, chunk=chunk)
    found = mixing.mixed_documents(mix, block=64)
    sizes = Counter((r.doc_id, len(brute.WORD.findall(r.text or ""))) for r in documents.collect())
    assert Counter((r.doc_id, r["size"]) for r in found.collect()) == sizes
    words = mixing.taken_words(mix, 64).join(mix.targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    check_mix([tuple(r) for r in words.select("source", "_id", "size", "source_size", "target", "taken").collect()])
    again = mixing.mixed_documents(mixing.mix_sources(documents.repartition(2), [5, 2, 1], block=64, chunk=chunk), block=64)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, found.collect()))


def test_schedule_is_even(documents):
    """In every stretch of the mix each source has nearly its share of the slots."""
    mix = mixing.mix_sources(documents, [5, 2, 1], block=64)
    slots = [(r.position, r.source) for r in mix.slots.collect()]
    need, total = Counter(s for _, s in slots), len(slots)
    for upto in range(50, total, 97):
        early = Counter(s for p, s in slots if p < upto)
        for s, n in need.items():
            assert abs(early[s] - upto * n / total) < 6


def test_repeated_documents(documents, nothing):
    kept = mixing.repeat_mixed(documents, [5, 2, 1], block=64)
    assert kept.columns == documents.columns
    taken = {}
    mix = mixing.taken_words(mixing.mix_sources(documents, [5, 2, 1], block=64), 64)
    for r in mix.where("size > 0").collect():
        taken.setdefault((r._id, r._hash), []).append(r.taken / r["size"])
    found = Counter((r.doc_id, r.h) for r in kept.select("doc_id", F.xxhash64("text").alias("h")).collect())
    expected = {k: round(sum(v) / len(v) + 1e-9) * len(v) for k, v in taken.items()}
    assert found == Counter({k: n for k, n in expected.items() if n})
    assert mixing.mixed_documents(mixing.mix_sources(nothing, [5, 2, 1])).count() == 0
    assert mixing.repeat_mixed(nothing, [5, 2, 1]).count() == 0


def test_shards(documents, nothing, tmp_path):
    shards, slots = [f"s{k}" for k in range(7)], 211
    owner = brute.lookup(shards, slots)
    assert sharding.fill_table(shards, slots) == [owner[k] for k in range(slots)]
    sizes = Counter(owner.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = brute.lookup(shards[:-1], slots)
    assert sum(owner[k] != fewer[k] for k in owner) < 2.5 * slots / 7
    placed = sharding.assign_shards(documents, shards, slots)
    rows = placed.collect()
    assert len(rows) == documents.count() and all(owner[r.slot] == r.shard for r in rows)
    assert set(placed.columns) == {*documents.columns, "slot", "shard"}
    sharding.write_shards(documents, shards, slots, str(tmp_path / "s"), files=2)
    assert documents.sparkSession.read.parquet(str(tmp_path / "s")).count() == documents.count()
    assert sharding.assign_shards(nothing, shards, slots).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 210)


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    scored = {r.doc_id: r for r in queries.op2_factor_quality(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in scored.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored.values())
    assert np.mean([scored[i].predicted == labels[i] for i in held]) > 0.93
    kept = {r.doc_id: r for r in queries.op10_quality_trees(spark, sf).collect()}
    assert np.mean([(kept[i].score >= 0.5) == labels[i] for i in held]) > 0.93


def test_factor_scores_are_pairwise_sums(documents, nothing, labels):
    machine = factor_quality.learn(documents, labels)
    for text, size in ((b"", None), (b"some words here", 15), (b"a | b | c ###\nx", -3)):
        index, value = factor_quality.features(text, size)
        pairs = sum(value[a] * value[b] * machine.factor[index[a]] @ machine.factor[index[b]] for a in range(len(index)) for b in range(a))
        raw = machine.bias + machine.weight[index] @ value + pairs
        assert abs(machine.score([(index, value)])[0] - 1 / (1 + np.exp(-raw))) < 1e-9
    scored = factor_quality.score_quality(documents, machine).collect()
    assert len(scored) == documents.count() and all(0 <= r.score <= 1 for r in scored)
    assert factor_quality.score_quality(nothing, machine).count() == 0
    none = factor_quality.learn(nothing, labels)
    assert none.score([factor_quality.features(b"x", 1)])[0] == pytest.approx(0.5, abs=0.1)
    assert quality_trees.learn(nothing, labels).score(np.zeros((1, len(quality_trees.FEATURES)))) == [0.5]


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.op_queries().items() if sql])
def test_query_equals_its_sql(spark, duck, name):
    run, sql = queries.op_queries()[name]
    df = run(spark, SF_DIR)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    expected = Counter(tuple(plain(row[names.index(c)]) for c in df.columns) for row in result.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == expected
