"""Operators on whole texts against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import line_dedup, quality_trees, simhash, suffix_dedup
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def hashes(documents):
    found = dict(rows_of(documents.select("text", F.xxhash64("text").alias("h")), "text", "h"))
    return lambda text: found[text]


@pytest.mark.parametrize("shingle", [3, 5])
def test_simhash_groups(documents, shingle):
    rows = rows_of(documents, "doc_id", "text")
    expected = [(i, f"{p:016x}", c) for (i, _), (p, c) in zip(rows, brute.simhash_groups(rows, shingle))]
    found = rows_of(simhash.simhash_dedup(documents, shingle), "doc_id", "fingerprint", "component_id")
    assert Counter(found) == Counter(expected)


def test_simhash_links_within_a_hot_block(spark, monkeypatch):
    """Many fingerprints near each other, dealt out as parts, are tied as by all pairs."""
    monkeypatch.setattr(simhash, "PART", 7)
    draw = np.random.default_rng(3)
    base = int(draw.integers(1 << 62))
    prints = sorted({base ^ sum(1 << int(b) for b in draw.integers(0, 62, draw.integers(0, 6))) for _ in range(150)})
    sets = brute.Sets()
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                sets.tie(a, b)
    df = spark.createDataFrame([(p, p) for p in prints], "_fp long, _id long")
    for blocks in (None, 4, 6):
        found = {r.fp: r.component for r in simhash.simhash_groups(df, blocks=blocks).collect()}
        assert found == {p: sets.root(p) for p in prints}


def test_simhash_keeps_one_of_each_group(documents):
    rows = rows_of(documents, "doc_id", "text")
    groups = brute.simhash_groups(rows, 5)
    kept = simhash.keep_first(documents, 5)
    assert kept.columns == documents.columns
    found = rows_of(kept, "doc_id", "text")
    by_row = {(i, t): c for (i, t), (_, c) in zip(rows, groups)}
    assert len(found) == len({by_row[r] for r in found})
    assert {by_row[r] for r in found} == {c for _, c in groups}
    assert all(i == by_row[i, t] for i, t in found)


def test_line_dedup(documents):
    rows = rows_of(documents, "doc_id", "text")
    expected = brute.line_dedup(rows, hashes(documents))
    done = line_dedup.dedup_lines(documents)
    assert done.columns == [*documents.columns, "_n_lines", "_n_dropped"]
    assert Counter(rows_of(done, "doc_id", "text")) == Counter(zip([i for i, _ in rows], expected))
    lost = sum((t or "").count("\n") - (e or "").count("\n") for (_, t), e in zip(rows, expected))
    assert lost > 10


@pytest.mark.parametrize("limit", [0, 100_000])
def test_line_dedup_of_lines_full_of_near_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
    draw = np.random.default_rng(5)
    lines = ["".join(draw.choice(list("ab"), draw.integers(2, 7))) for _ in range(120)]
    rows = [(k // 4, "\n".join(lines[k : k + 4])) for k in range(0, 120, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.line_dedup(rows, hashes(df), least=3)
    found = dict(rows_of(line_dedup.dedup_lines(df, least_chars=3), "doc_id", "text"))
    assert found == {i: e for (i, _), e in zip(rows, expected)}


def test_line_dedup_of_texts_that_begin_with_line_breaks(spark):
    lines = [f"line number {w} of the texts of this test" for w in ("one", "two", "three", "four")]
    a, b, c, d = lines
    texts = [f"{a}\n{b}", f"\n{b}\n{c}", "", f"\n\n{c}\n{d}", "\n", f"\n{d}\n{a}\n", f"{b}\n\n", f"\n{c}s"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    expected = brute.line_dedup(rows, hashes(df))
    assert dict(rows_of(line_dedup.dedup_lines(df), "doc_id", "text")) == {i: e for (i, _), e in zip(rows, expected)}
    table = line_dedup.line_table(df, 1, 20)
    inked = Counter((i, n) for i, t in rows for n, x in enumerate(t.split("\n")) if x.strip())
    assert Counter(rows_of(table, "_id", "line")) == inked


def test_line_dedup_query_joins_short_lines(spark, tmp_path):
    """Lines of one letter and more, one edit apart, through the registered query."""
    from tablewarden.llm import queries

    lines = ["a", "b", "ab", "xyz", "xyzw", "yz", "\U0001f600", "a b", "short", "shore", "nineteen characters", "nineteen characters."]
    draw = np.random.default_rng(4)
    rows = [(k, "\n".join(draw.choice(lines, 3))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    expected = brute.line_dedup(rows, hashes(df), least=1)
    found = rows_of(queries.op7_line_dedup(spark, str(tmp_path)), "doc_id", "kept_sha256")
    assert Counter(found) == Counter((i, hashlib.sha256(e.encode()).hexdigest()) for (i, _), e in zip(rows, expected))


def test_exact_line_dedup(documents):
    rows = rows_of(documents, "doc_id", "text")
    expected = brute.line_dedup(rows, hashes(documents), edits=0)
    found = rows_of(line_dedup.dedup_lines(documents, edits=0), "doc_id", "text")
    assert Counter(found) == Counter(zip([i for i, _ in rows], expected))


def test_substrings(documents):
    rows = rows_of(documents, "doc_id", "text")
    expected = brute.substrings(rows, hashes(documents))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = rows_of(suffix_dedup.dedup_substrings(documents), *names)
    assert Counter(found) == Counter((i, *e) for (i, _), e in zip(rows, expected))
    assert sum(e[1] for e in expected) > 1000


@pytest.mark.parametrize("small", [False, True])
def test_substrings_of_few_letters(spark, monkeypatch, small):
    """Texts made of copied stretches with edits, in long and short blocks and slices."""
    if small:
        for name, value in (("CHUNK", 1 << 8), ("BLOCK", 300), ("BUCKET", 20)):
            monkeypatch.setattr(suffix_dedup, name, value)
    draw = np.random.default_rng(7)
    parts = ["".join(draw.choice(list("abc"), draw.integers(5, 90))) for _ in range(12)]
    rows = []
    for k in range(60):
        text = "".join(parts[j] for j in draw.integers(0, 12, draw.integers(0, 9)))
        if text and draw.random() < 0.5:
            at = int(draw.integers(len(text)))
            text = text[:at] + "é" + text[at + 1 :]
        rows.append((k, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for length, gram in ((30, 8), (100, 24)):
        expected = brute.substrings(rows, hashes(df), length)
        found = suffix_dedup.dedup_substrings(df, length, gram)
        found = rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(found) == sorted((i, *e) for (i, _), e in zip(rows, expected))


def test_substrings_never_sort_a_large_bucket(spark, monkeypatch):
    """A passage of many texts that differ just before it: pieces share their core but are not equal."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", 40)
    sort_blocks = suffix_dedup._sort_blocks

    def bounded(length):
        run = sort_blocks(length)

        def rows(batches):
            seen = {}

            def watched():
                for batch in batches:
                    for a, p, n in zip(*(batch.column(k).to_pylist() for k in (0, 1, 5))):
                        seen[a, p] = seen.get((a, p), 0) + n
                        assert seen[a, p] <= 40, "a large bucket came whole to one task"
                    yield batch

            return run(watched())

        return rows

    monkeypatch.setattr(suffix_dedup, "_sort_blocks", bounded)
    draw = np.random.default_rng(9)
    word = lambda n: "".join(draw.choice(list("abcdefghij"), n))
    passage = word(160)
    rows = [(k, word(draw.integers(0, 30)) + passage + word(draw.integers(0, 30))) for k in range(200)]
    rows += [(None, "x" + passage), (None, None), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute.substrings(rows, hashes(df), 100)
    found = suffix_dedup.dedup_substrings(df)
    found = rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(found) == Counter((i, *e) for (i, _), e in zip(rows, expected))


def test_quality_counts(documents, labels):
    rows = rows_of(documents, "doc_id", "text")
    trees = quality_trees.learn(documents, labels)
    judged = quality_trees.judge(documents, trees)
    assert set(judged.columns) == set(documents.columns)
    found = rows_of(judged, "doc_id", *[f"quality.{c}" for c in quality_trees.COUNTS], "quality.base_failed")
    expected = []
    for i, t in rows:
        c = brute.counts(t)
        expected.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert Counter(found) == Counter(expected)
    assert not judged.where("quality.kept AND quality.base_failed").count()
    kept = quality_trees.filter_quality(documents, labels)
    assert kept.columns == documents.columns
    assert kept.count() == judged.where("quality.kept").count()


def test_trees_are_monotonic_and_learn():
    draw = np.random.default_rng(1)
    x = draw.random((3000, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * np.sin(9 * x[:, 2]) + draw.normal(0, 0.3, 3000) > 0).astype(float)
    trees = quality_trees.fit_trees(x, y, [1, -1, 0])
    assert np.mean((trees.score(x) > 0.5) == y) > 0.8
    for f, direction in ((0, 1), (1, -1)):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, f] = np.tile(np.linspace(-0.1, 1.1, 40), 50)
        steps = np.diff(trees.score(grid).reshape(50, 40), axis=1) * direction
        assert (steps >= -1e-12).all()
    none = quality_trees.fit_trees(np.zeros((0, 3)), np.zeros(0), [0, 0, 0])
    assert none.score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_empty_tables(nothing, labels):
    assert simhash.simhash_dedup(nothing).count() == 0
    assert simhash.keep_first(nothing).count() == 0
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert suffix_dedup.dedup_substrings(nothing).count() == 0
    assert quality_trees.filter_quality(nothing, labels).count() == 0


def thue_morse(n, a, b):
    return "".join(a if k.bit_count() % 2 else b for k in range(n))


def test_unequal_texts_whose_sums_of_powers_are_equal(spark):
    """A word and its complement, different at every character, are no copies."""
    from tablewarden.llm import near_dedup

    pair = [thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")]
    rows = [(k, t) for k, t in enumerate([*pair, f"x {pair[0]}\n{pair[1]} y"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 20):
        found = dict(rows_of(line_dedup.dedup_lines(df, least_chars=least), "doc_id", "text"))
        assert found == dict(rows)
    assert sorted(rows_of(near_dedup.keep_first(df), "doc_id")) == [(0,), (1,), (2,)]
    cut = suffix_dedup.dedup_substrings(df)
    expected = brute.substrings(rows, hashes(df))
    assert [tuple(r) for r in cut.orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()] == expected


def test_near_lines_of_every_kind_of_edit(spark):
    """Each place changed, lost or added, at lengths around the number of parts."""
    draw = np.random.default_rng(9)
    lines = []
    for size in (1, 2, 3, 4, 5, 7, 8, 9, 13, 26):
        line = "".join(draw.choice(list("abcdefghij"), size))
        lines.append([line])
        for k in range(size):
            lines[-1] += [line[:k] + "X" + line[k + 1 :], line[:k] + line[k + 1 :], line[:k] + "Y" + line[k:]]
    rows = [(k, x) for k, x in enumerate(x for group in lines for x in draw.permutation(group).tolist())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.line_dedup(rows, hashes(df), least=1)
    found = dict(rows_of(line_dedup.dedup_lines(df, least_chars=1), "doc_id", "text"))
    assert found == {i: e for (i, _), e in zip(rows, expected)}


def test_judge_keeps_columns_called_like_its_own(spark, labels):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    trees = quality_trees.learn(docs, labels)
    odd = docs.select("doc_id", "text", F.lit(1).alias("_score"), F.lit("c").alias("_counts"), F.lit(2).alias("_row"), F.lit(3).alias("quality"))
    judged = quality_trees.judge(odd, trees)
    assert judged.columns == ["doc_id", "text", "_score", "_counts", "_row", "quality"]
    assert {(r._score, r._counts, r._row) for r in judged.collect()} == {(1, "c", 2)}
    assert judged.where("quality.kept").count() == quality_trees.judge(docs, trees).where("quality.kept").count()
