"""Near-duplicates of the pipeline against the similarity of all pairs."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tablewarden.llm import near_dedup
from tests.llm import brute
from tests.llm.test_text import rows_of


def edited(draw, words, share):
    return [str(draw.integers(10**6)) if draw.random() < share else w for w in words]


@pytest.fixture(scope="module")
def copies(spark):
    """Copies with edits of texts of several lengths, and texts that share a passage."""
    draw = np.random.default_rng(11)
    passage = [str(w) for w in draw.integers(0, 10**6, 30)]
    rows = []
    for size in (5, 8, 20, 60, 200):
        for _ in range(6):
            base = [str(w) for w in draw.integers(0, 10**6, size)]
            for share in (0, 0.01, 0.02, 0.03, 0.05):
                rows.append(" ".join(edited(draw, base, share)))
    for _ in range(40):
        rows.append(" ".join([*map(str, draw.integers(0, 10**6, draw.integers(1, 9))), *passage]))
    rows += ["", " \n", "One two", "one TWO ", "three", None]
    rows = [(int(i), rows[i]) for i in draw.permutation(len(rows))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def firsts(rows):
    groups = {}
    for (i, _), g in zip(rows, brute.near_groups(rows)):
        groups.setdefault(g, []).append(i)
    return Counter(min(ids) for ids in groups.values())


def test_stage_keeps_one_of_each_near_group(spark, copies):
    rows, df = copies
    kept = corpus_pipeline.simhash_dedup(spark, df, "")
    assert Counter(i for i, in rows_of(kept, "doc_id")) == firsts(rows)
    assert len(firsts(rows)) < 0.8 * len(rows)


def test_keys_run_on_from_batch_to_batch():
    import pyarrow as pa

    draw = np.random.default_rng(2)
    rows = sorted((int(k), int(f), 1) for k, f in zip(draw.integers(0, 60, 150), draw.integers(0, 5, 150)))
    sets = {}
    for k, f, _ in rows:
        sets.setdefault(k, set()).add(f)
    expected = sorted((k, f, 1) for k, found in sets.items() if len(found) > 1 for f in found)
    for step in (1, 2, 7, 150):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + step])], ["key", "fp", "n"])
            for a in range(0, len(rows), step)
        ]
        found = [tuple(r.values()) for b in near_dedup._meeting(iter(batches)) for r in b.to_pylist()]
        assert sorted(found) == expected


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = rows_of(docs, "doc_id", "text")
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(i for i, in rows_of(kept, "doc_id")) == firsts(rows)
    assert near_dedup.keep_first(docs.limit(0)).count() == 0


def test_stage_links_by_simhash_as_well(spark):
    """Texts of one repeated passage have equal fingerprints, while their sets are mostly their own rests."""
    draw = np.random.default_rng(5)
    passage = [str(w) for w in draw.integers(0, 10**6, 21)]
    rows = [(i, " ".join([*passage * 40, *map(str, draw.integers(0, 10**6, 40))])) for i in range(4)]
    rows += [(9, " ".join(map(str, draw.integers(0, 10**6, 60)))), (None, rows[2][1])]
    assert len({p for p, _ in brute.simhash_groups(rows[:4], 5)}) == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(i for i, in rows_of(near_dedup.keep_first(df), "doc_id")) == Counter([0, 1, 2, 3, 9])
    kept = corpus_pipeline.simhash_dedup(spark, df, "")
    assert Counter(i for i, in rows_of(kept, "doc_id")) == Counter([0, 9])
    assert corpus_pipeline.simhash_dedup(spark, df.limit(0), "").isEmpty()


def linked_firsts(rows, width=5, bits=3):
    """Smallest ids of the groups: similar sets, and any two of a SimHash group alike with repeats counted."""
    tied = brute.Sets()
    for i, root in enumerate(brute.near_groups(rows, width)):
        tied.tie(i, root)
    grams = []
    for _, text in rows:
        words = brute.WORD.findall((text or "").lower())
        grams.append(Counter(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else Counter())
    prints = [brute.simhash(t, width) for _, t in rows]
    near = brute.Sets()
    for i, a in enumerate(prints):
        near.root(i)
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= bits:
                near.tie(i, j)
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if near.root(i) == near.root(j) and 9 * (a & b).total() >= 4 * (a.total() + b.total()):
                tied.tie(i, j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(tied.root(i), []).append(doc)
    return Counter(min((d for d in ids if d is not None), default=None) for ids in groups.values())


def test_texts_unlike_the_first_of_their_simhash_group_are_linked_too(spark):
    """Repeats of one passage, 40 to 150 times, with rests of their own: equal or close fingerprints, all
    counts apart from the first one's but not from each other's."""
    draw = np.random.default_rng(8)
    rows = []
    for lead, times in ((0, (40, 60, 66, 70, 100, 150, 155)), (100, (30, 31, 60, 58))):
        passage = [str(w) for w in draw.integers(0, 10**6, 21)]
        for k, n in enumerate(times):
            rows.append((lead + k, " ".join([*passage * n, *map(str, draw.integers(0, 10**6, 30 + n))])))
    rows += [(200, rows[1][1]), (None, rows[5][1]), (201, " ".join(map(str, draw.integers(0, 10**6, 60))))]
    rows += [(202, ""), (203, None), (204, "one"), (204, "one"), (205, "ONE ")]
    expected = linked_firsts(rows)
    assert not {2, 3, 103} & set(expected) and {0, 1, 4, 5, 100, 102} <= set(expected)
    df = spark.createDataFrame([rows[i] for i in draw.permutation(len(rows))], "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.simhash_dedup(spark, df, "")
    assert Counter(i for i, in rows_of(kept, "doc_id")) == expected


def test_stage_keeps_one_of_each_linked_group(spark, copies):
    rows, df = copies
    kept = corpus_pipeline.simhash_dedup(spark, df, "")
    assert Counter(i for i, in rows_of(kept, "doc_id")) == linked_firsts(rows)


def test_repeated_shingles_are_elements_of_their_own():
    texts = [b"a b c d e a b c d e a b c d e", b"", b"x y", b"a b c d e a b c d e"]
    owner, h = near_dedup._shingles(texts, 5, True)
    assert np.bincount(owner, minlength=4).tolist() == [11, 0, 1, 6]
    assert len(set(h[owner == 0])) == 11 and set(h[owner == 3]) < set(h[owner == 0])
    once, distinct = near_dedup._shingles(texts, 5)
    assert np.bincount(once, minlength=4).tolist() == [5, 0, 1, 5] and set(distinct) <= set(h)
