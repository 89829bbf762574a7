"""Spelling of long texts and of columns cut into blocks, against brute force."""

import random

from pyspark.sql import functions as F

from tablewarden.operators import spelling
from tablewarden.operators.spelling import adjacent_pairs, closest_pairs
from tablewarden.operators.variants import left_out_hashes
from tablewarden.plans.measures import Measured
from tablewarden.sources.lake import lake_from_tables
from tests import brute

KEYS = ["table_id", "col_idx"]


def texts_frame(spark, texts):
    rows = [("t", 0, k, text) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "table_id string, col_idx int, first_row long, text string")


def test_hashes_without_a_character_are_those_of_the_rest():
    text = "naïve " * 30 + "z€𝄞"
    hashes = left_out_hashes(text)
    assert len(hashes) == len(text) + 1
    for p in (0, 1, 17, len(text) - 1):
        rest = text[:p] + text[p + 1 :]
        assert list(hashes[p]) == list(left_out_hashes(rest)[-1])
    assert list(hashes[0]) != list(hashes[-1])


def test_blocks_of_any_size_give_the_closest_pairs(spark):
    random.seed(5)
    texts = list(dict.fromkeys("".join(random.choices("abcd", k=random.randint(3, 14))) for _ in range(60)))
    texts = [t for k, t in enumerate(texts) if all(brute.edit_distance(t, u) > 1 for u in texts[:k])]
    d, i, j = brute.closest(texts)
    expected = ("t", 0, d, i, j) + tuple(
        brute.closest(brute.without(texts, end))[0] for end in (i, j)
    )
    frame = texts_frame(spark, texts)
    for block in (3, 256):
        assert [tuple(r) for r in closest_pairs(frame, KEYS, len(texts), block).collect()] == [expected]


def test_long_texts_one_edit_apart(spark):
    base = "".join(random.Random(7).choices("abcdef ", k=5_000))
    texts = [
        base,
        base[:4_000] + base[4_001:],
        "x" * 64,
        "x" * 65,
        base[:100] + "#" + base[101:],
        "y" * 200,
        base[::-1],
        "",
    ]
    found = {(r.i, r.j) for r in adjacent_pairs(texts_frame(spark, texts), KEYS).collect()}
    assert found == {(0, 1), (0, 4), (2, 3)}


def test_few_long_texts_leave_the_short_way(spark, monkeypatch):
    """A column of few but long texts gives the same by either way."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc de", k=rng.randint(40, 90))) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    lake = lake_from_tables({"d": (df, ["k"], ["text"])})
    short = Measured(lake).se().collect()
    monkeypatch.setattr(spelling, "SHORT_CHARS", 100)
    assert Measured(lake).se().collect() == short
    d, i, j = brute.closest(texts)
    assert [(r.mpd, r.i, r.j) for r in short] == [(float(d), i, j)]


def test_columns_of_whole_documents(spark):
    """Texts of the registered query that has no SQL, with a near copy planted."""
    rng = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "größe"]
    texts = [" ".join(rng.choices(words, k=rng.randint(300, 900))) for _ in range(8)]
    texts.append(texts[2][:700] + "ZZ" + texts[2][702:])
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = Measured(lake_from_tables({"d": (df, ["k"], ["text"])})).se()
    assert [(r.mpd, r.i, r.j) for r in found.filter(F.col("col_idx") == 0).collect()] == [(2.0, 2, 8)]


def test_first_rows_tell_the_first_pair_of_a_column(spark):
    """Whatever number of rows is grouped first, pairs whose partner comes later are not lost."""
    rng = random.Random(11)
    schema = "table_id string, col_idx int, first_row long, text string, n long"
    columns = []
    for col in range(6):
        texts = list(dict.fromkeys("".join(rng.choices("abcdef", k=rng.randint(4, 7))) for _ in range(90)))
        columns.append(texts[:4] + [t for t in texts[4:] if all(brute.edit_distance(t, u) > 1 for u in texts[:4])])
        columns[-1].append(texts[col % 3] + "x")
    columns.append(["p" * k for k in range(1, 80, 2)])  # nothing one apart
    columns.append(["one", "two", *("word" * k for k in range(2, 40)), "tow", "on"])
    rows = [("t", c, k, text, 1) for c, texts in enumerate(columns) for k, text in enumerate(texts)]
    values = spark.createDataFrame(rows, schema)
    expected = {}
    for c, texts in enumerate(columns):
        d, i, j = brute.closest(texts)
        expected[c] = (d, i, j, *(brute.closest(brute.without(texts, end))[0] for end in (i, j)))
    for lead, early in ((20, 64), (20, 0)):
        found = spelling._long_columns(values, 100, lead, early).collect()
        assert {r.col_idx: (r.d, r.i, r.j, r.d_i, r.d_j) for r in found} == expected, (lead, early)
        for r in found:
            assert (r.text_i, r.text_j) == (columns[r.col_idx][r.i], columns[r.col_idx][r.j])


def test_few_rows_are_grouped_where_the_first_ones_have_a_pair(spark, monkeypatch):
    """A column of numbers is not grouped as a whole."""
    values = spark.range(500).selectExpr("'t' AS table_id", "0 AS col_idx", "id AS first_row", "string(id) AS text", "1L AS n")
    grouped = []
    whole = spelling.adjacent_pairs
    monkeypatch.setattr(spelling, "LEAD_ROWS", 20)
    monkeypatch.setattr(spelling, "adjacent_pairs", lambda texts, keys: grouped.append(texts.count()) or whole(texts, keys))
    assert [tuple(r)[2:5] for r in spelling._long_columns(values, 500).collect()] == [(1, 0, 1)]
    assert grouped == [20]
