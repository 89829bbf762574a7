import os

import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, size int, fp int, h1 string, line int, quality string, _hash int"
LONG = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(30_000))
NEAR = "the quick brown fox jumps over the lazy dog near the river bank"
ODD = [
    (None, None, None, None, None),
    (9001, None, "en", None, None),
    (9002, "", "en", "é", 0),
    (9003, " \t\n\x0b\n  ", "en", "src1", 7),
    (9004, LONG, "en", "src1", 1),
    (9005, LONG[:20_000] + " " + LONG[20_000:], None, None, -5),
    (9006, f"{NEAR}\n{NEAR}\n\nshort\n{NEAR[:-1]}\n{NEAR.replace('fox', 'fix')}", "en", "", 3),
    (9007, f"{NEAR[1:]}\nshore\n{NEAR}s\nX{NEAR}s", "en", "", 3),
    (9008, "one two three " * 40, "en", "src2", 3),
    (9008, "one two three " * 40, "en", "src2", 3),
    (9009, "a b   <|endoftext|> \U0001f600 ż\n\n\n  tail ", "en", "src2", 3),
    (None, f"{NEAR}\nsome other words that no other line of the table has at all", "en", "src3", None),
    (-4, "solo", "en", "src3", None),
    (9010, ("abcdefghij" * 14) + LONG[5_000:5_400], "en", "src3", None),
]


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest table, with odd rows and columns whose names operators use inside."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()] + ODD
    extra = ("x", 1, 2, "y", 3, "z", 4)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
