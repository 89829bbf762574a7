"""Resampling towards a target and hard negatives, each against its definition."""

import glob
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tablewarden.llm import hard_negatives, queries, target_resampling

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_target_resampling", "op13_hard_negatives"])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    run, sql = queries.op_queries()[name]
    df, result = run(spark, SF_DIR), duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = Counter(tuple(row[names.index(c)] for c in df.columns) for row in result.fetchall())
    assert Counter(map(tuple, df.collect())) == expected and expected


# ---- resampling ----------------------------------------------------------------------------------


def features(text, most):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]


def plain_resampling(rows, target, percent, most, buckets, least_words, seed):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s = Counter(bucket(f) for _, t in rows for f in features(t, most)[1])
    t = Counter(bucket(f) for x in target for f in features(x, most)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    out = []
    for i, text in rows:
        words, found = features(text, most)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    eligible = sorted((x for x in out if x[5] >= least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for rank, x in enumerate(eligible[: percent * len(eligible) // 100]):
        x[4] = rank + 1
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize("options", [{}, {"percent": 35, "most": 3, "buckets": 97, "least_words": 3, "seed": 7}, {"percent": 100, "least_words": 0}])
def test_resampling(spark, documents, options):
    given = {"percent": 10, "most": 1, "buckets": 10_000, "least_words": 20, "seed": 2024} | options
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    target = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    found = target_resampling.resample(documents, target, **options)
    assert Counter(map(tuple, found.collect())) == plain_resampling(rows, [r.text for r in target.collect()], **given)


def test_resampling_other_tables(spark, documents, nothing):
    assert target_resampling.resample(nothing, documents).count() == 0
    rows = [(1, "alpha beta " * 20, 5), (1, "alpha beta " * 20, 5), (2, "w" * 3_000 + " " + "é" * 100 + " z" * 30, 6), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = target_resampling.resample(df, documents.limit(0), percent=70, carry=["doc_id", "text", "score"])
    assert found.columns == ["doc_id", "text", "n_features", "weight", "score", "rank"]
    expected = plain_resampling([r[:2] for r in rows], [], 70, 1, 10_000, 20, 2024)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in found.collect()) == expected


def test_crc_of_ranges():
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, 5_000).astype(np.uint8)
    begins = draw.integers(0, 4_000, 400)
    ends = begins + draw.choice([0, 1, 2, 7, 47, 48, 49, 50, 900], 400)
    assert target_resampling.crc32_of(data, begins, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(begins, ends)]
    assert len(target_resampling.crc32_of(data, begins[:0], ends[:0])) == 0


# ---- hard negatives ------------------------------------------------------------------------------


def whole(x):
    return int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x)


def plain_negatives(rows, every, positives=5, negatives=5, least=80):
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [whole(x) for x in v], label))
    out = Counter()
    for i, v, label in good:
        if i % every:
            continue
        scored = [(max(-(2**63) + 1, min(2**63 - 1, sum(map(lambda a, b: a * b, v, w)))), j, other) for j, w, other in good if j != i and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            close = [x for x in scored if x[2] != label and least * p <= 100 * x[0] and x[0] <= p][:negatives]
            for rank, (s, k, _) in enumerate(close):
                out[i, j, rank + 1, k, p, s] += 1
    return out


@pytest.mark.parametrize("tile", [hard_negatives.TILE, 30])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_negatives(spark, tile, kind):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(6, 16))
    rows = [(k, [float(np.float32(c)) for c in base[k % 6] + draw.normal(0, 0.3, 16)], int(draw.integers(0, 3))) for k in range(120)]
    rows += [(200 + k, rows[3][1], k % 2) for k in range(40)]  # ties
    rows += [(40, rows[8][1], 1), (40, rows[8][1], 1), (-10, rows[9][1], 2), (5, rows[5][1], 2)]
    rows += [(None, rows[0][1], 1), (300, None, 1), (310, rows[0][1], None), (320, [1.0, None], 1), (330, [float("nan")] * 16, 1)]
    rows += [(340, [float("-inf")] * 16, 0), (350, [], 1), (351, [], 1), (352, [], 2), (360, [0.5, -0.25], 1), (361, [0.5, 0.5], 1), (362, [0.25, 0.0], 2)]
    if kind == "double":
        rows += [(400, [1e300] * 3, 1), (401, [1e299] * 3, 1), (402, [1e298] * 3, 2), (410, [3e7, -2e9, 1.5], 1), (411, [3e7, -2e9, 1.25], 1), (412, [3e7, -2e9, 1.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, label int, row string, tile int, visits int")
    found = hard_negatives.mine_negatives(df.repartition(3), df.vec_id % 10 == 0, tile=tile)
    expected = plain_negatives(rows, 10)
    assert Counter(map(tuple, found.collect())) == expected and len(expected) > 100
    assert hard_negatives.mine_negatives(df.limit(0), df.vec_id % 10 == 0).count() == 0


def test_packed_products_are_exact():
    draw = np.random.default_rng(5)
    for d, size in ((1, 3), (64, 256), (64, 1), (300, 5_000), (7, 10**6), (3, 10**9), (2, 4 * 10**18)):
        a, r = draw.integers(-size, size + 1, (4, d)), draw.integers(-size, size + 1, (11, d))
        exact = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in r] for u in a]
        assert hard_negatives.packed_products(a, r).tolist() == exact
    same = np.full((2, 3), 10**9)
    assert hard_negatives.packed_products(same, same).tolist() == [[3 * 10**18] * 2] * 2
