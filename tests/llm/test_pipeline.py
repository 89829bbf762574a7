"""The pipeline's stages one after another, each against brute force on what the last kept."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tablewarden.session import stage
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    made = {}
    for name, step in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        hashes = dict(docs.select("text", F.xxhash64("text")).collect())
        docs = stage(step(spark, docs, SF_DIR), "test")
        made[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
            after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if name == "quality_rules":
            assert set(after) < set(before)
            fails = {i for i, t in before if (c := brute.counts(t))[0] < 50 or 100 * c[4] > 50 * c[0]}
            assert not fails & {i for i, _ in after}
        elif name == "line_dedup":
            expected = brute.line_dedup(before, hashes.get)
            assert Counter(after) == Counter(zip([i for i, _ in before], expected))
        elif name == "simhash_dedup":
            firsts = {c for _, c in brute.simhash_groups(before, 5)}
            assert Counter(i for i, _ in after) == Counter(firsts)
        elif name == "mixing":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 2
    pieces = made["best_fit_packing"]
    assert pieces.where("piece = 0").count() == made["mixing"].count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def odd_rows():
    """Null ids, texts and sources, empty texts, repeated rows, and a text longer than every slice of a batch."""
    prose = [" ".join(f"word{(7 * k * k + 13 * i * k + i) % 997}" for k in range(80)) for i in range(6)]
    long = "\n".join(f"line {k} of {k * k % 1009} and {k % 11} others has {k * 31 % 977} things" for k in range(45_000))
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(prose)]
    rows += rows[:2] + [(None, prose[3], "en", None, None), (None, prose[3], "en", None, None)]
    rows += [(20, None, None, None, None), (21, "", "en", "b", 0), (22, " \n\n", "en", "b", 3), (23, long, "en", "b", len(long))]
    return rows


def test_odd_rows_and_clashing_names(spark):
    names = ["_row", "_id", "_hash", "fp", "root", "key", "n", "_score", "_counts", "text_a", "size", "rank"]
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"of {c}").alias(c) for c in names])
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF_DIR), "odd")
        if name == "best_fit_packing":
            break
        assert docs.columns == columns
        assert {tuple(r) for r in docs.select(*names).distinct().collect()} <= {tuple(f"of {c}" for c in names)}
        ids = Counter(i for i, in docs.select("doc_id").collect())
        if name == "quality_rules":
            assert set(ids) <= {*range(6), 23, None}
        elif name == "simhash_dedup":
            assert max(ids.values(), default=0) <= 1
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_each_stage_alone_on_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    docs = stage(docs, "odd")
    lines = corpus_pipeline.line_dedup_stage(spark, docs, SF_DIR)
    assert lines.count() == docs.count()
    firsts = corpus_pipeline.simhash_dedup(spark, docs, SF_DIR)
    # One without words stands for all of them, and the prose of the null id is that of document 3.
    assert Counter(i for i, in firsts.select("doc_id").collect()) == Counter([0, 1, 2, 3, 4, 5, 20, 23])
    mixed = corpus_pipeline.mix(spark, docs, SF_DIR)
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.pack(spark, docs, SF_DIR)
    assert packed.where("piece = 0").count() == docs.count()


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF_DIR), "none")
        assert docs.isEmpty(), name


def test_packing_leaves_no_words_in_a_worker(spark):
    """Workers live on: neither vocabulary nor words of the last stage may stay with them."""
    import pyarrow as pa

    from tablewarden.llm import packing, tokens

    class Docs:
        """Runs what mapInArrow is given, here instead of in a worker."""

        sparkSession, schema = spark, spark.range(1).withColumnRenamed("id", "doc_id").schema

        def select(self, *_):
            return self

        def mapInArrow(self, task, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", None])], ["doc_id", "text"])
            return sum(b.num_rows for b in task(iter([batch])))

    tokens.encoder.cache_clear()
    vocabulary = corpus_pipeline.vocabulary()
    assert packing.document_pieces(Docs(), 8, *vocabulary, lasting=False) == 2
    assert tokens.encoder.cache_info().currsize == 0
    assert packing.document_pieces(Docs(), 8, *vocabulary) == 2
    assert tokens.encoder.cache_info().currsize == 1
