"""A corpus made ready for training: five stages, each one operator of tablewarden.llm on all that the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewarden.llm import line_dedup, mixing, near_dedup, packing, quality_trees
from tablewarden.llm.common import table
from tablewarden.llm.queries import CAPACITY, MIX_WEIGHTS, vocabulary
from tablewarden.session import stage

# Words whose ids a worker keeps during a task: workers live on, and the other stages need their memory too.
REMEMBERED = 150_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and trees keep; others go.

    Null and empty texts have no words and go; repeated rows share a verdict; null ids stay null.
    """
    return quality_trees.filter_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that occur earlier. n_chars stays what the source stated.

    No row goes, whatever is left of its text. Null ids come last; repeated rows are one document.
    """
    return line_dedup.dedup_lines(docs).select(*[f"`{c}`" for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: SimHash links of 3 bits, verified, and similarities of 0.8, both of five-word shingles.

    The smallest id stays, null last. Texts without words, null ones among them, are one group.
    """
    return near_dedup.keep_first_linked(docs, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it: not at all, once or twice. Null sources are a source, the last one.

    Documents without words are never read, so null and empty texts go here.
    """
    return mixing.repeat_mixed(docs, MIX_WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, and where each lies in which sequence. Repeated rows are pieces each for itself."""
    pieces = packing.document_pieces(docs, CAPACITY, *vocabulary(), remembered=REMEMBERED, lasting=False)
    return packing.pack(pieces, CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

# The first stage's trees and the last one's token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written before the next reads it.

    Other columns than those of documents stay with their rows, whatever their names, up to the last
    stage. An empty table gives no rows from any stage.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
