"""Detection: gated measures of a lake, scored against a model, as findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.scores import better_ratio, differs, label_error, likelihood_ratio
from tablewarden.operators.dependency import PAIR_KEY
from tablewarden.operators.joins import BROADCAST_ROWS
from tablewarden.operators.profile import COLUMN_KEY
from tablewarden.plans.learn import (
    FD_FEATURES,
    FD_SCORES,
    NO_FEATURES,
    NO_LOG_SCORES,
    NO_SCORES,
    SE_FEATURES,
    SE_SCORES,
    UV_FEATURES,
    UV_SCORES,
)
from tablewarden.plans.scoring import likelihood_counts
from tablewarden.session import stage
from tablewarden.sources.lake import Lake

# Looked-up cells are fetched by broadcasting their row keys up to this many, counted, rows.
LOOKUP_ROWS = 200_000
ROW_KEY = ["table_id", "row_idx"]


def gate(measures: DataFrame, scores: tuple[str, str]) -> DataFrame:
    """Candidates: a row was dropped and the score changed."""
    before, after = scores
    return measures.filter(F.col("suspect_row").isNotNull() & (F.col(before) != F.col(after)))


def _scored(candidates: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """Candidates with their counts. Many candidates may share one row of counts, so these are a
    stage table: broadcast if few, else shuffled by all of `on`, where hot keys can be split."""
    counts = stage(counts, "counts")
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    return candidates.join(counts, on, "left").withColumns(
        {
            "p_dt": F.coalesce("p_dt", F.lit(0).cast("long")),
            "p_dot": F.coalesce("p_dot", F.lit(0).cast("long")),
        }
    )


def _score(
    candidates: DataFrame, model: DataFrame, features: list[str], scores: tuple[str, str]
) -> DataFrame:
    counts = likelihood_counts(candidates, model, features, scores)
    scored = _scored(candidates, counts, [*features, *scores])
    return scored.withColumn("LR", likelihood_ratio(F.col("p_dot"), F.col("p_dt")))


def score_uv(candidates: DataFrame, model: DataFrame) -> DataFrame:
    """Candidates with p_dt, p_dot and LR, where p_dt > 0."""
    return _score(candidates, model, UV_FEATURES, UV_SCORES).filter(F.col("p_dt") > 0)


def score_fd(candidates: DataFrame, model: DataFrame) -> DataFrame:
    """Candidate pairs with p_dt, p_dot and LR, where both counts are positive."""
    scored = _score(candidates, model, FD_FEATURES, FD_SCORES)
    return scored.filter((F.col("p_dt") > 0) & (F.col("p_dot") > 0))


def score_se(candidates: DataFrame, model: DataFrame) -> DataFrame:
    """Candidates with p_dt, p_dot and LR, where p_dt > 0."""
    return _score(candidates, model, SE_FEATURES, SE_SCORES).filter(F.col("p_dt") > 0)


def score_no(candidates: DataFrame, model: DataFrame) -> DataFrame:
    """All candidates; LR is the better of the raw and the log ratio, NULL if both are undefined."""
    on = [*NO_FEATURES, *NO_SCORES]
    raw = likelihood_counts(candidates, model, NO_FEATURES, NO_SCORES, larger_is_extreme=True)
    log = likelihood_counts(
        candidates, model, NO_FEATURES, NO_SCORES, NO_LOG_SCORES, larger_is_extreme=True
    )
    counts = raw.join(
        log.withColumnsRenamed({"p_dt": "p_dt_log", "p_dot": "p_dot_log"}), on, "full"
    )
    zero = F.lit(0).cast("long")
    scored = _scored(candidates, counts, on).withColumns(
        {"p_dt_log": F.coalesce("p_dt_log", zero), "p_dot_log": F.coalesce("p_dot_log", zero)}
    )
    return scored.withColumn(
        "LR",
        better_ratio(
            likelihood_ratio(F.col("p_dot"), F.col("p_dt")),
            likelihood_ratio(F.col("p_dot_log"), F.col("p_dt_log")),
        ),
    )


def lookup_rows(lake: Lake, candidates: DataFrame) -> DataFrame:
    """(table_id, row_idx, cells) of the suspect rows of a stage table of candidates.

    The lake stays where it is while the counted row keys are few enough to broadcast; beyond, the
    keys are unique rows, so the shuffle has no hot key. A lake that is numbered anew joins tables
    with the lists of their suspect rows, and makes texts of these rows alone.
    """
    keys = candidates.select("table_id", F.col("suspect_row").alias("row_idx")).distinct()
    return lake.rows_at(keys, candidates.count() <= LOOKUP_ROWS)


def _with_cells(
    scored: DataFrame, candidates: DataFrame, lake: Lake, clean: Lake | None
) -> DataFrame:
    """Add the suspect row's `cells` and `clean_cells`; NULL without a clean row."""
    found = scored.withColumnRenamed("suspect_row", "row_idx").join(
        lookup_rows(lake, candidates), ROW_KEY, "left"
    )
    if clean is None:
        return found.withColumn("clean_cells", F.lit(None).cast("array<string>"))
    truth = lookup_rows(clean, candidates).withColumnRenamed("cells", "clean_cells")
    return found.join(truth, ROW_KEY, "left")


def _pick(cells: str, idx: str) -> Column:
    return F.get(cells, F.col(idx))


def _error(*columns: str) -> Column:
    """Whether any of the cells differs from the clean one; NULL without a clean row."""
    changed = [differs(_pick("cells", c), _pick("clean_cells", c)) for c in columns]
    return F.when(F.col("clean_cells").isNotNull(), reduce(lambda a, b: a | b, changed))


def cell_findings(
    scored: DataFrame,
    candidates: DataFrame,
    error_type: str,
    lake: Lake,
    clean: Lake | None = None,
    truth_name: str = "correct_value",
) -> DataFrame:
    """Findings of a one-column detector, with the clean value and an error flag if there is one.

    Without a clean lake both are NULL.
    """
    named = lake.with_columns(scored.select(*COLUMN_KEY, "suspect_row", "LR"), "col_name")
    return _with_cells(named, candidates, lake, clean).select(
        F.lit(error_type).alias("error_type"),
        F.col("table_id").alias("path"),
        "col_name",
        "row_idx",
        "col_idx",
        "LR",
        _pick("cells", "col_idx").alias("value"),
        _pick("clean_cells", "col_idx").alias(truth_name),
        _error("col_idx").alias("error"),
    )


def pair_findings(
    scored: DataFrame, candidates: DataFrame, lake: Lake, clean: Lake | None = None
) -> DataFrame:
    """Findings of the dependency detector."""
    named = scored.select(*PAIR_KEY, "suspect_row", "LR")
    for side in ("1", "2"):
        named = lake.with_columns(
            named.withColumnRenamed(f"col_{side}_idx", "col_idx"), "col_name"
        ).withColumnsRenamed({"col_idx": f"col_{side}_idx", "col_name": f"col_{side}_name"})
    return _with_cells(named, candidates, lake, clean).select(
        F.lit("fd").alias("error_type"),
        F.col("table_id").alias("path"),
        "col_1_name",
        "col_2_name",
        "row_idx",
        "col_1_idx",
        "col_2_idx",
        "LR",
        _pick("cells", "col_1_idx").alias("value_1"),
        _pick("cells", "col_2_idx").alias("value_2"),
        _pick("clean_cells", "col_1_idx").alias("correct_value_1"),
        _pick("clean_cells", "col_2_idx").alias("correct_value_2"),
        _error("col_1_idx", "col_2_idx").alias("error"),
    )


def detect_uv(
    measures: DataFrame, model: DataFrame, lake: Lake, clean: Lake | None = None
) -> DataFrame:
    candidates = stage(gate(measures, UV_SCORES), "uv_candidates")
    return cell_findings(score_uv(candidates, model), candidates, "uniqueness", lake, clean)


def detect_fd(
    measures: DataFrame, model: DataFrame, lake: Lake, clean: Lake | None = None
) -> DataFrame:
    candidates = stage(gate(measures, FD_SCORES), "fd_candidates")
    return pair_findings(score_fd(candidates, model), candidates, lake, clean)


def detect_no(
    measures: DataFrame, model: DataFrame, lake: Lake, clean: Lake | None = None
) -> DataFrame:
    candidates = stage(gate(measures, NO_SCORES), "no_candidates")
    return cell_findings(score_no(candidates, model), candidates, "no", lake, clean)


def detect_se(
    measures: DataFrame, model: DataFrame, lake: Lake, clean: Lake | None = None
) -> DataFrame:
    candidates = stage(gate(measures, SE_SCORES), "se_candidates")
    return cell_findings(
        score_se(candidates, model), candidates, "spelling", lake, clean, "ground_truth"
    )


def detect_se_labelled(
    measures: DataFrame, model: DataFrame, lake: Lake, label_column: str = "label"
) -> DataFrame:
    """Spelling findings of non-numeric columns, with the label of the suspect row.

    The label column itself is not searched. Labels 2 and 1 give error 1 and 0, any other -1.
    """
    texts = lake.with_columns(
        measures.filter(~F.col("base_type").isin("int64", "float64")), "col_name"
    ).filter(F.col("col_name") != label_column)
    candidates = stage(gate(texts, SE_SCORES), "se_candidates")
    scored = score_se(candidates, model)
    found = _with_cells(
        scored.select(*COLUMN_KEY, "col_name", "suspect_row", "LR"), candidates, lake, None
    )
    label_at = lake.columns.filter(F.col("col_name") == label_column).withColumnRenamed(
        "col_idx", "label_idx"
    )
    if lake.uniform:
        at = label_at.first()
        found = found.withColumn("label_idx", F.lit(at and at["label_idx"]).cast("int"))
    else:
        found = found.join(label_at.select("table_id", "label_idx"), "table_id", "left")
    label = _pick("cells", "label_idx").try_cast("double").cast("int")
    return found.select(
        F.lit("spelling").alias("error_type"),
        F.col("table_id").alias("path"),
        "col_name",
        "row_idx",
        "col_idx",
        "LR",
        _pick("cells", "col_idx").alias("value"),
        label.alias("Label"),
        label_error(F.coalesce(label, F.lit(0))).alias("error"),
    )


def all_findings(cells: list[DataFrame], pairs: DataFrame | None = None) -> DataFrame:
    """One DataFrame of the findings of several detectors.

    Fields of the other kind of finding are NULL; `ground_truth` joins `correct_value`.
    """
    parts = [
        f.withColumnRenamed("ground_truth", "correct_value") for f in cells
    ] + ([] if pairs is None else [pairs])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
