"""The registered queries in plain SQL, written from the definitions rather than the closed forms.

Each text is a chain of WITH clauses. Perturbed measures are taken again on the data without the
suspect row, and likelihood counts compare every candidate with every training row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class SqlLake:
    """How to read a lake's cells in SQL: (table expression, table_id, row order, value columns)."""

    tables: list[tuple[str, str, str, list[tuple[str, str]]]]

    def ctes(self) -> list[str]:
        parts, base, columns = [], [], []
        for t, (source, table_id, order, cols) in enumerate(self.tables):
            base.append(
                f"base_{t} AS (SELECT {table_id} AS table_id, "
                f"row_number() OVER (PARTITION BY {table_id} ORDER BY {order}) - 1 AS row_idx, * FROM {source})"
            )
            for i, (name, kind) in enumerate(cols):
                text = {
                    "double": f"CAST(CASE WHEN {name} = 0 THEN 0.0 ELSE {name} END AS VARCHAR)",
                    "text": name,
                }.get(kind, f"CAST({name} AS VARCHAR)")
                parts.append(
                    f"SELECT table_id, CAST({i} AS INTEGER) AS col_idx, row_idx, {text} AS value, "
                    f"{name if kind in ('double', 'int') else 'NULL'}::DOUBLE AS x FROM base_{t}"
                )
                base_type = {"double": "float64", "int": "int64"}.get(kind, "object")
                columns.append(
                    f"SELECT DISTINCT table_id, CAST({i} AS INTEGER) AS col_idx, '{name}' AS col_name, "
                    f"'{base_type}' AS base_type FROM base_{t}"
                )
        return [
            *base,
            "cells AS (" + " UNION ALL ".join(parts) + ")",
            "meta AS (" + " UNION ALL ".join(columns) + ")",
        ]


ORDERS = SqlLake(
    [
        (
            "orders",
            "CAST(o_custkey AS VARCHAR)",
            "o_orderkey",
            [
                ("o_orderstatus", "text"),
                ("o_totalprice", "double"),
                ("o_orderdate", "timestamp"),
                ("o_orderpriority", "text"),
            ],
        )
    ]
)
# Orders with prices and priorities taken out by their keys.
BLANKED = SqlLake(
    [
        (
            "(SELECT * REPLACE (CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS o_totalprice, "
            "CASE WHEN o_orderkey % 13 <> 1 THEN o_orderpriority END AS o_orderpriority) FROM orders)",
            *ORDERS.tables[0][1:],
        )
    ]
)
LINEITEM = SqlLake(
    [
        (
            "lineitem",
            "CAST(l_suppkey AS VARCHAR)",
            "l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice",
            [
                ("l_orderkey", "int"),
                ("l_partkey", "int"),
                ("l_quantity", "double"),
                ("l_returnflag", "text"),
                ("l_linestatus", "text"),
                ("l_extendedprice", "double"),
                ("l_discount", "double"),
                ("l_linenumber", "int"),
                ("l_tax", "double"),
                ("l_shipdate", "timestamp"),
            ],
        )
    ]
)
EVENTS = SqlLake(
    [
        (
            "events",
            "CAST(user_id AS VARCHAR)",
            "event_id",
            [("event_type", "text"), ("value", "double"), ("props", "text"), ("ts", "timestamp")],
        )
    ]
)
CONVERSATIONS = SqlLake(
    [("conversations", "CAST(conv_id AS VARCHAR)", "turn", [("text", "text"), ("role", "text")])]
)
WHOLE = SqlLake(
    [
        ("region", "'region'", "r_regionkey", [("r_regionkey", "int"), ("r_name", "text")]),
        (
            "nation",
            "'nation'",
            "n_nationkey",
            [("n_nationkey", "int"), ("n_name", "text"), ("n_regionkey", "int")],
        ),
        (
            "supplier",
            "'supplier'",
            "s_suppkey",
            [("s_suppkey", "int"), ("s_name", "text"), ("s_nationkey", "int"), ("s_acctbal", "double")],
        ),
        (
            "customer",
            "'customer'",
            "c_custkey",
            [
                ("c_custkey", "int"),
                ("c_name", "text"),
                ("c_nationkey", "int"),
                ("c_acctbal", "double"),
                ("c_mktsegment", "text"),
            ],
        ),
        (
            "part",
            "'part'",
            "p_partkey",
            [
                ("p_partkey", "int"),
                ("p_name", "text"),
                ("p_brand", "text"),
                ("p_type", "text"),
                ("p_size", "int"),
                ("p_retailprice", "double"),
            ],
        ),
        (
            "orders",
            "'orders'",
            "o_orderkey",
            [
                ("o_orderkey", "int"),
                ("o_custkey", "int"),
                ("o_orderstatus", "text"),
                ("o_totalprice", "double"),
                ("o_orderdate", "timestamp"),
                ("o_orderpriority", "text"),
            ],
        ),
    ]
)
# Texts of all documents of one source as one table.
DOCUMENTS = SqlLake([("documents", "source", "doc_id", [("text", "text"), ("lang", "text"), ("n_chars", "int")])])


def query(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


# ---- profile and tokens --------------------------------------------------------------------------

TEXTS = "texts AS (SELECT *, coalesce(value, 'nan') AS text FROM cells)"


def _range(value: str, bounds: tuple[int, ...]) -> str:
    whens = " ".join(f"WHEN {value} <= {b} THEN {i}" for i, b in enumerate(bounds))
    return f"CAST(CASE WHEN {value} IS NULL THEN NULL {whens} ELSE {len(bounds)} END AS INTEGER)"


ROWS = (20, 50, 100, 500, 1000)
LENGTHS = (5, 10, 15, 20)
PREVALENCES = (50, 100, 1000, 10000, 100000)

PROFILE = [
    TEXTS,
    "counted AS (SELECT table_id, col_idx, count(*) AS n_rows, count(value) AS n_present, "
    "count(DISTINCT value) AS n_distinct, bool_and(regexp_full_match(text, '[\\p{L}\\p{N}]+')) AS alnum, "
    "bool_and(regexp_full_match(text, '\\p{N}+')) AS numeric_text FROM texts GROUP BY ALL)",
    "profile AS (SELECT c.*, m.col_name, m.base_type, "
    "CASE WHEN alnum THEN 'alnumeric' ELSE base_type END AS d_type, "
    f"{_range('n_present', ROWS)} AS rows_range FROM counted c JOIN meta m USING (table_id, col_idx))",
]

PIECES = "list_filter(string_split_regex(text, '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+'), lambda t: t <> '')"
TOKENS = [
    f"pieces AS (SELECT table_id, col_idx, row_idx, unnest({PIECES}) AS token FROM texts)",
    "table_tokens AS (SELECT table_id, token, count(*) AS cnt FROM pieces GROUP BY ALL)",
    "lake_tokens AS (SELECT token, CAST(sum(cnt) AS BIGINT) AS cnt FROM table_tokens GROUP BY ALL)",
]

PREVALENCE = [
    *TOKENS,
    "row_prevalence AS (SELECT table_id, col_idx, row_idx, avg(coalesce(cnt, 1)) AS p FROM "
    "(SELECT DISTINCT * FROM pieces) LEFT JOIN lake_tokens USING (token) GROUP BY ALL)",
    "prevalence AS (SELECT table_id, col_idx, round(coalesce(sum(p), 0), 6) AS prevalence, "
    f"{_range('round(coalesce(sum(p), 0), 6)', PREVALENCES)} AS avg_col_pre "
    "FROM texts LEFT JOIN row_prevalence USING (table_id, col_idx, row_idx) GROUP BY ALL)",
    "features AS (SELECT p.*, avg_col_pre FROM profile p JOIN prevalence USING (table_id, col_idx))",
]

# ---- measures ------------------------------------------------------------------------------------

UV = [
    "again AS (SELECT table_id, col_idx, min(r) AS suspect_row FROM (SELECT table_id, col_idx, value, "
    "min(row_idx) AS r FROM cells WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)",
    "uv_after AS (SELECT table_id, col_idx, count(DISTINCT value) / nullif(count(value), 0) AS ur_p FROM cells "
    "LEFT JOIN again USING (table_id, col_idx) WHERE row_idx IS DISTINCT FROM suspect_row GROUP BY ALL)",
    "uv AS (SELECT table_id, col_idx, d_type, rows_range, col_idx AS left_ness, avg_col_pre, "
    "n_distinct / nullif(n_present, 0) AS ur, ur_p, suspect_row FROM features "
    "LEFT JOIN again USING (table_id, col_idx) LEFT JOIN uv_after USING (table_id, col_idx))",
]


def _compliance(name: str, source: str) -> str:
    """Ratio of good determinant values of the pair cells in `source`."""
    return (
        f"{name} AS (SELECT table_id, i, j, "
        "CASE WHEN count(*) FILTER (good) = 0 THEN -1.0 ELSE count(*) FILTER (good) / sum(n) END AS fr FROM "
        f"(SELECT table_id, i, j, a, count(DISTINCT b) = 1 AS good, count(*) AS n FROM {source} GROUP BY ALL) "
        "GROUP BY ALL)"
    )


FD = [
    "pair_cells AS (SELECT l.table_id, l.col_idx AS i, r.col_idx AS j, l.row_idx, l.value AS a, "
    "coalesce('v' || r.value, 'm' || l.row_idx) AS b FROM cells l JOIN cells r "
    "ON l.table_id = r.table_id AND l.row_idx = r.row_idx AND l.col_idx < r.col_idx WHERE l.value IS NOT NULL)",
    _compliance("fr_before", "pair_cells"),
    "breaks AS (SELECT table_id, i, j, min(row_idx) AS suspect_row FROM (SELECT *, first_value(b) OVER "
    "(PARTITION BY table_id, i, j, a ORDER BY row_idx) AS b0 FROM pair_cells) WHERE b <> b0 GROUP BY ALL)",
    "pair_rest AS (SELECT pair_cells.* FROM pair_cells LEFT JOIN breaks USING (table_id, i, j) "
    "WHERE row_idx IS DISTINCT FROM suspect_row)",
    _compliance("fr_after", "pair_rest"),
    "fd AS (SELECT f.table_id, f.col_idx AS col_1_idx, g.col_idx AS col_2_idx, f.d_type AS d_type_1, "
    "g.d_type AS d_type_2, f.rows_range, f.col_idx AS left_ness_1, g.col_idx AS left_ness_2, "
    "f.avg_col_pre AS avg_col_pre_1, g.avg_col_pre AS avg_col_pre_2, b.fr AS fd, "
    "CASE WHEN b.fr = -1 THEN -1.0 ELSE r.fr END AS fd_p, "
    "CASE WHEN b.fr <> -1 THEN suspect_row END AS suspect_row "
    "FROM features f JOIN features g ON f.table_id = g.table_id AND f.col_idx < g.col_idx "
    "JOIN fr_before b ON b.table_id = f.table_id AND b.i = f.col_idx AND b.j = g.col_idx "
    "LEFT JOIN breaks s ON s.table_id = f.table_id AND s.i = f.col_idx AND s.j = g.col_idx "
    "LEFT JOIN fr_after r ON r.table_id = f.table_id AND r.i = f.col_idx AND r.j = g.col_idx)",
]


def _score_pass(tag: str, source: str) -> list[str]:
    """Median, MAD and scores of the numbers x in `source`; no score where MAD is 0 or undefined."""

    def middle(name: str, value: str, frm: str, extra: str) -> str:
        return (
            f"{name} AS (SELECT table_id, col_idx, log, "
            f"max({value}) FILTER (rn = (c + 1) // 2) AS lo, max({value}) FILTER (rn = c // 2 + 1) AS hi, "
            "any_value(c) AS c FROM (SELECT *, row_number() OVER w AS rn, "
            f"count(*) OVER (PARTITION BY table_id, col_idx, log) AS c FROM {frm} {extra} "
            f"WINDOW w AS (PARTITION BY table_id, col_idx, log ORDER BY {value})) GROUP BY ALL)"
        )

    return [
        middle(f"med_{tag}", "x", source, ""),
        f"dev_{tag} AS (SELECT s.*, abs(x - CASE WHEN lo = hi THEN lo ELSE (lo + hi) / 2 END) AS d FROM {source} s "
        f"JOIN med_{tag} USING (table_id, col_idx, log) WHERE isfinite(lo))",
        middle(f"mad_{tag}", "d", f"dev_{tag}", ""),
        f"score_{tag} AS (SELECT s.*, d / ((lo + hi) / 2) AS score FROM dev_{tag} s "
        f"JOIN mad_{tag} USING (table_id, col_idx, log) WHERE lo + hi > 0)",
        f"top_{tag} AS (SELECT table_id, col_idx, log, max(score) AS score FROM score_{tag} GROUP BY ALL)",
        f"worst_{tag} AS (SELECT table_id, col_idx, log, score, min(row_idx) AS suspect_row FROM score_{tag} "
        f"JOIN top_{tag} USING (table_id, col_idx, log, score) GROUP BY ALL)",
    ]


NO = [
    "numbers AS (SELECT table_id, col_idx, false AS log, row_idx, x FROM cells WHERE x IS NOT NULL UNION ALL "
    "SELECT table_id, col_idx, true, row_idx, CASE WHEN x = 0 THEN '-inf'::DOUBLE ELSE ln(x) END "
    "FROM (SELECT * FROM cells WHERE x >= 0))",
    *_score_pass("1", "numbers"),
    "numbers_rest AS (SELECT n.* FROM numbers n JOIN worst_1 USING (table_id, col_idx, log) "
    "WHERE row_idx <> suspect_row)",
    *_score_pass("2", "numbers_rest"),
    "scores AS (SELECT a.table_id, a.col_idx, a.log, a.score AS s1, coalesce(b.score, '-inf'::DOUBLE) AS s2, "
    "a.suspect_row FROM worst_1 a LEFT JOIN worst_2 b USING (table_id, col_idx, log))",
    "no AS (SELECT p.table_id, p.col_idx, p.base_type AS d_type, p.rows_range, r.s1 AS max_mad, r.s2 AS max_mad_p, "
    "coalesce(l.s1, 'inf'::DOUBLE) AS max_mad_log, coalesce(l.s2, 'inf'::DOUBLE) AS max_mad_log_p, r.suspect_row "
    "FROM profile p JOIN (SELECT * FROM scores WHERE NOT log) r USING (table_id, col_idx) "
    "LEFT JOIN (SELECT * FROM scores WHERE log) l USING (table_id, col_idx))",
]

# levenshtein() of this engine counts bytes: give every other letter of the data one byte of its own.
LETTERS = "çäÄóèñÑÊíêüÖÜÍÈöÓÉéßÇ"
LETTER_BYTES = [*range(1, 9), *range(14, 14 + len(LETTERS) - 8)]
ONE_BYTE = (
    f"translate(text, '{LETTERS}', " + " || ".join(f"chr({c})" for c in LETTER_BYTES) + ")"
)
DIFFERENT = (
    f"list_concat(list_filter({PIECES.replace('text', 'text_i')}, lambda t: NOT list_contains({PIECES.replace('text', 'text_j')}, t)), "
    f"list_filter({PIECES.replace('text', 'text_j')}, lambda t: NOT list_contains({PIECES.replace('text', 'text_i')}, t)))"
)
SE = [
    f"words AS MATERIALIZED (SELECT table_id, col_idx, text, {ONE_BYTE} AS plain, count(*) AS n, min(row_idx) AS r "
    "FROM texts GROUP BY ALL)",
    # Neighbours in the order of texts: without any one text, two of the three smallest of their
    # distances lose a pair at most, so no distance that is asked for is above the third.
    "beside AS (SELECT table_id, col_idx, levenshtein(plain, lag(plain) OVER (PARTITION BY table_id, col_idx "
    "ORDER BY plain, r)) AS d FROM words)",
    "bounds AS (SELECT table_id, col_idx, coalesce(list_sort(list(d) FILTER (d IS NOT NULL))[3], 2147483647) AS bound "
    "FROM beside GROUP BY ALL)",
    "distances AS MATERIALIZED (SELECT a.table_id, a.col_idx, CAST(levenshtein(a.plain, b.plain) AS DOUBLE) AS d, "
    "a.r AS i, b.r AS j FROM words a JOIN words b ON a.table_id = b.table_id AND a.col_idx = b.col_idx AND a.r < b.r "
    "JOIN bounds t ON t.table_id = a.table_id AND t.col_idx = a.col_idx WHERE levenshtein(a.plain, b.plain) <= bound)",
    "first_pair AS (SELECT * FROM distances QUALIFY row_number() OVER "
    "(PARTITION BY table_id, col_idx ORDER BY d, i, j) = 1)",
    "closest AS MATERIALIZED (SELECT p.*, a.text AS text_i, b.text AS text_j, a.n AS n_i, b.n AS n_j FROM first_pair p "
    "JOIN words a ON a.table_id = p.table_id AND a.col_idx = p.col_idx AND a.r = p.i "
    "JOIN words b ON b.table_id = p.table_id AND b.col_idx = p.col_idx AND b.r = p.j)",
    "left_i AS (SELECT c.table_id, c.col_idx, min(o.d) AS d_i FROM closest c JOIN distances o "
    "USING (table_id, col_idx) WHERE c.n_i > 1 OR (o.i <> c.i AND o.j <> c.i) GROUP BY ALL)",
    "left_j AS (SELECT c.table_id, c.col_idx, min(o.d) AS d_j FROM closest c JOIN distances o "
    "USING (table_id, col_idx) WHERE c.n_j > 1 OR (o.i <> c.j AND o.j <> c.j) GROUP BY ALL)",
    f"spelled AS (SELECT *, list_distinct({DIFFERENT}) AS diff FROM closest LEFT JOIN left_i USING (table_id, col_idx) "
    "LEFT JOIN left_j USING (table_id, col_idx))",
    "se AS (SELECT table_id, col_idx, base_type, d_type, rows_range, "
    f"{_range('list_avg(list_transform(diff, lambda t: length(t)))', LENGTHS)} AS range_mpd, d AS mpd, "
    "greatest(coalesce(d_i, 'inf'::DOUBLE), coalesce(d_j, 'inf'::DOUBLE)) AS mpd_p, "
    "CASE WHEN coalesce(d_j, 'inf'::DOUBLE) > coalesce(d_i, 'inf'::DOUBLE) THEN j ELSE i END AS suspect_row, i, j "
    "FROM spelled JOIN profile USING (table_id, col_idx) WHERE len(diff) > 0)",
]

# ---- models and findings -------------------------------------------------------------------------

# Tables in the order of a hash; the first int(0.8 * n) are for training.
SPLIT = (
    "split AS (SELECT table_id, row_number() OVER (ORDER BY md5('0:' || table_id), table_id) <= "
    "floor(0.8::DOUBLE * count(*) OVER ()) AS train FROM (SELECT DISTINCT table_id FROM cells))"
)
IS_TRAIN = "table_id IN (SELECT table_id FROM split WHERE train)"
IS_TEST = "table_id IN (SELECT table_id FROM split WHERE NOT train)"
KEYS = {
    "uv": ["d_type", "rows_range", "left_ness", "avg_col_pre"],
    "fd": ["d_type_1", "d_type_2", "rows_range", "left_ness_1", "left_ness_2", "avg_col_pre_1", "avg_col_pre_2"],
    "no": ["d_type", "rows_range"],
    "se": ["d_type", "rows_range", "range_mpd"],
}
SCORES = {
    "uv": ["ur", "ur_p"],
    "fd": ["fd", "fd_p"],
    "no": ["max_mad", "max_mad_p"],
    "se": ["mpd", "mpd_p"],
}
MEASURES = {
    "uv": [*PROFILE, *PREVALENCE, *UV],
    "fd": [*PROFILE, *PREVALENCE, *FD],
    "no": [*PROFILE, *NO],
    "se": [*PROFILE, *SE],
}


def model_cte(kind: str) -> str:
    extra = {"no": ["max_mad_log", "max_mad_log_p"]}.get(kind, [])
    kept = {"uv": "ur IS NOT NULL", "fd": "fd <> fd_p"}.get(kind, "true")
    fields = ", ".join([*KEYS[kind], *SCORES[kind], *extra])
    return (
        f"{kind}_model AS (SELECT {fields}, count(*) AS w FROM {kind} "
        f"WHERE {IS_TRAIN} AND {kept} GROUP BY ALL)"
    )


def scored_cte(kind: str, where: str = "true") -> str:
    s1, s2 = SCORES[kind]
    on = " AND ".join(f"m.{k} = c.{k}" for k in KEYS[kind])

    def counts(t1: str, t2: str) -> tuple[str, str]:
        if kind == "no":
            return f"m.{t1} >= c.{s2}", f"m.{t1} >= c.{s1} AND m.{t2} <= c.{s2}"
        return f"m.{t1} <= c.{s2}", f"m.{t1} <= c.{s1} AND m.{t2} >= c.{s2}"

    def total(condition: str) -> str:
        return f"CAST(coalesce(sum(m.w) FILTER ({condition}), 0) AS BIGINT)"

    p_dt, p_dot = counts(s1, s2)
    fields = [f"{total(p_dt)} AS p_dt", f"{total(p_dot)} AS p_dot"]
    lr, emitted = "p_dot / nullif(p_dt, 0)", "p_dt > 0"
    if kind == "no":
        l_dt, l_dot = counts("max_mad_log", "max_mad_log_p")
        fields += [f"{total(l_dt)} AS p_dt_log", f"{total(l_dot)} AS p_dot_log"]
        lr = f"greatest({lr}, p_dot_log / nullif(p_dt_log, 0))"
        emitted = "true"
    if kind == "fd":
        emitted = "p_dt > 0 AND p_dot > 0"
    return (
        f"{kind}_scored AS (SELECT *, {lr} AS LR FROM (SELECT c.*, {', '.join(fields)} FROM "
        f"(SELECT * FROM {kind} WHERE {IS_TEST} AND {where} AND suspect_row IS NOT NULL AND {s1} <> {s2}) c "
        f"LEFT JOIN {kind}_model m ON {on} GROUP BY ALL) WHERE {emitted})"
    )


# What the options of the measures change: the mean prevalence of a column, and buckets taken twice.
_SUM, _LENGTH = "round(coalesce(sum(p), 0), 6)", "list_avg(list_transform(diff, lambda t: length(t)))"


def with_options(ctes: list[str]) -> list[str]:
    """Steps of the measures with mean prevalences and double buckets."""
    twice = _range(f"({_range(_LENGTH, LENGTHS)})", LENGTHS)
    return [
        c.replace(_SUM, f"round({_SUM} / count(*), 6)").replace(_range(_LENGTH, LENGTHS), twice) for c in ctes
    ]


def prefixed(ctes: list[str], prefix: str) -> list[str]:
    """The same steps under other names, so that two lakes fit into one query."""
    names = "|".join(sorted((re.escape(c.split(" AS ", 1)[0]) for c in ctes), key=len, reverse=True))
    uses = re.compile(rf"(?:(?<=FROM )|(?<=JOIN ))({names})\b|^({names})(?= AS )|\b({names})(?=\.)")
    return [uses.sub(lambda m: prefix + m.group(0), c) for c in ctes]


def other_lake(kind: str, learnt: SqlLake, lake: SqlLake) -> list[str]:
    """Candidates of all of `lake`, scored by a model of all of `learnt` and with that one's tokens."""
    model = model_cte(kind).replace(IS_TRAIN, "true")
    steps = with_options(MEASURES[kind])
    own = [c.replace("LEFT JOIN lake_tokens", "LEFT JOIN learnt_lake_tokens") for c in steps]
    scored = scored_cte(kind).replace(IS_TEST, "true").replace(f"JOIN {kind}_model", f"JOIN learnt_{kind}_model")
    return [*prefixed([*learnt.ctes(), *steps, model], "learnt_"), *lake.ctes(), *own, scored]


NAMES = {"uv": "uniqueness", "no": "no", "se": "spelling"}


def cell_findings(kind: str, clean: str = "NULL", error: str = "CAST(NULL AS BOOLEAN)", truth: str = "") -> str:
    name = "ground_truth" if kind == "se" else "correct_value"
    return (
        f"SELECT '{NAMES[kind]}' AS error_type, s.table_id AS path, col_name, s.suspect_row AS row_idx, s.col_idx, "
        f"s.LR, c.value, CAST({clean} AS VARCHAR) AS {name}, {error} AS error FROM {kind}_scored s "
        "JOIN meta USING (table_id, col_idx) JOIN cells c ON c.table_id = s.table_id AND c.col_idx = s.col_idx "
        f"AND c.row_idx = s.suspect_row {truth}"
    )


def pair_findings() -> str:
    return (
        "SELECT 'fd' AS error_type, s.table_id AS path, m1.col_name AS col_1_name, m2.col_name AS col_2_name, "
        "s.suspect_row AS row_idx, s.col_1_idx, s.col_2_idx, s.LR, c1.value AS value_1, c2.value AS value_2, "
        "CAST(NULL AS VARCHAR) AS correct_value_1, CAST(NULL AS VARCHAR) AS correct_value_2, "
        "CAST(NULL AS BOOLEAN) AS error FROM fd_scored s "
        "JOIN meta m1 ON m1.table_id = s.table_id AND m1.col_idx = s.col_1_idx "
        "JOIN meta m2 ON m2.table_id = s.table_id AND m2.col_idx = s.col_2_idx "
        "JOIN cells c1 ON c1.table_id = s.table_id AND c1.col_idx = s.col_1_idx AND c1.row_idx = s.suspect_row "
        "JOIN cells c2 ON c2.table_id = s.table_id AND c2.col_idx = s.col_2_idx AND c2.row_idx = s.suspect_row"
    )
