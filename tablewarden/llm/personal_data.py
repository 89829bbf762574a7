"""Personal data by fixed forms, and by contexts that bootstrapping learns from them.

Emails, IP addresses, card and phone numbers in their usual forms are the seeds. The words around a
seed make lexical patterns, such as `reach me at _` or `call _ before`. Patterns and the identifiers
in their slots are a graph: a pattern is worth the share of its identifiers that are known, and an
identifier that no form knows is worth what the other patterns around it are. After a few rounds, the
patterns of high confidence give the identifiers that were not seen by form.

Any token with a digit or an @ is an identifier of the graph, so that a pattern in front of years,
versions or keys loses confidence. What a trusted pattern gives must still be like its kind: see
`_fits`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tablewarden.llm.common import slices
from tablewarden.session import ship_package, stage

KINDS = ["email", "ip", "card", "phone"]

# The forms. Possessive repeats give the same matches and never go back.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Tokens that may be identifiers: numbers in groups, colon-separated hexadecimals, words.
_TOKEN = re.compile(
    r"\(?[0-9][0-9().-]*+(?:\x20[0-9(][0-9().-]*+){0,7}+(?![\w@:])"
    r"|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])"
    r"|[\w.%+#-]++(?:(?:@|\(at\)|\[at\])[\w.%+#-]++)?+"
)
_MARK = re.compile(r"[0-9@]|\(at\)|\[at\]")
_DIGIT = re.compile("[0-9]")
# Characters of a token at least, and of context looked at on its left and right.
LEAST_TOKEN, LEFT, RIGHT = 5, 64, 32
# Copies of a pattern's or an identifier's summary, so that a hot one is spread over as many tasks.
SALTS = 8


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: of each @ the longest name before it, and the domain after it if it is one."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_ip(form: str) -> bool:
    parts = [p.lstrip("0") for p in form.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(form: str) -> bool:
    digits = form.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(form: str) -> bool:
    return 9 <= len(_DIGIT.findall(form)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the forms, by kind and start; kinds do not hinder each other."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, form, holds in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
            spans += [(kind, m.start(), m.end()) for m in form.finditer(text) if holds(m.group())]
    return spans


def _fits(token: str) -> int:
    """Bits of the kinds that an unseen identifier may be of.

    An email has a name and a host around its @ or its (at); an address three groups or more of
    digits with points or of hexadecimals with colons; a card 8 digits or more and a phone 6 to 15,
    both without letters.
    """
    bits = 1 if re.fullmatch(r"[\w.%+#-]+(?:@|\(at\)|\[at\])[\w.%+#-]+", token) else 0
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+){2,}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}", token):
        bits |= 2
    if not re.search(r"[^\W\d_]|[@:_%#]", token):
        digits = len(_DIGIT.findall(token))
        bits |= 4 * (digits >= 8) | 8 * (6 <= digits <= 15)
    return bits


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of a span: two words before it, and the words on both sides, within its line.

    Words are lowered and their digits read as 0; ^ and $ stand for the ends of the line.
    """
    low = text.rfind("\n", max(0, start - LEFT), start) + 1 or max(0, start - LEFT)
    high = text.find("\n", end, end + RIGHT)
    left = ["^", "^", *_DIGIT.sub("0", text[low:start].lower()).split()]
    right = [*_DIGIT.sub("0", text[end : high if high >= 0 else end + RIGHT].lower()).split(), "$"]
    return [f"{left[-2]} {left[-1]} _", f"{left[-1]} _ {right[0]}"]


def identifiers(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, str, list[str]]]:
    """(start, end, kinds, fits, name, patterns) of all forms and other tokens with a digit or an @.

    `kinds` are the bits of the forms there, none for other tokens, which overlap no form.
    """
    forms: dict[tuple[int, int], int] = {}
    for kind, a, b in base:
        forms[a, b] = forms.get((a, b), 0) | 1 << kind
    found = [(a, b, bits, 0) for (a, b), bits in sorted(forms.items())]
    if _MARK.search(text):
        edge, taken = 0, sorted(forms)
        for m in _TOKEN.finditer(text):
            token = m.group().rstrip(".-( ")
            if len(token) < LEAST_TOKEN or not _MARK.search(token):
                continue
            a, b = m.start(), m.start() + len(token)
            while edge < len(taken) and taken[edge][1] <= a:
                edge += 1
            if edge == len(taken) or taken[edge][0] >= b:
                found.append((a, b, 0, _fits(token)))
    return [(a, b, bits, fits, text[a:b].lower(), contexts(text, a, b)) for a, b, bits, fits in found]


_FOUND = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("kinds", T.IntegerType()),
        T.StructField("fits", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("patterns", T.ArrayType(T.StringType())),
    ]
)
_SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    field = ["start", "end", "kinds", "fits", "name", "patterns"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    for part in (p for b in batches for p in slices(b, b.column(1))):
        texts = [t or "" for t in part.column(1).to_pylist()]
        forms = [base_spans(t) for t in texts]
        base = [[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in forms]
        found = [[dict(zip(field, x)) for x in identifiers(t, spans)] for t, spans in zip(texts, forms)]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(pa.struct(list(zip(field, kinds)))))],
            ["_row", "_base", "_found"],
        )


def _joined(big: DataFrame, summary: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Inner join in which a hot key of `big` is dealt to SALTS tasks by the column `spread`."""
    salted = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "_salt"]).drop("_salt")


def _has(bits: str, kind: int) -> Column:
    return F.col(bits).bitwiseAND(1 << kind) != 0


def trusted_identifiers(entries: DataFrame, support: int, confidence: int, rounds: int) -> DataFrame:
    """(pattern, name, kind): unseen identifiers in the slots of patterns of high confidence.

    `entries` has (pattern, name, kinds, fits), copies included, which count once. For each kind a
    pattern with at least `support` different seeds has the confidence, in thousandths,
    (1000 seeds + what its unseen identifiers are worth) / (identifiers + 1). An unseen identifier is
    worth 1 - the product of (1 - confidence) over its patterns; where it counts for a pattern, over
    its other patterns. Worths begin at 0. All is in whole numbers, so that reruns agree.
    """
    edges = stage(
        entries.groupBy("pattern", "name").agg(F.bit_or("kinds").alias("kinds"), F.bit_or("fits").alias("fits")), "edges"
    )
    ks = range(len(KINDS))
    patterns = edges.groupBy("pattern").agg(
        F.count("*").alias("n"), *[F.count_if(_has("kinds", k)).alias(f"seeds_{k}") for k in ks]
    )
    supported = stage(patterns.where(" OR ".join(f"seeds_{k} >= {support}" for k in ks)), "patterns")
    unseen = stage(_joined(edges.where("kinds = 0").drop("kinds"), supported.select("pattern"), ["pattern"], "name"), "unseen")
    worths = None
    for number in range(rounds):
        known = supported
        if worths is not None:
            known = supported.join(worths, "pattern", "left")
        known = stage(
            known.select(
                "pattern",
                *[
                    F.when(
                        F.col(f"seeds_{k}") >= support,
                        F.floor((1000 * F.col(f"seeds_{k}") + (F.coalesce(f"worth_{k}", F.lit(0)) if number else 0)) / (F.col("n") + 1)),
                    ).otherwise(0).cast("long").alias(f"conf_{k}")
                    for k in ks
                ],
            ),
            "confidence",
        )
        # Logarithms of what is left, in millionths: whole numbers add up alike in any order.
        left = [F.round(F.log(1 - F.col(f"conf_{k}") / 1000) * 1_000_000).cast("long").alias(f"own_{k}") for k in ks]
        held = stage(_joined(unseen, known, ["pattern"], "name").select("pattern", "name", "fits", *[f"conf_{k}" for k in ks], *left), "held")
        totals = held.groupBy("name").agg(*[F.sum(f"own_{k}").alias(f"all_{k}") for k in ks])
        both = _joined(held, totals, ["name"], "pattern")

        def worth(logs: Column) -> Column:
            return F.floor(1000 - 1000 * F.exp(logs / 1_000_000))

        if number < rounds - 1:
            worths = stage(
                both.groupBy("pattern").agg(
                    *[F.sum(worth(F.col(f"all_{k}") - F.col(f"own_{k}"))).alias(f"worth_{k}") for k in ks]
                ),
                "worths",
            )
    sure = [
        (_has("fits", k) & (F.col(f"conf_{k}") >= confidence) & (worth(F.col(f"all_{k}")) >= confidence), F.lit(k)) for k in ks
    ]
    kind = F.coalesce(*[F.when(condition, k) for condition, k in sure])
    return stage(both.select("pattern", "name", kind.alias("kind")).where("kind IS NOT NULL"), "trusted")


def find_personal(
    docs: DataFrame, support: int = 5, confidence: int = 800, rounds: int = 3, carry: list[str] | None = None
) -> DataFrame:
    """The columns in `carry` (doc_id alone by default), and of every document `base`, the spans of the
    forms, and `spans`, these and what trusted patterns add: arrays of (kind, start, end), kind an
    index into KINDS, places in code points, ordered by kind and start.

    A pattern needs `support` different seeds of a kind, copies of texts thus counting once, and
    `confidence` thousandths. What it adds overlaps no form. Null and empty texts have no spans;
    repeated rows are documents of their own; null ids stay null; an empty table gives no rows. Texts
    are searched whole, in time linear in their length; a task holds one text, or about a megabyte of
    them, and some 300 bytes for each identifier. Carried columns called base or spans are replaced.
    """
    ship_package(docs.sparkSession)
    carry = [c for c in (["doc_id"] if carry is None else carry) if c not in ("base", "spans")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.col("text").alias("_text"))
    made = [T.StructField("_base", _SPANS), T.StructField("_found", T.ArrayType(_FOUND))]
    schema = T.StructType([rows.schema["_row"], *made])
    scanned = stage(rows.mapInArrow(_scan, schema).withColumn("_id", F.monotonically_increasing_id()), "scanned")
    entries = scanned.select("_id", F.explode("_found").alias("f")).select("_id", "f.*")
    slots = entries.select("_id", "start", "end", "kinds", "fits", "name", F.explode("patterns").alias("pattern"))
    trusted = trusted_identifiers(slots, support, confidence, rounds)
    placed = slots.where("kinds = 0").withColumn("_at", F.xxhash64("_id", "start"))
    added = (
        _joined(placed, trusted, ["pattern", "name"], "_at")
        .groupBy("_id", "start", "end")
        .agg(F.min("kind").alias("kind"))
        .groupBy("_id")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("_added"))
    )
    none = F.array().cast(_SPANS)
    return scanned.join(added, "_id", "left").select(
        "_row.*",
        F.col("_base").alias("base"),
        F.array_sort(F.concat("_base", F.coalesce("_added", none))).alias("spans"),
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def counted(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span written as [KIND]; of overlapping spans, those that start first.

    For the result of `find_personal` with "text" carried. A null text stays null.
    """

    @arrow_udf("string")
    def write(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, spans_ in zip(texts.to_pylist(), found.to_pylist()):
            parts, upto = [], 0
            for s in sorted(spans_ or [], key=lambda s: (s["start"], s["end"], s["kind"])):
                if s["start"] >= upto:
                    parts += [(t or "")[upto : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                    upto = s["end"]
            out.append(None if t is None else "".join(parts) + t[upto:])
        return pa.array(out, pa.string())

    return write(text, spans)
