"""Personal data: forms against plain patterns, contexts against the same rules in dictionaries."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewarden.llm import personal_data, queries
from tablewarden.llm.personal_data import KINDS

SF_DIR = "/root/testdata/sf0.001"
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def holds(kind, form):
    digits = re.sub(r"[^0-9]", "", form)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in form.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def plain_spans(text):
    return [
        (KINDS.index(kind), m.start(), m.end())
        for kind, form in FORMS.items()
        for m in re.finditer(form, text)
        if holds(kind, m.group())
    ]


def plain_contexts(text, a, b):
    before, after = text[max(0, a - 64) : a].rsplit("\n", 1)[-1], text[b : b + 32].split("\n", 1)[0]
    left = ["^", "^"] + re.sub("[0-9]", "0", before.lower()).split()
    right = re.sub("[0-9]", "0", after.lower()).split() + ["$"]
    return [" ".join([*left[-2:], "_"]), f"{left[-1]} _ {right[0]}"]


def plain_added(texts, support, confidence, rounds):
    """What patterns add to each text."""
    slots, edges, names = [], defaultdict(set), {}
    for k, text in enumerate(texts):
        base = plain_spans(text)
        for a, b, kinds, fits, name, patterns in personal_data.identifiers(text, base):
            assert patterns == plain_contexts(text, a, b)
            assert kinds == sum(1 << kind for kind, c, d in base if (c, d) == (a, b))
            assert kinds or not any(c < b and d > a for _, c, d in base)
            assert name == text[a:b].lower()
            old = names.get(name, (0, 0))
            names[name] = (old[0] | kinds, old[1] | fits)
            for p in patterns:
                edges[p].add(name)
                if not kinds:
                    slots.append((k, a, b, name, p))
    seeds = {p: [sum(names[n][0] >> k & 1 for n in own) for k in range(4)] for p, own in edges.items()}
    worth = defaultdict(int)
    for number in range(rounds):
        conf = {
            p: [(1000 * s + worth[p, k]) // (len(own) + 1) if s >= support else 0 for k, s in enumerate(seeds[p])]
            for p, own in edges.items()
            if max(seeds[p]) >= support
        }
        held = [(p, n) for p in conf for n in edges[p] if not names[n][0]]
        log = {(p, k): round(math.log(1 - c / 1000) * 1_000_000) for p, cs in conf.items() for k, c in enumerate(cs)}
        total = Counter()
        for p, n in held:
            for k in range(4):
                total[n, k] += log[p, k]
        worth = defaultdict(int)
        for p, n in held:
            for k in range(4):
                worth[p, k] += math.floor(1000 - 1000 * math.exp((total[n, k] - log[p, k]) / 1_000_000))
    found = defaultdict(set)
    for k, a, b, name, p in slots:
        if p not in conf:
            continue
        good = [
            kind
            for kind in range(4)
            if names[name][1] >> kind & 1
            and conf[p][kind] >= confidence
            and math.floor(1000 - 1000 * math.exp(total[name, kind] / 1_000_000)) >= confidence
        ]
        if good:
            found[k, a, b].add(good[0])
    return [sorted((min(kinds), a, b) for (i, a, b), kinds in found.items() if i == k) for k in range(len(texts))]


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, _id int").repartition(3)
    found = personal_data.find_personal(df, **options).collect()
    texts = [t or "" for _, t in rows]
    added = plain_added(texts, **({"support": 5, "confidence": 800, "rounds": 3} | options))
    expected = Counter()
    for (i, _), text, more in zip(rows, texts, added):
        base = plain_spans(text)
        expected[i, tuple(base), tuple(sorted(base + more))] += 1
    assert Counter((r.doc_id, tuple(map(tuple, r.base)), tuple(map(tuple, r.spans))) for r in found) == expected
    return sum(map(len, added))


ALPHABET = "a@.-+ 01259()%_\n"


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(ALPHABET, max_size=60), st.lists(st.sampled_from(["1.2.3.4", "256.1.1.1", "a@b.c", "@", "+49 (30) 123-456", "4111 1111 1111 1111", ".", " ", "-", "x"])).map("".join)))
def test_forms_are_those_of_plain_patterns(text):
    assert personal_data.base_spans(text) == plain_spans(text)


def test_forms_in_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "1 " * 100_000 + "x", "+1" + " " * 200_000, "1.2." * 50_000, "a.1-" * 50_000):
        base = personal_data.base_spans(text)
        personal_data.identifiers(text, base)


def seeds(k):
    return [f"reach me at user{k}@mail{k}.example.com today", f"please call +1 (202) 555-{1000 + 37 * k} before noon\nserver 10.0.{k}.{k + 1} answers"]


LUHN = [n for n in range(4_000_000_000_000_000, 4_000_000_000_001_000) if luhn(str(n))]


def planted():
    rows = [(10 * k + j, t) for k in range(9) for j, t in enumerate(seeds(k))]
    rows += [(200 + k, f"card number {LUHN[k]} was charged") for k in range(8)]
    rows += [
        (300, "you can reach me at user99@localhost today, or reach me at ann(at)example.org today"),
        (301, "please call 555-0199-22 before noon\nplease call AKIA99XY before noon"),
        (302, "server 10.0.300.1 answers"),
        (303, "card number 4000 0000 0000 was charged"),
        (304, "in the year 12345 the version 10.0.300.1 was made"),
        (305, "please call 555-0199-22 after noon"),
    ]
    rows += [(400 + k, f"order number {7_000_000 + k} was sent") for k in range(30)]
    rows += [(500 + k, f"order number +1 (202) 666-{1000 + k} was sent") for k in range(6)]
    return rows


def test_contexts_find_unseen_identifiers(spark):
    rows = planted()
    assert check(spark, rows) >= 5
    # Copies add nothing to a pattern's worth, and all of them get the spans.
    assert check(spark, rows + [(900 + k, rows[-40][1]) for k in range(50)] + [(300, rows[-42][1])]) >= 5
    assert check(spark, rows, support=3, confidence=600, rounds=1) >= 5
    assert check(spark, rows, support=100) == 0


def test_redacted(spark):
    df = spark.createDataFrame([(1, "é call +1 (202) 555-1000, a@b.co"), (2, None), (3, "")], "doc_id long, text string")
    found = personal_data.find_personal(df, carry=["doc_id", "text"])
    out = dict(found.select("doc_id", personal_data.redacted(F.col("text"), F.col("spans"))).collect())
    assert out == {1: "é call [PHONE], [EMAIL]", 2: None, 3: ""}


def test_personal_whole_table(spark, documents, nothing):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(spark, rows, support=2, confidence=500)
    assert personal_data.find_personal(nothing).count() == 0
    assert personal_data.find_personal(documents, carry=documents.columns).columns == [*documents.columns, "base", "spans"]


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op11_personal_data(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        written = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
