"""The operators once more, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def tie(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def simhash(text, shingle):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    grams = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows, shingle=3, bits=3):
    """(fingerprint, smallest id) of each (id, text)."""
    prints = [simhash(t, shingle) for _, t in rows]
    sets = Sets()
    kinds = sorted(set(prints))
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= bits:
                sets.tie(a, b)
    least = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        least[sets.root(p)].append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return [(p, least[sets.root(p)]) for p in prints]


def shingles(text, width=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def near_groups(rows, width=5):
    """Smallest row number of the group of each (id, text), by the similarity of all pairs."""
    grams = [shingles(t, width) for _, t in rows]
    sets = Sets()
    for i, a in enumerate(grams):
        sets.root(i)
        for j, b in enumerate(grams[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                sets.tie(i, j)
    return [sets.root(i) for i in range(len(rows))]


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(inside)


def one_edit(a, b):
    """Edit distance of at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]


def line_dedup(rows, text_hash, edits=1, least=20):
    """Texts without dropped lines, by row; rows alike in id and text are one document."""
    docs = sorted({(i is None, i or 0, text_hash(t), t or "") for i, t in rows if t is not None})
    before, by_length, gone = set(), defaultdict(set), {}
    for doc in docs:
        keep = []
        for line in doc[3].split("\n"):
            near = False
            if WORD.search(line):
                near = line in before
                if not near and edits and len(line) >= least:
                    near = any(one_edit(line, x) for n in (-1, 0, 1) for x in by_length[len(line) + n] if n or x != line)
                before.add(line)
                if len(line) >= least:
                    by_length[len(line)].add(line)
            if not near:
                keep.append(line)
        gone[doc[:3]] = "\n".join(keep)
    return [None if t is None else gone[i is None, i or 0, text_hash(t)] for i, t in rows]


def substrings(rows, text_hash, length=100):
    """(bytes, removed, spans, sha256 of the rest) by row."""
    docs = sorted({(i is None, i or 0, text_hash(t), (t or "").encode()) for i, t in rows})
    seen, found = set(), {}
    for doc in docs:
        text = doc[3]
        gone = bytearray(len(text))
        for k in range(len(text) - length + 1):
            window = text[k : k + length]
            if window in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(window)
        left = bytes(c for c, g in zip(text, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        found[doc[:3]] = (len(text), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return [found[i is None, i or 0, text_hash(t)] for i, t in rows]


def lookup(shards, slots):
    """Slots claimed in turn, each shard walking a list of its preferences."""
    wishes = []
    for s in shards:
        h = hashlib.md5(s.encode()).hexdigest()
        at, skip = int(h[:8], 16) % slots, int(h[8:16], 16) % (slots - 1) + 1
        wishes.append([(at + j * skip) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for k, wish in enumerate(wishes):
            if len(owner) < slots:
                owner[next(s for s in wish if s not in owner)] = k
    return owner
