"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts whose blanks do not all stand alone between other characters, as one pass over many texts.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN = rf"{_BLANK}{_BLANK}|\A{_BLANK}|{_BLANK}\z"
# Words whose ids a worker remembers at most, those that it met first: frequent words come early. A
# word costs about 200 bytes.
REMEMBERED = 600_000


class _Known(dict):
    def __init__(self, encode: Callable[[str], list[int]], most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word if word[:1] == "\n" else f" {word}")
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64 and len(self) < self.most:
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def _whole(tokenizer: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


@lru_cache(maxsize=4)
def largest_id(tokenizer: str) -> int:
    """The largest token id of a tokenizers file."""
    with open(tokenizer, encoding="utf-8") as file:
        known = json.load(file)
    return max([*known["model"]["vocab"].values(), *(t["id"] for t in known["added_tokens"])])


@lru_cache(maxsize=4)
def encoder(tokenizer: str, ranks: str, remembered: int = REMEMBERED) -> Callable[[pa.Array], Iterator[bytes]]:
    """A function from texts to the ids of each, as little-endian unsigned 32-bit numbers.

    `tokenizer` is the vocabulary's tokenizers file, `ranks` the same vocabulary for tiktoken. The
    vocabulary's pattern always starts a new piece at a blank or line end that stands alone between
    other characters, so the ids of such a text are those of its words, and words repeat. Other
    texts are encoded as one. Strings of special tokens inside a text count as these tokens, as the
    tokenizers file says; texts with one go through that library. A null text has no ids.
    `remembered` words stay in the memory of a worker as long as it lives.
    """
    import public_tokenizers
    import tiktoken

    with open(tokenizer, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
    plain = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
    ).encode_ordinary
    known = _Known(plain, remembered)

    def one(text: str, has_run: bool) -> bytes:
        if any(s in text for s in special):
            return np.array(_whole(tokenizer).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if has_run:
            return np.array(plain(text), "<u4").tobytes()
        words = text.replace("\n", " \n").split(" ")
        first = np.array(plain(words[0]), "<u4").tobytes()
        return first + b"".join(map(known.__getitem__, words[1:]))

    def encode(texts: pa.Array) -> Iterator[bytes]:
        runs = pc.match_substring_regex(texts, _RUN)
        for text, has_run in zip(texts.to_pylist(), runs.to_pylist(), strict=True):
            yield one(text, has_run) if text else b""

    return encode
