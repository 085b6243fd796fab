"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut at special tokens and then by the vocabulary's word pattern. Each
word holds two short arrays: the ids of its parts and the merge ranks of
adjacent parts. The lowest rank is searched by scanning, its boundary deleted,
and the ranks beside it refreshed, until no rank is left. Words of more than
``SCAN_LIMIT`` bytes take the same merges from a heap, so that one endless word
does not cost the square of its length; the results are equal.

Encoding needs no shuffle: each task encodes its own texts and remembers the
words it has seen (a bounded cache that worker processes keep between tasks).
The vocabulary is read once, by the driver, and broadcast; its size is that of
the public file, whatever the corpus.

Defined cases: null text is empty (no ids); texts of any length are encoded
whole; invalid UTF-8 is read with replacement characters; ids that are not in
the vocabulary decode to nothing; null ids rows, repeated rows and extra
columns keep their rows and are not looked at; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, utf8

#: Unicode White_Space, as the pattern's \s.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Word pattern of the byte-level vocabulary (fixed value).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + BLANK + r"\p{L}\p{N}]+|["
           + BLANK + r"]+(?![^" + BLANK + r"])|[" + BLANK + r"]+")
#: Words longer than this many bytes take their merges from a heap.
SCAN_LIMIT = 200
#: Words that a worker process remembers.
CACHE_WORDS = 300_000

_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes for
    themselves, the others for the letters from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def unsettled(text: str) -> bool:
    """True if the text holds code points that were unassigned in this Python's
    Unicode version: pattern libraries of other versions class them otherwise."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file (JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        ids: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = self.byte_of = {c: b for b, c in enumerate(letters)}
        self.source = source
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = [ids[c] for c in letters]
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.token_bytes = [b""] * self.size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {ids[a] * self.size + ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        self.word = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ids = [self.first[b] for b in word]
        if len(ids) > SCAN_LIMIT:
            return self._merge_long(ids)
        size, rank_of, merged = self.size, self.rank.get, self.merged
        ranks = [rank_of(a * size + b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)  # the leftmost of equal ranks
            ids[i] = merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] * size + ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] * size + ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        size, rank_of = self.size, self.rank.get
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := rank_of(ids[i] * size + ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        alive = [True] * n

        def push(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank_of(ids[i] * size + ids[j], _NONE)) != _NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue  # stale
            ids[i] = self.merged[r]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return [x for x, on in zip(ids, alive, strict=True) if on]

    def split(self, text: str) -> list[str]:
        """Words of a text; the tokenizers library splits texts with unsettled code points."""
        if not unsettled(text):
            return self.word.findall(text)
        from tokenizers import Tokenizer
        pieces = Tokenizer.from_str(self.source).pre_tokenizer.pre_tokenize_str(text)
        return [bytes(self.byte_of[c] for c in p).decode("utf-8") for p, _ in pieces]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        cache, out = self.cache, []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            words = self.split(part)
            new = {w for w in words if w not in cache}
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
                new = set(words)
            for w in new:
                cache[w] = np.array(self.merge_word(w.encode()), "<u4").tobytes()
            out.append(b"".join([cache[w] for w in words]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian unsigned 32-bit integers), special tokens included."""
        known, n = self.token_bytes, self.size
        return b"".join([known[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n]).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def loaded(source: str) -> Vocabulary:
    """The vocabulary of a file's text, built once per worker process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(source)
    return _LOADED[key]


def _source(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): little-endian unsigned 32-bit ids of every text.
    ``path`` names the vocabulary file on the driver."""
    source = _source(docs, path)

    def make():
        vocab = loaded(source.value)

        def run(b):
            return {"id": b.column(0), "ids": [vocab.encode(t.decode("utf-8", "replace")) for t in b.column(1).to_pylist()]}
        return run

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")), make,
                       "id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, text) of (id, ids binary); null ids give the empty text."""
    source = _source(encoded, path)

    def make():
        vocab = loaded(source.value)

        def run(b):
            ids = b.column(1).to_pylist()
            return {"id": b.column(0), "ids": b.column(1), "text": [vocab.decode(x or b"") for x in ids]}
        return run

    return map_batches(encoded.select("id", "ids"), make, "id long, ids binary, text string")
