"""Cost-balanced packing of documents into training sequences.

A piece of n tokens is estimated to cost ``linear * n + quadratic * n * n``.
Documents are taken by descending cost, each going to the lowest-cost sequence
that still has room for all of it. Whole multiples of the sequence length are
cut off long documents first (such a piece fills a sequence alone), and what
fits into no sequence whole is cut over the lowest-cost sequences with room.
A pool of documents opens just the room it needs: sequences of full length and,
for the rest, one sequence for each power of two in it, so none is padded.

Pools are bounded (``POOL_TOKENS``) and live within one task: no shuffle, and
nothing grows with the corpus. A task closes its last pool where its rows end.

Defined cases: null text is an empty document, which is its closing id alone;
texts of any length are packed whole; ties keep the order of rows; repeated
rows and null ids are packed as rows of their own; extra columns are ignored;
an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.llm.bpe import BLANK, byte_letters, unsettled
from faultline.llm.common import WordCache, schema_of, utf8
from faultline.llm.pieces import SIGNS

#: Tokens of a sequence.
SEQUENCE = 2048
#: Id that closes a document.
END_ID = 1
#: Tokens of the documents that are packed together.
POOL_TOKENS = 4_000_000
#: Estimated cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Words, and pieces of words, whose ids a worker process remembers, in each of two generations.
CACHE_WORDS, CACHE_PIECES = 150_000, 50_000

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary, cost double")


def assign(lengths: list[int], capacity: int = SEQUENCE, linear: float = LINEAR,
           quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one pool."""
    pieces, sequences = [], 0
    start = np.zeros(len(lengths), np.int64)
    left = np.array(lengths, np.int64)
    for d in np.flatnonzero(left >= capacity).tolist():
        for _ in range(int(left[d]) // capacity):
            pieces.append((d, int(start[d]), capacity, sequences, 0))
            start[d] += capacity
            sequences += 1
    left -= start
    total = int(left.sum())
    rest = total % capacity
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    room, used, cost = np.array(rooms, np.int64), np.zeros(len(rooms), np.int64), np.zeros(len(rooms))
    price = linear * left + quadratic * left.astype(float) ** 2

    def place(d: int, s: int, n: int) -> None:
        pieces.append((d, int(start[d]), n, sequences + s, int(used[s])))
        start[d] += n
        left[d] -= n
        used[s] += n
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    order = [d for d in np.argsort(-price, kind="stable").tolist() if left[d]]
    for d in order:
        fits = np.flatnonzero(room >= left[d])
        if len(fits):
            place(d, int(fits[np.argmin(cost[fits])]), int(left[d]))
    for d in order:
        while left[d]:
            open_ = np.flatnonzero(room)
            s = int(open_[np.argmin(cost[open_])])
            place(d, s, int(min(left[d], room[s])))
    return pieces


class WordIds:
    """Ids of whole texts, each word coded once by the tokenizer's model.

    A tokenizer that normalises (NFC, blanks, lower case) and splits by a
    pattern that drops blanks is followed word by word: the text is normalised
    and split here, and the model codes the words not met before. Any other
    tokenizer codes the whole text itself.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(source)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.by_word = self._splits_words(spec)
        if self.by_word:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.word = regex.compile(pattern.replace(r"\s", BLANK))
            self.letters = dict(enumerate(byte_letters()))
            self.model = self.tokenizer.model
            self.words = WordCache(self.code_word, CACHE_WORDS)  # as they stand between blanks
            self.pieces = WordCache(self.code, CACHE_PIECES)  # as the pattern splits them

    @staticmethod
    def _splits_words(spec: dict) -> bool:
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        return (normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"]
                and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["add_prefix_space"]
                and not pre[1]["use_regex"] and plain)

    def code(self, word: str) -> bytes:
        spelt = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def code_word(self, word: bytes) -> bytes:
        """Words of plain letters alone are one piece, spelt as they are; they are remembered as words only."""
        if word.isalpha():
            return array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        text = word.decode()
        if text[-1] in SIGNS and word[:-1].isalpha():  # one sign after plain letters is a piece of its own
            return self.pieces.join((text[:-1], text[-1]))
        return self.pieces.join(self.word.findall(text))

    def __call__(self, text: bytes) -> bytes:
        whole = text.decode("utf-8", "replace")
        if not self.by_word:
            return np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for part in self.cut.split(whole) if self.cut else [whole]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            if unsettled(part):
                out.append(np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # the library lowers letter by letter; only capital sigma looks at its neighbours in Python
            part = "".join([c.lower() for c in part]) if "\u03a3" in part else part.lower()
            out.append(self.words.join(part.encode().split()))
        return b"".join(out)


_LOADED: dict[int, WordIds] = {}


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE,
         end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC,
         pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Pieces of every document (``PIECES``): doc_id, start in the document's
    ids, length, ids_crc32, doc_tokens (with the closing id), sequence_id,
    offset in the sequence, ids (little-endian unsigned 32-bit) and cost, the
    estimate for the piece. ``path`` names the tokenizer file on the driver."""
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = schema_of(PIECES)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(source.value.encode())
        if key not in _LOADED:
            _LOADED[key] = WordIds(source.value)
        word_ids = _LOADED[key]
        first = TaskContext.get().partitionId() << 36  # sequence numbers of a task
        types = to_arrow_schema(schema)
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker held
        pool: list[tuple[int | None, bytes]] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal first, size
            pieces = assign([len(ids) // 4 for _, ids in pool], capacity, linear, quadratic)
            rows = []
            for d, s, n, seq, at in pieces:
                doc, ids = pool[d]
                part = ids[4 * s:4 * (s + n)]
                rows.append((doc, s, n, zlib.crc32(part), len(ids) // 4, first + seq, at, part,
                             linear * n + quadratic * n * n))
            first += 1 + max((p[3] for p in pieces), default=-1)
            pool.clear()
            size = 0
            for i in range(0, len(rows), 20_000):
                cols = zip(*rows[i:i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(cols, types, strict=True)],
                                                 names=types.names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pool.append((doc, word_ids(text) + end))
                size += len(pool[-1][1]) // 4
                if size >= pool_tokens:
                    yield from close()
        if pool:
            yield from close()

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).mapInArrow(run, schema)
