"""Alignment of two tokenizers over a corpus, with corpus-wide counts of linked ids.

Side A is a byte-level BPE, side B a sentencepiece model; both read a text with
a space before it. Byte offsets where tokens of both sides end cut them into
groups; an A and a B token whose byte ranges overlap are a link. A pair of ids
counts as many documents as hold it linked.

Counting is an external sort: records are spilled as compressed, sorted runs and
merged.

* A task codes its documents in chunks and keeps, for each chunk, which documents
  hold which pairs how often (compressed, in the written table of chunks). The
  documents of a chunk are counted by pair, so a pair of every document is one
  record for each chunk, not for each document.
* Each chunk's (pair, documents) records are dealt by the A id to ``RADIX`` runs,
  sorted by A id, then B id: blocks of zstd.
* ``FAN_IN`` runs of a radix at a time are merged through a heap of the runs'
  next blocks, and the merged runs likewise, until one is left in each radix:
  no task ever holds more than ``FAN_IN`` runs. All pairs of an A id stand
  together in the last run, whose neighbours give the id's highest count.
* Counts and best marks go back down the same levels, aligned with the records of
  each run, and last to the chunk, which adds them up for its documents.

Words (parts of a text between cuts where tokens of both sides always end) are
aligned once while a worker remembers them.

Defined cases: null and empty texts, and texts whose joined token bytes differ
from the text with its space (those holding U+2581, for one), have no tokens:
zeros, and an empty ``groups``; texts of any length are aligned whole; tied
counts all are an A id's highest; repeated rows and null ids are documents of
their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.llm.bpe import byte_letters
from faultline.llm.common import schema_of, utf8
from faultline.llm.pieces import PartIds, Pieces
from faultline.session import materialize

#: Runs that the records of a chunk are dealt to, and runs that are merged at a time.
RADIX, FAN_IN = 128, 64
#: Records of a block of a run.
BLOCK = 8192
#: Links and documents that close a chunk.
CHUNK_LINKS, CHUNK_DOCS = 1 << 20, 4000
#: Parts of texts that a worker process remembers, in each of two generations.
CACHE_PARTS = 200_000

MARK = "▁"


def _texts(numbers: int) -> np.ndarray:
    """Four byte strings for each number: followed by nothing, comma, bar and semicolon."""
    return np.array([f"{i}{end}".encode() for i in range(numbers) for end in ("", ",", "|", ";")], object)


class Aligner:
    """Records of words: (group string closed by a semicolon, links as A id << 32 |
    B id, numbers of A tokens, B tokens and groups); None where bytes differ."""

    def __init__(self, source: str, model: bytes):
        self.a = PartIds(source, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        vocab = json.loads(source)["model"]["vocab"]
        a_bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            a_bytes[i] = bytes(byte_of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = np.array(a_bytes, object), np.array(b_bytes, object)
        self.a_size, self.b_size = np.array([len(x) for x in a_bytes]), np.array([len(x) for x in b_bytes])
        self.texts = _texts(max(len(a_bytes), len(b_bytes)))
        self.space = self.b.piece_to_id(MARK)
        marks_in_front = all(MARK not in p.lstrip(MARK) for p in pieces)
        keeps_spaces = "".join(self.b.encode_as_pieces("  a  b")) == f"{MARK * 3}a{MARK * 2}b"
        self.by_part = marks_in_front and keeps_spaces and self.a.by_part
        self.parts = Pieces(self.code, CACHE_PARTS)

    def code(self, parts: list[str]) -> list[tuple[bytes, bytes, bytes] | None]:
        """Records of parts, each read with one space before it."""
        a = self.a(parts) if self.by_part else self.a.whole([" " + p for p in parts])
        b = [x or [self.space] for x in self.b.encode(parts, num_threads=1)]
        whole = [(" " + p).encode() for p in parts]
        a_ids, b_ids = np.frombuffer(b"".join(a), "<u4").astype(np.int64), np.array([y for x in b for y in x], np.int64)
        a_upto, b_upto = np.cumsum([len(x) // 4 for x in a]), np.cumsum([len(x) for x in b])
        # parts whose token bytes are not their own are left out
        a_text, b_text = self.a_bytes[a_ids].tolist(), self.b_bytes[b_ids].tolist()
        sound, i, j = np.zeros(len(parts), bool), 0, 0
        for k, (w, i2, j2) in enumerate(zip(whole, a_upto.tolist(), b_upto.tolist(), strict=True)):
            sound[k] = b"".join(a_text[i:i2]) == w == b"".join(b_text[j:j2])
            i, j = i2, j2
        out: list = [None] * len(parts)
        if not sound.any():
            return out
        n_a, n_b = np.diff(a_upto, prepend=0), np.diff(b_upto, prepend=0)
        a_ids, b_ids = a_ids[np.repeat(sound, n_a)], b_ids[np.repeat(sound, n_b)]
        n_a, n_b = n_a[sound], n_b[sound]
        # byte offsets in all sound parts, one after another; tokens of both sides end where a part ends
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        part_end = a_end[np.cumsum(n_a) - 1]
        ends = np.union1d(a_end, b_end)  # each stretch between two ends is one link
        links = a_ids[np.searchsorted(a_end, ends)] << 32 | b_ids[np.searchsorted(b_end, ends)]
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        a_last, b_last = np.searchsorted(a_end, both), np.searchsorted(b_end, both)
        # the groups' string: a group's A tokens, then its B tokens
        a_sign, b_sign = np.ones(len(a_ids), np.int64), np.ones(len(b_ids), np.int64)
        a_sign[a_last], b_sign[b_last] = 2, 3
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        string = np.empty(len(a_ids) + len(b_ids), np.int64)
        string[np.arange(len(a_ids)) + np.concatenate([[0], b_last + 1])[a_group]] = 4 * a_ids + a_sign
        string[np.arange(len(b_ids)) + a_last[b_group] + 1] = 4 * b_ids + b_sign
        string = self.texts[string].tolist()
        string_upto = np.cumsum(n_a + n_b).tolist()
        link_upto = (8 * (np.searchsorted(ends, part_end) + 1)).tolist()
        groups = np.diff(np.searchsorted(both, part_end) + 1, prepend=0)
        numbers = np.column_stack([n_a, n_b, groups]).astype("<i8").tobytes()
        raw, s, t = links.astype("<i8").tobytes(), 0, 0
        for m, k in enumerate(np.flatnonzero(sound).tolist()):
            s2, t2 = string_upto[m], link_upto[m]
            out[k] = (b"".join(string[s:s2]), raw[t:t2], numbers[24 * m:24 * m + 24])
            s, t = s2, t2
        return out

    def __call__(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes, bytes]]]:
        """Records of each text's parts; none if it has no tokens."""
        able = [t for t in texts if t and MARK not in t]
        found = self.parts(able) if self.by_part else ([r] for t in able for r in self.code([t]))
        for t in texts:
            records = next(found) if t and MARK not in t else []
            yield [] if None in records else records


_LOADED: dict[str, Aligner] = {}


def _loaded(source: str, model: bytes) -> Aligner:
    key = hashlib.sha256(source.encode() + model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Aligner(source, model)
    return _LOADED[key]


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers, compressed, in the smallest width that holds them."""
    top = int(numbers.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(numbers.astype(f"<u{width}").tobytes())


def unsqueeze(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed[1:]) if len(packed) > 1 else b""
    return np.frombuffer(raw, f"<u{packed[0]}").astype(np.int64)


def pack_run(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """A run: blocks of ascending pairs, as steps, and their counts."""
    out = []
    for at in range(0, len(pairs), BLOCK):
        part = pairs[at:at + BLOCK]
        keys, n = squeeze(np.diff(part, prepend=0)), squeeze(counts[at:at + BLOCK])
        out += [struct.pack("<II", len(keys), len(n)), keys, n]
    return b"".join(out)


def run_blocks(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    while at < len(run):
        k, n = struct.unpack_from("<II", run, at)
        at += 8
        yield np.cumsum(unsqueeze(run[at:at + k])), unsqueeze(run[at + k:at + k + n])
        at += k + n


def merge_runs(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ascending (pairs, counts) of all runs, a pair's counts summed; one block of each run is open."""
    sources = [run_blocks(r) for r in runs]
    heads, ends, block = [], [], {}

    def open_next(i: int) -> None:
        found = next(sources[i], None)
        if found is not None:
            block[i] = found
            heapq.heappush(ends, (int(found[0][-1]), i))
            heapq.heappush(heads, (int(found[0][0]), i))

    for i in range(len(sources)):
        open_next(i)
    while heads:
        bound = ends[0][0]  # every pair up to it stands in an open block
        taken = []
        while heads and heads[0][0] <= bound:
            i = heapq.heappop(heads)[1]
            pairs, counts = block[i]
            cut = int(np.searchsorted(pairs, bound, "right"))
            taken.append((pairs[:cut], counts[:cut]))
            if cut < len(pairs):
                block[i] = (pairs[cut:], counts[cut:])
                heapq.heappush(heads, (int(pairs[cut]), i))
        done = []
        while ends and ends[0][0] <= bound:
            done.append(heapq.heappop(ends)[1])
        for i in done:
            open_next(i)
        pairs = np.concatenate([p for p, _ in taken])
        counts = np.concatenate([c for _, c in taken])
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        yield pairs[first], np.add.reduceat(counts, first)


def merged(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = list(merge_runs(runs))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])


def _records(run: bytes) -> np.ndarray:
    """The pairs of a run."""
    return np.concatenate([p for p, _ in run_blocks(run)] or [np.zeros(0, np.int64)])


CHUNKS = ("chunk long, ids binary, nulls binary, stats binary, hashes binary, pairs binary, documents binary, "
          "held binary, places binary, times binary")
ANSWERS = "radix int, node long, counts binary, best binary"


def chunks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``CHUNKS``: documents by chunk. ids, nulls, stats (A tokens, B tokens, groups,
    links) and hashes by document; pairs and documents are the chunk's records;
    held (different pairs of each document), places (of those in pairs) and times
    tell which documents hold them how often."""
    sc = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        sources = sc.broadcast((f.read(), g.read()))
    schema = schema_of(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, types = _loaded(*sources.value), to_arrow_schema(schema)
        chunk, size = TaskContext.get().partitionId() << 32, 0
        ids, stats, hashes, links = [], [], [], []

        def close() -> pa.RecordBatch:
            nonlocal chunk, size
            n = [len(x) // 8 for x in links]
            pairs, at = np.unique(np.frombuffer(b"".join(links), "<i8"), return_inverse=True)
            width = max(len(pairs), 1)
            keys, times = np.unique(np.repeat(np.arange(len(ids)), n) * width + at, return_counts=True)
            doc, place = np.divmod(keys, width)
            held = np.bincount(doc, minlength=len(ids))
            first = np.concatenate([[0], np.cumsum(held)[:-1]])[held > 0]
            steps = np.diff(place, prepend=0)
            steps[first] = place[first]
            values = [chunk, np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids),
                      np.column_stack([np.array(stats, "<i8").reshape(-1, 3), n]).astype("<i8").tobytes(), b"".join(hashes),
                      squeeze(np.diff(pairs, prepend=0)), squeeze(np.bincount(place, minlength=len(pairs))),
                      squeeze(held), squeeze(steps), squeeze(times)]
            for x in (ids, stats, hashes, links):
                x.clear()
            chunk, size = chunk + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, types, strict=True)], names=types.names)

        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in b.column(1).to_pylist()]
            for doc, records in zip(b.column(0).to_pylist(), aligner(texts), strict=True):
                ids.append(doc)
                stats.append(np.frombuffer(b"".join([r[2] for r in records]), "<i8").reshape(-1, 3).sum(axis=0))
                hashes.append(hashlib.sha256(b"".join([r[0] for r in records])[:-1]).digest() if records else bytes(32))
                links.append(b"".join([r[1] for r in records]))
                size += len(links[-1]) // 8
                if size >= CHUNK_LINKS or len(ids) >= CHUNK_DOCS:
                    yield close()
        if ids:
            yield close()

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).mapInArrow(run, schema)


def spill(written: DataFrame, radix: int = RADIX) -> DataFrame:
    """(radix, node, run): each chunk's records, dealt by A id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, packed, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                pairs, counts = np.cumsum(unsqueeze(packed)), unsqueeze(n)
                to = (pairs >> 32) % radix
                order = np.argsort(to, kind="stable")
                bounds = np.searchsorted(to[order], np.arange(radix + 1))
                rows = [(r, pack_run(pairs[order[i:j]], counts[order[i:j]]))
                        for r, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if i < j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                     pa.array([x for _, x in rows], pa.binary())], names=["radix", "node", "run"])

    return written.select("chunk", "pairs", "documents").mapInArrow(run, "radix int, node long, run binary")


def _answer(radix: int, nodes: list[int], runs: list[bytes], pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> pa.Table:
    at = [np.searchsorted(pairs, _records(r)) for r in runs]
    return pa.table({"radix": pa.array([radix] * len(nodes), pa.int32()), "node": pa.array(nodes, pa.int64()),
                     "counts": pa.array([squeeze(counts[i]) for i in at], pa.binary()),
                     "best": pa.array([squeeze(best[i]) for i in at], pa.binary())})


def count(runs: DataFrame, n_nodes: int, fan_in: int = FAN_IN) -> DataFrame:
    """``ANSWERS`` to (radix, node, run): for every record of a run, in its order,
    the pair's count over all runs and whether it is the highest of its A id."""
    if n_nodes <= fan_in:
        def last(key: tuple, t: pa.Table) -> pa.Table:
            own = t["run"].to_pylist()
            pairs, counts = merged(own)
            side = pairs >> 32
            first = np.flatnonzero(np.diff(side, prepend=-1))
            top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(pairs))))
            return _answer(key[0].as_py(), t["node"].to_pylist(), own, pairs, counts, (counts == top).astype(np.int64))

        return runs.groupBy("radix").applyInArrow(last, ANSWERS)

    parents = -(-n_nodes // fan_in)
    runs = materialize(runs.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(parents))))

    def join_up(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"radix": [key[0]], "node": [key[1]],
                         "run": pa.array([pack_run(*merged(t["run"].to_pylist()))], pa.binary())},
                        schema=pa.schema([("radix", pa.int32()), ("node", pa.int64()), ("run", pa.binary())]))

    upper = materialize(runs.groupBy("radix", "parent").applyInArrow(join_up, "radix int, node long, run binary"))
    counted = upper.join(count(upper, parents, fan_in), ["radix", "node"]).withColumnRenamed("node", "parent")

    def hand_down(key: tuple, own: pa.Table, over: pa.Table) -> pa.Table:
        row = over.to_pylist()[0]
        return _answer(key[0].as_py(), own["node"].to_pylist(), own["run"].to_pylist(), _records(row["run"]),
                       unsqueeze(row["counts"]), unsqueeze(row["best"]))

    return runs.groupBy("radix", "parent").cogroup(counted.groupBy("radix", "parent")).applyInArrow(hand_down, ANSWERS)


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups binary")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          radix: int = RADIX, fan_in: int = FAN_IN) -> DataFrame:
    """``RESULT``: one row a document. n_best counts the links whose pair has its
    A id's highest count, count_sum adds up the links' counts; groups is the SHA-256
    of the groups' string, null without tokens. The paths name the tokenizer files on the driver."""
    written = materialize(chunks(docs, a_path, b_path, id_col, text_col))
    n = written.count()
    answers = count(spill(written, radix), max(n, 1), fan_in).withColumnRenamed("node", "chunk")
    types = to_arrow_schema(schema_of(RESULT))

    def add_up(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        pairs = np.cumsum(unsqueeze(row["pairs"]))
        counts, best = np.zeros(len(pairs) + 1, np.int64), np.zeros(len(pairs) + 1, np.int64)
        to = (pairs >> 32) % radix
        for r in found.to_pylist():
            at = np.flatnonzero(to == r["radix"])
            counts[at], best[at] = unsqueeze(r["counts"]), unsqueeze(r["best"])
        held, times = unsqueeze(row["held"]), unsqueeze(row["times"])
        end = np.cumsum(held)
        steps = np.cumsum(unsqueeze(row["places"]))
        place = steps - np.repeat(np.where(end > held, steps[np.maximum(end - held, 1) - 1], 0), held) if len(steps) else steps
        sums = [np.concatenate([[0], np.cumsum(times * x[place])]) for x in (best, counts)]
        stats = np.frombuffer(row["stats"], "<i8").reshape(-1, 4)
        n_best, count_sum = (x[end] - x[end - held] for x in sums)
        ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["nulls"], bool))
        hashes = [row["hashes"][i:i + 32] for i in range(0, len(row["hashes"]), 32)]
        return pa.Table.from_arrays([ids, *stats.T.copy(), n_best, count_sum,
                                     pa.array([h if n else None for h, n in zip(hashes, stats[:, 0], strict=True)], pa.binary())], schema=types)

    return written.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add_up, RESULT)
