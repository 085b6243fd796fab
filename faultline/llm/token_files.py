"""Token ids in binary files: frequency-ranked, byte-aligned, variable length.

``write`` codes every text with a tokenizer, adds an end id, and numbers the ids
of the vocabulary by falling frequency over the whole corpus, so that frequent
ids become small numbers. A number takes one to four bytes. The lengths of four
numbers share one control byte (two bits each, lengths less one, lowest bits
first); control bytes and data bytes stand apart, so that a decoder takes the
lengths from a table of 256 entries and all numbers from one gather.

A folder holds:

* ``ids/part-*``: blocks, each closed by a line feed. A block is, little-endian:
  ``FVB1``, then n_docs, n_ids, n_data (unsigned 64-bit); n_docs document ids
  (signed 64-bit); n_docs lengths (unsigned 64-bit); n_docs bytes, 1 where the
  document id is null; ceil(n_ids / 4) control bytes; n_data data bytes.
* ``vocabulary``: Parquet (rank, id, n).
* ``index``: Parquet (file, part, number, n_docs, n_ids, start): the files in
  order, start being the ids of all files before.

Documents stand in ascending order of their ids across blocks and files. Texts
are coded once; ids are counted in the tasks and summed by id; one range
exchange brings the documents in order, and Spark's text writer commits the
blocks (so a lost executor or a repeated task leaves no half file, on any file
system that Spark knows). Only the vocabulary's ranks, at most one row for each id of
the tokenizer, pass the driver.

Defined cases: null text is empty, its ids the end id alone; texts of any length
are one document in one block; equal document ids are ordered by their ids' hash,
rows equal in all stay rows of their own, and a number given to each row when it
is coded spreads them over the exchange; null document ids come first; extra columns are
ignored whatever their names; an empty table writes no block, and reading gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.llm.common import schema_of, scratch, utf8
from faultline.llm.pieces import CUT, PartIds, Pieces
from faultline.operators.ordering import running_sum
from faultline.session import materialize

#: Ids of a block (a longer document has a block of its own), and blocks of a file.
BLOCK_IDS, FILE_BLOCKS = 1 << 20, 16
#: Parts of texts whose ids a worker process remembers, in each of two generations.
CACHE_PARTS = 100_000

MAGIC, HEAD = b"FVB1", struct.Struct("<4sQQQ")
#: Byte lengths of the four numbers of each control byte, and the bits of a number by its length.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    x = np.ascontiguousarray(numbers, "<u4")
    size = 1 + (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    fours = np.zeros((-(-len(x) // 4), 4), np.uint8)
    fours.reshape(-1)[:len(x)] = size - 1
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    return control.tobytes(), x.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack_numbers(control: bytes | memoryview, data: bytes | memoryview, n: int) -> np.ndarray:
    """The ``n`` numbers of control bytes and data bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    padded = bytes(data) + b"\0\0\0"
    four = np.ndarray((len(data),), "<u4", padded, strides=(1,))  # the four bytes from each place on
    return four[at] & MASKS[size] if n else np.zeros(0, np.uint32)


def pack_block(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A block of (document id, numbers) pairs."""
    numbers = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    control, data = pack_numbers(numbers)
    return b"".join([
        HEAD.pack(MAGIC, len(docs), len(numbers), len(data)), np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
        np.array([len(x) for _, x in docs], "<u8").tobytes(), bytes(d is None for d, _ in docs), control, data])


class Block(NamedTuple):
    docs: list[int | None]
    lengths: np.ndarray
    n_ids: int
    control: memoryview
    data: memoryview


def blocks(content: bytes) -> Iterator[Block]:
    """The blocks of a file's bytes."""
    view, at = memoryview(content), 0
    while at < len(view):
        magic, n, n_ids, n_data = HEAD.unpack_from(view, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        ids, lengths = np.frombuffer(view, "<i8", n, at), np.frombuffer(view, "<u8", n, at + 8 * n).astype(np.int64)
        null = bytes(view[at + 16 * n:at + 17 * n])
        at += 17 * n
        mid = at + -(-n_ids // 4)
        end = mid + n_data
        if view[end:end + 1] != b"\n":
            raise ValueError(f"the block that ends at byte {end} is not closed")
        yield Block([None if f else int(d) for d, f in zip(ids, null, strict=True)], lengths, n_ids, view[at:mid], view[mid:end])
        at = end + 1


class TextIds:
    """Ids of whole texts: by their parts where the tokenizer allows it, else whole."""

    def __init__(self, source: str, width: str = "<u4"):
        self.ids = PartIds(source, width)
        self.parts = Pieces(self.ids, CACHE_PARTS)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.ids.by_part:
            return self.ids.whole(texts)
        cuts = [0 if t[:1] == " " else m.start() if (m := CUT.search(t)) else len(t) for t in texts]
        firsts = self.ids.whole([t[:i] for t, i in zip(texts, cuts, strict=True)])
        more = self.parts([t[i + 1:] for t, i in zip(texts, cuts, strict=True) if i < len(t)])
        return [first + b"".join(next(more)) if i < len(t) else first for t, i, first in zip(texts, cuts, firsts, strict=True)]


_LOADED: dict[tuple[str, str], TextIds] = {}


def _loaded(source: str, width: str) -> TextIds:
    key = (hashlib.sha256(source.encode()).hexdigest(), width)
    if key not in _LOADED:
        _LOADED[key] = TextIds(source, width)
    return _LOADED[key]


def encode(docs: DataFrame, path: str, end_id: int, width: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, ids, row): every text's ids (of ``width``, zstd) with the end id; ``row`` numbers the rows."""
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = schema_of("id long, ids binary, row long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, types, end = _loaded(source.value, width), to_arrow_schema(schema), np.array([end_id], width).tobytes()
        zip_, row = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 36
        for b in batches:
            ids = ids_of([t.decode("utf-8", "replace") for t in b.column(1).to_pylist()])
            packed = [zip_.compress(x + end) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, types.types[1]), pa.array(np.arange(row, row + len(ids)))],
                                             names=types.names)
            row += len(ids)

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).mapInArrow(run, schema)


def count_ids(tokens: DataFrame, size: int, width: str) -> DataFrame:
    """(id, n) of the ids that occur, summed in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, unzip = np.zeros(size, np.int64), [], zstandard.ZstdDecompressor()
        for b in batches:
            for ids in b.column(0).to_pylist():
                held.append(np.frombuffer(unzip.decompress(ids), width))
            if held:
                n += np.bincount(np.concatenate(held), minlength=size)
                held.clear()
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of all texts into ``folder`` (one that all executors share); returns it.
    ``path`` names the tokenizer file on the driver."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    size = 1 + max([end_id, *spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]])
    width = "<u2" if size <= 1 << 16 else "<u4"
    tokens = materialize(encode(docs, path, end_id, width, id_col, text_col))
    # one row for each id of the tokenizer at most, whatever the corpus
    counted = count_ids(tokens, size, width).toPandas().sort_values(["n", "id"], ascending=[False, True])
    rank = np.zeros(size, np.uint32)
    rank[counted["id"].to_numpy()] = np.arange(len(counted))
    spark.createDataFrame([(r, int(i), int(n)) for r, (i, n) in enumerate(counted[["id", "n"]].to_numpy())],
                          "rank int, id int, n long").coalesce(1).write.parquet(f"{folder}/vocabulary")
    ranks = sc.broadcast(rank)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, unzip = [], 0, zstandard.ZstdDecompressor()

        def close() -> pa.RecordBatch:
            block = pack_block(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["value"])

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                numbers = ranks.value[np.frombuffer(unzip.decompress(ids), width)]
                if held and n + len(numbers) > BLOCK_IDS:
                    yield close()
                    n = 0
                held.append((doc, numbers))
                n += len(numbers)
        if held:
            yield close()

    order = ["id", "hash", "row"]
    ordered = tokens.withColumn("hash", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order)
    # Spark's text writer puts out the bytes as they are, and a line feed after each row
    ordered.select("id", "ids").mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write \
        .option("maxRecordsPerFile", FILE_BLOCKS).option("compression", "none").option("lineSep", "\n").text(f"{folder}/ids")
    _index(spark, folder).write.parquet(f"{folder}/index")
    return folder


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/ids")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _index(spark: SparkSession, folder: str) -> DataFrame:
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [(len(x.docs), x.n_ids) for x in blocks(content)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([sum(d for d, _ in found)]), pa.array([sum(n for _, n in found)])],
                    names=["file", "n_docs", "n_ids"])

    number = [F.regexp_extract("file", r"^part-(\d+)-.*-c(\d+)", k).cast("int") for k in (1, 2)]
    found = _files(spark, folder).mapInArrow(heads, "file string, n_docs long, n_ids long") \
        .withColumns({"part": number[0], "number": number[1]})
    return running_sum(found, [], ["part", "number"], "n_ids", "start").select("file", "part", "number", "n_docs", "n_ids", "start")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of a written folder: ``ids`` as little-endian unsigned
    32-bit integers with the end id, ``start`` the ids of all documents before."""
    # at most one row for each id of the tokenizer
    id_of = spark.sparkContext.broadcast(
        spark.read.parquet(f"{folder}/vocabulary").toPandas().sort_values("rank")["id"].to_numpy("<u4"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                before = 0
                for x in blocks(content):
                    ids = id_of.value[unpack_numbers(x.control, x.data, x.n_ids)].tobytes()
                    end = np.cumsum(x.lengths)
                    first = end - x.lengths
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(x.docs)), pa.array(x.docs, pa.int64()), pa.array(first + before),
                         pa.array([ids[4 * i:4 * j] for i, j in zip(first.tolist(), end.tolist(), strict=True)], pa.binary())],
                        names=["file", "doc_id", "place", "ids"])
                    before += x.n_ids

    rows = _files(spark, folder).mapInArrow(unpack, "file string, doc_id long, place long, ids binary")
    index = spark.read.parquet(f"{folder}/index").select("file", "start")
    return rows.join(index, "file").select("doc_id", (F.col("start") + F.col("place")).alias("start"), "ids")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``read`` of what ``write`` wrote into a folder under the session's checkpoint folder."""
    spark = docs.sparkSession
    return read(spark, write(docs, path, scratch(spark), end_id, id_col, text_col))
