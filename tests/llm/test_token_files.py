"""Token files: round trips, exact ids, order, edge cases."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import token_files
from faultline.llm.common import prepare, scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
SOURCE = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SOURCE)
IDS = token_files.TextIds(SOURCE)
ODD = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "\n", "a\t \tb  \n", "don't we'll I'M", "<|endoftext|> hi <|endoftext|>", "x  <|endoftext|>\n",
       "é́ﬁ　x", "日本語の文 と 文", "x" * 3000, "\x1c a\x1f b", "͸ ԰ \U0001fae9 b", "12,5 (a) \"b\" c  d\xa0e", "á́ ǅ ʰ ª"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_numbers_round_trip(numbers):
    x = np.array(numbers, np.uint32)
    control, data = token_files.pack_numbers(x)
    assert len(control) == -(-len(x) // 4)
    assert len(data) == sum(max(1, (n.bit_length() + 7) // 8) for n in numbers)
    assert token_files.unpack_numbers(control, data, len(x)).tolist() == numbers


def test_control_bytes_hold_lengths_lowest_bits_first():
    control, data = token_files.pack_numbers(np.array([1, 300, 70_000, 1 << 24, 5], np.uint32))
    assert control == bytes([0b11100100, 0])
    assert data == b"\x01" + (300).to_bytes(2, "little") + (70_000).to_bytes(3, "little") + (1 << 24).to_bytes(4, "little") + b"\x05"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab é.\n\t'sS1,　\x1c<|endoftext|>", max_size=30), max_size=6))
def test_ids_are_the_librarys(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in IDS(texts)] == [
        LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_odd_texts():
    assert [np.frombuffer(x, "<u4").tolist() for x in IDS(ODD)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in ODD]


def _written(df):
    return [tuple(r) for r in token_files.round_trip(df, PATH).collect()]


def test_documents_come_back_in_order(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    monkeypatch.setattr(token_files, "FILE_BLOCKS", 2)
    rows = [(7 * i % 101, t, i) for i, t in enumerate(ODD * 3)] + [(5, None, 1), (None, "no id", 2), (5, "same", 3), (5, "same", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(5)
    got = sorted(_written(df), key=lambda r: r[1])
    want = sorted((i, np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t, _ in rows if i is not None)
    assert [r[0] for r in got] == [None] + [i for i, _ in want]
    assert sorted((r[0], bytes(r[2])) for r in got[1:]) == want
    ends = np.cumsum([len(r[2]) // 4 for r in got])
    assert [r[1] for r in got] == [0, *ends[:-1]]


def test_files_index_and_vocabulary(spark):
    prepare(spark)
    df = spark.createDataFrame([(i, "a a a b " * (i + 1)) for i in range(30)], "doc_id long, text string")
    folder = token_files.write(df, PATH, scratch(spark))
    words = spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()
    assert [r["n"] for r in words] == sorted((r["n"] for r in words), reverse=True)
    index = spark.read.parquet(f"{folder}/index").orderBy("part", "number").collect()
    assert sum(r["n_docs"] for r in index) == 30
    assert [r["start"] for r in index] == [sum(x["n_ids"] for x in index[:k]) for k in range(len(index))]
    got = token_files.read(spark, folder).orderBy("doc_id").collect()
    assert [zlib.crc32(r["ids"]) for r in got] == [
        zlib.crc32(np.array([*LIBRARY.encode("a a a b " * (i + 1), add_special_tokens=False).ids, 2], "<u4").tobytes()) for i in range(30)]


def test_empty_table(spark):
    prepare(spark)
    assert _written(spark.createDataFrame([], "doc_id long, text string")) == []
