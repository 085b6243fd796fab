"""BPE against the tokenizers library, and exact round trips."""

import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
MINE = bpe.Vocabulary(open(PATH, encoding="utf-8").read())

TEXTS = ["", "Hello world", "it's  we'll\n\n\tx", "über Ñandú éçê ß", "a<|endoftext|>b <|endoftext|>", "日本語 テキスト 🙂👍🏽",
         "x\xa0y  z　　w \x1c\x1d q", "123abc 4 56", "ab" * 700, "z" * 2001, "\r\n \x0b\x0c", "Nd, Nd, Nd,"]


def ids(text):
    return LIB.encode(text, add_special_tokens=False).ids


def mine(text):
    return [int.from_bytes(b[i:i + 4], "little") for b in [MINE.encode(text)] for i in range(0, len(b), 4)]


def test_fixed_texts():
    for t in TEXTS:
        assert mine(t) == ids(t), t
        assert MINE.decode(MINE.encode(t)) == LIB.decode(ids(t), skip_special_tokens=False) == t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(t):
    t = t.encode("utf-8", "replace").decode()
    assert mine(t) == ids(t)


def test_long_words_take_the_same_merges():
    for w in ("thereinthat" * 40, "ab" * 300, "aaaa" * 200):
        short = MINE.merge_word(w.encode())
        limit, bpe.SCAN_LIMIT = bpe.SCAN_LIMIT, 10**6
        try:
            assert MINE.merge_word(w.encode()) == short
        finally:
            bpe.SCAN_LIMIT = limit


def test_rows(spark):
    rows = [(i, t, "ids") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    want = sorted((repr(i), t or "", hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids(t or ""))).hexdigest()) for i, t, _ in rows)
    assert sorted((repr(r["id"]), r["text"], hashlib.sha256(r["ids"]).hexdigest()) for r in out) == want
    assert bpe.encode(df.limit(0), PATH).count() == 0
