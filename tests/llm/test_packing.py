"""Packing: every id in one piece, sequences gapless and unpadded, costs balanced."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import packing
from faultline.llm.common import WordCache

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60), st.sampled_from([64, 128]))
def test_assign(lengths, capacity):
    pieces = packing.assign(lengths, capacity)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, s, n, q, at in pieces:
        by_doc[d].append((s, n))
        by_seq[q].append((at, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(by_doc[d]):
            assert s == at and k > 0
            at += k
        assert at == n
    short = 0
    for seq in by_seq.values():
        at = 0
        for o, k in sorted(seq):
            assert o == at
            at += k
        assert at <= capacity and at & (at - 1) == 0  # full, or a power of two
        short += at < capacity
    assert short <= capacity.bit_length()


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    pieces = packing.assign(rng.integers(20, 1500, 4000).tolist())
    cost, fill = defaultdict(float), defaultdict(int)
    for _, _, n, q, _ in pieces:
        cost[q] += packing.LINEAR * n + packing.QUADRATIC * n * n
        fill[q] += n
    full = [cost[q] for q in cost if fill[q] == packing.SEQUENCE]
    assert np.std(full) < 0.12 * np.mean(full)


LIB = Tokenizer.from_file(PATH)
IDS = packing.WordIds(open(PATH, encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aZ\u00c9e\u0301 \u0130\u03a3\u03a3'stl19.\x1c\x85\xa0<|endoftext|>", max_size=60))
def test_ids_are_the_library_s(t):
    t = t.encode("utf-8", "replace").decode()
    assert np.frombuffer(IDS(t.encode()), "<u4").tolist() == LIB.encode(t, add_special_tokens=False).ids


def test_rows(spark):
    lib = Tokenizer.from_file(PATH)
    texts = ["", None, "One two THREE it's", "À la carte x <|endoftext|> y", "İstanbul ΑΣ ΑΣ. 42", "é ́a",
             "a|endoftext|>", "word salad " * 3000]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "none", 0), (2, texts[2], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(1)
    out = packing.pack(df, PATH).collect()
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, t, _ in rows:
        if i == 2:
            continue  # repeated
        want = lib.encode(t or "", add_special_tokens=False).ids + [1]
        ids = b"".join(r["ids"] for r in sorted(got[i], key=lambda r: r["start"]))
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert {r["doc_tokens"] for r in got[i]} == {len(want)}
    assert sum(r["length"] for r in got[2]) == 2 * len(lib.encode(texts[2]).ids + [1])
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert all(o == sum(n for _, n in s[:k]) for k, (o, _) in enumerate(s))
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_plain_words_are_remembered_once():
    with open(PATH, encoding="utf-8") as f:
        ids = packing.WordIds(f.read())
    text = "plain words, and (some) others: don't 3.14 Él naïve"
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids(text.encode()), "<u4").tolist() == want
    assert "plain" not in ids.pieces.young and "words" in ids.pieces.young


def test_a_known_word_costs_one_look_up():
    seen = []
    cache = WordCache(lambda w: seen.append(w) or w.encode(), 3)
    assert cache.join(["a", "b", "a", "c"]) == b"abac" and seen == ["a", "b", "c"]
    assert cache.join(["d", "a"]) == b"da" and cache.join(["b", "e"]) == b"be"  # taken over from the older generation
    assert seen == ["a", "b", "c", "d", "e"]
    assert cache.join(["f", "g", "h", "i"]) == b"fghi" and cache.join(["a"]) == b"a"
    assert seen[-1] == "a" and len(cache.young) + len(cache.young.old) <= 8


def test_signs_after_letters_are_pieces_of_their_own():
    with open(PATH, encoding="utf-8") as f:
        ids = packing.WordIds(f.read())
    for text in ("end. End, (end) end) end] \"end\" end?! don't. it's, a1. a.b. é. x' '. . ,", "tab\x01. \x7f. ab\x00c. \x1f!"):
        want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids(text.encode()), "<u4").tolist() == want
