"""Alignment of two tokenizers against brute force; merging of runs; edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import alignment
from faultline.llm.bpe import byte_letters
from faultline.llm.common import prepare

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", " a", "a ", "a  b", "a\n b", "\n", "a▁b", "<s>x</s>", "<|endoftext|> hi", "é́ﬁ　x", "x" * 4000,
       " \x00 ￾", "日本語の文 と 文", "a\t \tb  \n", "don't, \"we\"...", "\x1c a\x1f b"]


def brute(rows):
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(byte_letters())}
    a_bytes = {i: bytes(letters.get(c, 0) for c in t) for t, i in a_lib.get_vocab().items()}

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    docs = []
    for _, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes(i) for i in b) != whole:
            docs.append(None)
            continue
        links, spans, at = [], [], 0
        for i in a:
            spans.append((at, at := at + len(a_bytes[i]), i))
        other, at = [], 0
        for i in b:
            other.append((at, at := at + len(b_bytes(i)), i))
        j = 0
        for s, e, i in spans:
            while other[j][1] <= s:
                j += 1
            k = j
            while k < len(other) and other[k][0] < e:
                links.append((i, other[k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans} & {e for _, e, _ in other})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, _, i in side if low <= s < c) for side in (spans, other)))
            low = c
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).digest()))
    counts = Counter(pair for d in docs if d for pair in set(d[3]))
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    return [(i, 0, 0, 0, 0, 0, 0, None) if d is None else
            (i, d[0], d[1], d[2], len(d[3]), sum(counts[p] == top[p[0]] for p in d[3]), sum(counts[p] for p in d[3]), d[4])
            for (i, _), d in zip(rows, docs, strict=True)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *map(str, r)))


def test_documents_against_brute_force(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(alignment, "CHUNK_DOCS", 7)
    rng = random.Random(4)
    words = ["sea", "seas", "unhappily", "Köln", "x1", "and,", "tokenization", "naïve", "a", "...", "\n", "3.14"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(90)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "sea and"), (3, "sea"), (3, "sea")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, chunk int").repartition(6)
    got = [tuple(r) for r in alignment.align(df, A, B, radix=5, fan_in=3).collect()]  # several levels of merging
    got = [(*r[:-1], r[-1] and bytes(r[-1])) for r in got]
    assert order(got) == order(brute(rows))
    assert order([(*r[:-1], r[-1] and bytes(r[-1])) for r in map(tuple, alignment.align(df, A, B).collect())]) == order(got)


def test_empty_table(spark):
    prepare(spark)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 1 << 48), st.integers(1, 1 << 33), max_size=60), max_size=7))
def test_merged_runs(runs):
    block, alignment.BLOCK = alignment.BLOCK, 4
    try:
        packed = [alignment.pack_run(np.array(sorted(r), np.int64), np.array([r[k] for k in sorted(r)], np.int64)) for r in runs]
        pairs, counts = alignment.merged(packed)
    finally:
        alignment.BLOCK = block
    total = Counter()
    for r in runs:
        total.update(r)
    assert pairs.tolist() == sorted(total) and counts.tolist() == [total[k] for k in sorted(total)]
