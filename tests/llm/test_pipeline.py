"""The pipeline stage by stage against brute force on its own input."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_quality import brute as quality_brute
from test_simhash import brute_components, brute_fp
from test_suffix_dedup import brute as suffix_brute
from tokenizers import Tokenizer

import corpus_pipeline as P
from faultline.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(materialize(f(spark, out[-1], SF)))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    for s in stages[1:5]:
        assert s.dtypes == stages[0].dtypes


def test_language_and_quality(stages):
    raw, lang, clean = ({r["doc_id"]: r for r in s.collect()} for s in stages[:3])
    assert len(lang) >= 0.99 * len(raw) and all(lang[i] == raw[i] for i in lang)
    assert all(not quality_brute(lang[i]["text"])[5] for i in clean)
    for i, r in clean.items():
        lines = lang[i]["text"].split("\n")
        it = iter(lines)
        assert all(s in it for s in r["text"].split("\n")) and r["n_chars"] == len(r["text"])
    labels = {r["doc_id"]: r["quality"] for r in stages[0].sparkSession.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in raw and not quality_brute(raw[i]["text"])[5]]
    assert all(i in clean for i in good)


def test_one_of_each_group_stays(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    fps = [brute_fp(t) for _, t in rows]
    lab = brute_components(fps)
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted({rows[g][0] for g in lab})


def test_repeated_text_is_cut(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    want = {i: k.decode("utf-8", "ignore") for i, _, _, _, k in suffix_brute(rows)}
    got = {str(r["doc_id"]): r["text"] for r in stages[4].collect()}
    assert set(got) == set(want)
    for i, t in got.items():
        assert abs(len(t) - len(want[i])) <= 4 and (t == want[i] or len(t) > len(want[i]))  # split characters stay whole


def test_packed_ids(stages):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = defaultdict(list)
    for r in stages[5].collect():
        parts[r["doc_id"]].append(r)
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert set(parts) == set(texts)
    for i, t in texts.items():
        ids = b"".join(p["ids"] for p in sorted(parts[i], key=lambda p: p["start"]))
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids + [1]


def test_edge_cases(spark):
    import __spark_entry__ as E
    assert "pipeline" in E.queries()
    raw = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    extra = spark.createDataFrame([(None, "The " * 3, None, None, None), (5, None, "en", "s", 0), (6, "", None, "s", 0)], raw.schema)
    docs = raw.unionByName(raw.limit(10)).unionByName(extra).selectExpr("*", "1 as fp", "'x' as quality")
    # names that the operators use themselves
    own = ["_lid", "_lid_text", "_lid_host", "_verdict", "verdict", "_q", "_id", "_fp", "_s", "_own", "_no_text", "_0", "t", "id", "c0"]
    docs = docs.selectExpr("*", *[f"concat('{n}', doc_id) as {n}" for n in own])
    for empty in (False, True):
        d = docs.limit(0) if empty else docs
        for _, f in P.STAGES[:-1]:
            d = materialize(f(spark, d, SF))
            assert d.columns == docs.columns
            assert d.schema["quality"].dataType.simpleString() == "string"
            assert d.filter("quality <> 'x' or fp <> 1 or " + " or ".join(f"{n} <> concat('{n}', doc_id)" for n in own)).isEmpty()
        n = P.STAGES[-1][1](spark, d, SF).count()
        assert (n == 0) == empty
    ids = [r["doc_id"] for r in d.collect()]
    assert len(ids) == len(set(ids))
