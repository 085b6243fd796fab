"""Language identification: brute-force fusion, held-out accuracy, edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from faultline.llm import langid
from faultline.llm.common import prepare
from faultline.llm.queries import REGISTRY

SF = "/root/testdata/sf0.01"


def test_text_scores_match_plain_sums():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(langid.BINS, 3)).astype(np.float32)
    texts = [b"", b"a", b"Hello world", "Ünï cödé 123 x".encode(), bytes(rng.integers(97, 123, 5000, dtype=np.uint8))]
    got = langid.text_scores(texts, table)
    for t, row in zip(texts, got, strict=True):
        low = b" " + t.lower() + b" "
        bins = langid.trigram_bins(np.frombuffer(low, np.uint8)) if len(low) > 2 else []
        assert np.allclose(row[:3], table[bins].sum(axis=0) if len(bins) else 0, atol=1e-2) and row[3] == len(bins)


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(2)
    table = rng.normal(size=(langid.BINS, 2)).astype(np.float32)
    text = bytes(rng.integers(97, 123, 4321, dtype=np.uint8))
    whole = langid.text_scores([text, b"abc"], table)
    monkeypatch.setattr(langid, "CHUNK", 100)
    assert np.allclose(langid.text_scores([text, b"abc"], table), whole, atol=1e-2)


def test_fusion_matches_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source") \
        .withColumn("source", F.concat("source", F.when(F.col("doc_id") % 3 == 0, ".fr").otherwise(".com")))
    langs, n = sorted(langid.LANGUAGES), len(langid.LANGUAGES)
    logs = langid.train(docs, "text", "lang", tuple(langs), langid.SAMPLE)
    got = langid.identify(docs).select("doc_id", "language_id.*").toPandas().set_index("doc_id")
    full = np.c_[logs, langid.unknown_column(logs)].astype(np.float32)
    rows = docs.collect()
    scores = langid.text_scores([r["text"].encode() for r in rows], full)
    best = [int(s[:n].argmax()) if s[:n].max() > s[n] else None for s in scores]
    hc, sc, dc, all_ = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), Counter()
    for r, b in zip(rows, best, strict=True):
        if b is not None:
            suffix = r["source"].rsplit(".", 1)[1]
            hc[r["source"]][b] += 1
            sc[suffix][b] += 1
            dc[r["lang"]][b] += 1
            all_[b] += 1
    total = sum(all_.values())
    for r, s, b in zip(rows, scores, best, strict=True):
        flat = [(all_[k] + langid.PRIOR_ROWS / n) / (total + langid.PRIOR_ROWS) for k in range(n)]
        for counts in (sc[r["source"].rsplit(".", 1)[1]], hc[r["source"]]):
            c = [counts[k] - (b == k) for k in range(n)]
            flat = [(c[k] + langid.PRIOR_ROWS * flat[k]) / (sum(c) + langid.PRIOR_ROWS) for k in range(n)]
        prior, values, logit = flat, [*langs, ""], []
        for k in range(n):
            column = [dc[v][k] + langid.DECLARED_ROWS / len(values) for v in values]
            logit.append(langid.TEMPER * (s[k] - s[n]) + math.log(prior[k]) + math.log(column[values.index(r["lang"])] / sum(column)))
        top = max(max(logit), 0.0)
        post = math.exp(max(logit) - top) / (math.exp(math.log(0.01) - top) + sum(math.exp(x - top) for x in logit))
        assert abs(got.posterior[r["doc_id"]] - post) < 1e-3
        assert got.best[r["doc_id"]] == langs[int(np.argmax(logit))]


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("truth", F.col("lang"))
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    out = langid.identify(hidden).filter("doc_id % 2 = 1").select("truth", "language_id.*").toPandas()
    assert (out.truth == out.language).mean() > 0.98


def test_registered_query_keeps_labelled_documents(spark):
    out = REGISTRY["op6_language_id"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    m = out.merge(docs, on="doc_id")
    assert len(m) == len(docs) and (m.language == m.lang).mean() > 0.99


def test_edge_cases(spark):
    en = "the ship went over the water and the men were singing in the evening "
    fr = "le bateau est parti sur la mer et les hommes chantaient dans la nuit "
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr", "h.example") for i in range(60)]
    rows += [(100, None, "en", "h.example"), (101, " 12 34 !!", "en", None), (102, en, None, None), (103, en, "xx", "k.fr"),
             (None, fr, "fr", "h.example"), (5, en, "en", "h.example"), (104, en * 20_000, None, "h.example"), (105, "", None, None),
             (106, "ζηθικλ μνξοπρ στυφχ ψωαβγδ " * 6, None, "h.example")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, best string")
    out = langid.identify(df)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == [*df.columns, "language_id"]
    by = {r["doc_id"]: r["language_id"] for r in got}
    assert all(by[i]["language"] == ("en" if i % 2 else "fr") for i in range(60))
    for i in (100, 101, 105):
        assert by[i]["language"] is None and not by[i]["accepted"]
    assert by[102]["language"] == by[103]["language"] == by[104]["language"] == "en" and by[None]["language"] == "fr"
    assert by[106]["language"] is None
    assert langid.identify(df.limit(0)).count() == 0
    assert not langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).filter("language_id.accepted").count()


def test_page_evidence(spark):
    df = spark.createDataFrame([("http://User@Blog.Example.FR:80/a", "<!doctype html><HTML class=x lang='FR-fr'>"), (None, None)], "url string, html string")
    assert [tuple(r)[2:] for r in langid.page_evidence(df).collect()] == [("fr", "blog.example.fr", "fr"), (None, None, None)]


def test_pages_query_uses_markup_host_and_suffix(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = E.queries()["op6_page_language_id"](spark, sf).collect()
    assert len(got) == pages.count()
    assert all(r["kind"] == "page" and r["host"] and r["suffix"] for r in got)
    assert sum(r["declared"] is not None for r in got) > 0.5 * len(got)
    assert sum(r["n_trigrams"] > 0 for r in got) > 0.9 * len(got)


def test_page_suffix_decides_between_equal_pages(spark):
    """Pages of equal, poor text and without a declaration or known host differ by their suffix only."""
    english, german = "the house and the garden with the man ", "das haus und der garten mit dem mann "
    rows = [(i, f"http://h{i}.example.{'uk' if i % 2 else 'de'}/x", f"<html lang={'en' if i % 2 else 'de'}><p>{(english if i % 2 else german) * 5}")
            for i in range(200)]
    rows += [(1000 + k, f"http://new{k}.example.{s}/x", "<html><nav>das haus und der garten</nav><p>in man") for k, s in enumerate(["uk", "de"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.identify_pages(df).collect()}
    assert got[1]["language_id"]["best"] == "en" and got[0]["language_id"]["best"] == "de"
    assert got[1000]["suffix"] == "uk" and got[1001]["suffix"] == "de"
    assert got[1000]["text"] == got[1001]["text"] == "in man"  # the menu is not scored
    a, b = got[1000]["language_id"], got[1001]["language_id"]
    assert (a["best"], a["posterior"]) != (b["best"], b["posterior"])


def test_texts_without_a_letter_have_no_best_language(spark):
    prepare(spark)
    docs = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the sea and the sky are blue " * 5, "en"), ("le ciel et la mer sont bleus " * 5, "fr")] * 6)]
    docs += [(100, None, "en", "s"), (101, "", "fr", "s"), (102, "12 34 -- 5", None, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["language_id"] for r in langid.identify(df).collect()}
    assert all(got[i][c] is None for i in (100, 101, 102) for c in ("language", "best", "text_best"))
    assert {got[0]["best"], got[1]["best"]} == {"en", "fr"} == {got[0]["text_best"], got[1]["text_best"]}
