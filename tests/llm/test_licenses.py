"""License scan against brute-force containment and phrase search."""

import random
import re
import textwrap

from faultline.llm import licenses


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(t, threshold):
    w = words(t)
    places = sorted((i, lb) for p, lb in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    labels, best = set(), 0.0
    for lb, text in licenses.TEMPLATES:
        tw, span = set(words(text)), len(words(text)) * 5 // 4
        for i in range(len(w)):
            share = len(tw.intersection(w[i:i + span])) / len(tw)
            if share >= threshold - 1e-12:
                labels.add(lb)
                best = max(best, share)
    return len(w), places, sorted(labels), best


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in t.split()} | {"MIT", "license", "general", "public", "é", "x_y"})
    texts = [None, "", "license", "The MIT License", "MIT-license, Apache\nLicense", "general  PUBLIC license " * 3,
             "Of all the claims, few rights in this poem were reserved for readers.",
             "x " * 250 + "All rights reserved. " + "y " * 900 + licenses.TEMPLATES[1][1] + " z" * 700,
             " ".join(f"{a} " + "filler " * 120 for a in ["released", "under", "the", "mit", "license"]),
             "All rights reserved.", "Licensed under CC BY 4.0", "word " * 5000 + "apache license"]
    texts += [t.upper() for _, t in licenses.TEMPLATES] + ["prefix " + t + "\ntail" for _, t in licenses.TEMPLATES]
    for _ in range(150):
        kept = [w for w in rng.choice(licenses.TEMPLATES)[1].split() if rng.random() < 0.93]
        rng.shuffle(kept)
        texts.append("\n".join([" ".join(kept), " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))]))
    rare = texts.index("All rights reserved.")
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[rare], 2), (None, texts[rare], 3), (0, "MIT License", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    for threshold in (0.9, 0.7):
        got = licenses.scan(df, threshold=threshold).collect()
        have = sorted((str(r["id"]), r["n_words"], sorted((p["at"], p["label"]) for p in r["places"]), r["labels"], round(r["score"], 9)) for r in got)
        want = sorted((str(i), n, p, lb, round(s, 9)) for i, t, _ in rows for n, p, lb, s in [brute(t, threshold)])
        assert have == want
    assert licenses.scan(df.limit(0)).count() == 0


def test_wrapped_notices(spark):
    """A notice wrapped at 30-80 columns, in comment lines or after other text, is found like one on a line."""
    rng = random.Random(5)
    rows, want = [], []
    for label, text in licenses.TEMPLATES:
        for mark in ("", "# ", " * ", "// ", "dnl "):
            for width in (30, 72, 80):
                lines = textwrap.wrap(text, width)
                if mark == "":
                    lines[0] = f"Some words before. {lines[0]}"
                if len(lines) > 2:
                    lines.insert(rng.randint(1, len(lines) - 1), mark.strip() if mark != "dnl " else "")  # a line without words
                body = ["alpha beta gamma"] * rng.randint(0, 50) + [mark + x for x in lines] + ["delta epsilon " * 9] * 3
                rows.append((len(rows), "\n".join(body)))
                want.append(label)
    scattered = "\n".join(f"{w}\n" + "filler words go here\n" * 12 for w in licenses.TEMPLATES[6][1].split())
    rows += [(len(rows), scattered), (len(rows) + 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in licenses.scan(df).collect()}
    for (i, text), label in zip(rows, want, strict=False):
        assert label in got[i]["labels"] and got[i]["score"] >= 0.9, text
    assert got[rows[-2][0]]["labels"] == [] and got[rows[-1][0]]["score"] == 0
    assert licenses.scan(df.limit(0)).count() == 0


def test_scattered_words_get_no_label(spark):
    """Words of a short notice that stand apart in one line, and a long text of prefix words, meet no template."""
    texts = ["Of all the claims, few rights in this poem were reserved for readers.",
             " ".join(a + " word" * 150 for a in ["released", "under", "the", "mit", "license"]),
             "reserved " * 200_000, "restriction\n" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r["labels"] == [] and r["score"] == 0 for r in licenses.scan(df).collect())
