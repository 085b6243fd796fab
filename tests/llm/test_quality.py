"""Quality rules: counts against plain Python, line rules, edge cases."""

import random
import re

from faultline.llm import quality

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    cov = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            cov |= set(range(i, i + 5))
    full = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(cov),
            len(w) < 10 or 100 * len(cov) > 20 * len(w))


CLEAN = ["The storm came in over the hills at night, and nobody in the village was ready for it.",
         "By morning the road had gone. We walked down to the river to see what was left of the bridge.",
         "Nobody said much about it afterwards; there was nothing to say."]


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, quality0 string")
    return {r["doc_id"]: r["quality"] for r in quality.quality_rules(df).collect()}


def test_counts_match_plain_python(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "a\nb\na\n\n \nb", "é ü 日本 🙂 x", "a a a a a a a", "w " * 3000] + [
        " ".join(rng.choice(["a", "b", "c#", "|", "d\n", "e  f", "g\x0bh", "i\xa0j"]) for _ in range(rng.randint(3, 90))) for _ in range(60)]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert tuple(got[i][n] for n in NAMES) == brute(t), t


def test_line_rules(spark):
    clean = "\n".join(CLEAN)
    got = run(spark, [
        clean,
        clean + "\nHome | News | Sport | Contact",
        clean + "\nWe use cookies to improve your visit.",
        "\n".join(["Buy!! Now!! Cheap!! Deals!! Today!! Only!! Here!! Folks!!"] * 1 + CLEAN[:1]),
        "Home | News | Sport | Contact | About | Help | Shop | Terms | Jobs | Press",
        "word other thing again more words follow here without any stop at all",
        "a $$$ b *** c ### d %%% e &&& f *** g $$$ h *** i %%% j."])
    assert [got[i]["kept"] for i in range(7)] == [True, True, True, False, False, False, False]
    assert got[0]["clean_text"] == got[1]["clean_text"] == got[2]["clean_text"] == clean
    assert got[0]["lost_chars"] == 0 and got[0]["line_chars"] == len(clean) - 2


def test_prefilter_never_hides_a_failing_line(spark):
    rng = random.Random(9)
    parts = ["word", "Stop.", "|", "»", "!!", "##", "we use cookies", "a", "b", "c", "d", "LOREM IPSUM", "·"]
    texts = ["\n".join(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    lost = F.size(F.filter(F.split("text", "\n"), quality.line_fails)) > 0
    assert df.filter(lost & ~quality.may_fail(F.col("text"))).count() == 0
    assert df.filter(lost).count() > 50


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, CLEAN[0], 1), (None, CLEAN[0], 1)], "doc_id long, text string, kept int")
    out = quality.quality_rules(df)
    assert out.count() == 2 and out.columns == ["doc_id", "text", "kept", "quality"]
    assert quality.quality_rules(df.limit(0)).count() == 0
