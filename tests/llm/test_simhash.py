"""SimHash near-duplicates against a brute-force version."""

import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from faultline.llm import simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits=2):
    lab = list(range(len(fps)))
    def root(i):
        while lab[i] != i:
            i = lab[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((root(i), root(j)))
                lab[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = ["", None, "  \n", "One", "Two Words", "ÀB c\x0bd\x1ce É", "a b c"] + [
        " ".join(rng.choice(["aa", "Bb", "ccc,", "ü", "x\ty"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint_bytes((t or "").encode()) == brute_fp(t)


@pytest.mark.parametrize("limit,hot", [(512, 20_000), (2, 20_000), (512, 3)])
def test_links_find_every_component(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(simhash, "PAIR_GROUP", limit)
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = list({b ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for b in base for _ in range(40)}
               | {rng.getrandbits(64) for _ in range(200)} | {0})
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)}))
    got = simhash.links(df, hot=hot).collect()
    at = {f: i for i, f in enumerate(fps)}
    lab = brute_components(fps)
    mine = list(range(len(fps)))
    def root(i):
        while mine[i] != i:
            i = mine[i]
        return i
    for r in got:
        a, b = sorted((root(at[r["src"] % 2**64]), root(at[r["dst"] % 2**64])))
        mine[b] = a
    groups = lambda ls: sorted(sorted(i for i in range(len(fps)) if ls[i] == r) for r in set(ls))
    assert groups([root(i) for i in range(len(fps))]) == groups(lab)


def test_hot_group_probing_equals_pairs():
    rng = np.random.default_rng(3)
    fp = np.unique(np.uint64(0x123456789ABCDEF0) ^ rng.integers(0, 1 << 11, 900, dtype=np.uint64))
    a, b = simhash._group_links(fp, 2)
    lab = simhash._components(len(fp), a, b)
    i, j = np.triu_indices(len(fp), 1)
    ok = np.bitwise_count(fp[i] ^ fp[j]) <= 2
    assert np.array_equal(lab, simhash._components(len(fp), i[ok], j[ok]))


def test_near_duplicates_rows_and_edge_cases(spark):
    rng = random.Random(5)
    body = [" ".join(rng.choice(["red", "blue", "green", "sea", "sky"]) + str(rng.randrange(50)) for _ in range(80)) for _ in range(6)]
    rows = [(i, body[i % 6] + (" extra" if i > 11 else ""), "x") for i in range(18)] + [
        (40, None, "x"), (41, "", "x"), (42, " \n ", "x"), (None, body[0], "x"), (7, body[1], "x"), (50, "word " * 4000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")  # fp: a clashing name
    got = simhash.near_duplicates(df).toPandas()
    assert len(got) == len(rows)
    fps = [brute_fp(t) for _, t, _ in rows]
    lab = brute_components(fps)
    want = []
    for k, (i, _, _) in enumerate(rows):
        ids = [r[0] for r, l in zip(rows, lab, strict=True) if l == lab[k] and r[0] is not None]
        want.append((i, fps[k], min(ids)))
    have = [(None if pd.isna(i) else int(i), int(f) % 2**64, int(c)) for i, f, c in got[["id", "fp", "component"]].itertuples(index=False)]
    assert sorted(have, key=str) == sorted(want, key=str)
    signed = {f: f - 2**64 if f >= 2**63 else f for f in fps}
    root = {f: min(signed[g] for g, m in zip(fps, lab, strict=True) if m == lab[fps.index(f)]) for f in fps}
    assert all(root[int(f) % 2**64] == int(r) for f, r in got[["fp", "root"]].itertuples(index=False))
    empty = simhash.near_duplicates(df.limit(0))
    assert empty.columns == ["id", "fp", "component", "root"] and empty.count() == 0
