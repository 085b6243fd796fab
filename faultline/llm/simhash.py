"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint holds 64 majority bits of the XXH64 values of a text's word
shingles. Two fingerprints link when they differ in at most ``max_bits`` bits.
The 64 bits are cut into ``max_bits`` segments at most half as many as plain
pigeonholing needs: with ``max_bits = 2`` and two 32-bit segments, one segment
of any linked pair differs by at most one bit. The index therefore holds each
segment as it is and with each single bit made a wildcard; equal keys give the
candidates, which are verified on the whole fingerprint.

Bounded groups. Only distinct fingerprints are indexed (copies collapse in a
pre-aggregated group-by). Rows of a key meet in a hash bucket, and each bucket
returns the links reduced to stars of its local components, never its pairs.
A segment value held by more than ``hot`` fingerprints is keyed a second time:
its other bits differ by at most two, so among three pieces of them one is
equal; such a key fixes at least 31 + 10 of the 64 bits, which bounds the group
by the 2**23 values of the free bits (64 MB) whatever the corpus. Large groups
are searched by probing the sorted values (linear in the group), not by pairs.

Defined cases: null or wordless text has fingerprint 0 and links like any
other; fewer words than the shingle length give one shingle of all words; a
null ``id`` keeps its row and component (the component's label is the smallest
non-null id, null if it has none); repeated rows are returned as often as they
come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, numbered, prepare, shuffle_partitions, utf8
from faultline.operators.dbscan import connected_components
from faultline.session import materialize

#: XXH64 seed of the fingerprints.
SEED = 42
#: Distinct fingerprints that share a segment value before the value is split further.
HOT_SEGMENT = 20_000
#: Index rows per bucket that one task handles at a time.
BUCKET_ROWS = 400_000
#: Groups up to this size are verified pair by pair inside their task.
PAIR_GROUP = 512


def fingerprint_bytes(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.lower().split()  # bytes: only A-Z and the six ASCII blanks
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - 1 - np.fromiter(map(len, words), np.int64, n))[: n - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bits unpacked in bounded blocks
        block = h[at:at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per input row, the fingerprint as a signed long."""
    def make():
        def run(b):
            fp = np.array([fingerprint_bytes(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            return {"id": b.column(0), "fp": fp.view(np.int64)}
        return run

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")), make,
                       "id long, fp long")


def _masks(bits: list[int], most: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)]


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable, for a graph of n nodes."""
    lab = np.arange(n)
    while len(a):
        old = lab.copy()
        np.minimum.at(lab, a, lab[b])
        np.minimum.at(lab, b, lab[a])
        lab = lab[lab]
        if np.array_equal(lab, old):
            break
    return lab


def _group_links(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what is linked within one group of sorted distinct values."""
    n = len(fp)
    if n <= PAIR_GROUP:
        i, j = np.triu_indices(n, 1)
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        return i[ok], j[ok]
    free = np.bitwise_or.reduce(fp ^ fp[0])
    bits = [b for b in range(64) if int(free) >> b & 1]
    masks = _masks(bits, max_bits)[1:]
    if len(masks) > n:  # fewer pairs than probes
        out_a, out_b = [], []
        for i in range(n - 1):
            j = i + 1 + np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= max_bits)
            out_a.append(np.full(len(j), i))
            out_b.append(j)
        return np.concatenate(out_a), np.concatenate(out_b)
    lab, index = np.arange(n), np.arange(n)
    for m in masks:  # links are merged as they come: a dense group holds far more of them than rows
        other = fp ^ np.uint64(m)
        at = np.minimum(np.searchsorted(fp, other), n - 1)
        hit = np.flatnonzero(fp[at] == other)
        lab = _components(n, np.concatenate([index, hit]), np.concatenate([lab, at[hit]]))
    return index, lab


def bucket_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fp, smaller fp) stars of the links among rows with equal keys."""
    order = np.lexsort((fps, keys))
    k, v = keys[order], fps[order].astype(np.uint64)
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[start, len(k)])
    src, dst = [], []
    two = start[size == 2]  # most keys that are shared at all are shared by two
    ok = np.bitwise_count(v[two] ^ v[two + 1]) <= max_bits
    src.append(v[two[ok] + 1])
    dst.append(v[two[ok]])
    for s, c in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        f = v[s:s + c]
        lab = _components(c, *_group_links(f, max_bits))
        moved = np.flatnonzero(lab != np.arange(c))
        src.append(f[moved])
        dst.append(f[lab[moved]])
    a, b = np.concatenate(src), np.concatenate(dst)
    if len(a):
        a, b = np.unique(np.stack([a, b]), axis=1)
    return a, b


def links(distinct: DataFrame, max_bits: int = 2, hot: int = HOT_SEGMENT) -> DataFrame:
    """(src, dst): links between distinct fingerprints (column fp), as stars."""
    if not 1 <= max_bits <= 2:
        raise ValueError("two segments with one wildcard each cover a distance of 1 or 2")
    spark = distinct.sparkSession
    low = F.lit(0xFFFFFFFF).cast("long")
    segment = [F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32)]
    # key: segment number, wildcard (32: none), the segment without its wildcard bit
    wild = F.expr("transform(sequence(0L, 32L), i -> if(i = 32L, 0L, shiftleft(1L, int(i))))")

    def keyed(part: int):
        return F.transform(wild, lambda w, i: F.struct(
            (F.lit(part) * 33 + i).cast("long").alias("slot"),
            F.col("s").bitwiseAND(F.bitwise_not(w)).alias("value")))

    parts = [distinct.select("fp", segment[p].alias("s"), F.lit(p).alias("p")) for p in (0, 1)]
    hot_values = [q.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
                  .select(F.explode(keyed(p)).alias("k")).select("k.slot", "k.value") for p, q in enumerate(parts)]
    hot_keys = materialize(hot_values[0].unionByName(hot_values[1]).distinct())
    index = parts[0].select("fp", F.explode(keyed(0)).alias("k")) \
        .unionByName(parts[1].select("fp", F.explode(keyed(1)).alias("k"))).select("fp", "k.slot", "k.value")
    if hot_keys.isEmpty():
        index = index.select("fp", F.xxhash64("slot", "value").alias("key"))
    else:
        other = F.when(F.col("slot") < 33, segment[1]).otherwise(segment[0])
        pieces = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftright(other, s).bitwiseAND(F.lit(m).cast("long")).alias("v"))
                           for i, (s, m) in enumerate(((0, 2047), (11, 2047), (22, 1023)))])
        marked = index.join(hot_keys.withColumn("split", F.lit(True)), ["slot", "value"], "left")
        index = marked.select("fp", "slot", "value", F.explode(
            F.when(F.col("split"), pieces).otherwise(F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("v"))))
        ).alias("piece")).select("fp", F.xxhash64("slot", "value", "piece.i", "piece.v").alias("key"))

    # a chance clash of 64-bit keys only adds candidates: each is verified on the whole fingerprint
    n = distinct.count()
    buckets = max(shuffle_partitions(spark), -(-n * 66 // BUCKET_ROWS))

    def solve(batch: pd.DataFrame) -> pd.DataFrame:
        a, b = bucket_links(batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), max_bits)
        return pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})

    return index.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket") \
        .applyInPandas(solve, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """(id, fp, component, root): one row per input row; ``root`` is the
    component's smallest fingerprint. See the module's text."""
    prepare(docs.sparkSession)
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("first_id")))
    comp = connected_components(distinct, links(distinct.select("fp"), max_bits), id_col="fp")
    label = comp.join(distinct, comp["id"] == distinct["fp"]).select("fp", F.col("component").alias("root"), "first_id")
    first = label.groupBy("root").agg(F.min("first_id").alias("component"))
    named = materialize(label.join(first, "root").select("fp", "root", "component"))
    return fps.join(named, "fp").select("id", "fp", "component", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 2) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id (a row
    without an id only where no row of the component has one)."""
    given = docs.columns
    id_col, text_col = f"c{given.index(id_col)}", f"c{given.index(text_col)}"
    docs = numbered(docs)
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("b"))
    best = materialize(best.select(F.col("b.id").alias("_id"), F.col("b.fp").alias("_fp")))
    kept = docs.join(best, F.col(id_col).cast("long").eqNullSafe(F.col("_id")))
    # the same id may stand on rows of other texts, and repeat: the fingerprint and one row decide
    sizes = kept.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id")
    names = docs.columns
    if sizes.isEmpty():
        return kept.select(*names).toDF(*given)
    several = kept.join(sizes.withColumnRenamed("_id", "_s"), F.col("_id").eqNullSafe(F.col("_s")))
    checked = _with_fingerprint(several.select(*names, "_id", "_fp"), text_col, shingle).filter("_own = _fp") \
        .groupBy("_id", "_fp").agg(F.first(F.struct(*names)).alias("r")).select("r.*")
    single = kept.join(sizes.withColumnRenamed("_id", "_s"), F.col("_id").eqNullSafe(F.col("_s")), "left_anti").select(*names)
    return single.unionByName(checked).toDF(*given)


def _with_fingerprint(rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    own = F.pandas_udf(lambda t: pd.Series([np.uint64(fingerprint_bytes(x, shingle)).astype(np.int64) for x in t]), "long")
    return rows.withColumn("_own", own(utf8(text_col)))
