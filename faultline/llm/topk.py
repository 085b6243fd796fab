"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range partitioned by length, longest first, into buckets of like
length. A query starts with a lower bound of its k-th best score from the
longest bucket and then visits buckets in that order. In a bucket whose longest
vector is l, only vectors with cosine ``bound / (|q| * l)`` or more can still
win: where that local threshold is high, a few of the query's largest
coordinates give ranges that a candidate's coordinates must lie in; where it is
not, only the prefix of vectors that are long enough is multiplied. Every
candidate's product is then computed exactly, and the bound rises with it.
Buckets that are too short for all queries of a block are never sent to it.

The query set is a stated one and meets the buckets in blocks; a task holds one
query block (``QUERY_BLOCK`` rows) and one bucket group (about ``BUCKET`` times
``GROUP`` rows), whatever the table's size, and returns at most k rows a query.

Defined cases: vectors that are null, or hold null or non-finite components,
and rows without an id take no part; vectors of other lengths (dimensions) than
the query's are no candidates; a query's own id is never its candidate, however
often the row repeats, and a repeated row counts once; equal scores rank the
smaller id first; fewer than k candidates give fewer rows; extra columns are
ignored; an empty table gives an empty result. Finite components of any size
are multiplied exactly (as Python integers where 64 bits do not hold the sum); a
score beyond a long is returned as the largest or smallest long and ties there.
A component that is no finite double any more after scaling counts as non-finite.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, prepare
from faultline.session import materialize

#: Rows of a bucket, buckets of a group, queries of a block.
BUCKET, GROUP, QUERY_BLOCK = 4096, 8, 8192
#: Local cosine threshold from which coordinates are looked at, and how many.
COORDINATE_COSINE, COORDINATES = 0.6, 3
#: Largest score that is returned.
TOP_SCORE = 2**63 - 1
#: Relative slack of the pruning bounds against rounding.
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, dim, norm, v): floor(scale * x) of the usable vectors, as bytes of integer-valued doubles."""
    def make():
        def run(b):
            ids, vecs = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = {"id": [], "dim": [], "norm": [], "v": []}
            for i, x in zip(ids, vecs, strict=True):
                if x is None or any(e is None for e in x):
                    continue
                with np.errstate(over="ignore"):
                    a = np.floor(scale * np.array(x, np.float64)) + 0.0  # no negative zeros
                if not np.isfinite(a).all():
                    continue
                largest = max(np.abs(a).max(initial=0.0), 1.0)
                out["id"].append(i)
                out["dim"].append(len(a))
                out["norm"].append(min(float(largest * np.linalg.norm(a / largest)), np.finfo(np.float64).max))
                out["v"].append(a.astype("<f8").tobytes())
            return out
        return run

    rows = vectors.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return map_batches(rows, make, "id long, dim int, norm double, v binary")


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v), "<f8").reshape(len(v), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, kept within a long."""
    with np.errstate(over="ignore"):
        top = np.abs(a).max(axis=1, initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if (top < 2**53).all():
        return (a @ b.T).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    high = np.abs(b).max(axis=1, initial=0)
    for i, row in enumerate(a):
        with np.errstate(over="ignore"):
            fits = np.abs(row).max(initial=0) * high * max(len(row), 1) < 2**62
        small = np.abs(row).max(initial=0) < 2**62
        out[i, fits] = b[fits].astype(np.int64) @ row.astype(np.int64) if small else 0  # a zero vector's product is 0
        left = [int(x) for x in row]
        out[i, ~fits] = [min(max(sum(x * int(y) for x, y in zip(left, v, strict=True)), -TOP_SCORE), TOP_SCORE) for v in b[~fits]]
    return out


def merge_top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query: highest score, then smaller id; an id counts once."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k] if len(ids) == len(np.unique(ids)) else scores.min()
        keep = scores >= cut
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], scores[first]


class Bucket:
    """Vectors of like length, longest first, with sorted coordinate lists on demand."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, v: np.ndarray):
        order = np.lexsort((ids, -norms))
        self.ids, self.norms, self.v = ids[order], norms[order], v[order]
        self.unit = self.v / np.maximum(self.norms, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinates(self, q: np.ndarray, cosine: float) -> np.ndarray:
        """Positions whose focus coordinates can reach the cosine (q: unit query)."""
        focus = np.argsort(-np.abs(q))[:COORDINATES]
        hits = np.zeros(len(self.ids), np.int64)
        for f in focus.tolist():
            if f not in self.lists:
                order = np.argsort(self.unit[:, f], kind="stable")
                self.lists[f] = order, self.unit[order, f]
            order, values = self.lists[f]
            half = np.sqrt(max(0.0, 1 - cosine**2) * max(0.0, 1 - q[f]**2)) + SLACK
            # the range is one-sided where the query itself lies within the cone's cap
            low = -1.0 if -q[f] >= cosine else cosine * q[f] - half
            high = 1.0 if q[f] >= cosine else cosine * q[f] + half
            a, b = np.searchsorted(values, [low - SLACK, high + SLACK], side="left")
            hits[order[a:max(a, b)]] += 1
        return np.flatnonzero(hits == len(focus))


def search_bucket(bucket: Bucket, q_ids, q_norms, q, best: list, k: int, floor: np.ndarray) -> None:
    """Update ``best`` (ids, scores per query) with a bucket's candidates."""
    n = len(bucket.ids)
    wide: dict[int, list[int]] = {}
    for i in range(len(q_ids)):
        bound = floor[i]
        have = best[i][1]
        if len(have) >= k:
            bound = max(bound, have[k - 1])
        if bound == -np.inf or bound <= 0 or q_norms[i] == 0:
            wide.setdefault(n, []).append(i)
            continue
        length = bound / q_norms[i] * (1 - SLACK)
        fit = int(np.searchsorted(-bucket.norms, -length, side="right"))
        if not fit:
            continue
        cosine = bound / (q_norms[i] * bucket.norms[0]) * (1 - SLACK)
        if cosine >= COORDINATE_COSINE:
            at = bucket.by_coordinates(q[i] / q_norms[i], min(cosine, 1.0))
            at = at[at < fit]
            if len(at):
                _update(best, i, q_ids[i], bucket.ids[at], products(q[i:i + 1], bucket.v[at])[0], k, bound)
        else:
            wide.setdefault(-(-fit * 16 // n) * n // 16, []).append(i)  # like prefixes share a product
    for fit, members in wide.items():
        for at in range(0, len(members), 512):
            part = members[at:at + 512]
            scores = products(q[part], bucket.v[:min(fit, n)])
            for row, i in enumerate(part):
                _update(best, i, q_ids[i], bucket.ids[:min(fit, n)], scores[row], k, floor[i])


def _update(best: list, i: int, own: int, ids: np.ndarray, scores: np.ndarray, k: int, bound: float) -> None:
    keep = (scores >= bound) & (ids != own)
    best[i] = merge_top(np.concatenate([best[i][0], ids[keep]]), np.concatenate([best[i][1], scores[keep]]), k)


def _solve(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k of each query among the vectors of one bucket group."""
    out = []
    for dim, qs in queries.groupby("dim"):
        vs = vectors[vectors["dim"] == dim]
        if not len(vs):
            continue
        q, q_ids, q_norms = _matrix(qs["v"], dim), qs["id"].to_numpy(), qs["norm"].to_numpy()
        floor = qs["bound"].fillna(-np.inf).to_numpy(np.float64)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
        for _, rows in sorted(vs.groupby("bucket")):
            search_bucket(Bucket(rows["id"].to_numpy(), rows["norm"].to_numpy(), _matrix(rows["v"], dim)),
                          q_ids, q_norms, q, best, k, floor)
        out += [(i, c, s) for i, (ids, scores) in zip(q_ids.tolist(), best, strict=True)
                for c, s in zip(ids.tolist(), scores.tolist(), strict=True)]
    return pd.DataFrame(out, columns=["query_id", "id", "score"])


RESULT = "query_id long, id long, score long"


def search(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: float = 256.0, bucket: int = BUCKET, group: int = GROUP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k best of each row that ``is_query``
    (a condition on the column ``id``) among all other rows."""
    spark = vectors.sparkSession
    prepare(spark)
    ints = materialize(integer_vectors(vectors, id_col, vector_col, scale).dropDuplicates(["id", "dim", "norm", "v"]))
    total = ints.count()
    parts = max(1, -(-total // bucket))
    ranged = materialize(ints.repartitionByRange(parts, F.desc("norm"), F.asc("id")).withColumn("bucket", F.spark_partition_id()))
    queries = materialize(ranged.filter(is_query).drop("bucket").dropDuplicates(["id"]))
    blocks = max(1, -(-queries.count() // query_block))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # phase 1: bounds from the longest bucket (``bucket`` rows, however large the table)
    seeds = ranged.filter(F.col("bucket") == 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = queries.withColumn("bound", F.lit(None).cast("double")).groupBy("block").cogroup(seeds.groupBy("block")) \
        .applyInPandas(lambda q, v: _solve(q, v, k), RESULT)
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("bound"))
    bounded = materialize(queries.join(bounds.withColumnRenamed("query_id", "id"), "id", "left"))
    # phase 2: a block meets the bucket groups that are long enough for any of its queries
    least = bounded.groupBy("block").agg(F.min(F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / F.col("norm"))
                                               .otherwise(0.0)).alias("length"))
    groups = ranged.groupBy((F.col("bucket") / group).cast("int").alias("group")).agg(F.max("norm").alias("longest"))
    pairs = materialize(least.join(groups, F.col("longest") >= F.col("length") * (1 - SLACK)).select("block", "group"))
    left = bounded.join(pairs, "block")
    right = ranged.withColumn("group", (F.col("bucket") / group).cast("int")).join(pairs, "group")
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")) \
        .applyInPandas(lambda q, v: _solve(q, v, k), RESULT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "id", "score")
