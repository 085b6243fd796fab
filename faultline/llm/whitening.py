"""PCA whitening of embedding vectors; leading eigenvectors by spectrum slicing.

A vector is scaled and rounded down to integers, x = floor(scale * c). The fit
list holds each different x once. Its covariance (divisor n, centred before
multiplying) is summed in Spark: every task adds the outer products of its rows
and sends the matrix row by row. Rows then are projected where they lie.

The leading eigenpairs of the d x d covariance are found by slicing:

* the factors L D L' of V - s I (symmetric pivoting, blocks of one or two) tell
  by the signs of D how many eigenvalues lie above s (Sylvester's inertia);
* bisection on that count closes in on the i-th largest eigenvalue until it is
  alone in its slice (or, where eigenvalues are equal in double precision, the
  slice is as narrow as the matrix's rounding);
* Rayleigh quotient iteration from there converges cubically; it is kept
  orthogonal to the vectors found before;
* two more counts, just below and above the quotient, certify that it is the
  i-th. If they do not, bisection goes on and the iteration starts again.

Only sums over a dimension or a pair of dimensions reach the driver (8 d * d bytes,
33 MB at d = 2,048), whatever the number of rows.

Defined cases: rows whose vector is null, or holds null or non-finite entries,
take no part; entries beyond the 64-bit integers are set to the nearest; vectors
of another length than the most frequent one (the longest of equally frequent
ones) have no place in that covariance: their rows come back with null arrays;
equal vectors are fitted once, every row is projected; null and repeated ids are
rows like others; extra columns are ignored; a direction whose eigenvalue is not
above the rounding of the trace (1e-13 of it) is no component, so equal vectors
alone have none; ``deviation`` is null if it exceeds a 64-bit integer; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.llm.common import schema_of
from faultline.session import materialize

#: Eigenvalues up to this share of the trace are rounding.
FLAT = 1e-13
#: Tasks whose sums are added at a time.
FAN_IN = 256
#: Bunch and Kaufman's bound for a pivot of one row (fixed value).
PIVOT = (1 + 17 ** 0.5) / 8


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: the positive
    part of the inertia of D in the factors L D L' of matrix - shift I."""
    a = matrix - shift * np.eye(len(matrix))
    tiny = np.finfo(float).eps * max(np.abs(a).max(initial=0.0), np.finfo(float).tiny)
    count = 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = 1 + int(column.argmax()) if len(column) else 0
        big = column[r - 1] if r else 0.0
        if r and abs(a[0, 0]) < PIVOT * big:
            other = np.abs(a[r])
            other[r] = 0.0
            if abs(a[0, 0]) * other.max() < PIVOT * big * big:
                if abs(a[r, r]) >= PIVOT * other.max():
                    a[[0, r]] = a[[r, 0]]
                    a[:, [0, r]] = a[:, [r, 0]]
                else:  # a block of two: one eigenvalue on either side
                    a[[1, r]] = a[[r, 1]]
                    a[:, [1, r]] = a[:, [r, 1]]
                    count += 1
                    a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
                    continue
        pivot = a[0, 0] if abs(a[0, 0]) > tiny else -tiny  # on an eigenvalue: not above it
        count += pivot > 0
        a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:] / pivot)
    return int(count)


def leading(matrix: np.ndarray, k: int, flat: float = FLAT) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues above ``flat`` of the trace, falling, and their unit vectors (as columns)."""
    d = len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0  # no eigenvalue is beyond it
    least, step = flat * float(np.trace(matrix)) if d else 0.0, np.finfo(float).eps * max(d, 1) * size
    values, vectors = [], np.zeros((d, 0))
    random = np.random.default_rng(1)
    found = above(matrix, least) if size > 0 else 0
    for i in range(1, min(k, found) + 1):
        # slice: above(low) >= i, above(high) < i
        low, high = least, min(size * (1 + 1e-12), values[-1] + 4 * step) if values else size * (1 + 1e-12)
        n_low, n_high, narrow = found, above(matrix, high), False
        if n_high >= i:  # within rounding of the value before
            low, n_low, narrow = values[-1] - 4 * step, i, True
        while True:
            while not narrow and not (n_low == i and n_high == i - 1 and high - low < 0.1 * max(low, least)):
                mid = (low + high) / 2
                n = above(matrix, mid)
                low, n_low, high, n_high = (mid, n, high, n_high) if n >= i else (low, n_low, mid, n)
                narrow = high - low <= 2 * step
            value, vector = _refine(matrix, (low + high) / 2, vectors, random, step)
            margin = max(4 * step, 1e-12 * abs(value))
            certain = above(matrix, value - margin) >= i and above(matrix, value + margin) < i
            if certain or narrow:
                break
            mid = (low + high) / 2  # another value than the i-th: a narrower slice
            n = above(matrix, mid)
            low, n_low, high, n_high = (mid, n, high, n_high) if n >= i else (low, n_low, mid, n)
            narrow = high - low <= 2 * step
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors


def _refine(matrix: np.ndarray, shift: float, known: np.ndarray, random: np.random.Generator,
            step: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of a slice, orthogonal to ``known``."""
    def unit(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - known @ (known.T @ v)
            v = v / np.linalg.norm(v)
        return v

    d = len(matrix)
    v, value, best = unit(random.standard_normal(d)), shift, (np.inf, shift, None)
    for turn in range(30):
        try:
            w = np.linalg.solve(matrix - value * np.eye(d), v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue
            w = np.linalg.solve(matrix - (value + step) * np.eye(d), v)
        if not np.isfinite(w).all():
            break
        v = unit(w)
        quotient = float(v @ matrix @ v)
        residual = float(np.linalg.norm(matrix @ v - quotient * v))
        value = quotient if turn else shift  # one more step of inverse iteration before the quotient leads
        if residual >= best[0] / 2 and turn > 3:
            break
        if residual < best[0]:
            best = (residual, quotient, v)
    return best[1], best[2] if best[2] is not None else v


def _integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x): the rows that take part, x = floor(scale * c) as long."""
    c = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), c.alias("c"))
    sound = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(F.col("c").isNotNull() & F.coalesce(sound, F.lit(False))) \
        .select("id", F.transform("c", lambda v: F.floor(v * scale)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Model:
    """What a fit gives: n, the sums, the components with their eigenvalues, the trace and the error."""

    def __init__(self, d: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.d, self.n, self.sums, self.values, self.vectors, self.trace = d, n, sums, values, vectors, trace
        self.error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.sums, self.n)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2; None beyond 64 bits."""
        top = self.n * max(map(abs, (int(x.max(initial=0)), int(x.min(initial=0))))) + max(map(abs, self.sums), default=0)
        if self.d * top * top < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S / n in doubles: the whole part of S / n is taken off in integers where they are in range."""
    whole = np.array([s // n for s in sums], object)
    part = np.array([(s % n) / n for s in sums])
    safe = len(x) == 0 or max(abs(int(x.max())), abs(int(x.min()))) < 1 << 61
    less = x - whole.astype(np.int64) if safe else (x.astype(object) - whole)
    return less.astype(float) - part


def _sum_rows(rows: DataFrame, make: Callable[[pa.Array], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of the matrices ``make(x)``: added in each task,
    then row by row over ``FAN_IN`` tasks at a time, then over all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = make(b.column(0))
                total = part if total is None else total + part
        if total is not None:
            task, n = TaskContext.get().partitionId() // FAN_IN, len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * n), pa.array(list(range(n))), pa.array([v.tobytes() for v in total])], names=["task", "i", "v"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(b"".join(group["v"]), float).reshape(-1, width).sum(axis=0)
        return pd.DataFrame({"task": group["task"].iloc[:1], "i": group["i"].iloc[:1], "v": [total.tobytes()]})

    ddl = "task long, i long, v binary"
    sums = rows.select("x").mapInArrow(run, ddl).groupBy("task", "i").applyInPandas(add, ddl) \
        .groupBy("i").applyInPandas(add, ddl).orderBy("i").collect()  # d rows
    return np.frombuffer(b"".join(r["v"] for r in sums), float).reshape(-1, width)


def fit(x_rows: DataFrame, k: int) -> Model | None:
    """The model of (id, x) rows; None if there are none."""
    lengths = x_rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows")) \
        .orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0]["d"]
    different = materialize(x_rows.filter(F.size("x") == d).select("x").distinct())
    if d == 0:
        return Model(0, different.count(), [], np.zeros(0), np.zeros((0, 0)), 0.0)
    # whole sums: the digits below and above 2^32 apart, so that no 64-bit sum overflows below 2^31 rows a task
    n, sums = _whole_sums(different, d)
    covariance = _sum_rows(different, lambda c: (lambda y: y.T @ y)(_centred(_matrix(c, d), sums, n)), d) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading(covariance, k)
    model = Model(d, n, sums, values, vectors, float(np.trace(covariance)))
    if len(values):
        k = len(values)

        def moments(c: pa.Array) -> np.ndarray:
            w = model.whiten(_matrix(c, d))
            return np.vstack([w.sum(axis=0), w.T @ w])

        got = _sum_rows(different, moments, k) / n
        model.error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(k)).max())
    return model


def _whole_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            x = _matrix(b.column(0), d)
            n += len(x)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + lo for t, h, lo in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * d), pa.array(list(range(d))), pa.array([t >> 32 for t in total]), pa.array([t & 0xFFFFFFFF for t in total])],
                names=["n", "i", "high", "low"])

    got = rows.mapInArrow(run, "n long, i long, high long, low long").groupBy("i") \
        .agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()  # d rows
    return got[0]["n"], [(r["high"] << 32) + r["low"] for r in got]


def whiten(vectors: DataFrame, k: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error): one row for each
    row that takes part, ``whitened`` and ``explained`` by component (at most ``k``)."""
    rows = _integers(vectors, id_col, vector_col, scale)
    schema = schema_of("id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    model = fit(rows, k)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        explained = (model.values / model.trace).tolist() if len(model.values) else []
        for b in batches:
            fits = b.column(2).to_numpy(zero_copy_only=False) == model.d
            for keep in (fits, ~fits):
                part = b.filter(pa.array(keep))
                m = part.num_rows
                if not m:
                    continue
                if keep is fits:
                    x = _matrix(part.column(1), model.d) if model.d else np.zeros((m, 0), np.int64)
                    values = [model.deviation(x), model.whiten(x).tolist() if len(explained) else [[]] * m, [explained] * m, [model.error] * m]
                else:
                    values = [[None] * m] * 4
                columns = [part.column(0), [model.n] * m, *values]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type)
                                                  for c, t in zip(columns, types, strict=True)], names=types.names)

    return rows.select(F.col("id").cast("long").alias("id"), "x", F.size("x").alias("d")).mapInArrow(run, schema)
