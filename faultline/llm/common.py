"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from faultline.session import _WRITTEN, ensure_checkpoint_dir, release, ship_package  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test folder, read by Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows of an Arrow batch: documents are long rows, and a worker holds some copies of a batch.
ARROW_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, worker code and batch size for the session (idempotent)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def scratch(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, which ``session.cleanup`` deletes."""
    _WRITTEN.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/faultline-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def utf8(col: str | Column) -> Column:
    """A text column as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (Spark does not tell upper from lower case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..., so that names of an operator's own meet none of the caller's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str) -> DataFrame:
    """Map Arrow batches. ``make()`` runs once per task (worker caches live in
    its closure) and returns a function from a batch to columns by name."""
    schema = schema_of(ddl)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        types = to_arrow_schema(schema)
        for b in batches:
            if b.num_rows:
                out = fn(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[n], type=types.field(n).type, from_pandas=True) for n in names], names=names)

    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class _Young(dict):
    """The younger generation of a ``WordCache``: a word that is looked up for the first time is taken over or coded."""

    def __init__(self, code: Callable, old: dict):
        super().__init__()
        self.code, self.old = code, old

    def __missing__(self, word):
        known = self.old.get(word)
        if known is None:
            known = self.code(word)
        self[word] = known
        return known


class WordCache:
    """Codes of the words of whole texts, each word coded once while it is remembered.

    Two generations of at most ``limit`` words each: what the older one holds is
    taken over when it is met again, the rest is forgotten when the younger one
    is full. Memory is bounded whatever the number of different words.
    """

    def __init__(self, code: Callable, limit: int):
        self.code, self.limit = code, limit
        self.young = _Young(code, {})

    def join(self, words: Iterable) -> bytes:
        """The codes of ``words``, one after another."""
        out = b"".join(map(self.young.__getitem__, words))
        self.turn()
        return out

    def turn(self) -> None:
        """Start a new generation if the younger one is full."""
        if len(self.young) > self.limit:
            self.young.old = {}  # the oldest is forgotten
            self.young = _Young(self.code, self.young)
