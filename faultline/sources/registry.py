"""Named-dataset registry (S1): name -> how to read it and which column is the label.

The registry is driver-side configuration, not data. ``load_dataset`` reads
the source, then applies the reference's row rules: drop rows where every
column is missing (F1) and rows with a missing label (F2).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from faultline.operators import prepare as P
from faultline.sources import files
from faultline.sources import testdata as td


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    label_column: str
    description: str = ""
    path: str | None = None              # parquet / csv / headerless text file(s)
    fmt: str = "parquet"                 # parquet | csv | rows (header at row N)
    header_row: int = 0                  # 0-based row holding the column names (fmt="rows")
    feature_name_row: int | None = None  # row holding display names (fmt="rows")
    builder: Callable[[SparkSession, str], DataFrame] | None = field(default=None, compare=False)


class Registry:
    def __init__(self, configs: list[DatasetConfig] | None = None):
        self._cfg: dict[str, DatasetConfig] = {}
        for c in configs or []:
            self.add(c)

    def add(self, cfg: DatasetConfig) -> None:
        self._cfg[cfg.name] = cfg

    def names(self) -> list[str]:
        return list(self._cfg)

    def get(self, name: str) -> DatasetConfig:
        if name not in self._cfg:
            raise ValueError(f"Unknown dataset: {name}. Available: {', '.join(self._cfg)}")
        return self._cfg[name]

    def load(self, spark: SparkSession, name: str, root: str = "") -> tuple[DataFrame, str, dict[str, str]]:
        """-> (DataFrame, label column, feature-name map)."""
        cfg = self.get(name)
        name_map: dict[str, str] = {}
        if cfg.builder is not None:
            df = cfg.builder(spark, root)
        elif cfg.fmt == "parquet":
            df = spark.read.parquet(cfg.path)
        elif cfg.fmt == "csv":
            df = files.read_csv(spark, cfg.path)
        elif cfg.fmt == "rows":
            df = files.read_with_header_row(spark, cfg.path, cfg.header_row)
            if cfg.feature_name_row is not None:
                name_map = files.name_map(spark, cfg.path, cfg.header_row, cfg.feature_name_row)
        else:
            raise ValueError(f"unknown format {cfg.fmt}")
        df = P.drop_all_missing(df)
        if cfg.label_column in df.columns:
            df = P.drop_missing(df, [cfg.label_column])
        return df, cfg.label_column, name_map


def testdata_registry() -> Registry:
    """Datasets derived from the TPC-H-like test tables (root = sf_dir)."""
    return Registry([
        DatasetConfig("unit", "Bug", "one row per part, six metrics", builder=td.unit),
        DatasetConfig("sm", "Bug", "one row per (ship year, part), SM_* metrics", builder=td.sm),
        DatasetConfig("coverage", "Bug", "coverage ratios per (version, filename)", builder=td.coverage),
        DatasetConfig("effort", "Bug", "effort metrics per version id", builder=td.effort),
    ])
