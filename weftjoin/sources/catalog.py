"""Tables by binding: folders of Parquet and CSV files, CSVs named by pointer files, schemas from JSON."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Catalog:
    """DataFrames by binding name, registered as temporary views.  Nothing is cached unless asked for."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def add(self, binding: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(binding)
        self.tables[binding] = df
        return df

    def read(self, path: str) -> DataFrame:
        """A Parquet file or folder; a CSV; or a text file that holds the path of a CSV."""
        if path.rstrip("/").endswith(".parquet"):
            return self.spark.read.parquet(path)
        if not path.endswith(".csv"):
            path = "".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect()).replace("\n", "").replace("\r", "").strip()
        return self.spark.read.csv(path, header=True, inferSchema=True, escape="\\")

    @classmethod
    def from_dir(cls, spark: SparkSession, folder: str) -> Catalog:
        """Every file of a folder under its name up to the first dot.  A file that can't be read raises."""
        out = cls(spark)
        for path in out._listed(folder):
            out.add(path.rstrip("/").rsplit("/", 1)[-1].split(".")[0], out.read(path))
        return out

    def _listed(self, folder: str) -> list[str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        paths = [s.getPath() for s in fs.listStatus(root)]
        return sorted(p.toString() for p in paths if not p.getName().startswith((".", "_")))

    @classmethod
    def from_schema_json(cls, spark: SparkSession, path: str) -> Catalog:
        """``{"tables": [{"name", "file", "format": "csv", "schema": <StructType JSON>}]}``; files are relative to the JSON."""
        out, base = cls(spark), Path(path).parent
        for t in json.loads(Path(path).read_text())["tables"]:
            if t.get("format", "csv") != "csv":
                raise ValueError(f"{t['name']}: only csv tables are described by a schema, not {t['format']}")
            out.add(t["name"], spark.read.csv(str(base / t["file"]), schema=StructType.fromJson(t["schema"]), header=t.get("header", True), escape="\\"))
        return out

    def __getitem__(self, binding: str) -> DataFrame:
        return self.tables[binding]

    def clear(self) -> None:
        """Drop the views and whatever was cached of them."""
        for name, df in self.tables.items():
            df.unpersist()
            self.spark.catalog.dropTempView(name)
        self.tables.clear()


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate for the optimised plan; it starts no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes from which on an estimate stands for an unknown size; Catalyst then takes about 2^63, less by the columns left out.
UNKNOWN_BYTES = 1 << 50


def estimated_rows(df: DataFrame) -> float | None:
    """Rows by the same estimate, which knows no filters and takes bytes of files for bytes of rows: good for ratios; None if unknown."""
    size = estimated_bytes(df)
    return None if size >= UNKNOWN_BYTES else max(1.0, size / (8 + df._jdf.schema().defaultSize()))
