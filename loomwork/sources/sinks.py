"""Tables and records written out, and results that are read again if they are there."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, one for each partition; quotes are doubled, so that every text is read back."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def plain(value):
    """value as JSON has it: NumPy numbers and arrays as Python's, NaN and infinity as null, anything else unknown as its text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if isinstance(value, (str, int, bool)) or value is None else str(value)


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    """One small record, by the session's own file system."""
    fs, p = _filesystem(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(plain(record), ensure_ascii=False, sort_keys=True).encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def json_rows(df: DataFrame) -> DataFrame:
    """(json): each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_sparse(df: DataFrame, path: str, row: str, column: str, value: str) -> None:
    """A matrix as its cells other than 0: (row, col, value)."""
    df.select(F.col(row).alias("row"), F.col(column).alias("col"), F.col(value).cast("double").alias("value")).filter("value <> 0").write.mode("overwrite").parquet(path)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], mode: str = "auto") -> DataFrame:
    """The table at path; it is built and written first where it is missing, or always with mode "rebuild". With mode "read" a missing one raises."""
    fs, p = _filesystem(spark, path)
    done = fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
    if mode == "read" and not done:
        raise FileNotFoundError(path)
    if mode == "rebuild" or not done:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_manifest(spark: SparkSession, folder: str, stage: str, method: str, tables: dict[str, str], **more) -> str:
    """A record of what a stage made: its method and where its tables lie; returns the record's path."""
    path = f"{folder}/{stage}_manifest.json"
    write_json(spark, {"stage": stage, "method": method, "tables": tables, **more}, path)
    return path


def read_manifest(spark: SparkSession, folder: str, stage: str) -> dict[str, DataFrame]:
    """The tables of a stage's record; raises if one is missing."""
    found = read_json(spark, f"{folder}/{stage}_manifest.json")["tables"]
    missing = [name for name, path in found.items() if not exists(spark, path)]
    if missing:
        raise FileNotFoundError(f"{stage}: {', '.join(sorted(missing))}")
    return {name: spark.read.parquet(path) for name, path in found.items()}
