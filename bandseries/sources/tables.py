"""Sinks and sources for tables, datasets, results and models."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import RESULTS, flat_rows

FORMATS = ("parquet", "json")
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; in a folder of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN[app] = _OWN.get(app) or f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_flat(rows: DataFrame, path: str, with_host: bool = False, fmt: str = "parquet") -> None:
    """Flat training rows with or without the host's redshift, a folder for each augmentation pass."""
    columns = [f.name for f in flat_rows(with_host).fields]
    rows.select("pass", *columns).write.partitionBy("pass").format(fmt).save(path)


def read_flat(spark: SparkSession, path: str, with_host: bool = False, fmt: str = "parquet") -> DataFrame:
    """Flat rows back, with their pass; filters on the pass prune folders."""
    schema = flat_rows(with_host).add("pass", T.IntegerType())
    return spark.read.schema(schema).format(fmt).load(path)


def save_dataset(data: DataFrame, path: str, fmt: str = "json") -> None:
    """An assembled dataset with a `split` column, a folder for each split."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r}: use one of {', '.join(FORMATS)}")
    data.write.partitionBy("split").format(fmt).save(path)


def load_dataset(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r}: use one of {', '.join(FORMATS)}")
    return spark.read.schema(schema).format(fmt).load(path)


def save_results(results: DataFrame, path: str) -> None:
    """Result records as JSON, a folder for each model."""
    results.write.mode("append").partitionBy("model").json(path)


def load_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of all folders that exist; a warning for each that doesn't."""
    out = spark.createDataFrame([], RESULTS)
    for path in paths:
        try:
            out = out.unionByName(spark.read.schema(RESULTS).json(path))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            warnings.warn(f"no results at {path}", stacklevel=2)
    return out


def with_results(table: DataFrame, results: DataFrame) -> DataFrame:
    """table (model, ...) with each model's best_params, where there are results."""
    return table.join(results.select("model", "best_params"), "model", "left")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
