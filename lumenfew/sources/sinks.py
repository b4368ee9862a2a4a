"""Sinks: append, overwrite, refuse; and what is still to be done."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lumenfew.functions.metrics import order_free_digest


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Add rows; Spark's commit takes the place of retries."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def create(df: DataFrame, path: str, force: bool = False) -> None:
    """Refuse to overwrite unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def manifest(df: DataFrame, path: str) -> None:
    """Scalar columns only, as CSV with a header."""
    plain = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    df.select(*[f"`{c}`" for c in plain]).write.mode("overwrite").option("header", True).csv(path)


def pending(grid: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Rows of ``grid`` whose keys no earlier run has written; all where nothing is there yet."""
    try:
        done = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return grid
        raise
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenfew-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: made once, whatever is lost later."""
    path = f"{shared(df.sparkSession)}/lumenfew/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digest(df: DataFrame) -> str:
    """16 hex digits of the rows in any order."""
    return df.agg(order_free_digest(*df.columns).alias("d")).first().d[:16]


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """The corpus table, or an error that says how to get one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no corpus at {path}: build it with operators.simulate.corpus and store it with sinks.create") from e


def checked(df: DataFrame, condition: str, message: str) -> DataFrame:
    """``df``, or an error if a row breaks the condition."""
    if not df.where(~F.expr(condition)).isEmpty():
        raise ValueError(message)
    return df
