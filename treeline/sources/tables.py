"""Parquet tables bound to the atoms of a query."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.relation import rename


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, a local one if the session runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="treeline-")
    return f"{found.rstrip('/')}/treeline-{uuid.uuid4().hex}"


def stored(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a DataFrame to a shared folder and gives it back as it is read from there."""
    folder, made = shared_folder(spark), []

    def keep(df: DataFrame) -> DataFrame:
        made.append(f"{folder}/{len(made)}")
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bind(spark: SparkSession, folder: str, atoms: Mapping[str, tuple[str, Mapping[str, str]]]) -> dict[str, DataFrame]:
    """atom -> (table, {column: variable}): only the columns named are read."""
    return {atom: rename(table(spark, folder, name), dict(names)) for atom, (name, names) in atoms.items()}
