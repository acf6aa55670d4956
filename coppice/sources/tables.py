"""Delimited input and the tables handed from one study stage to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def normalise_names(df: DataFrame) -> DataFrame:
    """Replace dots in column names and name an unnamed leading column ``X``."""
    names = ["X" if c in {"", "_c0"} and i == 0 else c.replace(".", "_") for i, c in enumerate(df.columns)]
    if len(set(names)) != len(names):
        raise ValueError(f"column names clash after normalising: {names}")
    return df.toDF(*names)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    missing: str = "NA",
    sep: str = ",",
) -> DataFrame:
    """Read delimited text with a header.

    With a schema the file is read once, lazily; without one the types are inferred by an
    extra pass, so pass a schema for large inputs.
    """
    reader = spark.read.option("header", True).option("nullValue", missing).option("sep", sep)
    reader = reader.option("quote", '"').option("escape", '"')  # a quote inside quotes is doubled
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return normalise_names(reader.csv(path))


def _write(df: DataFrame, path: str, fmt: str, partition: str | None) -> None:
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA").option("escape", '"')
    writer.format(fmt).save(path)


def write_predictions(
    predictions: DataFrame, path: str, fmt: str = "parquet", partition: str | None = "model"
) -> None:
    """Store long predictions (or their summaries), one folder per model."""
    _write(predictions, path, fmt, partition)


def write_curves(curves: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store the series behind dependence charts, one folder per variable."""
    _write(curves, path, fmt, "variable")
