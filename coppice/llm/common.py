"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import coppice
from coppice.session import stage

__all__ = ["arrow_map", "doc_remainder", "documents", "fresh", "ship", "stage", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def utf8(column: str | Column) -> Column:
    """The UTF-8 bytes of a text, no bytes for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b""))


def doc_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_map(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``df.mapInArrow``, with this package sent to the executors first."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        folder = Path(tempfile.mkdtemp(prefix="coppice-py-"))
        root = Path(coppice.__file__).parent
        with zipfile.ZipFile(folder / "coppice.zip", "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        context.addPyFile(str(folder / "coppice.zip"))
        _shipped.add(context.applicationId)


_shipped: set[str] = set()
