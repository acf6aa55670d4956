"""Categories: lookup maps, alphabetical level codes, ranks as display order."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.operators.joins import BROADCAST_ROWS, fits_broadcast, lookup_join
from coppice.session import stage


def map_categories(
    df: DataFrame,
    mapping: DataFrame,
    key: str,
    category: str = "category",
    default: str | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the category of ``key`` from a (key, category) table; ``default`` fills the gaps."""
    joined = lookup_join(df, mapping.select(key, category), [key], "left", max_rows=max_rows)
    if default is None:
        return joined
    return joined.withColumn(category, F.coalesce(F.col(category), F.lit(default)))


def label_values(
    df: DataFrame,
    labels: DataFrame,
    key: str,
    label: str = "label",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the display label of ``key``, falling back to the raw value."""
    joined = lookup_join(df, labels.select(key, label), [key], "left", max_rows=max_rows)
    return joined.withColumn(label, F.coalesce(F.col(label), F.col(key).cast("string")))


def mapping_frame(spark, mapping: Mapping[str, str], key: str, value: str) -> DataFrame:
    """Two-column table of a small in-code mapping."""
    return spark.createDataFrame(list(mapping.items()), f"{key} string, {value} string")


def _ranked(levels: DataFrame, order: list[str], max_rows: int, known_rows: int | None) -> DataFrame:
    """Distinct rows with their position in the order of ``order``, from 0.

    A plain rank needs all rows in one task, which is fine only when they are counted to be
    few. Beyond the bound they are range-partitioned and staged with their partition number;
    a row's position is its rank inside the partition plus the number of rows in earlier
    partitions (one row per partition).
    """
    few = fits_broadcast(levels, max_rows) if known_rows is None else known_rows <= max_rows
    if few:
        everything = Window.orderBy(*order)
        return levels.withColumn("code", (F.row_number().over(everything) - 1).cast("bigint"))
    slices = max(2, int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(
        levels.repartitionByRange(slices, *order).withColumn("__part", F.spark_partition_id()),
        "levels",
    )
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    within = Window.partitionBy("__part").orderBy(*order)
    return (
        ranged.withColumn("__rank", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "__part")
        .withColumn("code", (F.col("__rank") + F.col("__offset")).cast("bigint"))
        .drop("__part", "__rank", "__offset")
    )


def level_codes(df: DataFrame, col: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Distinct levels of a column with their position in ascending order, from 0."""
    levels = df.select(col).where(F.col(col).isNotNull()).distinct()
    return _ranked(levels, [col], max_rows, None)


def ordinal_encode(
    df: DataFrame, col: str, out: str = "code", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add the level code of ``col``."""
    codes = level_codes(df, col, max_rows).withColumnRenamed("code", out)
    return lookup_join(df, codes, [col], "left", True, max_rows, derived=True)


@dataclass(frozen=True)
class CategoryEncoder:
    """Level codes learnt on a training table, for use on any later table.

    Levels are compared as text and coded alphabetically per column. A value unseen in
    training gets the code one past the last known level.
    """

    levels: DataFrame
    counts: dict[str, int]

    @classmethod
    def fit(
        cls, df: DataFrame, columns: list[str], max_rows: int = BROADCAST_ROWS
    ) -> CategoryEncoder:
        """Learn the levels of all columns in one pass over the table."""
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]
        )
        seen = df.select(F.explode(pairs).alias("__p")).select("__p.column", "__p.level")
        distinct = stage(seen.where(F.col("level").isNotNull()).distinct(), "levels")
        counts = dict.fromkeys(columns, 0)
        counts |= {r["column"]: r["count"] for r in distinct.groupBy("column").count().collect()}
        coded = _ranked(distinct, ["column", "level"], max_rows, sum(counts.values()))
        # positions run through the columns in name order: start each column at 0
        first, total = {}, 0
        for c in sorted(counts, key=lambda name: name.encode()):
            first[c], total = total, total + counts[c]
        start = F.coalesce(*[F.when(F.col("column") == F.lit(c), F.lit(n)) for c, n in first.items()])
        coded = coded.withColumn("code", F.col("code") - start)
        return cls(stage(coded, "level-codes"), counts)

    def transform(self, df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
        """Replace every encoded column by its numeric code (double)."""
        order = df.columns
        for c, known in self.counts.items():
            codes = self.levels.where(F.col("column") == F.lit(c)).select(
                F.col("level").alias("__level"), F.col("code").alias("__code")
            )
            keyed = df.withColumn("__level", F.col(c).cast("string"))
            coded = lookup_join(keyed, codes, ["__level"], "left", True, max_rows)
            code = F.coalesce(F.col("__code"), F.lit(known)).cast("double")
            code = F.when(F.col("__level").isNotNull(), code)
            df = coded.withColumn(c, code).drop("__code", "__level")
        return df.select(*order)


class LevelEncoder(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """``CategoryEncoder`` as a pipeline stage: replaces the input columns by their level codes.

    A level that training has not seen gets the code one past the last known one; nulls stay null.
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _fit(self, dataset: DataFrame) -> LevelEncoderModel:
        columns = self.getInputCols()
        rows = stage(dataset.select(*columns), "uncoded")
        return LevelEncoderModel(CategoryEncoder.fit(rows, columns))._set(inputCols=columns)


class LevelEncoderModel(Model, HasInputCols, MLReadable, MLWritable):
    """Fitted ``LevelEncoder``; saved with its levels as Parquet."""

    def __init__(self, encoder: CategoryEncoder):
        super().__init__()
        self.encoder = encoder

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.encoder.transform(dataset)

    def write(self) -> MLWriter:
        return _LevelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LevelReader(cls)


class _LevelWriter(MLWriter):
    def __init__(self, model: LevelEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        extra = {"counts": self.model.encoder.counts}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)
        self.model.encoder.levels.write.mode("overwrite").parquet(f"{path}/levels")


class _LevelReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> LevelEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        levels = self.sparkSession.read.parquet(f"{path}/levels")
        model = self.kind(CategoryEncoder(levels, dict(metadata["counts"])))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
