"""Scalar and aggregate column expressions used by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_mean(c: ColumnLike) -> Column:
    """Aggregate mean that is null as soon as one member is null (``avg`` skips nulls)."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def safe_ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Quotient, null for a zero denominator (plain division raises under ANSI)."""
    return F.try_divide(_col(numerator), _col(denominator))


def log2_or_null(c: ColumnLike) -> Column:
    """Base-2 logarithm; null at or below zero."""
    c = _col(c)
    return F.when(c > 0, F.log2(c))


def to_number(c: ColumnLike) -> Column:
    """Double value of a column, null where the text is not a number."""
    return _col(c).try_cast("double")


def residual(predicted: ColumnLike, observed: ColumnLike, sign: str = "predicted-observed") -> Column:
    """Prediction error. ``sign`` picks the direction, as both conventions are in use."""
    if sign == "predicted-observed":
        return _col(predicted) - _col(observed)
    if sign == "observed-predicted":
        return _col(observed) - _col(predicted)
    raise ValueError(f"unknown sign {sign!r}")


def composite_key(*cols: ColumnLike, sep: str = ".") -> Column:
    """One text key out of several columns; a null part is shown as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols])


def mse(predicted: ColumnLike, observed: ColumnLike) -> Column:
    """Aggregate mean squared error over rows that have both values."""
    return F.avg(F.pow(_col(predicted) - _col(observed), F.lit(2)))


def rmse(predicted: ColumnLike, observed: ColumnLike) -> Column:
    """Aggregate root mean squared error."""
    return F.sqrt(mse(predicted, observed))


def r2_explained(predicted: ColumnLike, observed: ColumnLike) -> Column:
    """Aggregate squared correlation as a fraction; null when either side is constant.

    Built from (co)variances because ``corr`` raises on a constant side under ANSI.
    """
    p, o = _col(predicted), _col(observed)
    both = p.isNotNull() & o.isNotNull()
    p, o = F.when(both, p), F.when(both, o)
    return F.try_divide(F.pow(F.covar_pop(p, o), F.lit(2)), F.var_pop(p) * F.var_pop(o))


def r2_out_of_bag(predicted: ColumnLike, observed: ColumnLike) -> Column:
    """Aggregate ``1 - mse / var_samp(observed)`` over rows that have a prediction."""
    p, o = _col(predicted), _col(observed)
    seen = F.when(p.isNotNull(), o)
    return F.lit(1.0) - F.try_divide(mse(p, o), F.var_samp(seen))
