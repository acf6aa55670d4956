"""Column expressions. All of them stay on the JVM and inside whole-stage codegen."""

from coppice.functions.columns import (
    composite_key,
    log2_or_null,
    mse,
    r2_explained,
    r2_out_of_bag,
    residual,
    rmse,
    safe_ratio,
    strict_mean,
    to_number,
)
from coppice.functions.hashing import bag_weight, out_of_bag, poisson1, stable_hash, uniform01

__all__ = [
    "bag_weight",
    "composite_key",
    "log2_or_null",
    "mse",
    "out_of_bag",
    "poisson1",
    "r2_explained",
    "r2_out_of_bag",
    "residual",
    "rmse",
    "safe_ratio",
    "stable_hash",
    "strict_mean",
    "to_number",
    "uniform01",
]
