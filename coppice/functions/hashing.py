"""Deterministic pseudo-random columns.

``rand`` depends on partitioning and on the attempt of a task; a hash of the row id does
not, so splits, folds and bags survive re-partitioning and lost executors unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_PER_DRAW = 8
_DRAWS_PER_DIGEST = 32 // _HEX_PER_DRAW
_SPAN = float(2**32)


def _digest(ids: list[str], salt: str) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(salt)))


def _draw(digest: Column, position: int) -> Column:
    chunk = F.substring(digest, position * _HEX_PER_DRAW + 1, _HEX_PER_DRAW)
    return F.conv(chunk, 16, 10).cast("bigint")


def stable_hash(ids: list[str], salt: str | int = 0) -> Column:
    """32-bit non-negative hash of the id columns; the same on every layout."""
    return _draw(_digest(ids, str(salt)), 0)


def uniform01(ids: list[str], salt: str | int = 0) -> Column:
    """Hash of the id columns scaled to [0, 1)."""
    return stable_hash(ids, salt) / F.lit(_SPAN)


def poisson1(u: Column) -> Column:
    """Poisson(1) value at probability ``u``, exact at 32-bit resolution."""
    steps, cumulative, k = [], 0.0, 0
    while 1.0 - cumulative > 1.0 / _SPAN:
        cumulative += math.exp(-1.0) / math.factorial(k)
        steps.append((k, cumulative))
        k += 1
    out = F.when(u < F.lit(steps[0][1]), F.lit(0))
    for value, bound in steps[1:]:
        out = out.when(u < F.lit(bound), F.lit(value))
    return out.otherwise(F.lit(k)).cast("int")


def bag_weight(ids: list[str], bag: int, seed: int = 0) -> Column:
    """Bootstrap multiplicity of a row in one bag (0 means out-of-bag).

    One digest serves four consecutive bags, so B bags cost B/4 digests per row when
    asked for together.
    """
    return poisson1(_bag_uniform(ids, bag, seed))


def out_of_bag(ids: list[str], bag: int, seed: int = 0) -> Column:
    """True where ``bag_weight`` is 0; evaluates the hash once, also inside a filter."""
    return _bag_uniform(ids, bag, seed) < F.lit(math.exp(-1.0))


def _bag_uniform(ids: list[str], bag: int, seed: int) -> Column:
    digest = _digest(ids, f"{seed}:{bag // _DRAWS_PER_DIGEST}")
    return _draw(digest, bag % _DRAWS_PER_DIGEST) / F.lit(_SPAN)
