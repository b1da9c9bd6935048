"""Random columns that depend on seed and row only, so output does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str, stream: int = 0) -> Column:
    """A double in [0, 1) from the seed, the keys of the row and the stream."""
    top = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *keys), 11)
    return top.cast("double") / float(1 << 53)


def integer(seed: int, low: Column | int, high: Column | int, *keys: Column | str, stream: int = 0) -> Column:
    """A whole number from ``low`` up to, not including, ``high``; ``high`` if both are equal, -1 if low is above."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    drawn = low + F.floor(uniform(seed, *keys, stream=stream) * (high - low)).cast("long")
    return F.when(low < high, drawn).when(low == high, high.cast("long")).otherwise(F.lit(-1).cast("long"))


def power_law(seed: int, low: float, high: float, k: float, *keys: Column | str, stream: int = 0) -> Column:
    """Whole part of a draw with density x^k between ``low`` and ``high``; k is not -1."""
    u, e = uniform(seed, *keys, stream=stream), k + 1
    return F.floor(F.pow((high**e - low**e) * u + low**e, F.lit(1 / e))).cast("long")


def exponential(seed: int, mean: float, *keys: Column | str, stream: int = 0) -> Column:
    return -F.lit(mean) * F.log(1 - uniform(seed, *keys, stream=stream))


def geometric(seed: int, p: float, *keys: Column | str, stream: int = 0) -> Column:
    """Trials up to the first success of probability ``p``."""
    if p >= 1:
        return F.lit(1).cast("long")
    return F.greatest(F.lit(1), F.ceil(F.log(1 - uniform(seed, *keys, stream=stream)) / F.log(F.lit(1 - p)))).cast("long")


def pareto(seed: int, mean: float, shape: float, *keys: Column | str, stream: int = 0) -> Column:
    """A Pareto draw with the given mean; the shape is above one."""
    return F.lit(mean * (1 - 1 / shape)) / F.pow(1 - uniform(seed, *keys, stream=stream), F.lit(1 / shape))
