"""Global row numbers and prefix sums without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewloom.session import Scratch

#: Rows that one range holds.
RANGE_ROWS = 1_000_000


def numbered(scratch: Scratch, df: DataFrame, order: list[Column], name: str = "row", value: Column | None = None) -> DataFrame:
    """Adds ``name``: how many rows (or how much of ``value``) come before a row in ``order``.

    Rows go to ranges of the order, which are sorted and written, so that a repeated task cannot move a row; the
    driver sums one number per range; inside a range rows have consecutive ids, and only a ``value`` needs a window. Ties are
    numbered arbitrarily, so the order should be total.
    """
    n = max(1, -(-df.count() // RANGE_ROWS))
    keyed = df if value is None else df.select("*", value.cast("long").alias("__v"))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # ids begin anew in every partition
    ranged = scratch.table(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__before": place}), "ranged")
    size = F.count("*") if value is None else F.sum("__v")
    sums = {r["__part"]: r["s"] for r in ranged.groupBy("__part").agg(size.alias("s")).collect()}
    starts, total = [], 0
    for part in sorted(sums):
        starts.append((part, total))
        total += sums[part]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, 0)], "__p int, __start long"))
    if value is not None:
        inside = Window.partitionBy("__part").orderBy("__before").rowsBetween(Window.unboundedPreceding, -1)
        ranged = ranged.withColumn("__before", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    met = ranged.join(offsets, ranged["__part"] == offsets["__p"])
    return met.select(*df.columns, (F.col("__start") + F.col("__before")).alias(name))
