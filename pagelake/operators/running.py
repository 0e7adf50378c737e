"""Running sums that no single task has to order as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_before(df: DataFrame, part: list[str], amount: Column, order: str, width: int | None = None, ties: list[str] | None = None, descending: bool = False, name: str = "__before") -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows of the same ``part`` that come before.

    Rows are ordered by the number ``order`` and then by ``ties``; nulls come first, or
    last if ``descending``, and rows whose ``part`` is null form a part of their own. Sums
    are taken for each stretch of the order first and run over the stretches, then within
    each stretch, so a window sees one stretch or one row for each of them. ``width`` makes
    stretches of that many units of ``order``, right where these hold a bounded number of
    rows; without it the rows are sorted over the cluster and a stretch is what one task
    got of a part, however the values are spread.
    """
    turn = F.desc_nulls_last if descending else F.asc_nulls_first
    keys = [turn(order), *(ties or [])]
    marked = df.withColumn("__amount", amount)
    if width is None:
        ranged = marked.repartitionByRange(*part, *keys) if part else marked.repartitionByRange(*keys)
        # the ids of the ranges are kept, as another evaluation could draw them otherwise
        marked = cut_lineage(ranged.withColumn("__stretch", F.spark_partition_id().cast("bigint")))
        along = F.asc("__stretch")
    else:
        marked = marked.withColumn("__stretch", F.floor(F.col(order) / width))
        along = turn("__stretch")
    marked = marked.withColumn("__place", F.struct(*part, "__stretch"))  # structs with equal nulls are equal
    sums = marked.groupBy(*part, "__stretch", "__place").agg(F.sum("__amount").alias("__sum"))
    over = Window.partitionBy(*part).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__place", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__earlier"))
    inner = Window.partitionBy("__place").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = marked.join(sums, "__place")
    return out.withColumn(name, F.col("__earlier") + F.coalesce(F.sum("__amount").over(inner), F.lit(0))).select(*df.columns, name)
