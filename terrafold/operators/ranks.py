"""Global row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def global_rank(df: DataFrame, coarse: list[Column], order: list[Column], name: str) -> DataFrame:
    """Add the row number by coarse keys (descending, not null), then by order.

    Rows are numbered within each combination of coarse keys, and the combinations' sizes, a small table, give the
    offsets: so the sort is dealt over tasks, and only the list of combinations meets in one. The coarse keys should
    have many values but far fewer than there are rows."""
    keys = [f"__k{i}" for i in range(len(coarse))]
    keyed = df.withColumns(dict(zip(keys, coarse, strict=True)))
    before = W.orderBy(*[F.desc(k) for k in keys]).rowsBetween(W.unboundedPreceding, -1)
    offsets = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return keyed.join(offsets, keys).withColumn(name, (F.col("__off") + within).cast("int")).drop("__off", *keys)
