"""Running sums and dense row numbers over large groups without a single-task window.

Rows are range-partitioned by (group, order). A window inside each partition and group gives local sums;
the totals of the earlier partitions, one small row per partition and group, are added. The result of the
range step is materialised, so its borders are the same in both uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import materialize


def running_sums(df: DataFrame, groups: list[str], order: list, sums: dict[str, str], name: str = "running") -> DataFrame:
    """``df`` with a column for each of ``sums`` ({new: summed column or '1'}): inclusive sum in ``order`` within ``groups``.

    ``order`` must be total within a group. Nulls count as 0. An empty table stays empty.
    """
    spread = df.repartitionByRange(*[F.col(g) for g in groups], *order).sortWithinPartitions(*[F.col(g) for g in groups], *order)
    kept = materialize(spread.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    local = Window.partitionBy("_pid", *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    value = {new: F.lit(1) if c == "1" else F.coalesce(F.col(c), F.lit(0)) for new, c in sums.items()}
    totals = kept.groupBy(*groups, "_pid").agg(*[F.sum(v).alias(f"_t_{new}") for new, v in value.items()])
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition, not per row of df
    offsets = totals.select(*groups, "_pid", *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in sums])
    out = kept.select("*", *[F.sum(v).over(local).alias(new) for new, v in value.items()])
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups] + [F.col("l._pid") == F.col("r._pid")]
    joined = out.alias("l").join(offsets.alias("r"), on=_all(same))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *[(F.col(f"l.{new}") + F.col(f"r._o_{new}")).alias(new) for new in sums])


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def row_numbers(df: DataFrame, groups: list[str], order: list, name: str = "row") -> DataFrame:
    """``df`` with a dense row number ``row`` from 1 within ``groups``."""
    return running_sums(df, groups, order, {"row": "1"}, name)
