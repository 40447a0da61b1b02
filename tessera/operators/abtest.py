"""A/B tests: click-through per group of sessions, t criterion, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import row_numbers
from tessera.tables import materialize

GROUP = 1000


def split_name(col="split_name"):
    """Spellings of a split's name made one: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.col(col)), r"[^\p{L}\p{N}]+", "")


def session_stats(sessions: DataFrame) -> DataFrame:
    """``split, session_id, has_click, mean_clicks``; null splits and null or empty click lists take no part."""
    total = F.aggregate("clicks", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("bigint"))
    return sessions.filter("split_name is not null and size(clicks) > 0").select(split_name().alias("split"), "session_id", (total > 0).cast("int").alias("has_click"), (total / F.size("clicks")).alias("mean_clicks"))


def group_metrics(sessions: DataFrame, size: int = GROUP) -> DataFrame:
    """``split, grp, ctr, mean_clicks`` of each full group of ``size`` successive sessions (by id) of a split; the incomplete last group is dropped."""
    numbered = row_numbers(session_stats(sessions), ["split"], [F.col("session_id")], "sessions")
    return (
        numbered.withColumn("grp", F.floor((F.col("row") - 1) / size).cast("bigint"))
        .groupBy("split", "grp")
        .agg(F.avg("has_click").alias("ctr"), F.avg("mean_clicks").alias("mean_clicks"), F.count("*").alias("n"))
        .filter(F.col("n") == size)
        .drop("n")
    )


def t_criterion(groups: DataFrame, a: str, b: str, metric: str, limit: float = 1.96) -> DataFrame:
    """``metric, t, reject`` of |m1 - m2| / sqrt(v1/n1 + v2/n2) with sample variances; null where a variance can't be had."""
    side = lambda s, n: [F.avg(F.when(F.col("split") == s, F.col(metric))).alias(f"m{n}"), F.var_samp(F.when(F.col("split") == s, F.col(metric))).alias(f"v{n}"), F.count(F.when(F.col("split") == s, 1)).alias(f"n{n}")]
    t = F.abs(F.col("m1") - F.col("m2")) / F.sqrt(F.expr("nullif(v1 / n1 + v2 / n2, 0)"))
    return groups.agg(*side(a, 1), *side(b, 2)).select(F.lit(metric).alias("metric"), F.round(t, 6).alias("t"), (t > limit).cast("int").alias("reject"))


def bootstrap(groups: DataFrame, a: str, b: str, metric: str, iterations: int = 1000, seed: int = 5, limit: float = 1.96) -> DataFrame:
    """``metric, asl``: share of bootstrap iterations in which the t criterion rejects.

    Every group gets a Poisson(1) weight in each iteration, drawn from a hash of (row, iteration), so nothing
    is collected and each iteration is one aggregate: groups x iterations rows are summed with a map-side combine.
    """
    known = materialize(groups.filter(F.col("split").isin(a, b)).select("split", "grp", F.col(metric).alias("x")), "groups")
    u = (F.pmod(F.xxhash64("split", "grp", "iteration", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = sum((u > p).cast("int") for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975))
    drawn = known.select("split", "grp", "x", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration")).withColumn("w", weight)
    sums = drawn.groupBy("iteration", "split").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("s"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("ss"))
    spread = F.col("ss") - F.try_divide(F.col("s") * F.col("s"), F.col("n"))
    stats = sums.select("iteration", "split", "n", F.try_divide("s", "n").alias("m"), F.try_divide(spread, F.col("n") - 1).alias("v")).filter("n > 1")
    one = stats.filter(F.col("split") == a).select("iteration", F.col("n").alias("n1"), F.col("m").alias("m1"), F.col("v").alias("v1"))
    two = stats.filter(F.col("split") == b).select("iteration", F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("v").alias("v2"))
    t = F.try_divide(F.abs(F.col("m1") - F.col("m2")), F.sqrt(F.greatest(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"), F.lit(0.0))))
    return one.join(two, "iteration").agg(F.lit(metric).alias("metric"), F.round(F.avg((t > limit).cast("int")), 6).alias("asl"))
