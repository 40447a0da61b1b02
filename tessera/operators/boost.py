"""Regression trees by exact split search, boosting, bagged boosting, oblivious trees.

Everything is a DataFrame: rows are (row, target, features array); a level of all trees of all bags is
grown by one job. Rows are counted by (bag, node, feature, value), which is what the exact search needs;
running sums over the sorted values give every split's gain. No node's rows are ever collected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import md5_hash
from tessera.operators.prefix import running_sums
from tessera.tables import materialize


def mse(rows: DataFrame, prediction: str = "prediction", target: str = "y") -> DataFrame:
    return rows.agg(F.round(F.avg(F.pow(F.col(prediction) - F.col(target), 2)), 6).alias("mse"))


def split_gains(rows: DataFrame, groups: list[str], min_leaf: int = 1) -> DataFrame:
    """``<groups>, feature, value, gain, n`` of every split value: smaller values go left, the others right.

    ``rows`` has the group columns, x (array of doubles) and y. gain = variance - weighted variance of the
    sides; a split must leave ``min_leaf`` rows left and more than ``min_leaf`` right. Null features never go left.
    """
    long = rows.select(*groups, "y", F.posexplode("x").alias("feature", "value")).filter("value is not null")
    per = long.groupBy(*groups, "feature", "value").agg(F.count("*").alias("c"), F.sum("y").alias("s"))
    total = per.groupBy(*groups, "feature").agg(F.sum("c").alias("n"), F.sum("s").alias("sn"))
    cum = running_sums(per, [*groups, "feature"], [F.col("value")], {"cc": "c", "cs": "s"}, "gains")
    both = cum.join(total, [*groups, "feature"])
    nl, sl = F.col("cc") - F.col("c"), F.col("cs") - F.col("s")  # strictly below the value
    nr, sr = F.col("n") - nl, F.col("sn") - sl
    # variance less the sides' weighted variance is nl nr / n^2 times the squared difference of their means: no squares of the target to cancel
    gain = nl * nr / (F.col("n") * F.col("n")) * F.pow(F.try_divide(sl, nl) - F.try_divide(sr, nr), F.lit(2))
    return both.filter((nl >= min_leaf) & (nr > min_leaf)).select(*groups, "feature", "value", F.round(gain, 9).alias("gain"), "n")


def best_splits(gains: DataFrame, groups: list[str]) -> DataFrame:
    """The split of the largest gain of each group (ties: smaller feature, then smaller value), if it gains anything."""
    best = F.max_by(F.struct("feature", "value", "gain", "n"), F.struct(F.col("gain"), -F.col("feature"), -F.col("value"))).alias("s")
    return gains.groupBy(*groups).agg(best).select(*groups, "s.feature", "s.value", "s.gain", "s.n").filter("gain > 0")


@dataclass
class Forest:
    """Trees as a flat table: (bag, step, node) -> feature, value; leaves -> weight. Node 1 is the root, children 2i and 2i + 1."""

    splits: dict[tuple[int, int], dict[int, tuple[int, float]]]
    leaves: dict[tuple[int, int], dict[int, float]]
    shrinkage: float
    bags: int
    steps: int
    columns: dict[int, list[int]]

    def tree(self, bag: int, step: int) -> Column:
        """Prediction of one tree as an expression."""

        def at(node: int) -> Column:
            if node in self.splits[bag, step]:
                feature, value = self.splits[bag, step][node]
                return F.when(F.coalesce(F.element_at("x", feature + 1) < value, F.lit(False)), at(2 * node)).otherwise(at(2 * node + 1))
            return F.lit(float(self.leaves[bag, step].get(node, 0.0)))

        return at(1)

    def bag(self, bag: int, steps: int | None = None) -> Column:
        out = self.tree(bag, 0)
        for step in range(1, min(steps or self.steps, self.steps)):
            out = out + self.shrinkage * self.tree(bag, step)
        return out

    def predict(self, rows: DataFrame, steps: int | None = None) -> DataFrame:
        """``rows`` with ``prediction``: mean over the bags of the first tree plus the shrunk others."""
        parts = [self.bag(b, steps) for b in range(self.bags)]
        return rows.withColumn("prediction", sum(parts[1:], parts[0]) / float(len(parts)))


def fit(rows: DataFrame, n_features: int, steps: int = 10, depth: int = 3, shrinkage: float = 0.05, min_leaf: int = 1, bags: int = 1, row_share: float = 1.0, column_share: float = 1.0, oblivious: bool = False, seed: int = 1, replace: bool = False) -> Forest:
    """Boosted trees on ``rows`` (row bigint, x array<double>, y double), ``bags`` of them at a time.

    steps=1, bags=1 is one tree; bags=1 boosting on residuals, the first tree unshrunk; more bags average
    boostings on samples of rows and of columns, which the trees remember. Rows are drawn by a hash of the row,
    without replacement, or with it (``replace``): then a row comes as often as a Poisson draw of mean ``row_share`` says. ``oblivious`` gives one split to a whole level and leaf values scaled by n / (2n + 1).
    Trees have at most bags * steps * 2^depth nodes and are kept on the driver; rows never are.
    """
    if replace:
        share = F.lit(True)
    elif row_share < 1.0:
        share = F.pmod(md5_hash(F.concat_ws("|", "row", "bag", F.lit(seed))), F.lit(1_000_000)) < int(row_share * 1_000_000)
    else:
        share = F.lit(True)
    columns = {b: _columns(n_features, column_share, b, seed) for b in range(bags)}
    state = rows.select("row", "x", F.col("y").cast("double").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag")).filter(share)
    if replace:
        state = state.withColumn("_times", _poisson(row_share, seed)).filter("_times > 0").withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_draw")
    state = materialize(state.withColumn("r", F.col("y")), "bags")
    splits, leaves = {}, {}
    for step in range(steps):
        for b in range(bags):
            splits[b, step], leaves[b, step] = {}, {}
        nodes = F.lit(1)
        for _ in range(depth):
            labelled = state.select("bag", nodes.alias("node"), F.col("r").alias("y"), _masked(columns, n_features).alias("x"))
            if oblivious:
                chosen = _level_split(labelled, min_leaf).collect()  # a row per bag
                grown = False
                live = {b: _live(splits[b, step]) for b in range(bags)}
                for r in chosen:
                    for node in live[r.bag]:
                        splits[r.bag, step][node] = (r.feature, r.value)
                        grown = True
            else:
                chosen = best_splits(split_gains(labelled, ["bag", "node"], min_leaf), ["bag", "node"]).collect()  # at most a row per node
                grown = bool(chosen)
                for r in chosen:
                    splits[r.bag, step][r.node] = (r.feature, r.value)
            if not grown:
                break
            nodes = _route({b: splits[b, step] for b in range(bags)})
        value = F.avg("r") * (F.count("*") / (2 * F.count("*") + 1)) if oblivious else F.avg("r")
        for r in state.groupBy("bag", nodes.alias("node")).agg(value.alias("v")).collect():
            leaves[r.bag, step][r.node] = r.v
        forest = Forest(splits, leaves, shrinkage, bags, step + 1, columns)
        if step + 1 < steps:
            by_bag = F.lit(0.0)
            for b in range(bags):
                by_bag = F.when(F.col("bag") == b, forest.tree(b, step)).otherwise(by_bag)
            state = state.withColumn("r", F.col("r") - (by_bag if step == 0 else shrinkage * by_bag))
            if step % 5 == 4:  # cut the lineage before the expression grows long
                state = materialize(state, "residuals")
    return forest


def _poisson(mean: float, seed: int) -> Column:
    """A Poisson draw from a hash of row and bag."""
    u = (F.pmod(F.xxhash64("row", "bag", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    term = total = math.exp(-mean)
    bounds = []
    for k in range(1, 40):
        bounds.append(total)
        term *= mean / k
        total += term
    return sum((u > p).cast("int") for p in bounds if p < 1 - 1e-12)


def _columns(n: int, share: float, bag: int, seed: int) -> list[int]:
    import random

    return sorted(random.Random(seed * 1000 + bag).sample(range(n), max(1, round(n * share))))


def _masked(columns: dict[int, list[int]], n: int) -> Column:
    """Features of the row's bag; the others are null and can't be split on."""
    if all(len(c) == n for c in columns.values()):
        return F.col("x")
    allowed = F.lit(None)
    for bag, chosen in columns.items():
        allowed = F.when(F.col("bag") == bag, F.array(*[F.lit(i) for i in chosen])).otherwise(allowed)
    return F.transform("x", lambda v, i: F.when(F.array_contains(allowed, i), v))


def _live(splits: dict[int, tuple]) -> list[int]:
    """Nodes of the lowest level."""
    level = [1]
    while level and all(n in splits for n in level):
        level = [c for n in level for c in (2 * n, 2 * n + 1)]
    return level


def _route(by_bag: dict[int, dict[int, tuple[int, float]]]) -> Column:
    def at(splits, node):
        if node not in splits:
            return F.lit(node)
        feature, value = splits[node]
        return F.when(F.coalesce(F.element_at("x", feature + 1) < value, F.lit(False)), at(splits, 2 * node)).otherwise(at(splits, 2 * node + 1))

    out = F.lit(1)
    for bag, splits in by_bag.items():
        out = F.when(F.col("bag") == bag, at(splits, 1)).otherwise(out)
    return out


def _level_split(labelled: DataFrame, min_leaf: int) -> DataFrame:
    """``bag, feature, value, gain``: the split whose gains, summed over the level's nodes, are the largest."""
    gains = split_gains(labelled, ["bag", "node"], min_leaf)
    level = gains.groupBy("bag", "feature", "value").agg(F.sum("gain").alias("gain"), F.sum("n").alias("n"))
    return best_splits(level, ["bag"])


def curve(forest: Forest, rows: DataFrame) -> DataFrame:
    """``steps, mse``: error after each number of steps, in one pass over the rows."""
    parts = []
    for steps in range(1, forest.steps + 1):
        bags = [forest.bag(b, steps) for b in range(forest.bags)]
        parts.append(F.avg(F.pow(sum(bags[1:], bags[0]) / float(len(bags)) - F.col("y"), 2)).alias(str(steps)))
    wide = rows.agg(*parts)
    pairs = ", ".join(f"{k}, `{k}`" for k in range(1, forest.steps + 1))
    return wide.selectExpr(f"stack({forest.steps}, {pairs}) as (steps, mse)").select("steps", F.round("mse", 6).alias("mse"))
