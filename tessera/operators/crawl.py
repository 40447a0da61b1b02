"""Crawl focusing: url segments by clustering, quotas by the share of known good urls, online admission."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLUSTERS = 33


def cluster_quality(labelled: DataFrame, quota: int = 10_000) -> DataFrame:
    """``cluster, n, n_good, ratio, share, quota`` of rows (cluster, is_good)."""
    total = labelled.count()
    return (
        labelled.groupBy("cluster")
        .agg(F.count("*").alias("n"), F.sum(F.col("is_good").cast("bigint")).alias("n_good"))
        .withColumn("ratio", F.col("n_good") / F.col("n"))
        .withColumn("share", F.col("n") / F.lit(max(total, 1)))
        .withColumn("quota", F.col("share") * quota)
    )


def cumulative_share(quality: DataFrame) -> DataFrame:
    """``cum_share``: running sum of shares from the best cluster down (ties by number). One row per cluster, so the window is small."""
    w = Window.orderBy(F.desc("ratio"), "cluster").rowsBetween(Window.unboundedPreceding, 0)
    return quality.withColumn("cum_share", F.sum("share").over(w))


def segment_model(features: DataFrame, k: int = CLUSTERS, size: int = 1 << 12, seed: int = 1):
    """KMeans over 0/1 features (key, feature) hashed to ``size`` columns. Returns (model, vectors)."""
    sets = features.groupBy("key").agg(F.collect_set("feature").alias("features"))
    vectors = HashingTF(numFeatures=size, binary=True, inputCol="features", outputCol="vector").transform(sets).select("key", "vector")
    return KMeans(k=k, seed=seed, featuresCol="vector", predictionCol="cluster", maxIter=10).fit(vectors), vectors


class Admission:
    """Sequential decision for each url: fetch it or not, so that good clusters use the quota first.

    Clusters stand in falling order of their ratio. The cluster whose turn it is is the first, from the last one on,
    whose cumulative share (with ``SLACK``) covers the spent part of the quota and whose ratio doesn't exceed the
    border; if more urls were tried than ``PATIENCE`` times its part of the quota, it is the one after. Its ratio is
    the border that a url's cluster must reach. A new border starts the count of tries anew.
    """

    #: What a cumulative share may fall short by, and how many times its quota a cluster is waited for.
    SLACK, PATIENCE = 0.01, 1.8

    def __init__(self, ratios: list[float], cum_shares: list[float], shares: list[float], quota: int):
        self.ratios, self.shares, self.quota = ratios, shares, quota
        self._reach = [c + self.SLACK for c in cum_shares]
        self._falling = [-r for r in ratios]
        self.used = self.tried = self.at = 0
        self.border = 1.0

    def _turn(self) -> int:
        """The cluster whose turn it is; the number of clusters if there is none."""
        at = max(self.at, bisect_left(self._reach, self.used / self.quota), bisect_left(self._falling, -self.border))
        waited = at < len(self.ratios) - 1 and self.tried > self.PATIENCE * self.quota * self.shares[at]
        return at + waited

    def fetch(self, ratio: float) -> bool:
        """Whether a url of a cluster with this ratio is fetched; changes the state."""
        self.tried += 1
        turn = self._turn()
        if turn < len(self.ratios):
            self.at = turn
            if self.ratios[turn] != self.border:
                self.border, self.tried = self.ratios[turn], 0
        granted = ratio >= self.border and self.used < self.quota
        self.used += granted
        return granted

    def state(self) -> tuple:
        return (self.used, self.tried, self.at, self.border)

    def restore(self, state: tuple) -> "Admission":
        self.used, self.tried, self.at, self.border = state
        return self


def replay(urls: DataFrame, quality: DataFrame, quota: int) -> DataFrame:
    """``site, rec_id, fetched``: admission of each site's urls (site, rec_id, cluster) in order of rec_id.

    The decision is sequential by nature, so a site is one ordered stream: rows are sorted within
    their partition and flow past the state batch by batch; no site is held in memory.
    """
    ranked = [r.asDict() for r in cumulative_share(quality).orderBy(F.desc("ratio"), "cluster").collect()]  # one row per cluster
    ratios, cum, shares = ([r[c] for r in ranked] for c in ("ratio", "cum_share", "share"))
    by_cluster = {r["cluster"]: r["ratio"] for r in ranked}

    def run(batches):
        site, state = None, None
        for pdf in batches:
            out = []
            for s, c in zip(pdf["site"], pdf["cluster"]):
                if state is None or s != site:
                    site, state = s, Admission(ratios, cum, shares, quota)
                out.append(state.fetch(by_cluster.get(c, 0.0)))
            yield pd.DataFrame({"site": pdf["site"], "rec_id": pdf["rec_id"], "fetched": out})

    ordered = urls.select("site", "rec_id", "cluster").repartition("site").sortWithinPartitions("site", "rec_id")
    return ordered.mapInPandas(run, "site string, rec_id bigint, fetched boolean")
