"""Near-duplicate sketches: five-word shingles, twenty bucket minima, exact pair search by prefix filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

BUCKETS = 20


def first_per_url(docs: DataFrame, url: str = "url", order: tuple[str, ...] = ("fetched_at", "rec_id")) -> DataFrame:
    """The first row of each url in ``order``; null urls are one group. One aggregation with map-side combine, no sort."""
    rest = [c for c in docs.columns if c not in order and c != url]
    picked = docs.groupBy(url).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first"))
    return picked.select(url, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)])


def sketches(docs: DataFrame, key: str, col: str = "text", width: int = 5, n: int = BUCKETS, include_last: bool = False) -> DataFrame:
    """``key, sketch``: for each document the minimum of its shingle hashes in every residue class modulo ``n``.

    Case counts. If some class is empty the ``n`` smallest distinct hashes are taken, if there are as many,
    else the document has no sketch and no row. The last window is left out unless ``include_last``.
    """
    made = text.windows(text.tokens(col, lower=False), width, include_last)
    hashes = F.transform(made, text.md5_hash)

    def sketch(h: Column) -> Column:
        # sorted by class and value, the first of each class is its minimum
        return text.let(F.array_sort(F.transform(h, lambda x: F.pmod(x, F.lit(n)) * F.lit(1 << 32) + x)), lambda s: text.let(_firsts(s), lambda m: _either(m, h)))

    def _firsts(s: Column) -> Column:
        new = F.filter(s, lambda v, i: (i == 0) | (F.shiftright(v, 32) != F.shiftright(F.get(s, i - 1), 32)))
        return F.transform(new, lambda v: v.bitwiseAND(F.lit((1 << 32) - 1)))

    def _either(minima: Column, h: Column) -> Column:
        distinct = F.array_sort(F.array_distinct(h))
        return F.when(F.size(minima) == n, F.array_sort(minima)).when(F.size(distinct) >= n, F.slice(distinct, 1, n))

    # a document is a row: nothing is shuffled, and its hashes are computed once
    return docs.select(F.col(key).alias("key"), text.let(hashes, sketch).alias("sketch")).filter("sketch is not null")


def classes(sketched: DataFrame) -> DataFrame:
    """``key, rep``: documents with the same sketch form a class named by its smallest key."""
    rep = sketched.groupBy("sketch").agg(F.min("key").alias("rep"))
    return sketched.join(rep, "sketch").select("key", "rep")


def pairs(sketched: DataFrame, least_shared: int, n: int = BUCKETS) -> DataFrame:
    """``key1, key2, shared, jaccard, share`` of class representatives that share ``least_shared`` hashes or more.

    Two sketches of ``n`` hashes that share s have one of them among their n - s + 1 rarest in common, so
    only these are joined: frequent shingles, which would make the join quadratic, drop out, exactly.
    """
    reps = sketched.groupBy("sketch").agg(F.min("key").alias("key"))
    hashes = reps.select("key", F.explode("sketch").alias("h"))
    frequency = hashes.groupBy("h").agg(F.count("*").alias("df"))
    ordered = hashes.join(frequency, "h").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("by_rarity"))
    prefix = ordered.select("key", F.explode(F.slice("by_rarity", 1, n - least_shared + 1)).alias("p")).select("key", F.col("p.h").alias("h"))
    candidates = prefix.select(F.col("key").alias("key1"), "h").join(prefix.select(F.col("key").alias("key2"), "h"), "h").filter("key1 < key2").select("key1", "key2").distinct()
    left, right = (reps.select(F.col("key").alias(f"key{i}"), F.col("sketch").alias(f"s{i}")) for i in (1, 2))
    shared = candidates.join(left, "key1").join(right, "key2").select("key1", "key2", F.size(F.array_intersect("s1", "s2")).alias("shared"))
    return shared.filter(F.col("shared") >= least_shared).select(
        "key1", "key2", "shared", F.round(F.col("shared") / (F.col("shared") + 2 * (n - F.col("shared"))), 6).alias("jaccard"), F.round(F.col("shared") / n, 6).alias("share")
    )
