"""Binary classification metrics, histograms, document statistics, vocabulary limits, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def safe_divide(a, b) -> Column:
    """a / b, 0 where either is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(a / b)


def confusion(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, tp, fp, fn, tn`` of rows (label boolean, score); a row with a null label or score counts nowhere.

    The rows are read once: scores are counted by label and the interval of thresholds they fall in, and
    the few interval counts are summed up per threshold.
    """
    bounds = sorted(set(thresholds))
    bucket = sum((F.col("score") > t).cast("int") for t in bounds)
    counts = scored.filter("label is not null and score is not null").groupBy("label", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    levels = scored.sparkSession.createDataFrame([(float(t), k + 1) for k, t in enumerate(bounds)], "threshold double, rank int")
    n = lambda label, above: F.coalesce(F.sum(F.when((F.col("label") == label) & ((F.col("bucket") >= F.col("rank")) == above), F.col("n"))), F.lit(0)).cast("bigint")
    return (
        F.broadcast(levels)
        .join(counts, F.lit(True), "left")
        .groupBy("threshold")
        .agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    )


def precision_recall(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of both classes and the macro F1 for confusion counts."""
    out = counts.withColumn("precision", safe_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", safe_divide("tp", F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    out = out.withColumn("precision_0", safe_divide("tn", F.col("tn") + F.col("fn"))).withColumn("recall_0", safe_divide("tn", F.col("tn") + F.col("fp")))
    out = out.withColumn("f1_0", safe_divide(2 * F.col("precision_0") * F.col("recall_0"), F.col("precision_0") + F.col("recall_0")))
    out = out.withColumn("macro_f1", (F.col("f1") + F.col("f1_0")) / 2)
    names = ["precision", "recall", "f1", "precision_0", "recall_0", "f1_0", "macro_f1"]
    return out.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in names])


def roc_auc(scored: DataFrame) -> DataFrame:
    """``auc``: exact area by rank sums, ties counting half. Equal scores are counted first; the running sums are over distinct scores."""
    from tessera.operators.prefix import running_sums

    per = scored.filter("label is not null and score is not null").groupBy("score").agg(F.sum(F.col("label").cast("bigint")).alias("pos"), F.sum((~F.col("label")).cast("bigint")).alias("neg"))
    cum = running_sums(per.withColumn("all", F.lit(1)), ["all"], [F.col("score")], {"neg_upto": "neg"}, "auc")
    return cum.agg(F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(F.round(F.col("wins") / F.expr("nullif(p * n, 0)"), 6).alias("auc"))


def histogram(rows: DataFrame, by: str, value: str, width: float, top: float) -> DataFrame:
    """``<by>, bin, density``: normalised histogram of each class over [0, top) in steps of ``width``; values outside are left out."""
    inside = rows.filter((F.col(value) >= 0) & (F.col(value) < top) & F.col(by).isNotNull())
    counts = inside.groupBy(by, F.floor(F.col(value) / width).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    total = Window.partitionBy(by)  # a row per class and bin
    return counts.select(by, "bin", F.round(F.col("n") / (F.sum("n").over(total) * width), 8).alias("density"))


def doc_stats(docs: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """``key, num_words, avg_word_len`` over letters-and-digits words; null text gives nulls, a text without words an average of 0."""
    words = text.tokens(col, text.ALNUM)
    length = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.char_length(w))
    n = F.when(words.isNotNull(), F.size(words))
    return docs.select(F.col(key), n.cast("bigint").alias("num_words"), F.when(n == 0, F.lit(0.0)).otherwise(F.round(length / n, 6)).alias("avg_word_len"))


def limited_vocabulary(docs: DataFrame, key: str = "doc_id", col: str = "text", min_df: float = 0.02, max_df: float = 0.9) -> DataFrame:
    """``term, df`` of words of two characters or more that stand in a share of the documents from ``min_df`` to ``max_df``."""
    terms = docs.select(F.explode(F.array_distinct(F.filter(text.tokens(col), lambda w: F.char_length(w) > 1))).alias("term"))
    n = docs.select(F.count("*")).scalar()
    return terms.groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= min_df * n) & (F.col("df") <= max_df * n))


def fold(key: str, k: int, seed: str = "") -> Column:
    """Fold 0..k-1 of a row by a hash of its key: the same in every run and on every layout."""
    return F.pmod(text.md5_hash(F.concat(F.col(key).cast("string"), F.lit(seed))), F.lit(k)).cast("bigint")


def sample_without_replacement(df: DataFrame, key: str, k: int, seed: str = "s") -> DataFrame:
    """The ``k`` rows with the smallest hash of key and seed (a top-k, not a full sort)."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(k)


def bootstrap_sample(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """Sampling with replacement: each row comes 0, 1, 2, ... times by a Poisson(1) draw from a hash of its key."""
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    times = sum((u > p).cast("int") for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582))
    return df.withColumn("_n", times).filter("_n > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def harness(rates: DataFrame) -> DataFrame:
    """``known_rate, fetched_rate, f1``: means over the runs (known_rate, fetched_rate), and the harmonic mean of the means."""
    mean = rates.agg(F.avg("known_rate").alias("q"), F.avg("fetched_rate").alias("f"))
    return mean.select(F.round("q", 6).alias("known_rate"), F.round("f", 6).alias("fetched_rate"), F.round(safe_divide(2 * F.col("q") * F.col("f"), F.col("q") + F.col("f")), 6).alias("f1"))


def repeated_recall(features: DataFrame, rows: DataFrame, key: str, feature: str, repeats: int, share: float) -> DataFrame:
    """``recall, size_ratio``: over ``repeats`` random halves of the rows, how well the half's frequent features reproduce the frequent ones of all.

    A feature is frequent on more than ``share`` of the rows. All halves are counted in one aggregation: a row's halves are
    bits of an array, and a feature's counts by half add up element by element in as many columns.
    """
    from functools import reduce

    inside = lambda r: (F.pmod(text.md5_hash(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(r)))), F.lit(2)) == 0).cast("bigint")
    sizes = rows.agg(F.count("*").alias("all"), *[F.sum(inside(r)).alias(f"h{r}") for r in range(repeats)]).first()  # one row
    drawn = rows.select(key, *[inside(r).alias(f"h{r}") for r in range(repeats)])
    counts = features.join(drawn, key).groupBy(feature).agg(F.count("*").alias("all"), *[F.sum(f"h{r}").alias(f"h{r}") for r in range(repeats)])
    golden = F.col("all") > share * sizes["all"]
    frequent = [F.col(f"h{r}") > share * sizes[f"h{r}"] for r in range(repeats)]
    totals = counts.agg(F.sum(golden.cast("bigint")).alias("golden"), F.sum(reduce(lambda a, b: a + b, [(golden & f).cast("bigint") for f in frequent])).alias("hits"), F.sum(reduce(lambda a, b: a + b, [f.cast("bigint") for f in frequent])).alias("found"))
    return totals.select(F.round(F.col("hits") / F.col("golden") / repeats, 6).alias("recall"), F.round(F.col("found") / F.col("golden") / repeats, 6).alias("size_ratio"))
