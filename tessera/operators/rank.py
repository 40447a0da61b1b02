"""Ranking of documents for queries: click log, tf-idf, text features, linear ranks, variants, top k."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def shown(clicks: DataFrame) -> DataFrame:
    """``query_id, doc_id, clicked bigint``: each shown document of each query once; 1 if it was ever clicked. Null and empty lists show nothing."""
    rows = clicks.select("query_id", F.coalesce("clicked", F.array().cast("array<bigint>")).alias("c"), F.explode("serp").alias("doc_id"))
    return rows.groupBy("query_id", "doc_id").agg(F.max(F.array_contains("c", F.col("doc_id")).cast("bigint")).alias("clicked"))


def click_rates(clicks: DataFrame) -> DataFrame:
    """``query_id, doc_id, n_shown, n_clicked``; the hot query's rows are summed before the shuffle."""
    rows = clicks.select("query_id", F.coalesce("clicked", F.array().cast("array<bigint>")).alias("c"), F.explode("serp").alias("doc_id"))
    return rows.groupBy("query_id", "doc_id").agg(F.count("*").alias("n_shown"), F.sum(F.array_contains("c", F.col("doc_id")).cast("bigint")).alias("n_clicked"))


def counted(words: Column) -> Column:
    """Array of (term, tf) of an array of words, counted within the row: sorted, so that equal words are runs."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        counts = text.let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(at, k + 1), n) - i).cast("bigint").alias("tf"))))
        return F.when(n > 0, counts)

    return text.let(F.array_sort(words), runs)


def term_counts(docs: DataFrame, key: str, col, pairs: bool = False) -> DataFrame:
    """``key, term, tf`` without a shuffle, as a document is a row; with ``pairs`` the terms are neighbouring word pairs."""
    words = text.tokens(col)
    return docs.select(F.col(key), F.explode(counted(text.bigrams(words) if pairs else words)).alias("t")).select(key, "t.term", "t.tf")


def idf(counts: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, idf`` with idf = log2(N / df)."""
    return counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log2(F.lit(float(max(n_docs, 1))) / F.col("df")))


#: A vocabulary of at most so many terms is broadcast (about 100 MB); a larger one is joined by a shuffle.
BROADCAST_TERMS = 1_000_000


def weighed(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Counts with their terms' idf; terms outside ``weights`` drop out. The hot terms of a large vocabulary are left to the adaptive skew join."""
    known = weights.select("term", "idf")
    return counts.join(F.broadcast(known) if weights.count() <= BROADCAST_TERMS else known, "term")


def tfidf(counts: DataFrame, weights: DataFrame, key: str, only: DataFrame | None = None) -> DataFrame:
    """``key, term, weight``: tf * idf, each document's vector of length 1; terms outside ``weights`` and of weight 0 drop out.

    With ``only`` (term) the rows of other terms are left out after they have counted for the length: what a query doesn't
    ask for needn't be shuffled.
    """
    raw = weighed(counts, weights).withColumn("raw", F.col("tf") * F.col("idf")).filter("raw > 0")
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    if only is not None:
        raw = raw.join(F.broadcast(only) if only.count() <= BROADCAST_TERMS else only, "term", "left_semi")
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def cosine(query_weights: DataFrame, doc_weights: DataFrame, candidates: DataFrame) -> DataFrame:
    """``query_id, doc_id, sim`` of candidate pairs with a common term; the pairs bound the join."""
    left = candidates.select("query_id", "doc_id").join(query_weights.withColumnRenamed("weight", "wq"), "query_id")
    return left.join(doc_weights.withColumnRenamed("weight", "wd"), ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("sim"))


def length_prior(length: Column, average: Column, a: float = 0.2, c: float = 0.7) -> Column:
    return c * (1 - F.abs(a * average - length) / average)


def keyword(query_counts: DataFrame, weights: DataFrame) -> DataFrame:
    """``query_id, keyword``: the query's known term of the highest idf, the alphabetically first of ties."""
    known = query_counts.join(weights.select("term", "idf"), "term")
    return known.groupBy("query_id").agg(F.min_by("term", F.struct(-F.col("idf"), F.col("term"))).alias("keyword"))


NOWHERE = 2**31 - 1


YEAR = r"(?:^|[^0-9A-Za-z_])([12][0-9]{3})(?:[^0-9A-Za-z_]|$)"


def year_of(col: Column) -> Column:
    """First number from 1000 to 2999 that stands alone, empty if there is none."""
    return F.regexp_extract(col, YEAR, 1)


PARTS = ("text", "title")


def _wanted(queries: DataFrame, places: DataFrame | None, keywords: DataFrame | None) -> DataFrame:
    """``query_id, term, times, place, year, key``: the words to look for, how often the query has them, and what they are."""
    asked = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    words = term_counts(asked, "query_id", "query").select("query_id", "term", F.col("tf").alias("times"))
    if places is not None:
        words = words.join(F.broadcast(places.select("term").distinct().withColumn("place", F.lit(1))), "term", "left").withColumn("place", F.coalesce("place", F.lit(0)))
    else:
        words = words.withColumn("place", F.lit(0))
    words = words.select("query_id", "term", "times", "place", F.lit(0).alias("year"), F.lit(0).alias("key"))
    extra = asked.select("query_id", year_of(F.col("query")).alias("term")).filter("term <> ''").select("query_id", "term", F.lit(0).cast("bigint"), F.lit(0), F.lit(1), F.lit(0))
    words = words.union(extra)
    if keywords is not None:
        words = words.union(keywords.select("query_id", "keyword", F.lit(0).cast("bigint"), F.lit(0), F.lit(0), F.lit(1)))
    return words.groupBy("query_id", "term").agg(F.sum("times").alias("times"), *[F.max(c).alias(c) for c in ("place", "year", "key")])


def positions(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, term, text, title``: ascending positions (from 0) of the wanted terms in both parts of each document."""
    placed = lambda c: F.transform(text.tokens(F.coalesce(c, F.lit(""))), lambda w, i: F.struct(F.lit(c).alias("part"), i.alias("at"), w.alias("term")))
    rows = docs.select("doc_id", F.explode(F.concat(*map(placed, PARTS))).alias("x")).select("doc_id", "x.term", "x.part", "x.at")
    terms = wanted.select("term").distinct()
    rows = rows.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term", "left_semi")
    return rows.groupBy("doc_id", "term").agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == c, F.col("at")))).alias(c) for c in PARTS])


def _closest(found: Column) -> Column:
    """Smallest distance of neighbours with different words in an array of (at, term)."""

    def walk(f: Column) -> Column:
        left, right = F.slice(f, 1, F.greatest(F.size(f) - 1, F.lit(0))), F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0)))
        return F.when(F.size(f) > 1, F.array_min(F.zip_with(left, right, lambda a, b: F.when(a["term"] != b["term"], b["at"] - a["at"]))))

    return text.let(F.array_sort(found), walk)


def text_features(pairs: DataFrame, queries: DataFrame, docs: DataFrame, places: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """Length, position, phrase, share, place, key-word and year features of (query_id, doc_id) pairs for text and title.

    ``docs`` has doc_id, text, title; absent texts and titles count as empty. ``places`` (term) is a gazetteer, a
    dimension table; ``keywords`` has query_id and keyword. Documents that don't exist give no row. The words' positions
    are looked up once per document and wanted word; a pair aggregates the few words of its query.
    """
    wanted = _wanted(queries, places, keywords)
    hits = pairs.select("query_id", "doc_id").join(wanted, "query_id").join(positions(docs, wanted), ["doc_id", "term"])
    aggregates = []
    for c in PARTS:
        there = F.size(c) > 0
        asked = there & (F.col("times") > 0)
        aggregates += [
            F.sum(F.when(asked, F.col("times"))).alias(f"have_{c}"),
            F.min(F.when(asked, F.element_at(c, 1))).alias(f"first_{c}"),
            F.flatten(F.collect_list(F.when(asked, F.transform(c, lambda at: F.struct(at.alias("at"), F.col("term").alias("term")))))).alias(f"at_{c}"),
            *[F.max((there & (F.col(kind) == 1)).cast("int")).alias(f"{kind}_{c}") for kind in ("place", "year", "key")],
        ]
    known = hits.groupBy("query_id", "doc_id").agg(*aggregates)
    joined = lambda c: F.array_join(text.tokens(F.coalesce(c, F.lit(""))), " ")
    q = queries.select("query_id", joined("query").alias("phrase"), F.size(text.tokens(F.coalesce("query", F.lit("")))).alias("n_words"))
    d = docs.select("doc_id", *[joined(c).alias(c) for c in PARTS], *[F.size(text.tokens(F.coalesce(c, F.lit("")))).cast("bigint").alias(f"len_{c}") for c in PARTS])
    rows = pairs.select("query_id", "doc_id").join(q, "query_id").join(d, "doc_id").join(known, ["query_id", "doc_id"], "left")
    out = [F.col("query_id"), F.col("doc_id")]
    for c in PARTS:
        have = F.coalesce(f"have_{c}", F.lit(0))
        out += [
            F.col(f"len_{c}"),
            F.coalesce(f"first_{c}", F.lit(NOWHERE)).cast("bigint").alias(f"first_pos_{c}"),
            F.coalesce(_closest(F.col(f"at_{c}")), F.lit(NOWHERE)).cast("bigint").alias(f"min_dist_{c}"),
            ((F.col("phrase") != "") & (F.instr(F.col(c), F.col("phrase")) > 0)).cast("int").alias(f"phrase_{c}"),
            F.round(F.when(F.col("n_words") > 0, have / F.col("n_words")).otherwise(0.0), 6).alias(f"part_{c}"),
            ((F.col("n_words") > 0) & (have == F.col("n_words"))).cast("int").alias(f"all_{c}"),
            F.coalesce(f"place_{c}", F.lit(0)).alias(f"geo_{c}"),
            F.coalesce(f"key_{c}", F.lit(0)).cast("double").alias(f"part_key_{c}"),
            F.coalesce(f"key_{c}", F.lit(0)).alias(f"all_key_{c}"),
            F.coalesce(f"year_{c}", F.lit(0)).alias(f"year_{c}"),
        ]
    return rows.select(*out)


#: The features in the order of the vector; the boosted term reads the first fourteen.
VECTOR = ["tfidf_text", "tfidf_title", "tfidf2_text", "tfidf2_title"] + [f"{n}_{c}" for n in ("len", "first_pos", "min_dist", "phrase", "part", "all", "geo", "part_key", "all_key", "year") for c in PARTS]
BOOSTED = 14


def similarities(pairs: DataFrame, queries: DataFrame, docs: DataFrame, n_docs: int, keep=lambda df, name: df) -> DataFrame:
    """``query_id, doc_id`` and the cosines of tf-idf vectors of words and of word pairs with text and title.

    Document frequencies are those of title and text together. Pairs of existing documents without a common term have 0.
    ``keep`` may write an intermediate table that is read twice.
    """
    whole = docs.select("doc_id", F.concat_ws(" ", "title", "text").alias("whole"))
    out = pairs.select("query_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    for label, two in (("tfidf", False), ("tfidf2", True)):
        weights = keep(idf(term_counts(whole, "doc_id", "whole", two), n_docs), label)
        counts = term_counts(queries.select("query_id", "query"), "query_id", "query", two)
        asked, terms = tfidf(counts, weights, "query_id"), counts.select("term").distinct()
        for c in PARTS:
            sims = cosine(asked, tfidf(term_counts(docs, "doc_id", c, two), weights, "doc_id", terms), pairs)
            out = out.join(sims.withColumnRenamed("sim", f"{label}_{c}"), ["query_id", "doc_id"], "left")
    return out.select("query_id", "doc_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in VECTOR[:4]])


def tfidf_rank(sims: DataFrame, title: float = 15.0) -> Column:
    """Word similarity of the text plus ``title`` times that of the title."""
    return F.col("tfidf_text") + title * F.col("tfidf_title")


def first_rank(sims: DataFrame, lengths: DataFrame, average: Column, title: float = 5.0) -> DataFrame:
    """``query_id, doc_id, score``: the four similarities (titles count ``title`` times) over the query's largest sum, plus the length prior.

    ``lengths`` has doc_id and n, the words of title and text. A query whose documents have nothing in common with it has similarity 0.
    """
    summed = sims.withColumn("sim", F.col("tfidf_text") + title * F.col("tfidf_title") + F.col("tfidf2_text") + title * F.col("tfidf2_title"))
    top = summed.groupBy("query_id").agg(F.max("sim").alias("top"))
    rows = summed.join(top, "query_id").join(lengths, "doc_id")
    return rows.select("query_id", "doc_id", (F.col("sim") / F.coalesce(F.expr("nullif(top, 0)"), F.lit(1.0)) + length_prior(F.col("n"), average)).alias("score"))


def min_max(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 within each group, a constant one to 0. Group minima and maxima are aggregated and joined: no window holds a group."""
    bounds = rows.groupBy(group).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [F.round(F.when(F.col(f"_hi_{c}") == F.col(f"_lo_{c}"), F.lit(0.0)).otherwise((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))), 6).alias(c) for c in columns]
    return rows.join(bounds, group).select(*[c for c in rows.columns if c not in columns], *scaled)


#: Coefficients of the linear rank by feature, those of the boosted term and of the length prior, and the divisor; distances count inverted.
COEFFICIENTS = dict(zip(VECTOR, (1, 5, 1, 5, 0, 0, 0, 0, 2, 1, 3, 7, 3, 7, 1, 1, 3, 6, 0, 0, 0, 0, 2, 4)))
BOOST, PRIOR, DIVISOR = 25.0, 2.0, 52.0
INVERTED = {"first_pos_text", "first_pos_title", "min_dist_text", "min_dist_title"}


def linear_rank(coefficients: dict[str, float] | None = None) -> Column:
    """Sum of the scaled features by their coefficients."""
    parts = [k * ((1 - F.col(c)) if c in INVERTED else F.col(c)) for c, k in (coefficients or COEFFICIENTS).items() if k]
    return sum(parts[1:], parts[0])


def final_rank(linear: Column, boosted: Column, length: Column, average: Column) -> Column:
    """Linear rank, boosted prediction and length prior in one score."""
    return (linear + BOOST * boosted + length_prior(length, average, c=PRIOR)) / DIVISOR


def expand_queries(queries: DataFrame, synonyms: DataFrame, top: int = 1, threshold: float = 0.9, stop: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, query``: each query's words followed by up to ``top`` synonyms of each that are similar enough; stop words get none."""
    strong = Window.partitionBy("term").orderBy(F.desc("sim"), "synonym")
    best = synonyms.filter(F.col("sim") >= threshold).withColumn("r", F.row_number().over(strong)).filter(F.col("r") <= top)
    words = queries.select("query_id", F.posexplode(text.tokens(F.coalesce("query", F.lit("")))).alias("at", "term"))
    added = words.filter(~F.col("term").isin(list(stop))).join(best, "term").select("query_id", (F.col("at") + F.lit(1 << 20)).alias("at"), "r", F.col("synonym").alias("term"))
    both = words.select("query_id", "at", F.lit(0).alias("r"), "term").unionByName(added)
    made = both.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "r", "term"))), lambda x: x["term"]), " ").alias("query"))
    return queries.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce("query", F.lit("")).alias("query"))


def top_k(scored: DataFrame, k: int = 5, group: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The ``k`` best items of each group with ``place`` from 1; ties go to the smaller item. Spark cuts each partition to k per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), item)
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def merge_variants(base: DataFrame, variants: DataFrame, decay: float = 0.99) -> DataFrame:
    """``query_id, doc_id, score``: base scores plus decay^replaced times the scores of rewritten queries (query_id, doc_id, score, replaced); documents unknown to the base come in."""
    extra = variants.select("query_id", "doc_id", (F.col("score") * F.pow(F.lit(decay), F.col("replaced"))).alias("score"))
    return base.select("query_id", "doc_id", "score").unionByName(extra).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def _options(queries: DataFrame, synonyms: DataFrame, at_most: int, threshold: float, max_words: int) -> DataFrame:
    """``query_id, places``: each word's place and its options, the word itself first; queries without words have no row."""
    strong = Window.partitionBy("term").orderBy(F.desc("sim"), "synonym")
    best = synonyms.filter(F.col("sim") > threshold).withColumn("r", F.row_number().over(strong)).filter(F.col("r") <= at_most).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("r", "synonym"))).alias("syn"))
    words = queries.select("query_id", text.tokens(F.coalesce("query", F.lit(""))).alias("w")).filter("size(w) > 0")
    placed = words.select("query_id", F.size("w").alias("n"), F.posexplode("w").alias("at", "term")).join(best, "term", "left")
    limit = F.when(F.col("n") > max_words, 0).when(F.col("n") > 4, 2).otherwise(at_most)
    usable = F.when(F.col("term").rlike("[0-9]") | F.col("syn").isNull(), F.array().cast("array<string>")).otherwise(F.slice(F.transform("syn", lambda s: s["synonym"]), 1, F.greatest(limit, F.lit(0))))
    options = placed.withColumn("options", F.concat(F.array("term"), F.when(limit > 0, usable).otherwise(F.array().cast("array<string>"))))
    return options.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "options"))).alias("places"))


def query_variants(queries: DataFrame, synonyms: DataFrame, at_most: int = 4, threshold: float = 0.8, max_words: int = 10) -> DataFrame:
    """``query_id, variant, query, replaced``: every choice of a word or one of its synonyms at each place.

    ``synonyms`` has term, synonym, sim. Words with digits are kept; queries of more than four words take two
    synonyms a word, those of more than ``max_words`` aren't rewritten. Variant 0 is the query itself.
    """
    per = _options(queries, synonyms, at_most, threshold, max_words)
    start = F.array(F.struct(F.array().cast("array<string>").alias("w"), F.lit(0).alias("replaced")))
    grow = F.aggregate(
        "places",
        start,
        lambda acc, p: F.flatten(F.transform(acc, lambda v: F.transform(p["options"], lambda o, i: F.struct(F.concat(v["w"], F.array(o)).alias("w"), (v["replaced"] + (i > 0).cast("int")).alias("replaced"))))),
    )
    return per.select("query_id", F.posexplode(grow).alias("variant", "v")).select("query_id", "variant", F.array_join("v.w", " ").alias("query"), F.col("v.replaced").alias("replaced"))


#: A table of so many hashed terms with their idf is broadcast (about 100 MB); a larger one is joined by a shuffle.
BROADCAST_HASHES = 4_000_000


def _grams(col) -> Column:
    """Words and word pairs of a text, counted, as one array of (term, tf): a pair has a blank in it, a word hasn't."""
    absent = F.array().cast("array<struct<term:string,tf:bigint>>")
    return text.let(text.tokens(F.coalesce(col, F.lit(""))), lambda w: F.concat(F.coalesce(counted(w), absent), F.coalesce(counted(text.bigrams(w)), absent)))


def variant_scores(pairs: DataFrame, queries: DataFrame, synonyms: DataFrame, docs: DataFrame, keep=lambda df, name: df, decay: float = 0.99, title: float = 5.0, at_most: int = 4, threshold: float = 0.8, max_words: int = 10) -> DataFrame:
    """``query_id, doc_id, score``: the first ranks of all variants of each query, summed with decay^replaced; ``merge_variants`` of all ``query_variants``.

    A query has up to 3^10 variants, but they are made of some 30 words and 80 word pairs: a document's weights of these
    options are looked up once, and one task a query adds them up for all variants, each with its own norms, its own best
    document and rounding to six digits. No variant is a row. The documents of a query are one row of sparse weights, and
    so are the queries that a document is shown for. ``keep`` may write an intermediate table that is read twice.
    """
    n_docs = docs.count()
    most = F.log2(F.lit(float(max(n_docs, 1))))
    counts = docs.select(F.explode(_grams(F.concat_ws(" ", "title", "text"))).alias("g")).groupBy("g.term").agg(F.count("*").alias("df"), F.sum("g.tf").alias("tf"))
    weights = keep(counts.select("term", F.xxhash64("term").alias("key"), "df", "tf", F.log2(F.lit(float(max(n_docs, 1))) / F.col("df")).alias("idf")), "weights")
    average = F.lit(float(weights.filter(~F.col("term").contains(" ")).agg(F.sum("tf")).first()[0] or 0) / max(n_docs, 1))

    places = keep(_options(queries, synonyms, at_most, threshold, max_words).select("query_id", F.col("places.options").alias("places")), "places")
    option = lambda p, a, b, term: F.struct(p.alias("p"), a.alias("a"), b.alias("b"), term.alias("term"))
    following = lambda p: F.coalesce(F.get("places", p + 1), F.array().cast("array<string>"))
    words = F.flatten(F.transform("places", lambda o, p: F.transform(o, lambda x, a: option(p, a, F.lit(-1), x))))
    two = F.flatten(F.transform("places", lambda o, p: F.flatten(F.transform(o, lambda x, a: F.transform(following(p), lambda y, b: option(p, a, b, F.concat_ws(" ", x, y)))))))
    offered = places.select("query_id", F.explode(F.concat(words, two)).alias("o")).select("query_id", "o.*")
    known = offered.join(weights.filter("idf > 0").select("term", "key", "idf"), "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("p", "a", "b", "key", "idf"))).alias("f"))
    asked = keep(places.select("query_id", F.transform("places", F.size).alias("sizes")).join(known, "query_id", "left"), "asked")

    # a term of one document has the largest idf: only the others and those asked for are looked up
    wanted = asked.select(F.explode("f.key").alias("key")).distinct().withColumn("asked", F.lit(True))
    table = keep(weights.join(wanted, "key", "left").filter("df > 1 or asked").select("key", "idf", F.coalesce("asked", F.lit(False)).alias("asked")), "table")
    of = lambda part: F.transform(_grams(PARTS[part]), lambda x: F.struct(F.lit(part).alias("part"), x["term"].alias("term"), x["tf"].alias("tf")))
    parts = F.concat(*map(of, range(len(PARTS))))
    slot = F.col("x.part") + F.when(F.col("x.term").contains(" "), 2).otherwise(0)
    rows = docs.select("doc_id", F.explode_outer(parts).alias("x")).select("doc_id", F.xxhash64("x.term").alias("key"), slot.alias("slot"), "x.tf")
    rows = rows.join(F.broadcast(table) if table.count() <= BROADCAST_HASHES else table, "key", "left").withColumn("raw", F.col("tf") * F.coalesce("idf", most))
    scales = [((title if k % 2 else 1.0) / F.expr(f"nullif(sqrt(sum(if(slot = {k}, raw * raw, 0))), 0)")).alias(f"s{k}") for k in range(4)]
    length = F.coalesce(F.sum(F.when(F.col("slot") < 2, F.col("tf"))), F.lit(0)).alias("n")
    vectors = rows.groupBy("doc_id").agg(length, *scales, F.collect_list(F.when(F.col("asked") & (F.col("raw") > 0), F.struct("key", "slot", "raw"))).alias("v"))
    weighted = F.transform("v", lambda x: x["raw"] * F.get(F.array(*[f"s{k}" for k in range(4)]), x["slot"]))
    vectors = vectors.select("doc_id", length_prior(F.col("n"), average).alias("prior"), F.col("v.key").alias("keys"), weighted.alias("w"))

    shown_for = pairs.select("query_id", "doc_id").join(asked.select("query_id", F.col("f.key").alias("keys")), "query_id", "left").select("doc_id", "query_id", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys"))
    shown_for = shown_for.groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "keys")).alias("q"))
    joined = vectors.join(shown_for, "doc_id").select("doc_id", "prior", "keys", "w", F.col("q.query_id").alias("query_ids"), F.col("q.keys").alias("asked"))
    hits = joined.mapInArrow(_hits, "query_id bigint, doc_id bigint, prior double, at array<int>, w array<double>")
    found = hits.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "prior", "at", "w")).alias("h"))
    absent = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    one = found.join(asked, "query_id", "left").select("query_id", *[F.col(f"h.{c}").alias(c) for c in ("doc_id", "prior", "at", "w")], absent("sizes", "int"), absent("f", "struct<p:int,a:int,b:int,key:bigint,idf:double>"))
    return one.mapInArrow(_summed(decay), "query_id bigint, doc_id bigint, score double")


def _lists(column):
    """Values and lengths of a list column without nulls."""
    import pyarrow.compute as pc

    return column.flatten(), pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _hits(batches):
    """Rows (doc_id, prior, keys, w, query_ids, asked): for each query the places of the keys it asks for that the document has, and their weights."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids, prior = batch.column(0), batch.column(1)
        keys, sizes = _lists(batch.column(2))
        weights = _lists(batch.column(3))[0].to_numpy(zero_copy_only=False)
        names, shown_for = _lists(batch.column(4))
        asked, asks = _lists(_lists(batch.column(5))[0])
        salt = np.arange(batch.num_rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # the same key in another document is another one
        own, of = np.unique(keys.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.repeat(salt, sizes), return_inverse=True)
        weights = np.bincount(of, weights, len(own))  # text and title
        row = np.repeat(np.arange(batch.num_rows), shown_for)
        pair = np.repeat(np.arange(len(row)), asks)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(asks) - asks, asks)
        sought = asked.to_numpy(zero_copy_only=False).view(np.uint64) ^ salt[row[pair]]
        where = np.searchsorted(own, sought)
        hit = where < len(own)
        hit[hit] = own[where[hit]] == sought[hit]
        ends = np.concatenate([[0], np.cumsum(np.bincount(pair[hit], minlength=len(row)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (at[hit].astype(np.int32), weights[where[hit]])]
        yield pa.RecordBatch.from_arrays([names, ids.take(pa.array(row)), prior.take(pa.array(row)), *lists], names=["query_id", "doc_id", "prior", "at", "w"])


def _summed(decay: float):
    """Rows (query_id, doc_id, prior, at, w, sizes, f), one for each query: its documents with their summed scores."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        array = lambda x: x.to_numpy(zero_copy_only=False)
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                doc_id, prior, at, w, sizes, f = (batch.column(c)[k].values for c in range(1, 7))
                at, each = _lists(at)
                scores = variant_sums(array(sizes), *map(array, f.flatten()), array(at), np.repeat(np.arange(len(each)), each), array(w.flatten()), array(prior), decay)
                out.append((np.full(len(scores), batch.column(0)[k].as_py()), array(doc_id), scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "doc_id", "score"])

    return run


#: Variants times documents that are held at once, and documents of one block.
CELLS, BLOCK = 1 << 20, 4096


def variant_sums(sizes, p, a, b, key, idf, at, doc, w, prior, decay: float = 0.99, cells: int = CELLS, block: int = BLOCK):
    """For each document of one query: decay^replaced times the first rank, summed over all variants.

    ``sizes``: options of each place. Features ``p, a, b, key, idf``: option a of place p (b is -1), or its pair with option b
    of the next place. ``at, doc, w``: weight of a feature in a document. Sums grow place by place, so that variants share
    those of their beginnings; the first places are gone through one by one where all variants don't fit ``cells``.
    """
    import numpy as np

    sizes, n, n_docs = [int(x) for x in sizes], len(sizes), len(prior)
    head, rest = 0, int(np.prod(sizes, dtype=np.int64))
    while head < n and rest * min(n_docs, block) > cells:
        rest //= sizes[head]
        head += 1
    shapes = [(s,) for s in sizes], list(zip(sizes, sizes[1:]))  # of words, of pairs
    squares, keys, features = ([[make(s) for s in kind] for kind in shapes] for make in (np.zeros, lambda s: np.zeros(s, np.int64), lambda s: []))
    for i, (x, y, z) in enumerate(zip(p.tolist(), a.tolist(), b.tolist())):
        two, cell = (1, (y, z)) if z >= 0 else (0, (y,))
        squares[two][x][cell], keys[two][x][cell] = idf[i] * idf[i], key[i]
        features[two][x].append((i, cell))
    order = np.argsort(at, kind="stable")
    at, doc = at[order], doc[order]
    w, bounds = w[order] * idf[at], np.searchsorted(at, np.arange(len(p) + 1))
    # equal terms at two places are one of twice the weight: its square is more than the sum of squares
    known = [[k[q > 0] for k, q in zip(keys[two], squares[two])] for two in (0, 1)]
    same = [(two, x, y) for two in (0, 1) for x in range(n - two) for y in range(x + 1, n - two) if np.intersect1d(known[two][x], known[two][y]).size]

    def tables(two: int, lo: int, hi: int) -> list:
        """For each place the weights of its options, or pairs, in the documents lo to hi; None where there are none."""
        out = []
        for shape, own in zip(shapes[two], features[two]):
            m = None
            for i, cell in own:
                d, v = doc[bounds[i] : bounds[i + 1]], w[bounds[i] : bounds[i + 1]]
                inside = (d >= lo) & (d < hi)
                if inside.any():
                    m = np.zeros((*shape, hi - lo)) if m is None else m
                    m[cell][d[inside] - lo] = v[inside]
            out.append(m)
        return out

    def grown(two: int, own: list, prefix: tuple, tail: tuple):
        """Sums of the tables' entries for all variants that begin with ``prefix``, the last place changing fastest."""
        sums = np.zeros((1, *tail))
        for x in range(n):
            t = own[x - two] if x >= two else None
            if x < head:
                sums = sums if t is None else sums + t[prefix[x - two : x + 1]]
            elif t is None:
                sums = np.repeat(sums, sizes[x], axis=0)
            elif two and x > head:
                sums = (sums.reshape(-1, sizes[x - 1], 1, *tail) + t).reshape(-1, *tail)
            else:
                sums = (sums[:, None] + (t[prefix[x - 1]] if two else t)).reshape(-1, *tail)
        return sums

    blocks = [(lo, min(lo + block, n_docs)) for lo in range(0, n_docs, block)]
    made = {x: [tables(two, *x) for two in (0, 1)] for x in blocks[:1]}  # the usual query has one block
    out = np.zeros(n_docs)
    for prefix in product(*map(range, sizes[:head])):
        chosen = [*prefix, *(np.unravel_index(np.arange(rest), sizes[head:]) if head < n else ())]
        norms = [grown(two, squares[two], prefix, ()) for two in (0, 1)]
        for two, x, y in same:
            cell = lambda m, x: m[two][x][tuple(chosen[x : x + 1 + two])]
            norms[two] = norms[two] + 2 * cell(squares, x) * (cell(keys, x) == cell(keys, y))
        inverse = [np.where(v > 0, 1 / np.sqrt(np.where(v > 0, v, 1)), 0.0) for v in norms]
        share = decay ** sum(((np.asarray(c) > 0).astype(float) for c in chosen), np.zeros(rest))

        def sims(x: tuple[int, int]):
            total = np.zeros((rest, x[1] - x[0]))
            for two in (0, 1):
                own = made[x][two] if x in made else tables(two, *x)
                if any(m is not None for m in own):
                    total += grown(two, own, prefix, total.shape[1:]) * inverse[two][:, None]
            return total

        first = sims(blocks[0])
        top = np.max([first.max(axis=1), *(sims(x).max(axis=1) for x in blocks[1:])], axis=0)
        top = np.where(top > 0, top, 1.0)
        for x in blocks:
            score = (first if x == blocks[0] else sims(x)) / top[:, None] + prior[slice(*x)]
            out[slice(*x)] += share @ (np.floor(score * 1e6 + 0.5) / 1e6)
    return out


def rank_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``n_queries``: queries whose ranked lists (query_id, place, doc_id) differ anywhere."""
    both = a.select("query_id", "place", F.col("doc_id").alias("d1")).join(b.select("query_id", "place", F.col("doc_id").alias("d2")), ["query_id", "place"], "full")
    return both.filter(~F.col("d1").eqNullSafe(F.col("d2"))).agg(F.countDistinct("query_id").alias("n_queries"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, chunk: int = 200_000, key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """``query_vec, vec_id, cosine, place``: the ``k`` most similar vectors of each query vector, itself excluded, exact.

    Vectors are hashed to chunks of at most about ``chunk`` rows; a task holds one chunk as a matrix, past which all query
    vectors stream in batches, and gives the k best of its chunk for each, which one window over small rows merges. Nothing
    passes through the driver. Null and zero vectors take no part.
    """
    spark = vectors.sparkSession
    chunks = max(1, -(-vectors.count() // chunk), spark.sparkContext.defaultParallelism)
    kind = dict(vectors.dtypes)[key]
    left = vectors.filter(F.col(col).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("asks"), F.col(key).alias("id"), F.col(col).cast("array<double>").alias("v"))
    right = queries.filter(F.col(col).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("asks"), F.col(key).alias("id"), F.col(col).cast("array<double>").alias("v"))
    rows = left.unionByName(right).repartition("chunk").sortWithinPartitions("chunk", "asks")
    found = rows.mapInArrow(_best_of_chunk(k), f"query_vec {kind}, id {kind}, cosine double").withColumnRenamed("id", key)
    return top_k(found, k, "query_vec", key, "cosine")


def _best_of_chunk(k: int):
    """Rows (chunk, asks, id, v): a chunk's vectors come first, then the query vectors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(batch, at):
            part = batch.filter(pa.array(at))
            v = part.column(3)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            norm = np.linalg.norm(x, axis=1)
            return part.column(2).to_numpy(zero_copy_only=False)[norm > 0], x[norm > 0] / norm[norm > 0][:, None]

        current, gathered, ids, matrix = None, [], None, None
        for batch in batches:
            chunk, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for c in np.unique(chunk):
                if c != current:
                    current, gathered, matrix = c, [], None
                own = (chunk == c) & (asks == 0)
                if own.any():
                    gathered.append(rows(batch, own))
                asked = (chunk == c) & (asks == 1)
                if not asked.any() or not gathered:
                    continue
                if matrix is None:
                    ids, matrix = np.concatenate([g[0] for g in gathered]), np.concatenate([g[1] for g in gathered])
                    order = np.argsort(ids, kind="stable")
                    ids, matrix = ids[order], matrix[order]
                names, x = rows(batch, asked)
                for at in range(0, len(names), 256):
                    sims = np.round(x[at : at + 256] @ matrix.T, 6)
                    sims[names[at : at + 256, None] == ids[None, :]] = -2
                    best = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # ids ascend, so ties go to the smaller
                    take = np.take_along_axis(sims, best, axis=1)
                    keep = take.ravel() > -2
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at : at + 256], best.shape[1])[keep]), pa.array(ids[best].ravel()[keep]), pa.array(take.ravel()[keep])], names=["query_vec", "id", "cosine"])

    return run
