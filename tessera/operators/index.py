"""Inverted index: postings in blocks, gap coding, and boolean search over many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import codecs, text
from tessera.plans import boolean

#: Ids per block: a term that stands in a third of all documents has many rows of bounded size instead of one without bound.
BLOCK = 65_536


def doc_terms(docs: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """``key, term``: the distinct terms of each document; null and empty texts have none."""
    return docs.select(F.col(key).alias("key"), F.explode(F.array_distinct(text.tokens(col))).alias("term"))


def postings(docs: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """``term, block, ids (ascending), n``; an id lies in block id div ``BLOCK``."""
    grouped = doc_terms(docs, key, col).groupBy("term", F.expr(f"key div {BLOCK}").alias("block"))
    return grouped.agg(F.sort_array(F.collect_list("key")).alias("ids"), F.count("*").alias("n"))


def local_ids(ids, block):
    """Ids within their block from 1, as the codecs need positive gaps."""
    return F.transform(ids, lambda i: i - block * BLOCK + 1)


def compressed(blocks: DataFrame, codec: str) -> DataFrame:
    """``term, block, n, codec, blob``."""
    return blocks.select("term", "block", "n", F.lit(codec).alias("codec"), codecs.encoder(codec)(local_ids(F.col("ids"), F.col("block"))).alias("blob"))


def decompressed(blobs: DataFrame, codec: str) -> DataFrame:
    """``term, block, ids`` of compressed blocks."""
    back = codecs.decoder(codec)("blob")
    return blobs.select("term", "block", back.alias("local")).select("term", "block", F.transform("local", lambda i: i + F.col("block") * BLOCK - 1).alias("ids"))


def store(docs: DataFrame, path: str, codec: str = "varbyte", key: str = "doc_id", col: str = "text") -> None:
    """Write the index: ``postings`` (compressed blocks with their codec) and ``docs`` (the universe)."""
    compressed(postings(docs, key, col), codec).write.mode("overwrite").parquet(f"{path}/postings")
    docs.select(F.col(key).alias("key")).write.mode("overwrite").parquet(f"{path}/docs")


def load(spark, path: str) -> DataFrame:
    """Exploded postings ``term, key`` of a stored index, whatever codecs its blocks have."""
    blobs = spark.read.parquet(f"{path}/postings")
    out = None
    for codec in codecs.CODECS:
        part = decompressed(blobs.filter(F.col("codec") == codec), codec).select("term", F.explode("ids").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def search(terms: DataFrame, universe: DataFrame, query: str) -> DataFrame:
    """Keys that one boolean query selects, as a plan of semi, anti and union joins. ``terms`` is (key, term)."""
    return boolean.plan(boolean.parse(query), terms, universe)


def search_many(queries: DataFrame, terms: DataFrame, universe: DataFrame, counts_only: bool = False) -> DataFrame:
    """Boolean queries (query_id, query) against documents (key, term), all in one job.

    Result: ``query_id, key``, or with ``counts_only`` ``query_id, n_results``. Query terms join the
    postings; each (query, document) gets the set of its matching terms, and the query's truth table
    says whether the set satisfies it; a query with too many terms for a table is evaluated on the set
    itself. Queries that hold for the empty set select documents that match
    no term, too: they are counted by complement and listed by an anti join against the universe. A
    query that can't be parsed, or is null, has no result. Unknown terms are empty sets.
    """
    parsed = queries.select("query_id", "query", boolean.truth("query").alias("t")).select("query_id", "query", "t.terms", "t.truth", "t.on_empty").filter("terms is not null")
    tabled = parsed.filter("truth is not null")
    wanted = tabled.select("query_id", F.posexplode("terms").alias("bit", "term"))
    hits = wanted.join(terms, "term").groupBy("query_id", "key").agg(F.sum(F.pow(F.lit(2), F.col("bit")).cast("bigint")).alias("mask"))
    judged = hits.join(tabled.select("query_id", "truth", "on_empty"), "query_id").select("query_id", "key", "on_empty", F.expr("substring(truth, cast(mask as int) + 1, 1) = '1'").alias("holds"))
    large = parsed.filter("truth is null")
    if not large.isEmpty():
        present = large.select("query_id", F.explode("terms").alias("term")).join(terms, "term").groupBy("query_id", "key").agg(F.collect_set("term").alias("present"))
        judged = judged.unionByName(present.join(large, "query_id").select("query_id", "key", "on_empty", boolean.judged("query", "present").alias("holds")))
    if counts_only:
        total = universe.count()
        touched = judged.groupBy("query_id").agg(F.sum(F.col("holds").cast("bigint")).alias("yes"), F.count("*").alias("touched"))
        empty = F.when(F.col("on_empty"), F.lit(total) - F.coalesce("touched", F.lit(0))).otherwise(0)
        return parsed.join(touched, "query_id", "left").select("query_id", (F.coalesce("yes", F.lit(0)) + empty).cast("bigint").alias("n_results"))
    found = judged.filter("holds").select("query_id", "key")
    return found.unionByName(_untouched(parsed.filter("on_empty").select("query_id"), judged, universe))


#: Keys of the universe in one block when complements are taken.
COMPLEMENT = 4_096


def _untouched(queries: DataFrame, judged: DataFrame, universe: DataFrame) -> DataFrame:
    """``query_id, key``: for each query the keys of the universe that none of its terms touches.

    The universe lies in hashed blocks; a query meets each block as one small row, to which its touched keys
    of that block and then the block's keys are joined. Only the result itself has the size of queries times keys.
    """
    n = F.greatest(F.lit(1), F.ceil(F.lit(1.0) * universe.count() / COMPLEMENT).cast("int"))
    place = F.pmod(F.xxhash64(F.col("key").cast("string")), n).cast("bigint").alias("block")
    blocks = universe.select("key", place).groupBy("block").agg(F.collect_list("key").alias("ids"))
    touched = judged.join(queries, "query_id", "left_semi").select("query_id", "key", place).groupBy("query_id", "block").agg(F.collect_list("key").alias("touched"))
    cells = queries.select("query_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("block")).join(touched, ["query_id", "block"], "left")
    left = F.when(F.col("touched").isNull(), F.col("ids")).otherwise(F.array_except("ids", "touched"))
    return cells.join(blocks, "block").select("query_id", F.explode(left).alias("key"))


def gap_table(docs: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """``term, key, gap``: difference to the term's previous id in its block (from the block's start for the first)."""
    rows = doc_terms(docs, key, col).withColumn("block", F.expr(f"key div {BLOCK}"))
    w = Window.partitionBy("term", "block").orderBy("key")
    return rows.select("term", "key", (F.col("key") - F.coalesce(F.lag("key").over(w), F.col("block") * BLOCK - 1)).alias("gap"))
