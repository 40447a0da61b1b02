"""Problem 2: near-duplicate records with small edits.

1. One Arrow pass turns each text into its set of 3-term shingles (64-bit), ``BANDS * ROWS`` minima
   of universal hash functions, one 64-bit key per band, and a sketch of one byte per minimum. It is
   written once to the shared folder, so every later step reads only the columns it needs.
2. Rows with the same shingle set form a class; only the class's smallest row goes on. A group of
   copies, however large, is one row from here on.
3. Rows that agree in a band are candidates. With 70 bands of 4 rows a pair at the threshold of 0.6
   is missed with probability 6e-5, one at 0.7 with 5e-9. A band or class that many rows share is cut
   into a grid of cells, so that its pairs are spread over many tasks.
4. Candidates are verified by their signatures' sketches (estimate within five standard errors of
   the threshold), the survivors exactly on the shingle sets.
5. Groups are the connected components of the verified links, by alternating large-star and
   small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import TERM
from tessera.tables import materialize, spread, table

BANDS, ROWS = 70, 4
WIDTH, MIN_TERMS, THRESHOLD = 3, 20, 0.6
#: 280 minima estimate a similarity of 0.6 with a standard error of 0.029; 1/256 of the bytes agree by chance.
SKETCH_MARGIN = 0.15
#: A key on more rows than ``HOT_ROWS`` and than one of ``HOT_SHARE`` of all is split over a grid of tasks.
HOT_ROWS, HOT_SHARE = 2_000, 50_000

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_M = _rng.integers(1, 2**64, ROWS + 1, dtype=np.uint64) | np.uint64(1)
_BLOCK = 4096


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of all runs of ``width`` successive terms, ascending."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mix(out + hashes[k : k + n])
    return np.unique(out)


def minima(x: np.ndarray) -> np.ndarray:
    """Minimum of every universal hash function over the set ``x`` (multiply-add, upper 32 bits)."""
    low = np.full(len(_A), 2**32 - 1, dtype=np.uint64)
    for at in range(0, len(x), _BLOCK):
        low = np.minimum(low, ((_A[:, None] * x[None, at : at + _BLOCK] + _B[:, None]) >> np.uint64(32)).min(axis=1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _M[ROWS]
    for k, row in enumerate(low.reshape(BANDS, ROWS).T):
        key = mix(key + row * _M[k])
    return key


_SIGNED = "rec_id bigint, url string, cls string, n_sh int, sh array<bigint>, bands array<bigint>, sketch binary"


def _sign(width: int, min_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, texts = (batch.column(k).to_pylist() for k in range(3))
            keep, words, lengths = [], [], []
            for k, text in enumerate(texts):
                found = TERM.findall(text.lower()) if text else []
                if len(found) >= min_terms:
                    keep.append(k)
                    words += found
                    lengths.append(len(found))
            if not keep:
                continue
            codes, names = pd.factorize(np.array(words, dtype=object))
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), dtype=np.uint64, count=len(names))[codes]
            ends = np.cumsum(lengths)
            sets = [shingles(hashes[e - n : e], width) for e, n in zip(ends, lengths)]
            low = [minima(x) for x in sets]
            sizes = np.array([len(x) for x in sets], dtype=np.int32)
            offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k in keep], pa.int64()),
                    pa.array([urls[k] for k in keep], pa.string()),
                    pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets], pa.string()),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(offsets(sizes), pa.array(np.concatenate(sets).view(np.int64))),
                    pa.ListArray.from_arrays(offsets(np.full(len(keep), BANDS)), pa.array(np.concatenate([band_keys(x) for x in low]).view(np.int64))),
                    pa.array([(x & np.uint64(255)).astype(np.uint8).tobytes() for x in low], pa.binary()),
                ],
                names=["rec_id", "url", "cls", "n_sh", "sh", "bands", "sketch"],
            )

    return run


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(len(b), -1)
    return pd.Series((x == y).mean(axis=1))


class NearDuplicates:
    """Near-duplicate links of ``df`` by the text column, rows identified by a unique ``rec_id``.

    Texts that are null, empty or shorter than ``min_terms`` terms take no part. ``url`` may be null;
    a null url differs from every other. Extra columns are ignored. An empty table gives no link.
    """

    def __init__(self, df: DataFrame, rec_id: str = "rec_id", url: str = "url", text: str = "text", width: int = WIDTH, min_terms: int = MIN_TERMS, threshold: float = THRESHOLD):
        self.threshold = threshold
        source = spread(df.select(F.col(rec_id).cast("bigint").alias("rec_id"), F.col(url).alias("url"), F.col(text).alias("text")), "rec_id")
        self.signed = materialize(source.filter("text is not null").mapInArrow(_sign(width, max(min_terms, width)), _SIGNED), "signed")
        first = self.signed.groupBy("cls").agg(F.min("rec_id").alias("rep"))
        self.members = materialize(self.signed.select("rec_id", "url", "cls").join(first, "cls").select("rec_id", "url", "rep"), "members")

    def links(self) -> DataFrame:
        """``a bigint, b bigint, jaccard double``: pairs a < b of class representatives that meet the threshold."""
        reps = self.members.filter("rec_id = rep").select("rec_id")
        bands = self.signed.select("rec_id", "bands").join(reps, "rec_id", "left_semi").select("rec_id", F.explode("bands").alias("key"))
        candidates = grid_pairs(bands, "key", "rec_id").distinct()
        side = lambda name, *cols: self.signed.select(F.col("rec_id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in cols))
        likely = (
            candidates.join(side("a", "sketch", "n_sh"), "a")
            .join(side("b", "sketch", "n_sh"), "b")
            .filter(F.least("n_sh_a", "n_sh_b") >= self.threshold * F.greatest("n_sh_a", "n_sh_b"))
            .filter(_agreement("sketch_a", "sketch_b") >= self.threshold - SKETCH_MARGIN)
            .select("a", "b", "n_sh_a", "n_sh_b")
        )
        shared = F.size(F.array_intersect("sh_a", "sh_b"))
        return (
            likely.join(side("a", "sh"), "a")
            .join(side("b", "sh"), "b")
            .withColumn("shared", shared)
            .withColumn("jaccard", F.col("shared") / (F.col("n_sh_a") + F.col("n_sh_b") - F.col("shared")))
            .filter(F.col("jaccard") >= self.threshold)
            .select("a", "b", "jaccard")
        )

    def pairs(self) -> DataFrame:
        """``rec_id_1, rec_id_2``: all row pairs (smaller first) with different url that meet the threshold."""
        m = lambda n: self.members.select(F.col("rec_id").alias(f"r{n}"), F.col("url").alias(f"u{n}"), F.col("rep").alias(f"rep{n}"))
        other_url = ~(F.col("u1").eqNullSafe(F.col("u2")) & F.col("u1").isNotNull())
        copies = self.members.select("rep", F.struct("rec_id", "url", "rep").alias("row"))
        unequal = ~(F.col("a.url").eqNullSafe(F.col("b.url")) & F.col("a.url").isNotNull())
        within = grid_pairs(copies, "rep", "row", (F.col("a.rec_id") < F.col("b.rec_id")) & (F.col("a.rep") == F.col("b.rep"))).filter(unequal).select(F.col("a.rec_id").alias("r1"), F.col("b.rec_id").alias("r2"))
        between = (
            self.links()
            .join(m(1), F.col("a") == F.col("rep1"))
            .join(m(2), F.col("b") == F.col("rep2"))
            .filter(other_url)
            .select("r1", "r2")
        )
        return within.unionByName(between).select(F.least("r1", "r2").alias("rec_id_1"), F.greatest("r1", "r2").alias("rec_id_2"))

    def groups(self) -> DataFrame:
        """``rec_id, group_id``: one row per row that is linked with or a copy of another; the group's smallest row names it."""
        component = components(self.links().select("a", "b"))
        joined = self.members.join(component, F.col("rep") == F.col("node"), "left").select("rec_id", F.coalesce("component", "rep").alias("group_id"))
        grown = joined.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").select("group_id")
        return joined.join(grown, "group_id", "left_semi").select("rec_id", "group_id")


def grid_pairs(rows: DataFrame, key: str, value: str, order=None) -> DataFrame:
    """``a, b``: the pairs a < b of ``value`` (or as ``order`` says) that share ``key`` (an integer), once for each key they share.

    Cells of hot keys are named by 64-bit hashes, so a pair without a common key may come out once in a great while; where
    that matters ``order`` must compare the keys.

    A key on more than ``HOT_ROWS`` rows and more than one of ``HOT_SHARE`` of all is cut into cells of a grid: its
    rows are hashed to g groups, and every pair of groups is a cell of its own, so no task sees more than two groups.
    Of such keys there are fewer than ``HOT_SHARE``; their list, which is broadcast, is bounded by that. Keys are first
    counted by hashed buckets, of which there are so few that the partial counts are small; only the keys of a bucket
    that is large enough to hold a hot one are counted themselves.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(value).alias("a"))
    total = rows.count()
    least = max(HOT_ROWS, total // HOT_SHARE)
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(64, 2 * total // least))).alias("bucket")
    full = rows.groupBy(bucket).agg(F.count("*").alias("n")).filter(F.col("n") > least).select("bucket")
    suspects = rows.select("key", bucket).join(F.broadcast(full), "bucket", "left_semi")
    hot = suspects.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("key", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("g"))
    placed = rows.join(F.broadcast(hot), "key", "left")
    i = F.pmod(F.xxhash64("a"), F.col("g")).cast("int")
    # cell (i, o) holds the pairs between these two groups; a key that isn't hot is a cell itself, without a group
    others = F.when(F.col("g").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("g") - 1))
    cells = placed.select("key", "a", i.alias("i"), F.explode(others).alias("o"))
    cell = F.when(F.col("i").isNull(), F.col("key").cast("bigint")).otherwise(F.xxhash64("key", F.least("i", "o"), F.greatest("i", "o")))
    left = cells.select(cell.alias("cell"), "a", "i", (F.col("i") == F.col("o")).alias("own"))
    right = cells.select(cell.alias("cell"), F.col("a").alias("b"), F.col("i").alias("j"))
    across = F.col("i").isNull() | (F.col("i") != F.col("j")) | F.col("own")
    return left.join(right, "cell").filter(order if order is not None else F.col("a") < F.col("b")).filter(across).select("a", "b")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of an undirected graph by alternating large-star and small-star.

    ``links`` has columns a and b. Each round is two aggregations over the links; the number of rounds
    is logarithmic in the graph's longest path. Stars have a link count equal to the node count, so a
    component of any size is spread over its links and never gathered in one task. Every round is
    written to the shared folder. Loops and repeated links do no harm; no link gives no row.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = materialize(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def p2_found(spark, sf_dir):
    return NearDuplicates(table(spark, sf_dir, "crawl_document")).pairs()


def p2_groups(spark, sf_dir):
    return NearDuplicates(table(spark, sf_dir, "crawl_document")).groups()


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
#: Brute force over all pairs of rows that share a run of three terms.
SQL = {
    "p2_found": r"""
        with k as (select * from (select rec_id, url, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w from crawl_document where text is not null) where len(w) >= 20),
        s as (select rec_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) g from k),
        n as (select rec_id, count(*) c from s group by 1),
        p as (select a.rec_id r1, b.rec_id r2, count(*) x from s a join s b on a.g = b.g and a.rec_id < b.rec_id group by 1, 2)
        select r1 as rec_id_1, r2 as rec_id_2 from p join n n1 on r1 = n1.rec_id join n n2 on r2 = n2.rec_id join k k1 on r1 = k1.rec_id join k k2 on r2 = k2.rec_id
        where x / (n1.c + n2.c - x) >= 0.6 and k1.url <> k2.url""",
}
