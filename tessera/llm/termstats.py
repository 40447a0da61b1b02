"""Problem 1: frequency of every distinct term or n-gram.

Each Arrow batch becomes one token array. Its suffix array is built by prefix doubling to a depth of
``DEPTH`` tokens, with the common prefix of every two neighbours from the ranks of the doubling levels;
runs of neighbours that share n leading tokens are the common-prefix intervals, i.e. the n-grams.
The length of an interval is the n-gram's occurrence count, and its record count is that length
less the within-record duplicate adjacencies. Records never cross batches, so both counts add up:
the partial counts are merged by one hash aggregation with a map-side combine. A term that a third
of all rows hold arrives as one row a batch, hence no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import TERM
from tessera.tables import spread

RARE_BELOW_ROWS = 3
COMMON_ABOVE_SHARE = 0.1
#: Tokens to which suffixes are ordered; n-grams up to this length come from one suffix array.
DEPTH = 8


def suffix_levels(ids: np.ndarray, record: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, ranks by level) by prefix doubling: level k ranks every suffix by its first 2**k tokens.

    A suffix ends with its record. Doubling stops when ``depth`` tokens are compared or all suffixes differ.
    """
    size = len(ids)
    ranks = ids.astype(np.int64) + 1  # 0 stands for the end of the record
    order, levels, width = np.argsort(ranks, kind="stable"), [ranks], 1
    while width < depth and width < size:
        ahead = np.zeros(size, dtype=np.int64)
        same = record[width:] == record[:-width]
        ahead[:-width][same] = ranks[width:][same]
        key = ranks * (int(ranks.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(size, dtype=np.int64)
        fresh[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
        ranks, width = fresh, width * 2
        levels.append(ranks)
        if int(ranks.max()) == size:
            break
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it (0 for the first), by descending the levels.

    ``left`` is the number of tokens from each position to the end of its record. Exact up to the width of all levels.
    """
    a, b = order[:-1].copy(), order[1:].copy()
    last = len(left) - 1
    out = np.zeros(len(a), dtype=np.int64)
    live = np.ones(len(a), dtype=bool)
    for k in range(len(levels) - 1, -1, -1):
        # equal ranks at level k mean that the next 2**k tokens agree, the record's end included
        agree = live & (levels[k][a] == levels[k][b])
        step = np.where(agree, np.minimum(1 << k, left[a]), 0)
        out += step
        ended = agree & (left[a] <= 1 << k)
        live &= ~ended
        a, b = np.minimum(a + step, last), np.minimum(b + step, last)
    return np.concatenate([[0], out])


def suffix_intervals(ids: np.ndarray, record: np.ndarray, n_max: int, depth: int | None = None):
    """Yield (n, first position, occurrences, records) of the n-grams of ``ids`` for n = 1..n_max.

    ``record`` is the ascending record number of each token; n-grams don't cross records. The suffixes are
    ordered to ``depth`` tokens (at least ``n_max``); an n-gram is a run of neighbours whose common prefix is n or more.
    """
    size = len(ids)
    if not size:
        return
    order, levels = suffix_levels(ids, record, max(n_max, depth or n_max))
    ends = np.append(np.flatnonzero(record[1:] != record[:-1]) + 1, size)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(size)
    lcp = common_prefixes(order, levels, left)
    sorted_record = record[order].astype(np.int64)
    n_records = int(record[-1]) + 1
    for n in range(1, n_max + 1):
        long_enough = left[order] >= n
        start = (lcp < n) & long_enough
        interval = np.cumsum(start) - 1
        interval, rec, first = interval[long_enough], sorted_record[long_enough], order[start]
        if not len(first):
            continue
        occurrences = np.bincount(interval, minlength=len(first))
        by_record = np.sort(interval * n_records + rec)  # records of an interval side by side
        again = by_record[1:][by_record[1:] == by_record[:-1]] // n_records
        yield n, first, occurrences, occurrences - np.bincount(again, minlength=len(first))


def _partial_counts(n_max: int):
    schema = pa.schema([("n", pa.int32()), ("term", pa.string()), ("occurrences", pa.int64()), ("n_rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: list[str] = []
            lengths = []
            for text in batch.column(0).to_pylist():
                found = TERM.findall(text.lower()) if text else []
                lengths.append(len(found))
                words += found
            if not words:
                continue
            ids, names = pd.factorize(np.array(words, dtype=object))
            record = np.repeat(np.arange(len(lengths)), lengths)
            for n, first, occurrences, rows in suffix_intervals(ids, record, n_max, DEPTH):
                text = names[ids[first]] if n == 1 else [" ".join(words[p : p + n]) for p in first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), n, dtype=np.int32)), pa.array(text, pa.string()), pa.array(occurrences.astype(np.int64)), pa.array(rows.astype(np.int64))],
                    schema=schema,
                )

    return run


def ngram_counts(df: DataFrame, text: str, n_max: int = 1) -> DataFrame:
    """``n int, term string, occurrences bigint, n_rows bigint, mark string`` for every n-gram.

    ``mark`` is ``rare`` below three rows, ``common`` above a tenth of the rows whose text isn't
    null, else null; rare wins where a tiny table makes a term both. All rows count, repeated ones
    too. Null, empty and blank texts hold no term; an empty table gives no row. Other columns of
    ``df`` are ignored whatever their names.
    """
    texts = df.select(F.col(text).alias("text"))
    counted = (
        texts.filter("text is not null")
        .mapInArrow(_partial_counts(n_max), "n int, term string, occurrences bigint, n_rows bigint")
        .groupBy("n", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("n_rows").alias("n_rows"))
    )
    total = texts.agg(F.count("text").alias("n")).scalar()
    mark = F.when(F.col("n_rows") < RARE_BELOW_ROWS, "rare").when(F.col("n_rows") > total * COMMON_ABOVE_SHARE, "common")
    return counted.withColumn("mark", mark)


def p1_found(spark, sf_dir):
    from tessera.tables import table

    pages = spread(table(spark, sf_dir, "crawl_document").select("rec_id", "text"), "rec_id")
    return ngram_counts(pages, "text").filter("mark is not null").select("term", "mark")


def p1_terms(spark, sf_dir):
    """Every term with its occurrences and rows; ``mark`` is null where it is neither rare nor common."""
    from tessera.tables import table

    pages = spread(table(spark, sf_dir, "crawl_document").select("rec_id", "text"), "rec_id")
    return ngram_counts(pages, "text").select("term", "occurrences", "n_rows", "mark")


def p1_bigrams(spark, sf_dir):
    from tessera.tables import table

    pages = spread(table(spark, sf_dir, "crawl_document").select("rec_id", "text"), "rec_id")
    return ngram_counts(pages, "text", 2).filter("n = 2").select("term", "occurrences", "n_rows", "mark")


_TERMS = r"select rec_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) term from crawl_document where text is not null"

SQL = {
    "p1_found": f"""
        with t as ({_TERMS}),
        c as (select term, count(distinct rec_id) n from t group by 1)
        select term, case when n < 3 then 'rare' else 'common' end as mark
        from c where n < 3 or n > (select count(text) from crawl_document) * 0.1""",
    "p1_terms": f"""
        with t as ({_TERMS}),
        c as (select term, count(*) occurrences, count(distinct rec_id) n_rows from t group by 1)
        select term, cast(occurrences as bigint) occurrences, cast(n_rows as bigint) n_rows,
               case when n_rows < 3 then 'rare' when n_rows > (select count(text) from crawl_document) * 0.1 then 'common' end as mark from c""",
    "p1_bigrams": r"""
        with w as (select rec_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w from crawl_document where text is not null),
        b as (select rec_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) term from w where len(w) > 1),
        c as (select term, count(*) occurrences, count(distinct rec_id) n_rows from b group by 1)
        select term, cast(occurrences as bigint) occurrences, cast(n_rows as bigint) n_rows,
               case when n_rows < 3 then 'rare' when n_rows > (select count(text) from crawl_document) * 0.1 then 'common' end as mark from c""",
}

QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p1_bigrams": p1_bigrams}
