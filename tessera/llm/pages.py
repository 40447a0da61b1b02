"""Problem 6: the page's own content among menus, notices, side columns, promotions and footers.

One shuffle brings the pages of a host together, in the order of their ids: hosts with many rows are salted over
many tasks. A task reads a host's pages (at most ``BLOCK_PAGES`` pages and ``BLOCK_CHARS`` characters at a time),
folds them into a wrapper (see ``wrapper``) and, where the block is the whole host, labels its pages at once by
their alignment to the wrapper. Of a host that needs several blocks it gives out the block's wrapper and the
pages instead; these wrappers are merged in a tree of (host, bucket) and host, in the order of their content, and
brought to the pages by a second shuffle, hashed by (host, salt) and sorted so that the wrapper comes first. Both
ways label by the same function, and each page's mark-up is repaired, parsed and aligned once (twice for hosts
with several blocks).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.wrapper import TEXT, Layout, Page, Wrapper
from tessera.tables import materialize, table

#: Pages and characters of a host in one block; a host with more rows is salted.
BLOCK_PAGES, BLOCK_CHARS = 5_000, 64_000_000
MERGE_BUCKETS = 64
#: A host is salted if it has more than ``BLOCK_PAGES`` rows and more than one of ``HOT_SHARE`` of all rows; the list of
#: such hosts, which is broadcast, is shorter than ``HOT_SHARE``. Smaller hosts with many rows are blocks of one task.
HOT_SHARE = 20_000

_PAGE = "site string, salt int, rec_id bigint, url string, body string, wrapper string"


def _page(body: str) -> Page:
    from tessera.llm.mojibake import restore

    return Page(restore(body)[0])


def _batch(names: list[str], columns) -> pa.RecordBatch:
    types = {"site": pa.string(), "salt": pa.int32(), "url": pa.string(), "body": pa.string(), "wrapper": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, columns)], names=names)


def _blocks(emit, names: list[str]):
    """Rows (site, salt, salts, rec_id, url, body), sorted by host, salt and id, to results, or to wrappers and pages."""
    out_names = ["site", "salt", "rec_id", "url", "body", "wrapper", *(f"out_{n}" for n in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, chars, cut = None, [], 0, False
        found: list[tuple] = []

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            """The finished block; ``last`` tells whether the host's rows in this task end with it."""
            site, salt, salts = current
            wrapper = Wrapper.of([page for _, _, _, page in block])
            if salts == 1 and last and not cut:
                layout = Layout(wrapper)
                for rec_id, url, _, page in block:
                    found.extend(emit(rec_id, url, page, layout.label(page)))
                return
            rows = [(site, None, None, None, None, wrapper.dumps())] + [(site, salt, rec_id, url, body, None) for rec_id, url, body, _ in block]
            yield _batch(out_names, [*zip(*rows), *([[None] * len(rows)] * len(names))])

        def results() -> Iterator[pa.RecordBatch]:
            if found:
                yield _batch(out_names, [*([[None] * len(found)] * 6), *zip(*found)])
                found.clear()

        for batch in batches:
            for site, salt, salts, rec_id, url, body in zip(*(batch.column(k).to_pylist() for k in range(6))):
                key = (site, salt, salts)
                if key != current or len(block) >= 2 * BLOCK_PAGES or chars > BLOCK_CHARS:
                    if block:
                        yield from close(key != current)
                    cut = key == current
                    current, block, chars = key, [], 0
                block.append((rec_id, url, body, _page(body)))
                chars += len(body)
            if len(found) > 20_000:
                yield from results()
        if block:
            yield from close(True)
        yield from results()

    return run


def _merge(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key: equal keys are neighbours, one wrapper is held at a time."""
        current, wrapper = None, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for *key, data in zip(*columns):
                if key != current:
                    if current is not None:
                        yield _batch(["site", "wrapper"], [[current[0]], [wrapper.dumps()]])
                    current, wrapper = key, Wrapper.loads(data)
                else:
                    wrapper.merge(Wrapper.loads(data))
        if current is not None:
            yield _batch(["site", "wrapper"], [[current[0]], [wrapper.dumps()]])

    return run


def merged(partial: DataFrame) -> DataFrame:
    """``site string, wrapper string``: one wrapper per host of partial ones, merged in a fixed order."""
    level = partial.select("site", "wrapper").withColumn("bucket", F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_BUCKETS)).cast("int"))
    level = level.repartition("site", "bucket").sortWithinPartitions("site", "bucket", "wrapper").select("site", "bucket", "wrapper").mapInArrow(_merge(["site", "bucket"]), "site string, wrapper string")
    return level.repartition("site").sortWithinPartitions("site", "wrapper").select("site", "wrapper").mapInArrow(_merge(["site"]), "site string, wrapper string")


def _apply(emit, names: list[str]):
    """Streams rows (site, rec_id, url, body, wrapper); a wrapper row comes before its host's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = None
        for batch in batches:
            rows: list[tuple] = []
            for _, rec_id, url, body, wrapper in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if wrapper is not None:
                    layout = Layout(Wrapper.loads(wrapper))
                    continue
                page = _page(body)
                rows += emit(rec_id, url, page, layout.label(page))
            if rows:
                yield _batch(names, zip(*rows))

    return run


def with_layouts(df: DataFrame, emit, names: list[str]) -> DataFrame:
    """Rows of bigint columns ``names`` that ``emit(rec_id, url, page, labels)`` gives for each page.

    ``df`` has rec_id, url, site, body. A null site is a host of its own. Rows whose body is null give nothing.
    """
    pages = df.select("rec_id", "url", F.coalesce("site", F.lit("")).alias("site"), "body").filter("body is not null")
    sizes = df.select(F.coalesce("site", F.lit("")).alias("site")).groupBy("site").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n")).scalar()
    hot = sizes.filter((F.col("n") > BLOCK_PAGES) & (F.col("n") * HOT_SHARE > total)).select("site", F.ceil(F.col("n") / BLOCK_PAGES).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    salted = pages.join(F.broadcast(hot), "site", "left").select("site", F.pmod(F.xxhash64("rec_id"), salts).cast("int").alias("salt"), salts.alias("salts"), "rec_id", "url", "body")
    outs = ", ".join(f"out_{n} bigint" for n in names)
    first = salted.repartition("site", "salt").sortWithinPartitions("site", "salt", "rec_id").mapInArrow(_blocks(emit, names), f"{_PAGE}, {outs}")
    first = materialize(first, "blocks")
    done = first.filter(f"out_{names[0]} is not null").select(*(F.col(f"out_{n}").alias(n) for n in names))
    rest = first.filter("rec_id is not null").select("site", "salt", "rec_id", "url", "body", "wrapper")
    places = rest.select("site", "salt").distinct()
    frames = merged(first.filter("wrapper is not null")).join(places, "site").select("site", "salt", *(F.lit(None).cast(t).alias(n) for n, t in (("rec_id", "bigint"), ("url", "string"), ("body", "string"))), "wrapper")
    ordered = rest.unionByName(frames).repartition("site", "salt").sortWithinPartitions("site", "salt", F.col("wrapper").isNull(), "rec_id")
    late = ordered.select("site", "rec_id", "url", "body", "wrapper").mapInArrow(_apply(emit, names), ", ".join(f"{n} bigint" for n in names))
    return done.unionByName(late)


def _content(rec_id, url, page, labels):
    from tessera.llm.spam import is_spam

    if is_spam(page.lines, [k for k, _ in labels]):
        return []
    return [(rec_id, k + 1) for k, label in labels if label == TEXT]


def main_content(df: DataFrame) -> DataFrame:
    """``rec_id, line_no``: the lines (from 1) of ``body`` that hold the page's own content.

    Pages that are spam by problem 4's rule give no line, nor do null and blank bodies. Lines are the
    pieces of the body split at a newline, empty ones included. Extra columns are ignored, repeated rows
    give their lines each. An empty table gives no row.
    """
    return with_layouts(df, _content, ["rec_id", "line_no"])


def p6_found(spark, sf_dir):
    return main_content(table(spark, sf_dir, "crawl_document"))


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
