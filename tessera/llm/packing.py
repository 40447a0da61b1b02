"""Problem 9: filling fixed-capacity containers with the texts, measured in tokens.

Sizes come from the corpus encoder. Texts larger than the capacity are cut into full pieces, each of
which fills a container, and a rest. The rows' sizes, not their texts, are hashed into groups of about ``GROUP`` items
that are packed on their own (a group costs one container that isn't full), so no task grows with the table. Within a
group the pool of sizes is a bit set, and each container is filled by best-two-fit: greedily with the
largest size that fits the gap, then its smallest item is replaced with the two unpacked items that
fit the widened gap best, if they leave less of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import TOKENIZER_DIR, load_merges, worker_encoder
from tessera.tables import spread, table

GROUP = 25_000
#: Tasks of the packing stage at most; a task packs its rows group by group.
MAX_TASKS = 20_000


class Pool:
    """Unpacked items by size: a stack of items for each size, a bit per size present and its mirror image."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.capacity = capacity
        self.items: dict[int, list[int]] = {}
        for item in np.argsort(sizes, kind="stable")[::-1].tolist():
            self.items.setdefault(int(sizes[item]), []).append(item)
        self.bits = self.mirror = 0
        for size in self.items:
            self._set(size)

    def _set(self, size: int) -> None:
        self.bits |= 1 << size
        self.mirror |= 1 << (self.capacity - size)

    def take(self, size: int) -> int:
        stack = self.items[size]
        item = stack.pop()
        if not stack:
            del self.items[size]
            self.bits &= ~(1 << size)
            self.mirror &= ~(1 << (self.capacity - size))
        return item

    def put(self, size: int, item: int) -> None:
        if size not in self.items:
            self.items[size] = []
            self._set(size)
        self.items[size].append(item)

    def largest(self, gap: int) -> int:
        """Largest size that fits, 0 if none does."""
        low = self.bits & ((1 << (gap + 1)) - 1)
        return low.bit_length() - 1 if low else 0

    def pair(self, gap: int, above: int) -> tuple[int, int] | None:
        """Two sizes with the largest sum of at most ``gap`` and more than ``above``."""
        for total in range(gap, above, -1):
            both = self.bits & (self.mirror >> (self.capacity - total))
            while both:
                a = both.bit_length() - 1
                if 2 * a != total or len(self.items[a]) > 1:
                    return a, total - a
                both &= ~(1 << a)
        return None


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; every size is between 1 and ``capacity``."""
    pool, out, container = Pool(sizes, capacity), np.zeros(len(sizes), dtype=np.int64), 0
    while pool.bits:
        gap, inside = capacity, []
        while gap and (size := pool.largest(gap)):
            inside.append((size, pool.take(size)))
            gap -= size
        if gap and len(inside) > 1 and pool.bits:
            size, item = inside[-1]  # taken in descending order: the last is the smallest
            found = pool.pair(gap + size, size)
            if found:
                inside.pop()
                inside += [(s, pool.take(s)) for s in found]
                pool.put(size, item)
        for _, item in inside:
            out[item] = container
        container += 1
    return out


def pack(df: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``container_kind string, container bigint, <key>, piece int, n_tokens int``: one row for each piece of each text and kind.

    A text that fits isn't split; a larger one gives full pieces and a rest, numbered from 0. Null and
    empty texts have no tokens, take no space and stand in the first container of their group. Kinds without a
    positive capacity give no row. ``containers`` is the fixed table of kinds, read on the driver. Repeated
    rows are packed each. Other columns are ignored.
    """
    spark = df.sparkSession
    kinds = [(r.container_kind, int(r.capacity), r.tokenizer) for r in containers.select("container_kind", "capacity", "tokenizer").filter("capacity > 0").collect()]
    source = spread(df.select(F.col(key).alias("item"), F.col(text).alias("text")), "item")
    kind = dict(source.dtypes)["item"]
    out = None
    groups = max(1, -(-df.count() // GROUP))
    for name in sorted({k[2] for k in kinds}):
        packed = _packed(_sizes(source, kind, name, folder), kind, [k[:2] for k in kinds if k[2] == name], groups)
        out = packed if out is None else out.unionByName(packed)
    if out is None:
        return spark.createDataFrame([], f"container_kind string, container bigint, `{key}` {kind}, piece int, n_tokens int")
    return out.withColumnRenamed("item", key)


def _sizes(source: DataFrame, kind: str, name: str, folder: str) -> DataFrame:
    merges = source.sparkSession.sparkContext.broadcast(load_merges(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(name, merges)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder.counts(part.column(1).to_pylist()))], names=["item", "n"])

    return source.mapInArrow(run, f"item {kind}, n bigint")


def _packed(sizes: DataFrame, kind: str, kinds: list[tuple[str, int]], groups: int) -> DataFrame:
    # sorted, so that a group's filling doesn't depend on the order in which the shuffle arrives
    sizes = sizes.repartition(min(groups, MAX_TASKS), "item").sortWithinPartitions("item", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        items, n = [], []
        group = 0

        def out():
            ids, counts = pa.concat_arrays(items), np.concatenate(n)
            for name, capacity in kinds:
                yield _rows(ids, counts, name, capacity, base + (group << 24))

        for batch in batches:
            items.append(batch.column(0))
            n.append(batch.column(1).to_numpy())
            if sum(map(len, n)) >= 2 * GROUP:
                yield from out()
                items, n, group = [], [], group + 1
        if items and sum(map(len, n)):
            yield from out()

    return sizes.mapInArrow(run, f"container_kind string, container bigint, item {kind}, piece int, n_tokens int")


def _rows(ids: pa.Array, counts: np.ndarray, name: str, capacity: int, base: int) -> pa.RecordBatch:
    full, rest = np.divmod(counts, capacity)
    pool = np.flatnonzero(rest)
    filled = best_two_fit(rest[pool], capacity)
    used = int(filled.max()) + 1 if len(filled) else 0
    rows = [np.repeat(np.arange(len(counts)), full), pool, np.flatnonzero(counts == 0)]
    start = np.cumsum(full) - full
    pieces = [np.arange(int(full.sum())) - np.repeat(start, full), full[pool], np.zeros(len(rows[2]), dtype=np.int64)]
    tokens = [np.full(len(rows[0]), capacity), rest[pool], np.zeros(len(rows[2]), dtype=np.int64)]
    container = [used + np.arange(len(rows[0])), filled, np.zeros(len(rows[2]), dtype=np.int64)]
    take = np.concatenate(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * len(take), pa.string()),
            pa.array(np.concatenate(container) + base),
            ids.take(pa.array(take)),
            pa.array(np.concatenate(pieces).astype(np.int32)),
            pa.array(np.concatenate(tokens).astype(np.int32)),
        ],
        names=["container_kind", "container", "item", "piece", "n_tokens"],
    )


def p9_packed(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "containers"))


def p9_fill(spark, sf_dir):
    """Containers used, the bound that no filling can beat, and the share of unused space, by kind."""
    packed = p9_packed(spark, sf_dir)
    used = packed.groupBy("container_kind").agg(F.sum("n_tokens").alias("n_tokens"), F.countDistinct("container").alias("n_containers"))
    capacity = table(spark, sf_dir, "containers").select("container_kind", "capacity")
    return used.join(capacity, "container_kind").select(
        "container_kind", "capacity", "n_tokens", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("unused_share")
    )


QUERIES = {"p9_packed": p9_packed, "p9_fill": p9_fill}
SQL: dict[str, str] = {}
