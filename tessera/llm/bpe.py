"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

Texts are cut by the tokenizer's public pattern. The pieces of a batch that this worker hasn't
met yet are encoded together: one linked symbol array holds them all, and an index maps each
adjacent pair that the vocabulary can merge to all its positions. The ranks that are active are
taken in ascending order from a heap; a rank is applied at all its positions at once, the links
are updated, and the pairs that arise next to the new symbols are added to the index. A new pair
always has a higher rank than the one that made it, so one ascending sweep equals merging each
piece on its own. Encoded pieces stay in a table of the worker, so a piece costs a lookup later.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.tables import spread, table

TOKENIZER_DIR = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
#: The public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TABLE_LIMIT = 1_000_000


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: visible Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_merges(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of each byte, pair keys ascending by rank, id that each pair becomes). Fixed size: the vocabulary's."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    byte_id = np.zeros(256, dtype=np.int64)
    for symbol, byte in _byte_symbols().items():
        byte_id[byte] = vocab[symbol]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
    becomes = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    return byte_id, keys, becomes


class PairIndexEncoder:
    """Encodes lists of byte strings by the pair occurrence index."""

    def __init__(self, byte_id: np.ndarray, keys: np.ndarray, becomes: np.ndarray):
        self.byte_id, self.keys, self.becomes = byte_id, keys, becomes
        self.order = np.argsort(keys)
        self.sorted_keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary has none."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.sorted_keys, key), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[at] == key, self.order[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each piece)."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        total = int(lengths.sum())
        if not total:
            return np.empty(0, dtype=np.int64), lengths
        symbol = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        after = np.arange(1, total + 1)
        before = np.arange(-1, total - 1)
        after[np.append(piece[1:] != piece[:-1], True)] = -1
        before[np.insert(piece[1:] != piece[:-1], 0, True)] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(positions: np.ndarray) -> None:
            rank = self.ranks(symbol[positions], symbol[after[positions]])
            known = rank >= 0
            rank, positions = rank[known], positions[known]
            if not len(rank):
                return
            by = np.argsort(rank, kind="stable")
            rank, positions = rank[by], positions[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, where in zip(rank[np.insert(cuts, 0, 0)].tolist(), np.split(positions, cuts)):
                if r in index:
                    index[r].append(where)
                else:
                    index[r] = [where]
                    heapq.heappush(heap, r)

        add(np.flatnonzero(after >= 0))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            where = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left, right = divmod(int(self.keys[rank]), 1 << 20)
            follow = after[where]
            valid = (symbol[where] == left) & (follow >= 0) & (symbol[follow] == right)
            where, follow = where[valid], follow[valid]
            if left == right and len(where) > 1:  # runs of the same symbol merge from the left, two by two
                where = _every_other(np.sort(where), after)
                follow = after[where]
            if not len(where):
                continue
            symbol[where] = self.becomes[rank]
            symbol[follow] = -1
            beyond = after[follow]
            after[where] = beyond
            has = beyond >= 0
            before[beyond[has]] = where[has]
            after[follow] = -1
            front = before[where]
            front = front[front >= 0]
            fresh = np.concatenate([where[has], front])
            if len(fresh):
                add(np.unique(fresh) if len(fresh) > 1 else fresh)
        live = symbol >= 0
        return symbol[live], np.bincount(piece[live], minlength=len(pieces))


def _every_other(where: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of positions of an equal pair, those that merge: in each chain of overlapping ones the 1st, 3rd, ..."""
    chained = np.zeros(len(where), dtype=bool)
    chained[1:] = after[where[:-1]] == where[1:]
    start = np.flatnonzero(~chained)
    offset = np.arange(len(where)) - np.repeat(start, np.diff(np.append(start, len(where))))
    return where[offset % 2 == 0]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array itself, or a copy of at least twice its size if it holds less than ``size``."""
    if size <= len(array):
        return array
    out = np.empty(max(size, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


class CorpusEncoder:
    """Texts to ids, with a table of the pieces this worker has already encoded."""

    def __init__(self, merges: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.encoder = PairIndexEncoder(*merges)
        self.split = regex.compile(PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.used = 0
        self.ids = np.empty(1 << 16, dtype=np.int32)
        self.start = np.empty(1 << 14, dtype=np.int64)
        self.length = np.empty(1 << 14, dtype=np.int64)

    def _keep(self, fresh: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append encoded pieces to the table, whose arrays double when they are full."""
        old, new, end = len(self.code), len(self.code) + len(fresh), self.used + len(ids)
        self.ids = _room(self.ids, end)
        self.start, self.length = _room(self.start, new), _room(self.length, new)
        self.ids[self.used : end] = ids
        self.start[old:new] = self.used + np.cumsum(lengths) - lengths
        self.length[old:new] = lengths
        self.used = end
        self.code.update(zip(fresh, range(old, new)))

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all pieces, number of pieces of each text)."""
        if len(self.code) > _TABLE_LIMIT:
            self._clear()
        pieces: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                found = self.split(text)
                counts[k] = len(found)
                pieces += found
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.code]
        if fresh:
            ids, lengths = self.encoder.encode([p.encode("utf-8", "surrogatepass") for p in fresh])
            self._keep(fresh, ids, lengths)
        return np.fromiter(map(self.code.__getitem__, pieces), dtype=np.int64, count=len(pieces)), counts

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        codes, pieces = self.codes(texts)
        sums = np.concatenate([[0], np.cumsum(self.length[codes])])
        ends = np.cumsum(pieces)
        return sums[ends] - sums[ends - pieces]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts)."""
        codes, pieces = self.codes(texts)
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[codes] - (ends - lengths), lengths)
        sums = np.concatenate([[0], ends])
        return self.ids[flat], np.concatenate([[0], sums[np.cumsum(pieces)]])


_kept: dict[str, CorpusEncoder] = {}


def worker_encoder(name: str, merges) -> CorpusEncoder:
    """The encoder of this Python worker; it outlives a task where workers are reused."""
    if name not in _kept:
        _kept[name] = CorpusEncoder(merges.value if hasattr(merges, "value") else merges)
    return _kept[name]


def encode_column(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``<key>, ids array<int>``: the ids of each text without special tokens.

    The strings of special tokens are ordinary text. Null and empty texts give an empty list; blank
    ones their ids. Each input row gives one row, repeated ones too. The merge table that is
    broadcast has the vocabulary's fixed size (1 MB).
    """
    merges = df.sparkSession.sparkContext.broadcast(load_merges(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(name, merges)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=[key, "ids"])

    chosen = df.select(F.col(key), F.col(text))
    return chosen.mapInArrow(run, f"`{key}` {chosen.dtypes[0][1]}, ids array<int>")


def p8_ids(spark, sf_dir):
    return encode_column(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
