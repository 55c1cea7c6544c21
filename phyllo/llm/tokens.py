"""Encoding of whole texts with a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash (random 3-partite hypergraph, peeled) finds
whole pre-tokens that stand in the vocabulary; the others are merged by a heap
over linked bytes. The results of pre-tokens are kept in a bounded cache.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Fixed value: how this public vocabulary splits text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class PerfectHash:
    """Maps each of n distinct byte strings to its own number below n."""

    def __init__(self, keys: list[bytes]):
        self.keys, n = keys, len(keys)
        self.third = max(2, -(-123 * n // 300) + 1)
        for self.seed in range(100):
            if self._build(n):
                break
        else:
            raise ValueError("no acyclic hypergraph found; are the keys distinct?")
        place = self.slots(keys)
        self.order = np.empty(n, np.int64)
        self.order[place] = np.arange(n)

    def _vertices(self, keys: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_128_digest

        seed = self.seed
        digests = np.frombuffer(b"".join([xxh3_128_digest(k, seed) for k in keys]), np.uint32).reshape(-1, 4)
        return (digests[:, :3].astype(np.int64) * self.third >> 32) + np.arange(3) * self.third

    def _build(self, n: int) -> bool:
        edges = self._vertices(self.keys)
        degree = np.bincount(edges.ravel(), minlength=3 * self.third)
        held = np.zeros(3 * self.third, np.int64)
        for k in range(3):
            np.bitwise_xor.at(held, edges[:, k], np.arange(n))
        rounds, left = [], n
        while left:
            free = np.flatnonzero(degree == 1)
            if not len(free):
                return False
            peeled, first = np.unique(held[free], return_index=True)
            rounds.append((peeled, free[first]))
            left -= len(peeled)
            for k in range(3):
                np.subtract.at(degree, edges[peeled, k], 1)
                np.bitwise_xor.at(held, edges[peeled, k], peeled)
        self.g = np.zeros(3 * self.third, np.int8)
        used = np.zeros(3 * self.third, np.int64)
        for peeled, free in reversed(rounds):
            sums = self.g[edges[peeled]].sum(1)
            self.g[free] = (free // self.third - sums) % 3
            used[free] = 1
        self.rank = np.cumsum(used) - 1
        return True

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """Number of each key; of a foreign key that of some other key, or nonsense below n."""
        v = self._vertices(keys)
        return self.rank[v[np.arange(len(v)), self.g[v].sum(1) % 3]]

    def find(self, keys: list[bytes]) -> list[int]:
        """Position of each key in the key list, -1 for foreign ones."""
        if not keys:
            return []
        mine = self.keys
        return [i if mine[i] == k else -1 for i, k in zip(self.order[self.slots(keys)].tolist(), keys)]


class Tokenizer:
    """Byte-level BPE of a rank file, for pre-tokens split by ``PATTERN``."""

    def __init__(self, path: str = VOCABULARY, cache: int = 400_000):
        import regex

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.ranks, self.limit = ranks, cache
        self.ids = list(ranks.values())
        self.whole = PerfectHash(list(ranks))
        self.split = regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.length = array("i"), array("q"), array("i")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of bytes that are no token as a whole: lowest rank first, leftmost among equals."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it was merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= stop or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(piece[before[i] : stop])) is not None:
                heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of new pre-tokens into the cache."""
        new = list(pieces - self.known.keys())
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        for p, b, i in zip(new, raw, self.whole.find(raw)):
            ids = (self.ids[i],) if i >= 0 else self.merge(b)
            self.known[p] = len(self.start)
            self.start.append(len(self.flat))
            self.length.append(len(ids))
            self.flat.extend(ids)

    def indices(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache positions of all pre-tokens one after another, and how many each text has."""
        if len(self.known) > self.limit:
            self.clear()
        split = [self.split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        get = self.known.__getitem__
        return np.fromiter(map(get, chain.from_iterable(split)), np.int64, int(counts.sum())), counts

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text; 0 for empty and null ones."""
        at, counts = self.indices(texts)
        sums = np.concatenate([[0], np.cumsum(np.array(self.length, np.int64)[at])]) if len(at) else np.zeros(1, np.int64)
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text; an empty list for empty and null ones."""
        at, counts = self.indices(texts)
        length, start = np.array(self.length, np.int64)[at], np.array(self.start, np.int64)[at]
        sums = np.concatenate([[0], np.cumsum(length)])
        places = np.repeat(start - sums[:-1], length) + np.arange(sums[-1])
        offsets = np.concatenate([[0], sums[np.cumsum(counts)]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(self.flat, np.int32)[places]))


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker and vocabulary; it lives as long as the worker."""
    return Tokenizer(path)


def _chunks(batch: pa.RecordBatch, column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, so long texts never pile up in one step."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def text_list(column: pa.Array) -> list[str | None]:
    """Python strings of a text column; bytes that are no UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Token ids of every text: ``doc_id`` and ``ids``, without special tokens.

    Null and empty texts have an empty list; strings that spell a special token
    are ordinary text. One narrow pass: no shuffle, and only the two columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for part in _chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), t.encode(text_list(part.column(1)))], names=["doc_id", "ids"])

    source = documents.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Number of tokens of every text: ``doc_id`` and ``tokens``; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for part in _chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(t.lengths(text_list(part.column(1))))], names=["doc_id", "tokens"])

    source = documents.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, tokens long")
