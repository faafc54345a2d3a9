"""Byte-level BPE of whole corpora with numpy matrices.

Texts are cut into pieces by the vocabulary's pattern; the distinct pieces of a batch are put into padded
matrices by length. In each round every row merges its leftmost pair of the smallest rank; pairs are looked
up in an open-addressing hash table, and the matrix is compacted. Rows without a mergeable pair leave.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
LONG_PIECE = 2048  # longer pieces are merged with a heap, whose cost doesn't grow with the square of the length
KEPT_PIECES = 400_000  # pieces remembered by a worker; then it starts afresh


class PairTable:
    """Open-addressing hash table from (left id, right id) to the merged id, whose order is the rank."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        bits = int(np.ceil(np.log2(max(4, len(pairs) * 3))))
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        todo, slot = np.arange(len(pairs)), self._slot(pairs)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            at, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[at], self.values[at] = pairs[placed], merged[placed]
            todo = np.setdiff1d(todo, placed)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair doesn't merge or an id is negative (padding)."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 20) | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class Vocabulary:
    """A rank file with the merges it implies."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.ranks.values()) >= 1 << 20:
            raise ValueError("a pair's key holds ids below 2**20")
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 20 | b)
                    merged.append(rank)
        self.table = PairTable(np.array(pairs, np.int64), np.array(merged, np.int32))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        import regex

        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, np.ndarray] = {}

    def _bucket(self, ids: np.ndarray) -> list[np.ndarray]:
        """ids: padded with -1; the merged ids of each row, in order."""
        out: list[np.ndarray] = [None] * len(ids)  # type: ignore[list-item]
        rows = np.arange(len(ids))
        merge = self.table.get(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = merge.argmin(axis=1) if merge.shape[1] else np.zeros(len(rows), np.int64)
            low = merge[np.arange(len(rows)), at] if merge.shape[1] else np.full(len(rows), NONE)
            done = low == NONE
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k][ids[k] >= 0]
            if done.all():
                break
            go = ~done
            rows, ids, merge, at, low = rows[go], ids[go], merge[go], at[go], low[go]
            n = np.arange(len(rows))
            ids[n, at] = low
            # compaction: everything right of the merged pair moves one to the left
            keep = np.arange(ids.shape[1] - 1)[None, :] + (np.arange(ids.shape[1] - 1)[None, :] > at[:, None])
            ids = np.take_along_axis(ids, keep, axis=1)
            if ids.shape[1] == 1:
                merge = np.empty((len(rows), 0), np.int32)
                continue
            pick = np.arange(merge.shape[1] - 1)[None, :]
            merge = np.take_along_axis(merge, pick + (pick >= at[:, None]), axis=1)
            # only the pairs beside the merged one are new
            right = np.flatnonzero(at < merge.shape[1])
            merge[right, at[right]] = self.table.get(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            merge[left, at[left] - 1] = self.table.get(ids[left, at[left] - 1], ids[left, at[left]])
        return out

    def _one_long(self, raw: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap of pairs over a linked list."""
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.table.get(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(m, i, ids[i], ids[i + 1]) for i, m in enumerate(first) if m != NONE]
        heapq.heapify(heap)
        look = lru_cache(maxsize=1 << 16)(lambda a, b: int(self.table.get(np.array([a], np.int32), np.array([b], np.int32))[0]))
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = m, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (r := look(ids[x], ids[y])) != NONE:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def learn(self, pieces: Iterator[str]) -> None:
        """Encode the pieces that aren't known yet, by buckets of length."""
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) > LONG_PIECE:
                self.known[p] = self._one_long(raw)
            else:
                buckets.setdefault(4 if len(raw) <= 4 else 1 << (len(raw) - 1).bit_length(), []).append((p, raw))
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for _, r in part), np.uint8).reshape(len(part), width)
                size = np.array([len(r) for _, r in part])
                ids = np.where(np.arange(width)[None, :] < size[:, None], self.byte_ids[raw], np.int32(-1))
                self.known.update(zip((p for p, _ in part), self._bucket(ids)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; an empty array for empty and null texts."""
        cut = [self.split(t) if t else [] for t in texts]
        new = {p for ps in cut for p in ps if p not in self.known}
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
            new = {p for ps in cut for p in ps}
        self.learn(new)
        none = np.empty(0, np.int32)
        return [np.concatenate([self.known[p] for p in ps]) if ps else none for ps in cut]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, ident: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(ident, ids): ids of the whole text without special tokens; an empty list for empty and null texts.

    Text that looks like a special token is ordinary text. Every input row gives a row (doc_id is unique, so nothing is
    shuffled to compare rows). The executors read the rank file from ``folder``.
    """
    path = f"{folder}/{name}.tiktoken"

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for texts in parts:
            out = []
            for k in range(0, len(texts), 2000):
                out += v.encode(texts.iloc[k : k + 2000].tolist())
            yield pd.Series(out)

    return docs.select(F.col(ident), ids(F.col(text)).alias("ids"))
