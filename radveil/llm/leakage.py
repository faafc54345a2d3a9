"""Evaluation texts inside training text, by size-partitioned MinHash containment.

A passage counts from WINDOW successive words on. So the sets whose containment is searched are the word
shingles of windows of that length: an item's sketch holds, for each of its windows, the minimum of the hashes
of the window's shingles, and a document's likewise. A shared window gives a shared minimum for certain, so
no leak is lost; neighbouring windows mostly share their minimum, so sketches are a fraction of the text.
Items are partitioned by size. A passage of ten words holds six shingles of five, so an item of n shingles has at least the
share 6 / n of them in a document it leaks into; the threshold of containment of a partition is the least such share
of its items, and the partition with the largest items asks for the smallest. Items that share a minimum and reach the
threshold are verified on the words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10  # successive words of a leak
SHINGLE = 5  # words of a shingle
ITEMS_PER_PASS = 20_000  # bound what a pass broadcasts; more items take more passes over the documents
CHARS_PER_PASS = 32_000_000
WORDS = re.compile("[a-z0-9]+")


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class Hasher:
    """64-bit hashes of words, remembered for the run of a task."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        if len(self.known) > 2_000_000:
            self.known.clear()
        k = self.known
        return np.fromiter((k[w] if w in k else k.setdefault(w, xxhash.xxh64_intdigest(w)) for w in ws), np.uint64, len(ws))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n successive words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        total = total * np.uint64(0x100000001B3) + _mixed(h[j : len(h) - n + 1 + j])
    return _mixed(total)


def window_minima(h: np.ndarray, window: int, shingle: int) -> np.ndarray:
    """The MinHash of each window."""
    s, per = shingle_hashes(h, shingle), window - shingle + 1
    if len(s) < per:
        return np.empty(0, np.uint64)
    out = s[: len(s) - per + 1]
    for j in range(1, per):
        out = np.minimum(out, s[j : len(s) - per + 1 + j])
    return out


class ItemIndex:
    """Sketches of items by size partition, and their windows for verification."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        hasher, self.window, self.shingle = Hasher(), window, shingle
        self.exact: list[tuple[str, set[tuple[str, ...]], np.ndarray]] = []
        parts: dict[int, tuple[list, list, list]] = {}
        for ident, text in items:
            ws = words(text)
            if len(ws) < window:
                continue  # it can't leak as a passage of that length
            h = hasher(ws)
            sketch, in_order = np.unique(window_minima(h, window, shingle)), shingle_hashes(h, shingle)
            shingles = np.unique(in_order)
            # a window that repeats shingles holds fewer than window - shingle + 1 different ones
            fewest = min(len(np.unique(in_order[k : k + window - shingle + 1])) for k in range(len(ws) - window + 1))
            keys, owners, shares = parts.setdefault(self.size_class(len(shingles)), ([], [], []))
            keys.append(sketch)
            owners += [len(self.exact)] * len(sketch)
            shares.append(fewest / len(shingles))
            self.exact.append((ident, self.windows(ws), shingles))
        self.parts = []
        for _, (keys, owners, shares) in sorted(parts.items()):
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            self.parts.append((min(shares), flat[order], np.array(owners)[order]))

    @staticmethod
    def size_class(n: int) -> int:
        """Two classes for each doubling of the size."""
        return int(2 * np.log2(n))

    def windows(self, ws: list[str]) -> set[tuple[str, ...]]:
        return {tuple(ws[k : k + self.window]) for k in range(len(ws) - self.window + 1)}

    def search(self, text: str | None, hasher: Hasher) -> list[str]:
        ws = words(text)
        if len(ws) < self.window:
            return []
        h = hasher(ws)
        hits = self.candidates(np.unique(window_minima(h, self.window, self.shingle)), h)
        if not hits:
            return []
        mine = self.windows(ws)
        return sorted({self.exact[o][0] for o in hits if not mine.isdisjoint(self.exact[o][1])})

    def candidates(self, sketch: np.ndarray, h: np.ndarray) -> list[int]:
        """The items with a minimum of the sketch whose containment in the words h reaches their partition's threshold."""
        hits, mine = [], None
        for least, keys, owners in self.parts:
            lo, hi = np.searchsorted(keys, sketch, "left"), np.searchsorted(keys, sketch, "right")
            met = hi > lo
            if not met.any():
                continue
            mine = np.unique(shingle_hashes(h, self.shingle)) if mine is None else mine
            for o in np.unique(np.concatenate([owners[a:b] for a, b in zip(lo[met], hi[met])])).tolist():
                shingles = self.exact[o][2]
                at = np.searchsorted(mine, shingles)
                shared = np.count_nonzero(mine[np.minimum(at, len(mine) - 1)] == shingles)
                if shared >= least * len(shingles) - 1e-9:
                    hits.append(o)
        return hits


def _searcher(index):
    """Column function of a broadcast ItemIndex: the items that leak into each text."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def leaks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for texts in parts:
            yield pd.Series([index.value.search(t, hasher) for t in texts])

    return leaks


def found(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """(doc_id, item_id): the document holds at least ``window`` successive words of the item.

    Null, empty and blank texts and items shorter than a window give nothing; repeated rows count once; an item_id with
    several texts leaks by any of them. Whole texts are searched. The items are a fixed query set: they are broadcast in
    blocks of bounded number and length, the documents are read once a block and never shuffled.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("string").alias("item_id"), "item_text").where("item_id is not null and item_text is not null").distinct()
    n, chars = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()
    blocks = max(1, -(-n // items_per_pass), -(-chars // CHARS_PER_PASS))
    out = None
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        index = spark.sparkContext.broadcast(ItemIndex([(r.item_id, r.item_text) for r in rows], window, shingle))

        got = docs.select("doc_id", F.explode(_searcher(index)("text")).alias("item_id")).distinct()
        out = got if out is None else out.unionByName(got)
    return out


def by_item(leaks: DataFrame) -> DataFrame:
    """(item_id, n_docs) of the items that leaked."""
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
