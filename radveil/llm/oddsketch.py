"""Near-duplicate texts by odd sketches.

Exact copies (same words) form a class first; only class representatives are compared. Their MinHash samples give
bands for candidates, and are folded into a parity bitmap, the odd sketch: the population count of the XOR of two
sketches estimates the similarity of a candidate. Candidates whose estimate is far below the threshold are
dropped, the others are verified on their exact shingle sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Stage
from .leakage import Hasher, shingle_hashes

BANDS, ROWS = 96, 4  # a pair of similarity 0.5 meets in a band with probability 0.998, of 0.55 with 0.9999
SKETCH_WORDS = 16  # 64-bit words of the odd sketch: 1,024 bits
SLACK = 0.2  # an estimate this far under the threshold is over four standard errors away
WORDS = re.compile("[a-z0-9]+")

_SIGNED = T.StructType([T.StructField("n_words", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])


def _signer(shingle: int, least_words: int, bands: int, rows: int, words_in_sketch: int):
    k, bits = bands * rows, 64 * words_in_sketch
    pairs = (k + 1) // 2

    @F.pandas_udf(_SIGNED)
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(20240229)
        a = rng.integers(1, 2**63, pairs, np.uint64) | np.uint64(1)
        b = rng.integers(0, 2**63, pairs, np.uint64)
        salt = rng.integers(0, 2**63, k, np.uint64)
        hasher = Hasher()
        for texts in parts:
            out = []
            for text in texts:
                ws = WORDS.findall((text or "").lower())
                if len(ws) < max(least_words, shingle):
                    out.append((len(ws), [], [], []))
                    continue
                s = np.unique(shingle_hashes(hasher(ws), shingle))
                least = np.full(2 * pairs, np.iinfo(np.uint32).max, np.uint32)
                for at in range(0, len(s), 4096):  # whole texts, in blocks that bound memory
                    h = s[at : at + 4096, None] * a[None, :] + b[None, :]
                    h ^= h >> np.uint64(29)
                    # either half of a hash is a sample of its own
                    least = np.minimum(least, h.view(np.uint32).min(axis=0))
                low = least[:k].astype(np.uint64)
                banded = np.zeros(bands, np.uint64)
                for r in range(rows):
                    banded = (banded ^ low[r::rows]) * np.uint64(0x9E3779B97F4A7C15)
                    banded ^= banded >> np.uint64(31)
                spot = ((low ^ salt) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)) % np.uint64(bits)
                parity = np.bincount(spot.astype(np.int64), minlength=bits) & 1
                sketch = np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)
                out.append((len(ws), s.view(np.int64), banded.view(np.int64), sketch))
            yield pd.DataFrame(out, columns=_SIGNED.names)

    return sign


def estimate(a: Column, b: Column, samples: int, words_in_sketch: int) -> Column:
    """Similarity from two odd sketches: 1 - size of the symmetric difference / (2 samples)."""
    bits = 64 * words_in_sketch
    odd = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    inside = F.greatest(F.lit(1e-9), 1 - 2 * odd / F.lit(bits))
    return 1 + F.lit(bits / 2) * F.log(inside) / F.lit(2 * samples)


def signed_classes(docs: DataFrame, ident: str, text: Column, shingle: int, least_words: int, stage: Stage, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(members: ident, cls; signed: cls, shingles, bands, sketch). Class: texts of the same words; cls its smallest ident.

    Texts of fewer than ``least_words`` words take no part. Nulls: a null ident takes no part, null text is empty.
    """
    plain = F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    rows_ = docs.where(F.col(ident).isNotNull()).select(F.col(ident).alias("ident"), plain.alias("plain")).where(F.size(F.split("plain", " ")) >= least_words)
    rows_ = rows_.withColumn("key", F.md5("plain"))
    heads = rows_.groupBy("key").agg(F.min("ident").alias("cls"), F.first("plain").alias("plain"))
    sign = _signer(shingle, least_words, bands, rows, SKETCH_WORDS)
    reps = stage.write(heads.select("key", "cls", sign("plain").alias("s")).select("key", "cls", "s.*"))
    members = stage.write(rows_.select("ident", "key").distinct().join(reps.select("key", "cls"), "key").select("ident", "cls"))
    return members, reps.where("size(shingles) > 0").drop("key", "n_words")


def similar_classes(signed: DataFrame, threshold: float, stage: Stage, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(cls_a, cls_b, similarity), cls_a < cls_b: classes whose shingle sets have a Jaccard similarity of threshold or more."""
    flat = signed.select("cls", F.posexplode("bands").alias("band", "key"))
    l, r = flat.select("band", "key", F.col("cls").alias("cls_a")), flat.select("band", "key", F.col("cls").alias("cls_b"))
    pairs = stage.write(l.join(r, ["band", "key"]).where("cls_a < cls_b").select("cls_a", "cls_b").distinct())
    side = lambda s, *cs: signed.select(F.col("cls").alias(f"cls_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in cs))
    guess = pairs.join(side("a", "sketch"), "cls_a").join(side("b", "sketch"), "cls_b")
    guess = guess.where(estimate(F.col("sketch_a"), F.col("sketch_b"), bands * rows, SKETCH_WORDS) >= threshold - SLACK).select("cls_a", "cls_b")
    both = guess.join(side("a", "shingles"), "cls_a").join(side("b", "shingles"), "cls_b")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    similarity = shared / (F.size("shingles_a") + F.size("shingles_b") - shared)
    return both.select("cls_a", "cls_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def report_text() -> Column:
    return F.concat(F.coalesce("technique", F.lit("")), F.lit(" "), F.coalesce("findings", F.lit("")))


def found(reports: DataFrame, threshold: float = 0.5, shingle: int = 3, least_words: int = 20) -> DataFrame:
    """(report_a, report_b), report_a < report_b: reports whose runs of three words overlap by half or more.

    Exact copies are given as pairs with the smallest report of their class, so a group of copies of any size gives
    rows in proportion to its members. Between different texts every member of one class is paired with the smallest report
    of the other, both ways: no link between different texts is lost. Null texts are empty; repeated rows count once.
    """
    stage = Stage(reports.sparkSession, "oddsketch")
    members, signed = signed_classes(reports, "report_id", report_text(), shingle, least_words, stage)
    linked = stage.write(similar_classes(signed, threshold, stage).select("cls_a", "cls_b"))
    every = linked.unionByName(linked.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b")))
    across = members.join(every, members["cls"] == every["cls_a"]).select(F.col("ident").alias("x"), F.col("cls_b").alias("y"))
    pairs = members.select(F.col("ident").alias("x"), F.col("cls").alias("y")).unionByName(across).where("x <> y")
    return pairs.select(F.least("x", "y").alias("report_a"), F.greatest("x", "y").alias("report_b")).distinct()


def grouped(reports: DataFrame, threshold: float = 0.8, shingle: int = 5, least_words: int = 20) -> DataFrame:
    """(report_id, group_id, n_links): a row per report of enough words; group of directly or indirectly similar reports, five
    words and 0.8 by default; n_links counts the different texts its text is similar to."""
    from .contraction import groups

    stage = Stage(reports.sparkSession, "oddgroups")
    members, signed = signed_classes(reports, "report_id", report_text(), shingle, least_words, stage)
    linked = stage.write(similar_classes(signed, threshold, stage).select("cls_a", "cls_b"))
    roots = groups(linked, "cls_a", "cls_b").withColumnRenamed("node", "cls")
    degree = linked.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    got = members.join(roots, "cls", "left").join(degree, "cls", "left")
    return got.select(F.col("ident").alias("report_id"), F.coalesce("group_id", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def standard_error(similarity: float, samples: int = BANDS * ROWS) -> float:
    """Of the MinHash part of the estimate."""
    return math.sqrt(similarity * (1 - similarity) / samples)
