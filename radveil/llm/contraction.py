"""Groups of pairwise matches by randomised graph contraction.

Each round every vertex hooks to that vertex of its closed neighbourhood which comes first in a fresh
hash order; edges are relabelled and deduplicated, and what remains is a smaller graph. The mappings
of all rounds are then expanded backwards, and every group gets its smallest record as its name.
Expected vertices fall by a constant factor a round. Each round is a written table: lost executors cost
no more than a stage.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_of, lookup
from ..session import Stage

MAX_ROUNDS = 100


def groups(links: DataFrame, a: str = "a", b: str = "b", seed: int = 7) -> DataFrame:
    """(node, group_id) of every node in a link; group_id is the smallest node linked directly or indirectly.

    Links with a null end count for nothing; self-links name their node only; repeated links and either direction are
    fine; no links give no rows. A vertex may hold any share of the links: the hook is aggregated before the shuffle and
    relabelling sends hot vertices through a bounded broadcast.
    """
    stage = Stage(links.sparkSession, "contraction")
    rng = random.Random(seed)
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    first = stage.write(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    edges, maps, previous = first.where("u <> v"), [], None
    for _ in range(MAX_ROUNDS):
        key = rng.getrandbits(62)
        order = lambda c, key=key: F.struct(F.xxhash64(F.lit(key), c).alias("h"), F.col(c).alias("w"))
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.min(order("v")).alias("m"), F.count("*").alias("n"))
        counted = stage.write(hooks.select("u", F.least(F.col("m"), order("u"))["w"].alias("to"), "n"))
        # the links of each vertex were counted with its hook, so both look-ups know the hot ones
        hook, hot = counted.drop("n"), hot_of(counted, ["u"], "n")
        one = lookup(edges, hook, ["u"], hot=hot).select(F.col("to").alias("x"), F.col("v").alias("u"))
        two = lookup(one, hook, ["u"], hot=hot).select("x", F.col("to").alias("y")).where("x <> y")
        rest = stage.write(two.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        maps.append(hook)
        stage.drop(previous)
        edges = previous = rest
        if rest.isEmpty():
            break
    else:
        raise RuntimeError("the graph did not contract")
    # expand backwards: the last mapping is final, each earlier one is looked up in what came after
    final = maps[-1]
    for hook in reversed(maps[:-1]):
        later = final.select(F.col("u").alias("to"), F.col("to").alias("root"))
        final = stage.write(lookup(hook, later, ["to"], "left").select("u", F.coalesce("root", "to").alias("to")))
    names = final.groupBy("to").agg(F.min("u").alias("group_id"))
    named = lookup(final, names, ["to"]).select(F.col("u").alias("node"), "group_id")
    nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(named, "node", "left").select("node", F.coalesce("group_id", "node").alias("group_id"))


def clean_id(c: Column) -> Column:
    """Trimmed of all white space and lower-cased; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), F.lit(""))


def review_pairs(review: DataFrame) -> DataFrame:
    """(a, b, same) of each review row. Where record_a or record_b is null or blank, both come from the halves of pair_key;
    rows that name no record give (null, null)."""
    half = lambda k: clean_id(F.get(F.split("pair_key", r"\|"), k))
    ra, rb = clean_id(F.col("record_a")), clean_id(F.col("record_b"))
    whole = ra.isNotNull() & rb.isNotNull()
    a = F.when(whole, ra).otherwise(F.coalesce(half(0), ra, rb))
    b = F.when(whole, rb).otherwise(F.coalesce(half(1), rb, ra))
    return review.select(a.alias("a"), b.alias("b"), F.coalesce(F.lower(F.regexp_replace("decision", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")) == "same", F.lit(False)).alias("same"))


def found(review: DataFrame) -> DataFrame:
    """(uid, group_id) of every record named in linkage_review; confirmed rows link, others only name."""
    pairs = review_pairs(review)
    named = pairs.select(F.explode(F.array("a", "b")).alias("uid")).where("uid is not null").distinct()
    linked = groups(pairs.where("same and a <> b"))
    return named.join(linked.withColumnRenamed("node", "uid"), "uid", "left").select("uid", F.coalesce("group_id", "uid").alias("group_id"))
