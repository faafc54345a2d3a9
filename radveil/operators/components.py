"""Connected components by alternating stars: every node ends at the smallest id it can reach.

Each round links all larger neighbours of a node, then all smaller ones, to the node's smallest
neighbour. Rounds grow with the logarithm of the component size; each is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stage
from .skew import hot_of, lookup


def _star(pairs: DataFrame, large: bool, stage: Stage) -> DataFrame:
    """pairs (a, b) with a > b; links to the smallest neighbour. Hot nodes are known from the aggregate that finds it."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stage.write(both.groupBy("u").agg(F.min("v").alias("__v"), F.count("*").alias("n")).select("u", F.least("u", "__v").alias("m"), "n"))
    met = lookup(both, least.drop("n"), ["u"], hot=hot_of(least, ["u"], "n"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in an edge; root is the smallest node reached.

    Edges with a null end and self-loops link nothing (a self-loop's node gets itself as root);
    repeated edges and either direction are fine; no edges give no rows.
    """
    stage = Stage(edges.sparkSession, "components")
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    first = stage.write(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    nodes = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct()
    now, print_ = first.where("a <> b"), None
    for _ in range(max_rounds):
        step = stage.write(_star(stage.write(_star(now, True, stage)), False, stage))
        mark = tuple(step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now is not first and hasattr(now, "_radveil_path"):
            stage.drop(now)
        now = step
        if mark == print_:
            break
        print_ = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
