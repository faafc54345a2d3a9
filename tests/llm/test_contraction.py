import random

import pytest

pytest.importorskip("radveil.llm")

from radveil.llm import contraction as C  # noqa: E402


def union_find(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(p)}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(300):03d}", f"v{rng.randrange(300):03d}") for _ in range(180)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(100)]
    df = spark.createDataFrame(edges + edges[:20], "a string, b string")
    got = {r.node: r.group_id for r in C.groups(df).collect()}
    assert got == union_find(edges)


def test_review_rows(spark):
    rows = [
        (None, " SAME ", "B ", " a"),
        ("a|c", "same", None, None),
        ("X|y", "different", None, None),
        ("c|d", "same?", "c", "d"),
        ("c|d", None, "c", "D"),
        (None, "same", None, None),
        ("q", "same", None, None),
        ("m|n", "same", "m", None),
        ("k|k", "same", "k", "K"),
        (None, "same", "", "z"),
    ]
    df = spark.createDataFrame(rows * 2, "pair_key string, decision string, record_a string, record_b string")
    got = {r.uid: r.group_id for r in C.found(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x", "y": "y", "q": "q", "m": "m", "n": "m", "k": "k", "z": "z"}
    assert C.found(df).count() == len(got)
    assert C.found(df.limit(0)).count() == 0


def test_hot_vertex_goes_through_the_bounded_broadcast(spark, monkeypatch):
    from radveil.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    edges = [("hub", f"h{i:03d}") for i in range(150)] + [("h001", "x"), ("y", "z")]
    got = {r.node: r.group_id for r in C.groups(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == union_find(edges)
