import pytest

pytest.importorskip("radveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from radveil.llm import leakage as L  # noqa: E402


def brute(docs, items, n=10):
    grams = lambda t: {tuple(w[k : k + n]) for w in [L.words(t)] for k in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, u in items if i and grams(t) & grams(u)}


def test_against_all_pairs(spark):
    item = " ".join(f"i{k}" for k in range(40))
    w = item.split()
    docs = [
        (1, "x y " + " ".join(w[5:15]) + " z"),
        (2, "x y " + " ".join(w[5:14]) + " z"),
        (3, "X—" + "-".join(w[20:33]).upper() + "!"),
        (4, " ".join(w[0:5] + ["gap"] + w[5:12])),
        (5, None),
        (6, ""),
        (7, "  "),
        (8, "pad " * 200_000 + " ".join(w[30:40])),
        (9, "short one two three four five six seven eight nine ten"),
        (10, "x y " + " ".join(w[5:15]) + " z"),
    ]
    items = [("A", item), ("A", item), ("B", "one two three four five six seven eight nine ten"), ("C", "too short"), ("D", None), (None, item), ("E", "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("item_text", F.lit(1))
    i = spark.createDataFrame(items, "item_id string, item_text string").withColumn("doc_id", F.lit(0)).withColumn("text", F.lit("clash"))
    want = brute(docs, items)
    assert {tuple(r) for r in L.found(d, i).collect()} == want and (9, "B") in want and (8, "A") in want and (2, "A") not in want
    assert L.found(d.union(d), i).count() == len(want)
    assert {tuple(r) for r in L.found(d, i, items_per_pass=1).collect()} == want
    assert L.found(d.limit(0), i).count() == L.found(d, i.limit(0)).count() == 0
    assert {r.item_id: r.n_docs for r in L.by_item(L.found(d, i)).collect()}["A"] == 4


def test_each_partition_asks_for_its_own_containment(monkeypatch):
    """A small item must share six of its eight shingles; in one partition with a long item, a single one would do."""
    import random

    rng = random.Random(3)
    small = [f"s{k}" for k in range(12)]
    items = [("small", " ".join(small)), ("long", " ".join(f"l{k}" for k in range(600)))]
    parted = L.ItemIndex(items, 10, 5)
    monkeypatch.setattr(L.ItemIndex, "size_class", staticmethod(lambda n: 0))
    whole = L.ItemIndex(items, 10, 5)
    assert len(parted.parts) == 2 and len(whole.parts) == 1

    def candidates(index, ws):
        h = L.Hasher()(ws)
        return index.candidates(L.np.unique(L.window_minima(h, 10, 5)), h)

    seen = 0
    for _ in range(300):
        k = rng.randrange(8)
        ws = [f"p{rng.random()}" for _ in range(5)] + small[k : k + 5] + [f"p{rng.random()}" for _ in range(5)]
        assert candidates(parted, ws) == []
        seen += len(candidates(whole, ws))
    assert seen
    for k in range(3):  # a leak is a candidate of both
        assert candidates(parted, ["x"] + small[k : k + 10]) == candidates(whole, ["x"] + small[k : k + 10]) == [0]
    assert candidates(parted, [f"l{k}" for k in range(300, 310)]) == [1]
    again = L.ItemIndex([("r", "a b c d e " * 6), ("r", "one two three")], 10, 5)
    assert again.search("x " + "a b c d e " * 2, L.Hasher()) == ["r"]


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    M = __import__("radveil.llm.mojibake", fromlist=["x"])
    assert M.repair_text("A" * 2_000_000 + " é") == ("A" * 2_000_000 + " é", False)
    assert time.time() - began < 20
