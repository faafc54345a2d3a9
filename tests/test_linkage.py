import random

from pyspark.sql import functions as F

from radveil.operators import linkage as L
from radveil.operators.components import connected_components
from radveil.operators.skew import lookup

SCHEMA = "uid string, name_part string, n_tokens int, name_norm string, sex string, birth_year int, id_hash string"


def recs(spark, rows):
    return spark.createDataFrame([(u, n, k, norm, s, y, i) for u, n, k, norm, s, y, i in rows], SCHEMA)


def reasons(df):
    return {(r.a, r.b): r.reason for r in df.collect()}


def test_pass_one(spark):
    df = recs(spark, [("a", "n", 2, "x y", "M", 1970, "i"), ("b", "n", 2, "x y", "M", 1990, "i"), ("c", "n", 2, "x y", "M", None, None), ("d", "n", 2, "x y", "M", 1971, None), ("e", "n", 2, "x y", "M", 1972, None), ("f", "n", 2, "x y", "F", 1970, None), ("g", "m", 1, "z", "M", 1970, None), ("h", "m", 1, "z", "M", 1971, None), ("o", "", 0, "", "M", 1970, "q"), ("p", "", 0, "", "M", 1970, "q")])
    got = reasons(L.same_name_pairs(df.union(df)))
    assert got == {("a", "b"): "same_id_no", ("a", "c"): "same_name_missing_age", ("b", "c"): "same_name_missing_age", ("c", "d"): "same_name_missing_age", ("c", "e"): "same_name_missing_age", ("a", "d"): "same_name_near_age", ("d", "e"): "same_name_near_age", ("a", "e"): "same_name_birth_year_differs", ("g", "h"): "single_token_name"}
    assert reasons(L.same_id_pairs(df)) == {}


def test_merge_edges_have_the_closure_of_the_pairs(spark):
    rng = random.Random(4)
    rows = [(f"u{i:03d}", name, 1 if name == "m" else 2, "x", rng.choice("MF"), rng.choice([None, *range(1960, 1990)]), rng.choice([None, "i", "j", "k"])) for i in range(150) for name in [rng.choice("nom")]]
    df = recs(spark, rows)
    pairs = L.same_name_pairs(df).where("action = 'merge'").select("a", "b")
    one = {r.uid: r.root for r in L.clusters_of(df, pairs).collect()}
    two = {r.uid: r.root for r in L.clusters_of(df, L.merge_edges(df)).collect()}
    assert one == two


def test_review_pairs_of_one_name_without_the_merging_ones(spark):
    rng = random.Random(5)
    rows = [(f"u{i:03d}", rng.choice(["n", "m", None]), rng.choice([0, 1, 2]), "x", rng.choice(["M", "F", None]), rng.choice([None, *range(1960, 1970)]), rng.choice([None, "i", "j"])) for i in range(200)]
    df = recs(spark, rows + rows[:9])
    want = sorted(map(tuple, L.same_name_pairs(df).where("action = 'review'").select("a", "b", "reason").collect()))
    assert sorted(map(tuple, L.same_name_review(df).collect())) == want and want


def test_chain_is_one_cluster_and_decisions(spark):
    df = recs(spark, [(f"u{k}", "n", 2, "ab cd", "M", 1970 + k, None) for k in range(4)] + [("v1", "m", 1, "solo", "F", 1980, None), ("v2", "m", 1, "solo", "F", 1981, None), ("w1", "m", 1, "solo", "M", 1980, None), ("w2", "m", 1, "solo", "M", 1981, None)])
    review, base = L.review_queue(df)
    assert {r.uid: r.root for r in base.collect()}["u3"] == "u0"
    dec = spark.createDataFrame([("v1|v2", " Same "), ("u0|v1", "same"), (None, "same")], "pair_key string, decision string")
    final, pending = L.apply_decisions(df, review, base, L.normalised_decisions(dec))
    roots = {r.uid: r.root for r in final.collect()}
    assert roots["v2"] == "v1" and roots["u0"] == "u0" and roots["w2"] == "w2"
    assert {r.uid for r in pending.collect()} == {"w1", "w2"}


def test_similar_names_against_all_pairs(spark):
    from radveil.functions.similarity import jaro_winkler

    rng = random.Random(1)
    base = ["rahima begum", "karim uddin", "abdul karim", "salma khatun"]
    names = {("".join(c if rng.random() > 0.08 else rng.choice("aeiou") for c in rng.choice(base))) for _ in range(80)} | {"a", "ab"}
    rows = [(f"u{i}", f"p{i}", 2, n, "F", 1980, None) for i, n in enumerate(sorted(names))]
    got = {tuple(sorted((r.name_norm_a, r.name_norm_b))) for r in L.similar_names(recs(spark, rows)).collect()}
    want = {(a, b) for a in names for b in names if a < b and a[0] == b[0] and jaro_winkler(a, b) >= 0.92}
    assert got == want and want


def test_similar_names_meet_in_every_cell(spark, monkeypatch):
    from radveil.functions.similarity import jaro_winkler

    monkeypatch.setattr(L, "CELL", 90)
    rng = random.Random(2)
    swap = lambda n, k: n[:k] + n[k + 1 : k + 2] + n[k : k + 1] + n[k + 2 :]
    names = {swap(rng.choice(["rahima begum", "rahim uddin", "r\u0101hima", "r" * 70, "ra" * 33]), rng.randrange(12))[: rng.choice([3, 11, 12, 80])] for _ in range(300)}
    values = [(n, p) for n in names for p in ("p" + n, "q")]
    rows = [(f"u{i}", p, 2, n, sex, 1980, None) for i, (n, p) in enumerate(sorted(values)) for sex in ("F", "M", None)]
    got = [(r.sex, r.name_norm_a, r.name_part_a, r.name_norm_b, r.name_part_b, r.score) for r in L.similar_names(recs(spark, rows)).collect()]
    want = {(s, *a, *b, jaro_winkler(a[0], b[0])) for s in "FM" for a in values for b in values if a < b and a[1] != b[1] and a[0][0] == b[0][0] and jaro_winkler(a[0], b[0]) >= 0.92}
    assert len(got) == len(want) and set(got) == want


def test_similar_names_of_one_letter_are_not_compared_one_by_one():
    import time

    import numpy as np

    from radveil.functions import similarity as S

    rng = random.Random(6)
    part = lambda: "".join(rng.choice("bdgkmnrst") + rng.choice("aeiou") for _ in range(rng.choice([3, 4])))
    names = sorted({"b" + part() + " " + part() for _ in range(4000)})
    every = np.arange(len(names))
    began = time.process_time()
    S.similar_in(names, every, every, 0.92)
    mine = time.process_time() - began
    began = time.process_time()
    for a in names[:100]:
        for b in names[:1000]:
            S.may_reach(a, b, 0.92)
    plain = (time.process_time() - began) * len(names) ** 2 / 2 / 100_000
    assert mine < plain / 5


def test_components(spark):
    edges = [("c", "b"), ("b", "a"), ("x", "x"), (None, "a"), ("p", "q"), ("q", "p"), *((f"n{i:02d}", f"n{i + 1:02d}") for i in range(40))]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.root for r in connected_components(df, "a", "b").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "p": "p", "q": "p", **{f"n{i:02d}": "n00" for i in range(41)}}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_hot_lookup(spark, monkeypatch):
    from radveil.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.range(300).select(F.when(F.col("id") < 200, 1).when(F.col("id") < 205, None).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).where("k <> 299")
    for how in ("inner", "left"):
        assert sorted(map(str, lookup(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))


def test_research_ids(spark):
    clusters = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")], "uid string, root string")
    old = spark.createDataFrame([("a", "RP-B"), ("b", "RP-A"), ("d", "RP-A")], "uid string, research_patient_id string")
    ids, retired = L.assign_research_ids(clusters, old)
    got = {r.uid: r.research_patient_id for r in ids.collect()}
    assert got["a"] == got["b"] == got["d"] == "RP-A" and got["c"].startswith("RP-") and len(got["c"]) == 13
    assert [tuple(r) for r in retired.collect()] == [("RP-B", "RP-A")]
