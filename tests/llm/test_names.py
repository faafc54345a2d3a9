import random

import pytest

pytest.importorskip("radveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from radveil.llm import names as N  # noqa: E402
from radveil.session import Stage  # noqa: E402

P, L, K = "uid string, patient_name string, id_no string", "uid string, sex string, birth_year int", "nickname string, formal_name string"


def test_folding():
    same = [("Md. Sanahin Chirolori", "CHIROLORI, Sanahin"), ("BalamaGungongobun", "Balama Gungongobun"), ("Zalaleen-Trossoseno", "Zalalin Tr0ssoseno"), ("Mst Taretul Trossoseno Begum", "Jushu Trossoseno")]
    for a, b in same:
        assert sorted(N.parts_of(a, {"jushu": "Taretul"})) == sorted(N.parts_of(b, {"jushu": "Taretul"}))
    assert N.parts_of("Begum", {}) == ["bigum"] and N.parts_of("", {}) == [] and N.parts_of("12 -", {}) == []
    assert N.same_name("dilunul chiruluri", "chiruluri dilunl") and N.same_name("khivultalun turulik", "khiv turulik ultalun")
    assert not N.same_name("dilunul chiruluri", "ranizin chiruluri")


def brute_average_linkage(edges, least):
    sim = {}
    for a, b, s in edges:
        sim[a, b] = sim[b, a] = s
    clusters = [{x} for x in sorted({x for e in edges for x in e[:2]})]
    while True:
        best = None
        for i, x in enumerate(clusters):
            for y in clusters[i + 1 :]:
                v = sum(sim.get((p, q), 0) for p in x for q in y) / len(x) / len(y)
                key = (-v, min(min(x), min(y)), max(min(x), min(y)))
                if v >= least and (best is None or key < best[0]):
                    best = (key, x, y)
        if best is None:
            return {frozenset(c) for c in clusters}
        clusters = [c for c in clusters if c is not best[1] and c is not best[2]] + [best[1] | best[2]]


@pytest.mark.parametrize("seed", range(2))
def test_average_linkage(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(26)]
    edges = [(a, b, round(rng.uniform(0.3, 1), 6)) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if rng.random() < (0.8 if i // 5 == nodes.index(b) // 5 else 0.08)]
    got = N.average_linkage(spark.createDataFrame(edges, "a string, b string, sim double"), Stage(spark, "t")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == brute_average_linkage(edges, N.AVERAGE)


def test_cosine_join_finds_all_pairs(spark):
    rng = random.Random(7)
    syl = [c + v for c in "bdgklmnrst" for v in "aiu"]
    canon = sorted({" ".join(sorted(["".join(rng.choice(syl) for _ in range(3)), rng.choice(["trusinu", "chiruluri", "nazurigil"])])) for _ in range(120)})
    canon += sorted({c[:3] + rng.choice("ptk") + c[4:] for c in canon[:40]} - set(canon))
    v = spark.createDataFrame([(c, "F", 1980 + i % 2) for i, c in enumerate(canon)], "canon string, sex string, birth_year int")
    stage = Stage(spark, "t")
    weights = N.gram_weights(v.select("canon"))
    w = {r.canon: r.w for r in N.vectors(v.select("canon"), weights).collect()}
    part = spark.createDataFrame([(p,) for p in sorted({p for c in canon for p in c.split()})], "part string")
    pw = {r.part: {x.gram: x.w for x in r.g} for r in N.weighted(part, "part", weights).collect()}
    cos = lambda a, b, t: sum(x * t[b].get(g, 0) for g, x in t[a].items())
    two = lambda a, b: any(cos(p, q, pw) >= N.PART and cos(r, s, pw) >= N.PART for p, r in [a.split(), a.split()[::-1]] for q, s in [b.split()])
    common = {r.canon: frozenset(r.common) for r in N.common_parts(v.select("canon")).collect()}
    want = {(a, b) for a in canon for b in canon if a < b and cos(a, b, w) >= N.COSINE and two(a, b) and N.same_name(a, b, common[a] | common[b])}
    got = {(r.canon_a, r.canon_b) for r in N.similar_names(v, stage).collect()}
    assert want and want <= got and all(N.same_name(a, b, common[a] | common[b]) and cos(a, b, w) >= N.COSINE for a, b in got)


def test_found(spark):
    rows = [
        ("a1", "Md. Sanahin Chirolori", "X1"), ("a2", "SANAHIN  CHIROLORI", None), ("a3", "Chirolori, Sanaheen", "X2"), ("a4", "S. Chirolori", "X1"), ("a5", "md. sanahin   chirolori", "X1"),
        ("b1", "Ranizin Chirolori", "X1"), ("b2", "Jushu Trossoseno", None), ("b3", "Taretul Trossoseno", None), ("c1", "Sanahin Chirolori", None), ("c2", "Sanahin Chirolory", None), ("d1", None, "X1"), ("e1", "", None), ("f1", "Sanahin Chirolori", None), ("g1", "রেজিয়া তালমুন", None), ("h1", "x" * 5000, None),
    ]
    years = {"a1": 1980, "a2": 1981, "a3": 1980, "a4": 1980, "a5": 1980, "b1": 1980, "b2": 1990, "b3": 1991, "c1": 1960, "c2": None, "f1": 1980, "d1": 1980, "e1": 1980, "g1": 1980, "h1": 1980}
    recs = [(u, "F" if u == "f1" else "U" if u == "g1" else "M", y) for u, y in years.items()]
    p = spark.createDataFrame(rows * 2, P).withColumn("sex", F.lit("clash")).withColumn("birth_year", F.lit("clash")).withColumn("name", F.lit(1))
    l = spark.createDataFrame(recs * 2, L).withColumn("patient_name", F.lit(1)).withColumn("person", F.lit(1))
    k = spark.createDataFrame([("Jushu", "Taretul"), (None, "x")], K)
    got = {tuple(r) for r in N.found(p, l, k).collect()}
    group = ["a1", "a2", "a3", "a4", "a5"]
    want = {(x, y) for x in group for y in group if x < y} - {("a1", "a5")} | {("b2", "b3")}
    assert got == want and N.found(p, l, k).count() == len(want)
    assert N.found(p.limit(0), l, k).count() == N.found(p, l.limit(0), k).count() == 0
    assert N.found(p, l, k.limit(0)).count() == len(want) - 1


def test_successive_birth_years_are_not_parted(spark):
    names = ["Sanahin Chirolori", "Sanahin Chirolory", "Sanahim Chirolori"]
    people = [(f"{k}{y}", n, y) for y in [*range(1950, 1980), 1990] for k, n in enumerate(names)]
    p = spark.createDataFrame([(u, n, None) for u, n, _ in people], P)
    l = spark.createDataFrame([(u, "M", y) for u, _, y in people], L)
    k = spark.createDataFrame([], K)
    got = {tuple(r) for r in N.found(p, l, k).collect()}
    assert got == {(u, v) for u, n, y in people for v, m, z in people if u < v and n != m and abs(y - z) <= N.YEARS}
    assert {r.birth_year: r.person for r in N.people(p, l, k).where("person like '%|1990'").collect()}.keys() == {1990}


def plain_spells(x, y):
    from itertools import permutations

    return any(N.edits("".join(p), "".join(q)) <= 1 for p in permutations(x) for q in permutations(y))


def test_spelling_of_split_names_for_any_number_of_parts():
    import random

    rng = random.Random(6)
    for _ in range(600):
        x = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4))]
        text = list("".join(rng.sample(x, len(x))))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(text) + 1)
            text[k : k + rng.randrange(2)] = rng.choice([[], ["a"], ["b"]])
        cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(rng.randrange(3)))})
        y = [w for w in ("".join(text[a:b]) for a, b in zip(cuts, cuts[1:])) if w] or ["c"]
        assert N.spells(tuple(sorted(x)), tuple(sorted(y))) == plain_spells(x, y), (x, y)
    many = "ab cd ef gh ij kl mn op qr".split()
    assert N.spells(tuple(many), ("abcd", "efghij", "klmnxp", "qr")) and not N.spells(tuple(many), ("abcd", "efghij", "kxmnxp", "qr"))
    assert N.same_name("a" * 5 + " bbbb ccc ddd ee", "bbbbccc ddd aaaaa ee")


def test_similarity_is_that_of_the_least_similar_parts():
    assert N.name_similarity("rahima sultan", "rahima sultan") == 1.0
    assert N.name_similarity("rahima sultan", "rahmia sultan") < 1 and N.name_similarity("rahima sultan", "rahmia sultan") >= N.SIMILAR
    assert N.name_similarity("rahima sultan", "karina sultan") < N.name_similarity("rahima sultan", "rahimo sultan")
    assert N.name_similarity("rahima sultan", "dolores sultan") < N.SIMILAR
    assert N.name_similarity("rahi ma sultan", "rahima sultan") >= N.SIMILAR


def test_cosine_and_linkage_both_decide(spark, monkeypatch):
    """With either step switched off the result is another."""
    reports, records, nicknames = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("parse_report", "linkage_records", "nicknames"))
    rows = lambda: {tuple(r) for r in N.found(reports, records, nicknames).collect()}
    both = rows()
    monkeypatch.setattr(N, "SIMILAR", 0.8)
    assert rows() != both
    monkeypatch.undo()
    chain = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.6), ("c", "d", 0.6), ("d", "e", 0.9)], "a string, b string, sim double")
    from radveil.session import Stage

    linked = {r.node: r.cluster for r in N.average_linkage(chain, Stage(spark, "t")).collect()}
    assert linked["a"] == linked["b"] != linked["d"] == linked["e"]
    with pytest.raises(ValueError):
        monkeypatch.setattr(N, "NICKNAMES", 3)
        N.folded(reports.selectExpr("patient_name as name"), nicknames)


def test_join_leaves_out_no_pair(spark):
    """All pairs over both thresholds that pass the check of spelling, whatever a typo leaves of a part's grams or however parts are split."""
    rng = random.Random(3)
    syl = [c + v for c in "bdgklmnrst" for v in "aiu"]
    word = lambda n: "".join(rng.choice(syl) for _ in range(n))

    def typo(t):
        k = rng.randrange(len(t) - 1)
        return rng.choice([t[:k] + t[k + 1] + t[k] + t[k + 2 :], t[:k] + t[k + 1 :], t[:k] + "z" + t[k:], t[:k] + "z" + t[k + 1 :]])

    families = [word(4) for _ in range(3)]
    names = [[word(rng.choice([2, 3, 4, 15])), rng.choice(families), word(3)][: 1 + k % 3] for k in range(90)]
    for parts in [*names]:
        names += [[typo(p) for p in parts], [typo("".join(parts))], [typo(parts[0]), *parts[1:]], [parts[0][:3], parts[0][3:] or "ka", *parts[1:-1], typo(parts[-1])]]
    canon = sorted({" ".join(sorted(p)) for p in names} | {"hanisin nazurigil", "hnaisin nazurigil"})
    v = spark.createDataFrame([(c, "F", 1980 + 2 * (i % 2)) for i, c in enumerate(canon)], "canon string, sex string, birth_year int")
    w = {r.canon: r.w for r in N.vectors(v.select("canon"), N.gram_weights(v.select("canon"))).collect()}
    common = {r.canon: frozenset(r.common) for r in N.common_parts(v.select("canon")).collect()}
    over = lambda a, b: N.name_similarity(a, b) >= N.SIMILAR and sum(x * w[b].get(g, 0) for g, x in w[a].items()) >= N.COSINE
    want = {(a, b) for i, a in enumerate(canon) for b in canon[i + 1 :] if over(a, b) and N.same_name(a, b, common[a] | common[b])}
    sizes = {tuple(sorted(len(x.split()) for x in pair)) for pair in want}
    assert {(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3), (3, 4)} <= sizes and ("hanisin nazurigil", "hnaisin nazurigil") in want
    assert {(r.canon_a, r.canon_b) for r in N.similar_names(v, Stage(spark, "t")).collect()} == want


def test_cuts_of_near_parts_meet():
    rng = random.Random(4)
    for size in [*range(4, 40)] * 20:
        a = b = "".join(rng.choice("abcd") for _ in range(size))
        for _ in range(2):
            k = rng.randrange(len(b) - 1)
            b = rng.choice([b[:k] + b[k + 1] + b[k] + b[k + 2 :], b[:k] + b[k + 1 :], b[:k] + "x" + b[k:], b[:k] + "x" + b[k + 1 :]])
        if N.edits(a, b) <= 2:
            assert N.cuts(a, 2) & N.cuts(b, 2), (a, b)
    assert len(N.cuts("".join(map(chr, range(0x4E00, 0x4E00 + 5000))), 2)) < 130
