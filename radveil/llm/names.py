"""Variant spellings of typed names, linked into persons.

Names become folded parts (honorifics and added parts off, nicknames as their given names, sounds and look-alike
digits as one letter) and sparse vectors of weighted character 3-grams. A distributed join finds all pairs over the thresholds of
cosine and similarity that pass the check of spelling, within sex and nearby birth years; it is lossless, for it is blocked by what that check
needs. Distinct parts are compared first, by what is left of them without a letter or two; then names of as many parts meet on
two parts at a time, one as it stands and one as any spelling near it: either alone is common, both together are rare, so the join
grows with the matches, not with the square of the names. Names with parts split or run together meet on their letters in order, all or
all but one.

A name's family part weighs most in such a vector and is shared by many, so the similarity of two names is that of their
least similar parts: the least cosine of paired parts, in vectors of 2-grams, which a typo changes least. From SIMILAR on, a pair
that passes an exact check of spelling is an edge of an average-linkage clustering with this similarity, done by rounds of
reciprocal nearest neighbours, which merge what the sequential algorithm would merge. Names with an initial
join the one cluster that fits, or the one that shares their number.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Stage

COSINE = 0.3  # least cosine of two names in the join
NICKNAMES = 100_000  # rows; a larger table is an error, for it is sent to every executor
PART = 0.33  # cosine of parts up from which tests hold the join to all pairs; the join itself needs no such bound
SIMILAR = 0.55  # least similarity of two names, that of their least similar parts
AVERAGE = 0.35  # least average similarity at which clusters merge
COMMON, COMMON_LEAST = 4, 10  # a part that so many times as many names have as the name's other parts is a family name
YEARS = 2  # most years between birth years of one person
LONG = 24  # letters of a part up to which spellings two edits away are found by leaving out letters; beyond, by pieces
RARE_CAP = 1000  # a gram counts as no rarer than one name in so many, so that a typo's grams don't outweigh the name

#: Honorifics and added parts, which may be there or not.
PARTS_OFF = set(
    "md mohd mohammad mohammed muhammad mohamed mohamad mst most mosammat musammat mr mrs ms miss dr prof professor sheikh shaikh sk late alhaj haji hazi sri shri smt"
    " begum khatun khanam uddin miah mia bibi"
    .split()
)
#: Spellings of one sound or shape, applied in this order.
FOLDS = (("0", "o"), ("1", "l"), ("5", "s"), ("3", "e"), ("8", "b"), ("ee", "i"), ("oo", "u"), ("ou", "u"), ("ph", "f"), ("bh", "v"), ("ck", "k"), ("q", "k"), ("y", "i"), ("w", "v"), ("e", "i"), ("o", "u"))

_FOLDED = T.StructType([T.StructField("canon", T.StringType()), T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("initial", T.StringType()), T.StructField("rest", T.StringType())])


def fold(word: str) -> str:
    w = word.lower()
    for a, b in FOLDS:
        w = w.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", w)


def parts_of(name: str, nicknames: dict[str, str]) -> list[str]:
    """Folded parts of a name in written order; an initial is a part of one letter."""
    apart = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z][^\W\d_A-Z])", " ", name)
    words = [w for w in re.findall(r"[^\W_]+", apart) if not w.isdigit()]
    kept = [w for w in words if w.lower() not in PARTS_OFF] or words
    return [fold(nicknames.get(w.lower(), w)) for w in kept]


def folded(names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """Adds the struct 'f' to rows with 'name': canon (sorted parts), parts, initial and the other part if one part is an initial.

    The nicknames are a fixed table; of several formal names of one nickname the first in the alphabet counts.
    """
    few = nicknames.where("nickname is not null and formal_name is not null").groupBy(F.lower("nickname").alias("n")).agg(F.min("formal_name").alias("f")).limit(NICKNAMES + 1).collect()
    if len(few) > NICKNAMES:
        raise ValueError(f"more than {NICKNAMES} nicknames")
    known = {r.n: r.f for r in few}

    @F.pandas_udf(_FOLDED)
    def f(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            parts = parts_of(v, known) if v else []
            single, full = [p for p in parts if len(p) == 1], [p for p in parts if len(p) > 1]
            one = len(single) == 1 and len(full) >= 1
            rows.append((" ".join(sorted(full)), full, single[0] if one and len(full) == 1 else None, "".join(full) if one and len(full) == 1 else None))
        return pd.DataFrame(rows, columns=_FOLDED.names)

    return names.withColumn("f", f("name"))


def grams(canon: Column) -> Column:
    """Distinct 3-grams of each part with its edges marked."""
    return F.array_distinct(F.flatten(F.transform(F.split(canon, " "), lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p))), lambda i: F.substr(F.concat(F.lit("<"), p, F.lit(">")), i, F.lit(3))))))


def gram_weights(canons: DataFrame) -> DataFrame:
    """(gram, df, idf): distinct names that hold the gram, and the log of their inverse share."""
    n = canons.count()
    flat = canons.select(F.explode(grams(F.col("canon"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    return flat.withColumn("idf", F.log(1 + F.lit(float(n)) / F.greatest(F.col("df"), F.lit(n / RARE_CAP))))


def weighted(texts: DataFrame, column: str, weights: DataFrame) -> DataFrame:
    """(column, g: array of gram and weight, rarest first, length 1)."""
    each = texts.select(column, F.explode(grams(F.col(column))).alias("gram")).join(weights, "gram").groupBy(column).agg(F.array_sort(F.collect_list(F.struct("df", "gram", "idf"))).alias("g"))
    norm = F.sqrt(F.aggregate("g", F.lit(0.0), lambda s, x: s + x["idf"] * x["idf"]))
    return each.withColumn("norm", norm).select(column, F.transform("g", lambda x: F.struct(x["gram"].alias("gram"), (x["idf"] / F.col("norm")).alias("w"))).alias("g"))


def vectors(canons: DataFrame, weights: DataFrame) -> DataFrame:
    """(canon, w: map of gram to weight)."""
    return weighted(canons, "canon", weights).select("canon", F.map_from_entries("g").alias("w"))


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Edits with neighbouring letters swapped as one."""
    if a == b:
        return 0
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def allowed(n: int) -> int:
    """Edits that leave a part of n letters the same: short parts are dense, two edits often make another name of them."""
    return 0 if n < 4 else 1 if n < 9 else 2


def same_name(a: str, b: str, common: frozenset[str] = frozenset()) -> bool:
    """Do folded names match part by part in some order, or as a whole where parts were split or run together.

    ``common``: parts that very many names share (family names). These are sparse, so two edits leave them the same.
    """
    x, y = a.split(), b.split()

    def close(p: str, q: str) -> bool:
        n = min(len(p), len(q))
        return edits(p, q) <= (max(2, allowed(n)) if n >= 6 and (p in common or q in common) else allowed(n))

    if len(x) == len(y):
        free = list(y)
        for p in x:
            hit = min(free, key=lambda q: edits(p, q))
            if not close(p, hit):
                break
            free.remove(hit)
        else:
            return True
    if len(x) == len(y) <= 2:
        return False
    # parts split or run together: some order of one side's parts spells the other's
    return spells(tuple(sorted(x)), tuple(sorted(y)))


@lru_cache(maxsize=200_000)
def spells(x: tuple[str, ...], y: tuple[str, ...], left: str = "", right: str = "", budget: int = 1) -> bool:
    """Do the parts of x in some order, run together, spell those of y in some order, but for ``budget`` edits (swaps are one).

    left, right: letters of the parts taken so far that aren't matched yet. A part is only taken where the letters before it
    matched, so orders that can't be right are left at their first letters.
    """
    n = 0
    while n < min(len(left), len(right)) and left[n] == right[n]:
        n += 1
    left, right = left[n:], right[n:]
    if abs(len(left) + sum(map(len, x)) - len(right) - sum(map(len, y))) > budget:
        return False
    if left and right:
        if not budget:
            return False
        edited = [(left[1:], right[1:]), (left[1:], right), (left, right[1:])]
        if len(left) > 1 and left[:2] == right[1::-1]:
            edited.append((left[2:], right[2:]))
        if any(spells(x, y, a, b, budget - 1) for a, b in edited):
            return True
        # a swap may lie over the border of two parts
        if len(left) == 1 and x:
            return any(spells(_without(x, p), y, left + p, right, budget) for p in {*x})
        return bool(len(right) == 1 and y) and any(spells(x, _without(y, q), left, right + q, budget) for q in {*y})
    if not left and x:
        return any(spells(_without(x, p), y, p, right, budget) for p in {*x})
    if not right and y:
        return any(spells(x, _without(y, q), left, q, budget) for q in {*y})
    return len(left) + len(right) + sum(map(len, x + y)) <= budget


def _without(parts: tuple[str, ...], one: str) -> tuple[str, ...]:
    k = parts.index(one)
    return parts[:k] + parts[k + 1 :]


@lru_cache(maxsize=200_000)
def _vector(part: str, edges: bool = True) -> frozenset[str]:
    """The 2-grams of a part."""
    text = f"<{part}>" if edges else part
    return frozenset(text[i : i + 2] for i in range(max(1, len(text) - 1)))


def _cosine(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / (len(a) * len(b)) ** 0.5


def name_similarity(a: str, b: str) -> float:
    """The least cosine of the parts, each paired with its nearest; of names with different numbers of parts, which were split or run
    together, the cosine of all their letters."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return _cosine(*(frozenset().union(*(_vector(p, False) for p in ps)) for ps in (x, y)))
    return min(min(max(_cosine(_vector(p), _vector(q)) for q in there) for p in here) for here, there in ((x, y), (y, x)))


def similarity_from(least: float):
    """Column function: the similarity of names from ``least`` on that pass the check of spelling; else null."""

    def one(x: str, y: str, p, q) -> float | None:
        v = name_similarity(x, y)
        return v if v >= least and same_name(x, y, frozenset({*p, *q})) else None

    @F.pandas_udf(T.DoubleType())
    def f(a: pd.Series, b: pd.Series, common_a: pd.Series, common_b: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(a, b, common_a, common_b)], dtype="float64")

    return f


def common_parts(canons: DataFrame) -> DataFrame:
    """(canon, common): the part of a name that COMMON times as many distinct names have as any other of its parts, and at least COMMON_LEAST names."""
    each = canons.select("canon", F.explode(F.array_distinct(F.split("canon", " "))).alias("part"))
    often = each.groupBy("part").agg(F.count("*").alias("n"))
    ranked = each.join(often, "part").groupBy("canon").agg(F.sort_array(F.collect_list(F.struct("n", "part")), asc=False).alias("p"))
    first, second = F.get("p", 0), F.get("p", 1)
    is_common = (first["n"] >= COMMON_LEAST) & (first["n"] >= COMMON * F.coalesce(second["n"], F.lit(0)))
    return ranked.select("canon", F.when(is_common, F.array(first["part"])).otherwise(F.array().cast("array<string>")).alias("common"))


def cuts(part: str, n: int) -> set[str]:
    """Texts of which two parts at most n edits apart (swaps are one) share at least one.

    Of a short part what is left without up to n letters. A long one has too many of these; n edits touch at most 2n of its 2n + 1
    pieces, so one piece stands in the other part too, at most n letters off.
    """
    out: set[str] = set()
    if len(part) <= LONG + n:
        front = {part}
        out |= front
        for _ in range(n):
            front = {t[:i] + t[i + 1 :] for t in front for i in range(len(t))}
            out |= front
    if len(part) > LONG:
        m = 2 * n + 1
        for size in range(len(part) - n, len(part) + n + 1):
            for k in range(m):
                a, b = k * size // m, (k + 1) * size // m
                out |= {f"{size} {k} {part[a + d : b + d]}" for d in range(-n, n + 1) if a + d >= 0}
    return out


def cuts_of(n: int | None = None):
    """Column function: the cuts of a part for n edits, or as many as it is allowed."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def f(parts: pd.Series) -> pd.Series:
        return pd.Series([sorted(cuts(p, allowed(len(p)) if n is None else n)) for p in parts], dtype="object")

    return f


def alike(least: int):
    """Column function: are two parts at most as many edits apart as they are allowed, or ``least`` if that is more."""

    @F.pandas_udf(T.BooleanType())
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits(x, y) <= max(least, allowed(min(len(x), len(y)))) for x, y in zip(a, b)], dtype="bool")

    return f


def near_spellings(canons: DataFrame, common: DataFrame, stage: Stage) -> DataFrame:
    """(part, near): every two parts of names that same_name() may take for one another, and each with itself. common: of common_parts()."""
    parts = stage.write(padded(canons).select(F.explode("parts").alias("part")).distinct())
    keyed = lambda df, n: df.select("part", F.explode(cuts_of(n)("part")).alias("cut")).select("part", F.xxhash64("cut").alias("cut"))
    met = lambda a, b: a.join(b.withColumnRenamed("part", "near"), "cut").where("part <> near").select("part", "near").distinct()
    each = keyed(parts.where(F.length("part") >= 4), None)
    by_length = met(each, each).where(alike(0)("part", "near"))
    # beside a common part two edits are allowed from 6 letters on; from 9 on they are anyway
    between = F.length("part").between(6, 10)
    known = keyed(common.select(F.explode("common").alias("part")).distinct().where(between), 2)
    by_common = met(known, keyed(parts.where(between), 2)).where((F.least(F.length("part"), F.length("near")) >= 6) & alike(2)("part", "near"))
    both = by_common.unionByName(by_common.select(F.col("near").alias("part"), F.col("part").alias("near")))
    return stage.write(by_length.unionByName(both).unionByName(parts.select("part", F.col("part").alias("near"))).distinct())


def padded(canons: DataFrame) -> DataFrame:
    """(canon, k, parts): k parts; a name of one part gets an empty second one."""
    parts = F.split("canon", " ")
    return canons.select("canon", F.size(parts).alias("k"), F.when(F.size(parts) == 1, F.concat(parts, F.array(F.lit("")))).otherwise(parts).alias("parts"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _letters(canons: pd.Series) -> pd.Series:
    """The letters of names in order, all and all but one: names whose letters in any order are at most one edit apart share one."""

    def some(canon: str) -> list[str]:
        t = "".join(sorted(canon.replace(" ", "")))
        return [t, *sorted({t[:i] + t[i + 1 :] for i in range(len(t)) if not i or t[i] != t[i - 1]})]

    return pd.Series([some(c) for c in canons], dtype="object")


def join_keys(canons: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (canon, key): any two names that same_name() takes for one share a key, one of them in the first table, the other in the second.

    Of names with as many parts every part of one is near a part of the other: the two rarest parts of one name, the first in all spellings
    near it, meet two parts of the other, the second in all spellings near it. Names with parts split or run together, which
    aren't both of one or of two parts, have the same letters but for one edit.
    """
    names = padded(canons)
    key = lambda a, b: F.xxhash64("k", a, b).alias("key")
    near_to = lambda c: near.select(F.col("part").alias(c), F.col("near").alias(f"{c}_near"))
    each = names.select("canon", "k", F.explode("parts").alias("part"))
    often = each.groupBy("part").agg(F.count("*").alias("n"))
    rarest = each.join(often, "part").groupBy("canon", "k").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("p"))
    first = rarest.select("canon", "k", F.get("p", 0)["part"].alias("p"), F.get("p", 1)["part"].alias("q")).join(near_to("p"), "p").select("canon", key("p_near", "q"))
    ordered = F.flatten(F.transform("parts", lambda p, i: F.transform(F.filter("parts", lambda q, j: j != i), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    second = names.select("canon", "k", F.explode(ordered).alias("x")).select("canon", "k", "x.p", "x.q").join(near_to("q"), "q").select("canon", key("p", "q_near"))
    letters = names.select("canon", "k", F.explode(_letters("canon")).alias("t")).select("canon", "k", F.xxhash64(F.lit("="), "t").alias("key"))
    return tuple(a.unionByName(letters.where(which).select("canon", "key")).distinct() for a, which in ((first, "k <> 2"), (second, "k > 1")))


def similar_names(vertices: DataFrame, stage: Stage) -> DataFrame:
    """(canon_a, canon_b, sim), canon_a < canon_b, of all pairs with cosine COSINE or more that occur with one sex and near birth years,
    have a similarity of SIMILAR or more and pass the check of spelling; others have 0."""
    canons = stage.write(vertices.select("canon").distinct())
    weights = stage.write(gram_weights(canons))
    vec = stage.write(vectors(canons, weights))
    shared = stage.write(common_parts(canons))
    first, second = join_keys(canons, near_spellings(canons, shared, stage))
    spots = vertices.select("canon", "sex", "birth_year").distinct()
    # sex and year go into the key; names travel as hashes, for a false meeting is dropped by the cosine
    at = lambda df, year, h: df.select(F.xxhash64("key", "sex", year).alias("k"), F.xxhash64("canon").alias(h))
    near_years = F.explode(F.sequence(F.col("birth_year") - YEARS, F.col("birth_year") + YEARS))
    l = at(spots.select("canon", "sex", near_years.alias("year")).join(first, "canon"), "year", "x")
    r = at(spots.join(second, "canon"), "birth_year", "y")
    pairs = l.join(r, "k").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    side = lambda s, h: vec.select(F.xxhash64("canon").alias(h), F.col("canon").alias(f"c{s}"), F.col("w").alias(f"w{s}"))
    met = pairs.join(side("a", "x"), "x").join(side("b", "y"), "y")
    swap = F.col("ca") > F.col("cb")
    met = met.select(F.when(swap, F.col("cb")).otherwise(F.col("ca")).alias("canon_a"), F.when(swap, F.col("ca")).otherwise(F.col("cb")).alias("canon_b"), "wa", "wb")
    cosine = F.aggregate(F.map_entries("wa"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at("wb", e["key"]), F.lit(0.0)))
    near = met.select("canon_a", "canon_b", cosine.alias("cosine")).where(F.col("cosine") >= COSINE)
    for s in "ab":
        near = near.join(shared.select(F.col("canon").alias(f"canon_{s}"), F.col("common").alias(f"common_{s}")), f"canon_{s}")
    return stage.write(near.select("canon_a", "canon_b", similarity_from(SIMILAR)("canon_a", "canon_b", "common_a", "common_b").alias("sim")).where("sim is not null"))


def average_linkage(edges: DataFrame, stage: Stage, least: float = AVERAGE) -> DataFrame:
    """(node, cluster) by average linkage over edges (a, b, sim), a < b; pairs without an edge have similarity 0.

    Each round merges clusters that are each other's nearest (ties by id), until there are none; the nearest of all pairs always
    is one, so every round but the last merges. Sums of similarities and sizes give the averages
    of merged clusters exactly, so no cluster's members are ever gathered.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    member = stage.write(nodes.select("node", F.col("node").alias("cluster"), F.lit(1).cast("bigint").alias("one")))
    sizes = member.select("cluster", F.col("one").alias("size"))
    links = stage.write(edges.select("a", "b", F.col("sim").alias("total")))
    while True:
        s = lambda c: sizes.select(F.col("cluster").alias(c), F.col("size").alias(f"n_{c}"))
        avg = links.join(s("a"), "a").join(s("b"), "b").withColumn("avg", F.col("total") / (F.col("n_a") * F.col("n_b"))).where(F.col("avg") >= least - 1e-12)
        both = avg.select("a", "b", "avg").unionByName(avg.select(F.col("b").alias("a"), F.col("a").alias("b"), "avg"))
        best = both.groupBy("a").agg(F.min(F.struct((-F.col("avg")).alias("d"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("b"))).alias("m")).select("a", F.col("m.b").alias("b"))
        mutual = stage.write(best.alias("x").join(best.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.a < x.b").select(F.col("x.a").alias("keep"), F.col("x.b").alias("gone")))
        if mutual.isEmpty():
            return member.select("node", "cluster")
        old = (member, sizes, links, mutual)
        to = lambda df, c: df.join(mutual.select(F.col("gone").alias(c), "keep"), c, "left").withColumn(c, F.coalesce("keep", c)).drop("keep")
        member = stage.write(to(member, "cluster"))
        sizes = stage.write(to(sizes, "cluster").groupBy("cluster").agg(F.sum("size").alias("size")))
        moved = to(to(links, "a"), "b").where("a <> b")
        links = stage.write(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total").groupBy("a", "b").agg(F.sum("total").alias("total")))
        stage.drop(*old)


def people(reports: DataFrame, records: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(uid, name, birth_year, person) of the records that take part: non-null name, sex M or F, a birth year; person null if unknown.

    Spellings are clustered within a sex, whatever the year; person is a cluster in a run of birth years with no gap over YEARS, so
    records of one person may still have birth years too far apart. Repeated rows count once; a uid with several names or birth years stands once for each.
    """
    stage = Stage(reports.sparkSession, "names")
    known = records.where("uid is not null and sex in ('M', 'F') and birth_year is not null").select("uid", "sex", "birth_year").distinct()
    rows = reports.where("uid is not null and patient_name is not null").select("uid", F.col("patient_name").alias("name"), F.upper(F.regexp_replace("id_no", r"(?U)\s+", "")).alias("no")).distinct().join(known, "uid")
    values = folded(rows.select("name").distinct(), nicknames)
    rows = stage.write(rows.join(values.select("name", "f.canon", "f.initial", "f.rest"), "name"))
    full = rows.where("initial is null and canon <> ''")
    vertices = stage.write(full.select("canon", "sex", "birth_year").distinct())
    sims = similar_names(vertices, stage)
    a = vertices.select(F.col("canon").alias("canon_a"), "sex", F.col("birth_year").alias("y_a"))
    b = vertices.select(F.col("canon").alias("canon_b"), "sex", F.col("birth_year").alias("y_b"))
    other = sims.join(a, "canon_a").join(b, ["canon_b", "sex"]).where(F.abs(F.col("y_a") - F.col("y_b")) <= YEARS)
    ids = lambda c: F.concat_ws("|", c, "sex")
    edges = other.select(ids("canon_a").alias("x"), ids("canon_b").alias("y"), "sim").distinct().select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")
    clusters = average_linkage(stage.write(edges), stage)
    placed = stage.write(full.withColumn("node", ids("canon")).join(clusters, "node", "left").select("uid", "name", "birth_year", "no", "sex", "canon", F.coalesce("cluster", "node").alias("cluster")))
    # a cluster's birth years part only where more than YEARS lie between them
    by_year = W.partitionBy("cluster").orderBy("birth_year")
    runs = placed.select("cluster", "birth_year").distinct().withColumn("first", F.coalesce(F.col("birth_year") - F.lag("birth_year").over(by_year) > YEARS, F.lit(True)))
    runs = runs.select("cluster", "birth_year", F.concat_ws("|", "cluster", F.max(F.when(F.col("first"), F.col("birth_year"))).over(by_year).cast("string")).alias("person"))
    placed = placed.join(runs, ["cluster", "birth_year"]).select("uid", "name", "birth_year", "no", "sex", "canon", "person")
    placed = stage.write(placed)
    short = with_initials(rows.where("initial is not null"), placed)
    return placed.select("uid", "name", "birth_year", "person").unionByName(short)


@F.pandas_udf(T.IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(x, y) for x, y in zip(a, b)], dtype="int32")


def near_parts(typed: DataFrame, known: DataFrame) -> DataFrame:
    """(typed, rest) of parts at most one edit apart: such parts share themselves or themselves with a letter left out."""
    cuts = lambda c: F.array_union(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1))))
    a, b = (df.where(F.length(c) > 0).select(c, F.explode(F.array_distinct(cuts(c))).alias("cut")) for df, c in ((typed, "typed"), (known, "rest")))
    return a.join(b, "cut").select("typed", "rest").distinct().where((_edits("typed", "rest") <= 1) & ((F.length("typed") > 3) | (F.col("typed") == F.col("rest"))))


def with_initials(short: DataFrame, placed: DataFrame) -> DataFrame:
    """(uid, name, birth_year, person) of names with an initial.

    Persons fit whose other part is the same but for one edit, whose remaining part starts with the initial, of one sex and near birth years. The
    person must share the record's number, or be the only one that fits; else it is null.
    """
    spots = placed.select("person", "sex", "birth_year", "canon").distinct()
    part = F.transform(F.split("canon", " "), lambda p, i: F.struct(p.alias("rest"), F.filter(F.split("canon", " "), lambda q, j: j != i).alias("others")))
    fits = spots.select("person", "sex", F.col("birth_year").alias("y"), F.explode(part).alias("p")).select("person", "sex", "y", "p.rest", F.explode("p.others").alias("o")).select("person", "sex", "y", "rest", F.substring("o", 1, 1).alias("initial")).distinct()
    mine = short.select("uid", "name", "sex", "birth_year", "no", "initial", F.col("rest").alias("typed")).distinct()
    near = near_parts(mine.select("typed").distinct(), fits.select("rest").distinct())
    met = mine.join(near, "typed").join(fits, ["sex", "rest", "initial"]).where(F.abs(F.col("birth_year") - F.col("y")) <= YEARS)
    held = placed.where("no is not null and no <> ''").select("person", "no").distinct().withColumn("shared", F.lit(True))
    per = met.select("uid", "name", "birth_year", "no", "person").distinct().join(held, ["person", "no"], "left")
    pick = per.groupBy("uid", "name", "birth_year").agg(F.count("*").alias("n"), F.min("person").alias("only"), F.count("shared").alias("n_shared"), F.min(F.when(F.col("shared"), F.col("person"))).alias("by_no"))
    chosen = F.when(F.col("n_shared") == 1, F.col("by_no")).when((F.col("n_shared") == 0) & (F.col("n") == 1), F.col("only"))
    return mine.select("uid", "name", "birth_year").distinct().join(pick.select("uid", "name", "birth_year", chosen.alias("person")), ["uid", "name", "birth_year"], "left")


def found(reports: DataFrame, records: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(uid_a, uid_b), uid_a < uid_b: records of one person whose names differ in more than letter case and runs of blanks.

    Every pair of records is a row, as the result is defined; rows grow with the product of a person's spellings.
    Null names, unknown sexes and missing birth years take no part; empty tables give no rows.
    """
    plain = F.lower(F.trim(F.regexp_replace("name", r"(?U)\s+", " ")))
    rows = Stage(reports.sparkSession, "pairs").write(people(reports, records, nicknames).where("person is not null").select("uid", "birth_year", "person", plain.alias("plain")).distinct())
    # spellings of a person first, so that records of one spelling don't meet each other
    spelt = rows.select("person", "plain", "birth_year").distinct()
    l, r = (spelt.select("person", F.col("plain").alias(f"plain_{s}"), F.col("birth_year").alias(f"y_{s}")) for s in "ab")
    pairs = l.join(r, "person").where((F.col("plain_a") < F.col("plain_b")) & (F.abs(F.col("y_a") - F.col("y_b")) <= YEARS))
    side = lambda s: rows.select("person", F.col("plain").alias(f"plain_{s}"), F.col("birth_year").alias(f"y_{s}"), F.col("uid").alias(f"u_{s}"))
    got = pairs.join(side("a"), ["person", "plain_a", "y_a"]).join(side("b"), ["person", "plain_b", "y_b"]).where("u_a <> u_b")
    return got.select(F.least("u_a", "u_b").alias("uid_a"), F.greatest("u_a", "u_b").alias("uid_b")).distinct()
