"""Record linkage: keyed passes, similar names, clusters, human decisions, research ids.

Records: uid, name_part, n_tokens, name_norm, sex, birth_year, id_hash, rec_index. Repeated rows count once.
"""

from __future__ import annotations

import secrets

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import SIMILAR_NAME
from ..functions.similarity import similar_in
from ..session import Stage
from .components import connected_components

COLUMNS = ["uid", "name_part", "n_tokens", "name_norm", "sex", "birth_year", "id_hash"]


def _sides(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    other = [c for c in df.columns if c not in keys]
    return tuple(df.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in other)) for s in "ab")


def same_name_pairs(recs: DataFrame) -> DataFrame:
    """Pass 1: pairs of equal keyed name and sex with action 'merge' or 'review' and the reason; nothing for far birth years."""
    named = recs.select(*COLUMNS).distinct().where("n_tokens > 0").drop("name_norm")
    a, b = _sides(named, ["name_part", "sex"])
    got = a.join(b, ["name_part", "sex"]).where("uid_a < uid_b").select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b"), _same_name_reason().alias("reason"))
    return got.where("reason is not null").withColumn("action", F.when(F.col("reason").isin(*MERGING), "merge").otherwise("review"))


MERGING = ("same_id_no", "same_name_near_age")


def _same_name_reason():
    gap = F.abs(F.col("birth_year_a") - F.col("birth_year_b"))
    return (
        F.when(F.col("id_hash_a") == F.col("id_hash_b"), "same_id_no")
        .when(gap.isNull(), "same_name_missing_age")
        .when((gap <= 1) & (F.col("n_tokens_a") >= 2), "same_name_near_age")
        .when(gap <= 1, "single_token_name")
        .when(gap == 2, "same_name_birth_year_differs")
    )


def same_name_review(recs: DataFrame) -> DataFrame:
    """The pairs of pass 1 with action 'review' (a, b, reason), without building those that merge.

    Records that agree in all that the reason depends on are one kind. Kinds are paired first, then the records of those under review: the
    many records of one name and number don't meet each other.
    """
    named = recs.select(*COLUMNS).distinct().where("n_tokens > 0 and name_part is not null and sex is not null").drop("name_norm")
    kinds = named.withColumn("kind", F.to_json(F.struct("name_part", "sex", "n_tokens", "birth_year", "id_hash")))
    a, b = _sides(kinds.drop("uid").distinct(), ["name_part", "sex"])
    pairs = a.join(b, ["name_part", "sex"]).select("kind_a", "kind_b", _same_name_reason().alias("reason")).where(F.col("reason").isNotNull() & ~F.col("reason").isin(*MERGING))
    side = lambda s: kinds.select(F.col("kind").alias(f"kind_{s}"), F.col("uid").alias(s))
    return pairs.join(side("a"), "kind_a").join(side("b"), "kind_b").where("a < b").select("a", "b", "reason")


def merge_edges(recs: DataFrame) -> DataFrame:
    """Edges with the same closure as the merging pairs of pass 1, but linear in the records.

    Records of one name, sex and number hang on their smallest uid; so do records of one name, sex and
    birth year; the smallest uids of neighbouring years are linked. No pairs within a group are built.
    """
    named = recs.select(*COLUMNS).distinct().where("n_tokens > 0")

    def stars(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        heads = df.groupBy(*keys).agg(F.min("uid").alias("b"))
        return df.join(heads, keys).select(F.col("uid").alias("a"), "b").where("a <> b"), heads

    by_id, _ = stars(named.where("id_hash is not null"), ["name_part", "sex", "id_hash"])
    by_year, heads = stars(named.where("n_tokens >= 2 and birth_year is not null"), ["name_part", "sex", "birth_year"])
    following = heads.select("name_part", "sex", (F.col("birth_year") - 1).alias("birth_year"), F.col("b").alias("a"))
    return by_id.unionByName(by_year).unionByName(following.join(heads, ["name_part", "sex", "birth_year"]).select("a", "b"))


def same_id_pairs(recs: DataFrame) -> DataFrame:
    """Pass 2: pairs of equal keyed number whose name or sex differs.

    The identities of a number are paired first, then their records: the many records of one person under a number with very
    many reports don't meet each other.
    """
    known = recs.select("uid", "name_part", "sex", "id_hash").distinct().where("id_hash is not null")
    named = lambda c: F.coalesce(F.col(c), F.lit("\0"))
    known = known.select("uid", "id_hash", F.concat_ws("\x1f", named("name_part"), named("sex")).alias("who"))
    a, b = _sides(known.select("id_hash", "who").distinct(), ["id_hash"])
    pairs = a.join(b, "id_hash").where("who_a < who_b")
    side = lambda s: known.select("id_hash", F.col("who").alias(f"who_{s}"), F.col("uid").alias(f"u_{s}"))
    got = pairs.join(side("a"), ["id_hash", "who_a"]).join(side("b"), ["id_hash", "who_b"]).where("u_a <> u_b")
    return got.select(F.least("u_a", "u_b").alias("a"), F.greatest("u_a", "u_b").alias("b"), F.lit("same_id_no_different_identity").alias("reason")).distinct()


#: Values of a block that one task compares with each other or with as many others.
CELL = 4000
SIMILAR = "sex string, name_part_a string, name_norm_a string, name_part_b string, name_norm_b string, score double"


def _similar_in_cell(cell: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one cell: of its values with each other, or of those of one part with those of the other."""
    cell = cell.sort_values(["name_norm", "name_part"], ignore_index=True)
    norm, part = cell["name_norm"].to_numpy(dtype=object), cell["name_part"].to_numpy(dtype=object)
    rows = np.flatnonzero(cell["part"] == cell["i"])
    others = rows if cell["i"].iloc[0] == cell["j"].iloc[0] else np.flatnonzero(cell["part"] == cell["j"])
    a, b, score = similar_in(list(norm), rows, others, SIMILAR_NAME)
    differ = part[a] != part[b]
    a, b = a[differ], b[differ]
    return pd.DataFrame({"sex": cell["sex"].iloc[0], "name_part_a": part[a], "name_norm_a": norm[a], "name_part_b": part[b], "name_norm_b": norm[b], "score": score[differ]})


def similar_names(recs: DataFrame) -> DataFrame:
    """Pairs of distinct name values (name_part, name_norm) of one sex and first letter at or over the threshold.

    Distinct values only are compared. The values of a block are dealt into parts of about CELL, and each pair of parts is a cell
    of its own, so that one hot letter isn't one task. In a cell all pairs are looked at, by the letters that they lack, as bits.
    """
    values = recs.select("sex", "name_part", "name_norm").where("name_norm <> '' and sex is not null and name_part is not null").distinct()
    values = Stage(recs.sparkSession, "names").write(values.withColumn("first", F.substring("name_norm", 1, 1)))
    sizes = values.groupBy("sex", "first").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    dealt = values.join(sizes, ["sex", "first"]).withColumn("part", F.pmod(F.xxhash64("name_norm", "name_part"), F.col("parts")).cast("int"))
    # part p meets each part k, itself too, in the cell of both
    cells = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "k"), "j": F.greatest("part", "k")})
    return cells.groupBy("sex", "first", "i", "j").applyInPandas(_similar_in_cell, SIMILAR)


def similar_pairs(recs: DataFrame, clusters: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Pass 3: records of similar names, same sex, birth years at most 2 apart or unknown, of different clusters, not yet in review."""
    rows = recs.select(*COLUMNS).distinct().join(clusters, "uid")
    names = similar_names(recs)
    side = lambda s: rows.select("sex", *(F.col(c).alias(f"{c}_{s}") for c in ("name_part", "name_norm", "uid", "birth_year", "root")))
    got = names.join(side("a"), ["sex", "name_part_a", "name_norm_a"]).join(side("b"), ["sex", "name_part_b", "name_norm_b"])
    gap = F.abs(F.col("birth_year_a") - F.col("birth_year_b"))
    got = got.where((gap.isNull() | (gap <= 2)) & (F.col("root_a") != F.col("root_b")))
    got = got.select(F.least("uid_a", "uid_b").alias("a"), F.greatest("uid_a", "uid_b").alias("b"), F.lit("similar_name").alias("reason")).distinct()
    return got.join(reviewed.select("a", "b"), ["a", "b"], "left_anti")


def clusters_of(recs: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, root) of every record; root is the smallest uid of the cluster."""
    comps = connected_components(edges, "a", "b").select(F.col("node").alias("uid"), "root")
    return recs.select("uid").distinct().join(comps, "uid", "left").select("uid", F.coalesce("root", "uid").alias("root"))


def review_queue(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(review pairs a, b, reason; clusters before decisions). Of several reasons the later pass's stands."""
    stage = Stage(recs.sparkSession, "linkage")
    base = stage.write(clusters_of(recs, merge_edges(recs)))
    # only the reviewable pairs of pass 1 are built; merges went through merge_edges
    first = same_name_review(recs)
    second = same_id_pairs(recs)
    two = stage.write(second.unionByName(first.join(second.select("a", "b"), ["a", "b"], "left_anti")))
    return stage.write(two.unionByName(similar_pairs(recs, base, two))), base


def normalised_decisions(review_rows: DataFrame) -> DataFrame:
    """(pair_key, decision) trimmed and lower-cased; rows without key count for nothing; of different answers the greatest stands."""
    clean = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    return review_rows.where("pair_key is not null").groupBy("pair_key").agg(F.max(clean).alias("decision"))


def pair_key(a, b):
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def apply_decisions(recs: DataFrame, review: DataFrame, base: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final clusters, pending uids). Only pairs under review are merged by a 'same'."""
    stage = Stage(recs.sparkSession, "decide")
    keyed = review.withColumn("pair_key", pair_key("a", "b")).join(decisions, "pair_key", "left")
    joined = base.select(F.col("uid").alias("a"), F.col("root").alias("b")).where("a <> b").unionByName(keyed.where("decision = 'same'").select("a", "b"))
    final = stage.write(clusters_of(recs, joined))
    root = lambda s: final.select(F.col("uid").alias(s), F.col("root").alias(f"root_{s}"))
    open_ = keyed.where("decision is null or decision not in ('same', 'different')").join(root("a"), "a").join(root("b"), "b").where("root_a <> root_b")
    return final, open_.select(F.explode(F.array("a", "b")).alias("uid")).distinct()


def review_rows(review: DataFrame, decisions: DataFrame, identity: DataFrame) -> DataFrame:
    """The 17 columns of the review file, in order of reason, then pair."""
    side = lambda s: identity.select(F.col("uid").alias(s), *(F.col(c).alias(f"{n}_{s}") for c, n in (("patient_name", "name"), ("sex", "sex"), ("age_raw", "age"), ("report_date", "date"), ("id_no", "id_no"), ("source", "file"))))
    got = review.withColumn("pair_key", pair_key("a", "b")).join(decisions, "pair_key", "left").join(side("a"), "a").join(side("b"), "b")
    two = lambda n: (f"{n}_a", f"{n}_b")
    return got.select("pair_key", "reason", F.coalesce("decision", F.lit("")).alias("decision"), F.col("a").alias("record_a"), F.col("b").alias("record_b"), *two("name"), *two("sex"), *two("age"), *two("date"), *two("id_no"), *two("file")).orderBy("reason", "pair_key")


@F.pandas_udf(T.StringType())
def _random_hex(rows: pd.Series) -> pd.Series:
    return pd.Series([secrets.token_hex(5).upper() for _ in rows])


def random_ids(df: DataFrame, prefix: str, column: str, taken: DataFrame | None = None) -> DataFrame:
    """Adds a random id per row, written before use; draws again while two are equal or one is taken."""
    stage = Stage(df.sparkSession, "ids")
    for _ in range(8):
        out = stage.write(df.withColumn(column, F.concat(F.lit(prefix + "-"), _random_hex(F.monotonically_increasing_id()))))
        clash = out.groupBy(column).count().where("count > 1").limit(1).count()
        if taken is not None:
            clash += out.join(taken.select(column), column, "left_semi").limit(1).count()
        if not clash:
            return out
    raise RuntimeError("no free ids")


def keyed_ids(df: DataFrame, prefix: str, column: str, source: str) -> DataFrame:
    """Adds ids that depend on ``source`` only: the injectable provider for tests and oracles."""
    return df.withColumn(column, F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(F.col(source), 256), 1, 10))))


def assign_research_ids(clusters: DataFrame, existing: DataFrame, provider=random_ids) -> tuple[DataFrame, DataFrame]:
    """((uid, research_patient_id), (retired, into)).

    A cluster keeps the smallest id one of its members had; its other ids retire. New clusters get a new id.
    ``existing``: (uid, research_patient_id); a cluster that splits leaves its id on all parts that held it.
    """
    prior = clusters.join(existing.withColumnRenamed("research_patient_id", "old"), "uid")
    kept = prior.groupBy("root").agg(F.min("old").alias("research_patient_id"))
    retired = prior.join(kept, "root").where(F.col("old") != F.col("research_patient_id")).select(F.col("old").alias("retired"), F.col("research_patient_id").alias("into")).distinct()
    new = clusters.select("root").distinct().join(kept, "root", "left_anti")
    fresh = provider(new, "RP", "research_patient_id", existing) if provider is random_ids else provider(new, "RP", "research_patient_id", "root")
    ids = kept.unionByName(fresh.select("root", "research_patient_id"))
    return clusters.join(ids, "root").select("uid", "research_patient_id"), retired
