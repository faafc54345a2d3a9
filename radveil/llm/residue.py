"""Template residue, filler, error pages and viewer notices in report sections.

Sections are cut into segments; a segment's shape is the segment without its label ('Comment: '), digits as 0. Fixed forms of
residue, which stand for a person who would look through the reports, give trusted labels to the distinct shapes of all reports. What
no form fits gets its label by likeness: near-duplicates of a labelled shape, found with SimHash tables partitioned by size and bit block, each
probed with the keys near its own, verified by Hamming distance and text similarity. Labels spread from trusted shapes through the
connected components until nothing new is reached. What made a shape residue must be found in its near-duplicate again: a template's
sentence with its blanks filled in is none. A section is hit if it holds a labelled shape.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Stage
from .sanitise import small_join

HAMMING = 3  # bits by which a table's key may differ
TABLES = 4  # of 16 bits
RADIUS = TABLES * (HAMMING + 1) - 1  # segments this near have a table in which their keys are HAMMING bits apart or less
SIMILARITY = 0.65  # Jaccard of character 3-grams: a template with another blank in it, as short as these are, shares no more
EVIDENCE = 0.5  # share of the grams that made a segment residue which its near-duplicate must hold
FIELDS = ("findings", "impression")
SPLIT = r"\n|\r|(?<=[.!])\s+|(?:(?<=[\])}>»])|(?<=\w \*{3}))\s+(?=\p{Lu})"  # lines, sentences, also where one begins behind a bracket or mark
LABEL = r"^[A-Za-z]{3,12}: +"

#: Placeholders of the earlier scrub, no template residue.
SCRUBBED = "CLINICIAN|NAME|PHONE|EMAIL|ID|ID_NUMBER|ADDRESS|PERSON|PERSON_NAME|DATE|NUMBER|LEFT|RIGHT|REDACTED"
#: Forms of residue. Case matters in CASED, not in the others.
CASED = [
    rf"\[(?!(?:{SCRUBBED})\])[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\]",
    r"%[A-Z][A-Z0-9_]{2,}%",
    r"\[object [A-Z]\w*\]",
    r"#(?:FIELD|REF|VALUE|NAME|N/A|NULL|NUM|DIV/0)[!?]?",
]
PLACEHOLDER = [
    r"\{\{[^{}\n]{0,60}\}\}",
    r"\$\{[^{}\n]{0,60}\}",
    r"\{[a-z_][a-z0-9_ ]{0,40}\}",
    r"<<[^<>\n]{1,60}>>",
    r"«\s*[a-z_][a-z0-9_]*\s*»",
    r"%%\w+%%|@@\w+@@|\$\$\w+\$\$|##\w+##",
    r"<(?:insert|enter|date|name|type|fill|patient|add|your|size|side|value)\b[^<>\n]{0,60}>",
    r"\[(?:insert|enter|type|fill|choose|select|size|side|date|value|location|number|organ|lobe|level|segment)\b[^\]\n]{0,60}\]",
    r"\[\s*\]|\[\s*_+\s*\]|\[\s*\.{2,}\s*\]",
    r"_{3,}|\?{3,}|\.{4,}",
    r"\*{2,}\s*(?:fill|insert|enter|complete|add|type)[^*\n]{0,60}\*{2,}",
]
WORDED = [
    r"\bx(?:x+|\.x+)\s*(?:ml|mm|cm|mg|mgy|hu|%)",
    r"\btbd\b",
    r"-{2,}\s*no template[^\n]{0,60}-{2,}|no template (?:assigned|selected|found)",
    r"\(?delete as (?:applicable|appropriate|needed)[^)\n]{0,80}\)?",
    r"\bselect one\s*:|\bchoose one\s*:",
    r"click (?:here )?to (?:enter|add|edit|insert) text|type [a-z_0-9]+ here|enter [a-z_0-9]+ here|insert [a-z_0-9]+ here",
    r"macro not found|could not load (?:auto ?text|template|macro)|autotext '",
    r"to be (?:dictated|filled in)|replace before (?:signing|use|sending)",
]
FILLER = [
    r"\blorem\b|\bipsum\b|\bfipsum\b|dolor sit",
    r"\b(blah|test|asdf|foo|bla)(?:[ ,.-]+\1\w*)+",
    r"\basdf\w*\b|\bqwert\w*\b",
    r"(?:sample|dummy|placeholder|filler|example) text\b|text goes here",
    r"\bx{3,}(?:\s+x{2,})+",
]
ERROR = [
    r"\bnullvalue\b",
    r"\berror \d{1,3}\b|\bhttp[ /]?\d|\bstatus(?: code)? \d{1,3}\b",
    r"</?(?:html|head|body|title|div|span|script|p|br|h\d)\b[^>\n]*>|<!doctype",
    r"bad gateway|gateway time(?:d )?-?out|internal server error|service (?:is )?(?:temporarily )?unavailable",
    r"\bserver (?:fault|error)\b|connection (?:reset|refused|timed out|lost)\b|request timed out",
    r"access denied\s*[:.]|you (?:are not allowed|do not have permission)|permission denied",
    r"(?:page|template|document|file|report)\b[^.\n]{0,40}\b(?:could not be found|was not found|not found|has been moved|has been removed)",
    r"did not (?:answer|respond)[^.\n]{0,20}retry|retry later|try again later",
    r"\btraceback \(|\bstack trace\b|unhandled exception|null ?pointer|\[error\b",
    r"^(?:undefined|null|nan|none|n/?a n/?a)\.?$",
]
NOTICE = [
    r"java ?script|enable (?:scripts?|scripting|cookies)|\bscripts? (?:is|are) (?:disabled|required|blocked|off)",
    r"(?:does|do) not (?:run|support|allow) scripts|\bneeds scripts\b|requires? scripts?\b",
    r"your browser\b|cookies (?:are|must)",
    r"session (?:has )?(?:ended|expired|timed out|is over)|(?:sign|log) ?in again|please (?:sign|log) ?in\b",
]
#: A form of PLACEHOLDER or CASED holds one of MARKS; one of WORDED, FILLER, ERROR or NOTICE one of STEMS in lower case, or is SHORT.
MARKS = r"[\[{$<«%@#_*]|\?{3}|\.{4}"
STEMS = ["tbd", "xx", "x.x", "no template", "delete as", "select one", "choose one", "click", " here", "macro not", "could not load", "autotext", "to be dictated", "to be filled", "replace before"]
STEMS += ["lorem", "ipsum", "dolor sit", "blah", "asdf", "qwert", " text", *(w + m for w in ("test", "foo", "bla") for m in " ,.-")]
STEMS += ["nullvalue", "error", "http", "status", "<", "gateway", "server", "unavailable", "connection", "timed out", "denied", "not allowed", "permission", "not found", "not be found", "been moved", "been removed"]
STEMS += ["retry", "try again", "traceback", "stack trace", "exception", "pointer", "script", "cookies", "browser", "session", "in again", "please sign", "please log"]
SHORT = 16
_CASED = "|".join(f"(?:{p})" for p in CASED)
_FORMS = "(?i)" + "|".join(f"(?:{p})" for p in PLACEHOLDER)
_WORDY = "(?i)" + "|".join(f"(?:{p})" for p in WORDED)
_PROSE = "(?i)" + "|".join(f"(?:{p})" for p in FILLER + ERROR + NOTICE)


def segments(reports: DataFrame) -> DataFrame:
    """(uid, field, shape) of the non-empty segments; repeated rows give repeated segments."""
    each = reports.select("uid", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS))).alias("s")).where("s.text is not null")
    cut = each.select("uid", "s.field", F.explode(F.split("s.text", SPLIT)).alias("segment"))
    return cut.select("uid", "field", shape_of(F.col("segment")).alias("shape")).where("shape <> ''")


def shape_of(segment: Column) -> Column:
    """The segment without blanks at its ends and without its label, digits as 0."""
    bare = F.regexp_replace(segment, r"(?U)^\s+|\s+$", "")
    bare = F.when(bare.contains(": "), F.regexp_replace(bare, LABEL, "")).otherwise(bare)
    return F.regexp_replace(bare, r"[0-9]+", "0")


def trusted(shape: Column) -> tuple[Column, Column]:
    """(is the segment residue by a fixed form, the segment with a line break for each form).

    The long alternations are tried only on segments that hold a mark or a stem without which none of them can match.
    """
    low = F.lower(shape)
    stems = F.length(shape) <= SHORT
    for stem in STEMS:
        stems = stems | low.contains(stem)
    residue = F.when(shape.rlike(MARKS), shape.rlike(_FORMS) | shape.rlike(_CASED)).otherwise(F.lit(False)) | F.when(stems, shape.rlike(_WORDY) | shape.rlike(_PROSE)).otherwise(F.lit(False))
    rest = shape
    for p in (_FORMS, _CASED, _WORDY, _PROSE):
        rest = F.regexp_replace(rest, p, "\n")
    return residue, rest


BLOCK = 1 << 18  # grams whose bits are summed at a time
LANE = 255  # grams whose bits a byte can count
LANES = np.uint64(0x0101010101010101)


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased text's character 3-grams, its ends marked by blanks."""
    a = np.frombuffer(f" {text.lower()} ".ljust(3).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = a[: len(a) - 2]
    for j in (1, 2):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + a[j : len(a) - 2 + j]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bit_counts(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How many of each text's hashes have each bit (texts by 64). Eight bits are counted at once, one in each byte of a word, over at
    most LANE hashes; hashes: those of all texts on end, sizes: how many each has, at least one."""
    starts = np.cumsum([0, *sizes])
    cuts = np.concatenate([np.arange(a, b, LANE) for a, b in zip(starts[:-1], starts[1:])])
    out = np.empty((len(cuts), 8, 8), np.uint8)
    for k in range(8):
        out[:, :, k] = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts).view(np.uint8).reshape(-1, 8)
    first = np.searchsorted(cuts, starts[:-1])
    return np.add.reduceat(out.reshape(-1, 64), first, axis=0, dtype=np.int64)


def simhashes(texts: list[str]) -> np.ndarray:
    """The SimHash of each text: a bit is set if more than half of the gram hashes have it."""
    out, group, size = [], [], 0

    def flush() -> None:
        if group:
            sizes = [*map(len, group)]
            total = bit_counts(np.concatenate(group), sizes)
            out.append(np.packbits(2 * total > np.array(sizes)[:, None], axis=1, bitorder="little").view(np.int64).ravel())
            group.clear()

    for text in texts:
        h = gram_hashes(text)
        if size + len(h) > BLOCK:
            flush()
            size = 0
        if len(h) > BLOCK:  # a very long text by itself, in blocks that bound memory
            total = sum(bit_counts(h[k : k + BLOCK], [len(h[k : k + BLOCK])])[0] for k in range(0, len(h), BLOCK))
            out.append(np.packbits(2 * total > len(h), bitorder="little").view(np.int64))
        else:
            group.append(h)
            size += len(h)
    flush()
    return np.concatenate(out) if out else np.empty(0, np.int64)


def gram_counts(texts: list[str]) -> list[int]:
    """How many different grams each text has."""
    return [len(np.unique(gram_hashes(t))) for t in texts]


_HASHED = T.StructType([T.StructField("h", T.LongType()), T.StructField("size", T.IntegerType())])


@F.pandas_udf(_HASHED)
def simhash(texts: pd.Series) -> pd.DataFrame:
    """SimHash and size class. Texts whose sets of grams have a similarity of SIMILARITY or more are in one class or in neighbouring ones."""
    each = texts.tolist()
    size = np.floor(np.log(np.array(gram_counts(each), float)) / -np.log(SIMILARITY) + 1e-9) if each else np.empty(0)
    return pd.DataFrame({"h": simhashes(each), "size": size.astype("int32")})


def grams(text: str) -> set[str]:
    t = f" {text.lower()} "
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))}


@F.pandas_udf(T.DoubleType())
def gram_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of the lower-cased texts' character 3-grams."""
    return pd.Series([len(x & y) / len(x | y) for x, y in ((grams(s), grams(t)) for s, t in zip(a, b))], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def evidence(shape: pd.Series, rest: pd.Series) -> pd.Series:
    """The grams of a segment that its rest doesn't hold."""
    return pd.Series([sorted(grams(s) - grams(r)) for s, r in zip(shape, rest)], dtype="object")


@F.pandas_udf(T.ArrayType(T.StringType()))
def carried(shape: pd.Series, labelled: pd.Series, why: pd.Series) -> pd.Series:
    """What a segment holds of the evidence of a labelled one, if it is similar to it and holds enough; else null."""

    def held(s: str, t: str, w: list[str]) -> list[str] | None:
        x, y = grams(s), grams(t)
        both = [g for g in w if g in x]
        return both if both and len(x & y) >= SIMILARITY * len(x | y) and len(both) >= EVIDENCE * len(w) else None

    return pd.Series([held(*x) for x in zip(shape, labelled, why)], dtype="object")


#: What a key is combined with to give all keys at most HAMMING bits from it.
FLIPS = [sum(1 << b for b in bits) for n in range(HAMMING + 1) for bits in combinations(range(16), n)]


def _keys(h: str) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("t"), F.shiftrightunsigned(F.col(h), 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("key")) for k in range(TABLES)))


def near_hashes(tables: DataFrame, front: DataFrame) -> DataFrame:
    """(h, g) of the hashes h in tables (size, t, key, h) that are at most RADIUS bits from a hash g of front (size, g) of a near size."""
    own = front.select("g", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    own = own.select("g", "size", F.explode(_keys("g")).alias("k")).select("g", "size", "k.t", "k.key")
    probe = own.select("g", "size", "t", "key", F.explode(F.array(*map(F.lit, FLIPS))).alias("flip")).select("g", "size", "t", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    # sorted on both sides: the probe is far larger than it is estimated, too large to be broadcast
    return tables.join(probe.hint("merge"), ["size", "t", "key"]).where(F.bit_count(F.col("h").bitwiseXOR(F.col("g"))) <= RADIUS).select("h", "g").distinct()


def trusted_shapes(segs: DataFrame, most: int | None = None) -> DataFrame:
    """(shape, why) of the residue that a form fits; why: the grams that made it residue. segs: (shape), with uid if only a sample of ``most``
    reports is to be labelled, by which one can see how far labels spread."""
    if most is not None:
        few = segs.select("uid").distinct().orderBy(F.xxhash64("uid"), "uid").limit(most)
        segs = segs.join(F.broadcast(few), "uid", "left_semi")
    is_residue, rest = trusted(F.col("shape"))
    return segs.select("shape").where(is_residue).distinct().select("shape", evidence("shape", rest).alias("why"))


def labelled_shapes(segs: DataFrame, stage: Stage, most: int | None = None) -> DataFrame:
    """(shape, hops) of residue: trusted shapes (0 hops) and what near-duplication connects with them. segs: (uid, shape); most: see trusted_shapes."""
    every = stage.write(segs.select("shape").distinct().select("shape", simhash("shape").alias("s")).select("shape", "s.*"))
    seeds = stage.write(trusted_shapes(every if most is None else segs, most).join(every, "shape"))
    labelled = stage.write(seeds.select("shape", F.lit(0).alias("hops")))
    tables = every.select("h", "size").distinct().select("h", "size", F.explode(_keys("h")).alias("k")).select("h", "size", "k.t", "k.key")
    front, hops = seeds.where("size(why) > 0"), 0
    while True:
        known = front.select(F.col("shape").alias("from"), F.col("h").alias("g"), F.col("size").alias("of"), "why")
        near = near_hashes(tables, known.select("g", F.col("of").alias("size")).distinct()).join(known, "g").join(every, "h").where(F.abs(F.col("size") - F.col("of")) <= 1)
        told = near.join(labelled, "shape", "left_anti").select("shape", "size", "h", carried("shape", "from", "why").alias("why")).where("why is not null")
        new = stage.write(told.groupBy("shape", "size", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("why")))).alias("why")))
        if new.isEmpty():
            return labelled
        hops += 1
        labelled, front = stage.write(labelled.unionByName(new.select("shape", F.lit(hops).alias("hops")))), new


def found(reports: DataFrame) -> DataFrame:
    """(uid, field) of the sections that are, or hold in places, residue. Null and empty sections are no hit; repeated rows count once."""
    stage = Stage(reports.sparkSession, "residue")
    # cut once: the shapes, the sample and the hits are all read from it
    segs = stage.write(segments(reports.where("uid is not null").select("uid", *FIELDS).distinct()))
    shapes = labelled_shapes(segs.select("uid", "shape"), stage)
    return small_join(segs, shapes, ["shape"], "left_semi").select("uid", "field").distinct()


def cleaned(reports: DataFrame) -> DataFrame:
    """uid and the sections without their residue segments, rest joined by blanks; null where nothing remains or was."""
    stage = Stage(reports.sparkSession, "cleaned")
    once = reports.select("uid", *FIELDS).where("uid is not null").distinct().withColumn("row", F.xxhash64(*FIELDS))
    each = once.select("uid", "row", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS))).alias("s")).where("s.text is not null")
    cut = each.select("uid", "row", "s.field", F.posexplode(F.split("s.text", SPLIT)).alias("pos", "segment")).withColumn("shape", shape_of(F.col("segment")))
    cut = stage.write(cut)
    shapes = labelled_shapes(cut.where("shape <> ''").select("uid", "shape"), stage)
    kept = small_join(cut.where("shape <> ''"), shapes.select("shape"), ["shape"], "left_anti")
    back = kept.groupBy("uid", "row", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "segment"))), lambda x: x["segment"]), " ").alias("text"))
    wide = back.groupBy("uid", "row").agg(*(F.first(F.when(F.col("field") == f, F.col("text")), ignorenulls=True).alias(f) for f in FIELDS))
    return once.select("uid", "row").join(wide, ["uid", "row"], "left").drop("row")
