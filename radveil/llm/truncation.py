"""Texts cut by field limits or transfers.

First test, lengths: per source and unit (characters, bytes) the discrete hazard of ending at a length is the number of texts
of that length over those at least as long, both by window functions. It is tested against the hazard of the
neighbouring lengths; Benjamini-Hochberg controls the false discoveries over all tests. Copies of a text count once.

Second test, endings: a transfer that broke off has no typical length, so no hazard shows it. How sentences with a given
start end in this corpus is counted over all distinct texts, for the copies of a cut
text would make its ending look usual. A text whose last piece
has no terminator is incomplete if pieces with such a start mostly have one. At significant lengths weaker evidence is
enough; elsewhere the start must be known as that of a terminated sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, lookup
from ..session import Stage

NEIGHBOURS = 50  # lengths on either side
FALSE_DISCOVERY = 0.01
LEAST_EXPECTED = 0.05  # texts; keeps the test defined where neighbours are empty
SEEN = 3  # other pieces with the same start that count as knowledge
STRONG, WEAK = 0.5, 0.2  # share of terminated pieces with that start
FORMULA = 0.05  # share of the pieces with that start which are this very piece without a terminator
SHORT = 4  # tokens up to which a whole piece is counted, so that a closing formula without its full stop is known

MARK = r"(?U)(?:\s*(?:\[(?:more|cut|truncated|cont(?:inued|\.)?|\.\.\.|…)\]|\((?:more|cut|truncated|cont(?:inued|\.|d)?)\)|…|\.{3,}|>{2,}))+$|(?<=[\p{L}\p{M}\p{N}])[-‐]$"
TERMINATED = r"[.!?।。]['\"”’»)\]]*$"
BRACKETED = r"(?s)^(?:\(.*\)|\[.*\]|“.*”|\".*\"|«.*»|\*{3}.*\*{3})$"
UNCLOSED = r"^(?:\([^)]*|\[[^\]]*|“[^”]*|«[^»]*)$"
SENTENCES = r"(?<=[.!?।。])\s+"
PIECES = r"\n|\r|" + SENTENCES
TAIL = 64  # characters that are searched for marks first
LONGEST_MARK = 24  # characters; where no more than that is left of the tail the marks may begin before it, and the whole text is searched
PREFIX = 24  # letters of a start by which longer ones are joined; then they are compared in full
#: White space.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def lengths(docs: DataFrame) -> DataFrame:
    """(source, unit, n): lengths of the distinct non-empty texts of each source in characters and bytes."""
    each = docs.where("text is not null and length(text) > 0").select("source", F.xxhash64("text").alias("h"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).distinct()
    return each.select("source", F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("n")) for u in ("chars", "bytes")))).alias("x")).select("source", "x.unit", "x.n")


def hazards(docs: DataFrame) -> DataFrame:
    """(source, unit, n, ends, at_risk, expected, p): p bounds the chance of so many ends at this length if its hazard were its neighbours'.

    A null source is a source of its own. Windows run over distinct lengths, counted before any row moves.
    """
    counted = lengths(docs).groupBy(F.coalesce("source", F.lit("")).alias("source"), "unit", "n").agg(F.count("*").alias("ends"))
    per = W.partitionBy("source", "unit").orderBy("n")
    near = per.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    risk = counted.withColumn("at_risk", F.sum("ends").over(W.partitionBy("source", "unit").orderBy(F.col("n").desc())))
    around = risk.withColumns({"__e": F.sum("ends").over(near) - F.col("ends"), "__r": F.avg("at_risk").over(near)})
    expected = F.greatest(F.lit(LEAST_EXPECTED), F.col("__e") / (2 * NEIGHBOURS) * F.col("at_risk") / F.col("__r"))
    # Chernoff's bound of the upper Poisson tail
    tail = F.when(F.col("ends") > F.col("expected"), F.exp(-(F.col("ends") * F.log(F.col("ends") / F.col("expected")) - F.col("ends") + F.col("expected")))).otherwise(F.lit(1.0))
    return around.withColumn("expected", expected).withColumn("p", tail).drop("__e", "__r")


def significant(haz: DataFrame, q: float = FALSE_DISCOVERY) -> DataFrame:
    """The lengths whose hazard stands out, Benjamini-Hochberg at q over all tests.

    Its limit is the largest p that is at most q times the share of p-values up to it. Counted without a ranking: from q
    downwards the limit is set to q times the share of the p-values within it, until none falls out any more.
    """
    haz = Stage(haz.sparkSession, "hazards").write(haz)
    tests, within = haz.agg(F.count("*"), F.count_if(F.col("p") <= q)).first()
    limit = q
    while within:
        limit = q * within / tests
        still = haz.where(F.col("p") <= limit).count()
        if still == within:
            break
        within = still
    return haz.where((F.col("p") <= limit) & F.lit(within > 0))


def _key(token: Column) -> Column:
    return F.regexp_replace(token, "[0-9০-৯]+", "0")


def _starts(piece: Column) -> Column:
    """First token, first two tokens (null for one token), all of a short piece without its terminator (else null); digits as 0."""
    # no more tokens than needed are cut off; what remains stays in one
    tokens = F.filter(F.split(piece, r"\s+", SHORT + 2), lambda t: t != "")
    one, two = _key(F.get(tokens, 0)), _key(F.get(tokens, 1))
    whole = F.when(F.size(tokens) <= SHORT, F.regexp_replace(F.array_join(F.transform(tokens, _key), " "), TERMINATED, ""))
    return F.struct(one.alias("one"), F.when(two.isNotNull(), F.concat(one, F.lit(" "), two)).alias("two"), whole.alias("whole"), F.size(tokens).alias("tokens"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a filter on them isn't pushed below them, which would compute them again."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__once")
    return df.select("*", made).select(*(F.col(c) for c in df.columns), *(F.col(f"__once.{n}").alias(n) for n in columns))


def pieces(docs: DataFrame) -> DataFrame:
    """doc_id, source, bare (text without white space and cut marks at its end), last piece, whether it has a line of its own, how it starts and whether it ended.

    Marks stand at the end, so patterns see the last TAIL characters first; where these are little but marks, more may stand before
    them, and the pattern sees the whole text. Dots of any number are taken off before.
    """
    end = lambda c: F.rtrim(c, F.lit(SPACE))
    whole = once(docs.where("text is not null").select("doc_id", "source", "text"), bare=end(F.col("text")))
    whole = whole.withColumn("bare", F.when(F.col("bare").endswith("..."), end(F.rtrim("bare", F.lit(".")))).otherwise(F.col("bare")))
    size = F.greatest(F.lit(0), F.length("bare") - TAIL)
    tail = F.regexp_replace(F.right("bare", F.lit(TAIL)), MARK, "")
    marked = F.when((size > 0) & (F.length(end(tail)) < LONGEST_MARK), F.regexp_replace("bare", MARK, "")).otherwise(F.concat(F.substr(F.col("bare"), F.lit(1), size), tail))
    whole = once(whole, marked=end(marked)).drop("bare").withColumnRenamed("marked", "bare").where("bare <> ''")
    whole = once(whole, line=F.trim(F.substring_index(F.translate("bare", "\r", "\n"), "\n", -1)))
    whole = once(whole, last=F.trim(F.element_at(F.split("line", SENTENCES), -1)))
    ended = F.right("last", F.lit(8)).rlike(TERMINATED) | F.col("last").rlike(BRACKETED)
    return once(whole, ended=ended).select("doc_id", "source", "text", "bare", "last", (F.col("line") == F.col("last")).alias("own_line"), "ended", _starts(F.col("last")).alias("starts"))


def start_statistics(docs: DataFrame) -> DataFrame:
    """(level, key, n, terminated) over all pieces of all distinct texts: level 1 by the first token, 2 by two, 3 by all of a short piece. Counted map-side first."""
    each = pieces(docs).select("bare").distinct().select(F.explode(F.split("bare", PIECES)).alias("piece"))
    known = each.where("trim(piece) <> ''").select(_starts(F.trim("piece")).alias("s"), F.right(F.rtrim("piece"), F.lit(8)).rlike(TERMINATED).cast("int").alias("t"))
    rows = known.select(F.explode(F.array(F.struct(F.lit(1).alias("level"), F.col("s.one").alias("key")), F.struct(F.lit(2).alias("level"), F.col("s.two").alias("key")), F.struct(F.lit(3).alias("level"), F.col("s.whole").alias("key")))).alias("x"), "t")
    return rows.where("x.key is not null").groupBy("x.level", "x.key").agg(F.count("*").alias("n"), F.sum("t").alias("terminated"))


def beginnings(stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """(one, n0, t0): a single token may itself be cut; what pieces do whose first token begins with it. Short tokens meet the
    prefixes of up to PREFIX letters, longer ones the tokens that share so many letters with them and begin with them."""
    firsts = stats.where("level = 1").select("key", "n", "terminated")
    each = firsts.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("key"), F.lit(PREFIX))), lambda k: F.substr(F.col("key"), F.lit(1), k))).alias("one"), "n", "terminated")
    short = each.groupBy("one").agg(F.sum("n").alias("n0"), F.sum("terminated").alias("t0")).join(wanted.where(F.length("one") <= PREFIX), "one", "left_semi")
    head = lambda c: F.substring(c, 1, PREFIX)
    long = wanted.where(F.length("one") > PREFIX).withColumn("head", head("one")).join(firsts.where(F.length("key") > PREFIX).withColumn("head", head("key")), "head").where(F.col("key").startswith(F.col("one")))
    return short.unionByName(long.groupBy("one").agg(F.sum("n").alias("n0"), F.sum("terminated").alias("t0")))


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, source, at_limit, share): the cut texts, whether at a significant length, and the share of terminated pieces with the same start.

    Null, empty and blank texts are never cut, nor are texts whose last piece is terminated or bracketed. Every document is
    looked at in full; doc_id is unique.
    """
    stage = Stage(docs.sparkSession, "truncation")
    stats = stage.write(start_statistics(docs))
    limits = stage.write(significant(hazards(docs)).select("source", "unit", "n"))
    open_ = stage.write(pieces(docs).where("not ended").select("doc_id", "source", F.coalesce("source", F.lit("")).alias("from"), F.col("starts.one").alias("one"), F.col("starts.two").alias("two"), F.col("starts.whole").alias("whole"), F.col("starts.tokens").alias("tokens"), "own_line", F.col("last").rlike(UNCLOSED).alias("unclosed"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")))
    level = lambda k, name: stats.where(F.col("level") == k).select(F.col("key").alias(name), F.col("n").alias(f"n{k}"), F.col("terminated").alias(f"t{k}"))
    rows = open_.count()
    hot = {c: hot_keys(open_.where(F.col(c).isNotNull()), [c], rows) for c in ("one", "two", "whole")}
    got = open_
    for k, name in ((2, "two"), (1, "one"), (3, "whole")):
        got = lookup(got, level(k, name), [name], "left", hot[name])
    got = lookup(got, beginnings(stats, open_.where("tokens < 2").select("one").distinct()), ["one"], "left", hot["one"])

    def share(k: int) -> Column:
        """Without the piece itself."""
        return F.when(F.col(f"n{k}") - 1 >= SEEN, F.col(f"t{k}") / (F.col(f"n{k}") - 1))

    # the last token may be cut itself: then the piece is also judged by its start without it
    several = F.col("tokens") >= 2
    by_start = F.when(F.col("tokens") >= 3, F.coalesce(share(2), share(1))).when(several, F.greatest(share(2), share(1))).otherwise(F.greatest(share(1), share(0)))
    got = got.withColumn("share", F.when(F.col("unclosed"), F.lit(1.0)).otherwise(by_start))
    # a short piece on a line of its own is a formula if it also stands with a terminator, or without one often enough among its like
    bare = F.col("n3") - F.col("t3") - 1
    formula = (F.col("t3") >= SEEN) | ((bare >= SEEN) & (bare >= FORMULA * F.when(several, F.col("n2")).otherwise(F.col("n1"))))
    got = got.withColumn("formula", F.col("own_line") & F.coalesce(formula, F.lit(False)))
    for unit in ("chars", "bytes"):
        at = limits.where(F.col("unit") == unit).select(F.col("source").alias("from"), F.col("n").alias(unit), F.lit(True).alias(f"at_{unit}"))
        got = lookup(got, at, ["from", unit], "left", hot_keys(open_, ["from", unit], rows))
    got = got.withColumn("at_limit", F.coalesce("at_chars", "at_bytes", F.lit(False)))
    cut = F.when(F.col("at_limit"), F.coalesce(F.col("share") >= WEAK, F.lit(True))).otherwise(F.coalesce(F.col("share") >= STRONG, F.lit(False))) & ~F.col("formula")
    return got.where(cut).select("doc_id", "source", "at_limit", "share")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id) of the cut texts."""
    return flagged(docs).select("doc_id").distinct()


def rates(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, rate) over the non-empty texts of each source."""
    cut = flagged(docs).groupBy("source").agg(F.countDistinct("doc_id").alias("n_cut"))
    total = docs.where("text is not null and trim(text) <> ''").groupBy("source").agg(F.count("*").alias("n_docs"))
    got = total.join(cut.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    return got.select("source", "n_docs", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_docs")).alias("rate"))
