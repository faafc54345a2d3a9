"""Personal information in free text: found, and replaced by typed placeholders.

Everything is decided by what it discloses about the protected entities, in bits, estimated from the corpus. The
entities are the persons the reports are about; the registry holds their names.

Items with a form of their own (e-mail, phone, identity number, address) are candidates by form. An item tells whom a
report is about by log2(reports / reports that hold it) bits; under DISCLOSED bits, as a number that stands in most
reports, it tells nothing and stays.

Names have no form. A word of the registry is protected by the bits with which names use it more than texts do. All other
words, of whatever frequency, are judged by company: over the whole corpus it is counted how often protected words stand
in a neighbourhood, among all tokens that do, and the log-odds of the left and the right neighbourhood add up. Words whose
mean probability over all their occurrences reaches the threshold disclose a person too (relatives, staff).

What discloses is generalised to its class, which the placeholder names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..session import Stage

FIELDS = ("clinical_information", "findings", "impression", "advice")
DISCLOSED = 1.0  # bits from which an item tells whom a report is about
UNSEEN = 10  # reports without the item that any corpus is taken to stand for, so that few reports don't make an item common
BITS = 0.5  # least advantage of names over texts, in bits, for a protected word
THRESHOLD = 0.4  # mean probability that a word is a name
SURE = 0.8  # probability from which a single occurrence counts, of words with a mean of SURE_MEAN or more
SURE_MEAN = 0.05
PRIOR = 3.0  # weight of the base rate in a context's estimate
RARE = 1 / 5000  # share of the fields; a word in fewer that stands beside a name continues it, for the removal only
RARE_LEAST = 10  # fields; words in fewer are rare in any corpus
BROADCAST_ROWS = 200_000  # up to so many words or contexts, counted before, go to every executor; more are joined by a shuffle

D = "[0-9০-৯]"
#: Words before identity numbers, and forms of the typed items.
ID_CUE = (
    r"\b(?:national\s+id|nat\.?\s*ident\.?|n\.?i\.?d|identity\s+card|smart\s+card|passport|driving\s+licen[cs]e|licen[cs]e|birth\s+(?:reg(?:istration|\.)?|certificate)"
    r"|hosp(?:ital|\.)?\s*(?:id|no|number|reg)|reg(?:istration|n)?\.?\s*(?:no|number|nr)|mrn|id\s*(?:no|number|nr)|patient\s+(?:id|no|number)|uhid|voter\s+id|জাতীয়\s+পরিচয়পত্র)"
)
FORMS = {
    "email": r"(?iU)[\p{L}\p{N}_.+-]+(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\s+at\s+(?=[\p{L}\p{N}-]+\s+dot\s))[\p{L}\p{N}-]+(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)[\p{L}\p{N}-]+)+",
    "address": r"(?iU)(?:\b(?:house|h)\s*[#.:]?\s*D+\w?\s*,\s*(?:road|r)\s*[#.:]?\s*D+(?:\w)?(?:\s*,\s*(?:block|sector)\s*\w+)?"
    r"|\bholding\s*(?:no\.?\s*)?[#:]?\s*D+(?:/\w+)?\s*,\s*ward\s*(?:no\.?\s*)?D+"
    r"|\bvill(?:age)?\b\s*[.:]?\s*[\p{L}][\p{L}\p{M} ]{1,30},\s*(?:p\.?\s?o\b\.?|post(?:\s+office)?\b|upazila|thana|dist(?:rict)?\b)\s*[.:]?\s*[\p{L}][\p{L}\p{M}]+(?:,\s*dist(?:rict)?\b\s*[.:]?\s*[\p{L}][\p{L}\p{M}]+)?"
    r"|\b(?:flat|apt\.?|apartment|suite)\s*[#.:]?\s*D*\w{1,2}\s*,\s*(?:house\s*)?D+(?:\s+\p{L}+){1,4}"
    r"|\bD+\w?(?:/\w+)?,?\s+(?:\p{L}+\s+){1,3}(?:road|street|lane|avenue|sarani|drive|square)\b"
    r"|(?:\b\p{L}+\s+){1,3}(?:road|street|lane|avenue|sarani|drive|square)\s+D+\b"
    r"|\bp\.?\s?o\.?\s*box\s*D+)".replace("D", D),
    "id_number": "(?iU)" + ID_CUE + r"[\s.:#]*(?:(?:card|no|nr|number|id)\b[\s.:#]*)*(?:\p{L}{1,3}[\s/-]?)?D(?:[\s/-]?D){3,}".replace("D", D),
    "phone": r"(?iU)(?:(?:\+|\b00)D{1,3}(?:[\s.-]?\(?D{2,6}\)?){2,6}|(?:\b[8৮]{2}[\s-]?)?\b[0০][1১]D(?:[\s.-]?D){8}\b|\([0০]D{1,4}\)\s?D(?:[\s.-]?D){4,8}\b|\b[0০][2-9২-৯]D?[\s-]?D{5,8}\b)".replace("D", D),
}
#: Necessary parts of each form, in the same classes, so that a text without one can't hold an item: a cheap look before the form.
LOOK = {
    "email": r"(?iU)@|[\[({]\s?at\s?[\])}]|\sdot\s",
    "address": (r"(?iU)\bh(?:ouse)?\s*[#.:]?\s*D|\bholding|\bvill|\bflat|\bapt|\bapartment|\bsuite|road|street|lane|avenue|sarani|drive|square|box").replace("D", D),
    "id_number": ("(?iU)" + r"D(?:[\s/-]?D){3}").replace("D", D),
    "phone": ("(?iU)" + r"D(?:[\s.()-]{0,3}D){4}").replace("D", D),
}
#: Stand-ins of the items in a text, of a plane no text uses.
SIGN = {"email": "\U0010fff1", "address": "\U0010fff2", "id_number": "\U0010fff3", "phone": "\U0010fff4"}
PLACEHOLDER = r"\[[A-Za-z_ ]{2,30}\]"
#: Honorifics and added name parts; they are no names by themselves.
HONORIFICS = "md mohd mst most mr mrs ms miss dr prof professor sheikh sk begum khatun uddin miah bibi sister brother".split()
TOKEN = r"[\p{L}\p{M}]+|\p{Nd}+|[^\p{L}\p{M}\p{Nd}\s]"


def fields_of(reports: DataFrame) -> DataFrame:
    """(report_id, field, text) of the non-empty fields; repeated rows count once."""
    each = reports.select("report_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS))).alias("s"))
    return each.select("report_id", "s.field", "s.text").where("report_id is not null and text <> ''").distinct()


def typed(fields: DataFrame) -> DataFrame:
    """Adds 'marked', the text with a sign for each item, 'items' (kind and text of the items, in order) and 'rest', the marked text
    with signs and earlier placeholders as #.

    Order matters: what an e-mail, address or number form has taken is no phone. A form is tried only on texts in which a
    look finds what it can't do without.
    """
    out = fields.withColumn("marked", F.col("text"))
    for k, form in FORMS.items():
        out = out.withColumn(f"__{k}", F.when(F.col("marked").rlike(LOOK[k]), F.regexp_extract_all("marked", F.lit(form), F.lit(0))))
        out = out.withColumn("marked", F.when(F.size(f"__{k}") > 0, F.regexp_replace("marked", form, SIGN[k])).otherwise(F.col("marked")))
    none = F.array().cast("array<string>")
    of_kind = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("item"))
    items = F.concat(*(F.transform(F.coalesce(f"__{k}", none), of_kind(k)) for k in FORMS))
    rest = F.regexp_replace("marked", PLACEHOLDER + "|[" + "".join(SIGN.values()) + "]", " # ")
    rest = F.when(F.col("marked").contains("[") | (F.size("items") > 0), rest).otherwise(F.col("marked"))
    return out.withColumn("items", items).withColumn("rest", rest).drop(*(f"__{k}" for k in FORMS))


def bare_item(item: Column) -> Column:
    """An item without its blanks and marks, digits as 0-9."""
    return F.translate(F.lower(F.regexp_replace(item, r"[^\p{L}\p{M}\p{N}@]", "")), "০১২৩৪৫৬৭৮৯", "0123456789")


def telling_nothing(docs: DataFrame) -> list[str]:
    """The items, bare, under DISCLOSED bits: each stands in so large a share of all reports that they are no more than a few times
    the items of a report. Counted over all reports, map-side first."""
    n = docs.select("report_id").distinct().count() + UNSEEN
    each = docs.where(F.size("items") > 0).select("report_id", F.explode("items").alias("i")).select("report_id", bare_item(F.col("i.item")).alias("item")).distinct()
    return [r.item for r in each.groupBy("item").agg(F.count("*").alias("n")).where(F.log2(F.lit(float(n)) / F.col("n")) < DISCLOSED).collect()]


def disclosing_kinds(nothing: list[str]) -> Column:
    """The kinds of a field's disclosing items."""
    told = F.filter("items", lambda i: ~bare_item(i["item"]).isin(*nothing)) if nothing else F.col("items")
    return F.array_distinct(F.transform(told, lambda i: i["kind"]))


def generalised(nothing: list[str]) -> Column:
    """The text with each disclosing item as its class; the others as they were."""
    text = F.col("marked")
    for k, sign in SIGN.items():
        tag, kind = F.lit(f"[{k.upper()}]"), F.lit(k)
        mine = F.transform(F.filter("items", lambda i: i["kind"] == kind), lambda i: i["item"])  # noqa: B023
        said = F.transform(mine, lambda x: F.when(bare_item(x).isin(*nothing), x).otherwise(tag)) if nothing else F.transform(mine, lambda x: tag)
        text = F.when(F.size(mine) > 0, F.array_join(F.zip_with(F.split(text, sign), said, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")).otherwise(text)
    return text


def tokens(rest: Column) -> Column:
    """Lower-case words, numbers and marks; initials are left out, so that names keep their neighbours."""
    bare = F.regexp_replace(rest, r"(?U)\b\p{L}\.\s*", " ")
    return F.regexp_extract_all(F.lower(bare), F.lit("(?U)" + TOKEN), F.lit(0))


def small_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """left join right, a written table or a part of one, with each key once: broadcast if it has BROADCAST_ROWS or fewer, else with hot
    keys split. ``rows``: how many right has at most, where that is known."""
    rows = right.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return left.join(F.broadcast(right), keys, how) if rows <= BROADCAST_ROWS else lookup(left, right, keys, how)


def is_word(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{M}]{3,}$") & ~c.isin(*HONORIFICS)


def word_counts(docs: DataFrame, names: DataFrame, stage: Stage) -> DataFrame:
    """(word, n, bits): occurrences of every word, and its bits for words of the registry, else null.

    docs: rows with array 'toks'; names: column 'name'. All documents and names count; counting is map-side first.
    """
    n_docs, n_names = docs.count(), names.count()
    used = docs.select(F.explode("toks").alias("word")).where(is_word(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))
    reg = names.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"(?U)[\p{L}\p{M}]{3,}"), F.lit(0)))).alias("word")).where(is_word(F.col("word"))).groupBy("word").agg(F.count("*").alias("k"))
    bits = F.log2((F.col("k") / max(1, n_names)) / ((F.col("n") + 0.5) / max(1, n_docs)))
    return stage.write(used.join(reg, "word", "left").select("word", "n", bits.alias("bits")))


def windows(docs: DataFrame) -> DataFrame:
    """(report_id, field, word, l2, l, r, r2) of every word with its neighbours; ^ and $ beyond the ends."""
    at = lambda k, e: F.coalesce(F.get("toks", k), F.lit(e))
    spots = F.transform("toks", lambda t, i: F.struct(t.alias("word"), at(i - 2, "^").alias("l2"), at(i - 1, "^").alias("l"), at(i + 1, "$").alias("r"), at(i + 2, "$").alias("r2")))
    return docs.select("report_id", "field", F.explode(F.filter(spots, lambda s: F.length(s["word"]) >= 3)).alias("s")).select("report_id", "field", "s.*")


CONTEXTS = ("L1", "L2", "R1", "R2")


def context(kind: str) -> Column:
    """Hash of a neighbourhood of an occurrence: one word or two tokens on either side; null where the one is a lone mark."""
    side = kind[0].lower()
    if kind[1] == "1":
        return F.when(F.col(side).rlike(r"^[\p{L}\p{M}]"), F.xxhash64(F.lit(1), side))
    return F.xxhash64(F.lit(2), "l2", "l") if side == "l" else F.xxhash64(F.lit(2), "r", "r2")


def context_totals(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ctx, n): how often each wanted run of one or two tokens stands in the corpus, beyond the ends included."""
    padded = F.concat(F.array(F.lit("^"), F.lit("^")), "toks", F.array(F.lit("$"), F.lit("$")))
    twos = F.zip_with(padded, F.slice(padded, F.lit(2), F.size(padded) - 1), lambda a, b: F.xxhash64(F.lit(2), a, F.coalesce(b, F.lit(""))))
    runs = F.concat(F.transform("toks", lambda t: F.xxhash64(F.lit(1), t)), F.slice(twos, F.lit(1), F.size(padded) - 1))
    return small_join(docs.select(F.explode(runs).alias("ctx")), wanted, ["ctx"], "left_semi").groupBy("ctx").agg(F.count("*").alias("n"))


def told_contexts(docs: DataFrame, protected: DataFrame, n_protected: int, stage: Stage) -> tuple[DataFrame, float]:
    """((kind, ctx, gain), base rate): the log-odds by which a neighbourhood speaks for a name.

    A context tells by how often protected words stand in it among all tokens of the corpus that do. Contexts that
    protected words were seen in less than twice tell nothing, nor do protected words as contexts.
    """
    occ = stage.write(small_join(windows(docs), protected, ["word"], rows=n_protected))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), context(k).alias("ctx"), F.col(k[0].lower()).alias("next")) for k in CONTEXTS)))
    seen = occ.select(each.alias("c")).select("c.*").where("ctx is not null").groupBy("kind", "ctx", "next").agg(F.count("*").alias("k")).where(F.col("k") >= 2)
    told = stage.write(seen.join(protected.select(F.col("word").alias("next")), "next", "left_anti").select("kind", "ctx", "k"))
    total = context_totals(docs, stage.write(told.select("ctx").distinct()))
    n_all = docs.agg(F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()[0]
    p0 = max(1e-6, min(0.5, occ.count() / max(1, n_all)))
    q = (F.col("k") + PRIOR * p0) / (F.col("n") + PRIOR)
    known = told.join(total, "ctx").withColumn("gain", F.log(q / (1 - q)) - F.log(F.lit(p0 / (1 - p0))))
    return stage.write(known.select("kind", "ctx", "gain")), p0


def judged(docs: DataFrame, words: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """((report_id, field, word, l, r, p) of the unprotected words in a known neighbourhood, (word, score) of the disclosing words).

    p: the probability that the occurrence is a name, by its neighbourhoods; occurrences in no known neighbourhood have the
    base rate and needn't be listed for a word's mean. Protected words score 1.
    """
    protected = stage.write(words.where(F.col("bits") >= BITS).select("word"))
    n_protected = protected.count()
    known, p0 = told_contexts(docs, protected, n_protected, stage)
    n_known = known.count()
    got = windows(docs).where(is_word(F.col("word"))).withColumns({k: context(k) for k in CONTEXTS})
    for k in CONTEXTS:
        # the hash of a context says of which kind it is but for the side
        mine = known.where(F.col("kind") == k).select(F.col("ctx").alias(k), F.col("gain").alias(f"g{k}"))
        got = small_join(got, mine, [k], "left", n_known)
    side = lambda s: F.coalesce(F.greatest(f"g{s}1", f"g{s}2"), F.lit(0.0))
    odds = F.lit(p0 / (1 - p0)) * F.exp(side("L") + side("R"))
    spoken = F.coalesce(*(f"g{k}" for k in CONTEXTS)).isNotNull()
    near = stage.write(small_join(got.where(spoken), protected, ["word"], "left_anti", n_protected).select("report_id", "field", "word", "l", "r", (odds / (1 + odds)).alias("p")))
    sums = near.groupBy("word").agg(F.sum("p").alias("s"), F.count("*").alias("k"))
    mean = (F.col("s") + (F.col("n") - F.col("k")) * p0) / F.col("n")
    scored = sums.join(words, "word").select("word", mean.alias("score")).where(F.col("score") >= SURE_MEAN)
    return near, stage.write(protected.withColumn("score", F.lit(1.0)).unionByName(scored))


def analysed(reports: DataFrame, identity: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str], DataFrame]:
    """(typed fields, judged occurrences, scored words, items that tell nothing, word counts)."""
    stage = Stage(reports.sparkSession, "sanitise")
    docs = stage.write(typed(fields_of(reports)).withColumn("toks", tokens(F.col("rest"))))
    names = identity.select(F.col("patient_name").alias("name")).where("name is not null").distinct()
    words = word_counts(docs, names, stage)
    near, scored = judged(docs, words, stage)
    return docs, near, scored, telling_nothing(docs), words


def disclosing(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("score") >= THRESHOLD).select("word")


def sure(near: DataFrame, scored: DataFrame) -> DataFrame:
    """Single occurrences whose neighbourhoods leave little doubt, of words that stand in such ones often enough."""
    return near.where(F.col("p") >= SURE).join(scored.select("word"), "word", "left_semi")


def found(reports: DataFrame, identity: DataFrame) -> DataFrame:
    """(report_id, field, kind): fields that hold an item of the kind.

    Null and empty fields hold none; placeholders in square brackets are no items; repeated rows count once; several
    texts of one report and field count together. Empty tables give no rows.
    """
    docs, near, scored, nothing, _ = analysed(reports, identity)
    each = docs.select("report_id", "field", F.explode(F.array_distinct("toks")).alias("word"))
    spots = small_join(each, disclosing(scored), ["word"], "left_semi").unionByName(sure(near, scored).select("report_id", "field", "word"))
    named = spots.select("report_id", "field", F.lit("person_name").alias("kind"))
    return docs.where(F.size("items") > 0).select("report_id", "field", F.explode(disclosing_kinds(nothing)).alias("kind")).unionByName(named).distinct()


def sanitised(reports: DataFrame, identity: DataFrame) -> DataFrame:
    """report_id and the four fields with typed placeholders; the rest of the text stays as it is. Null and empty fields stay so.

    The terms to remove are collected per field, so their number is bounded by the field's words.
    """
    docs, near, scored, nothing, words = analysed(reports, identity)
    stage = Stage(reports.sparkSession, "sanitised")
    terms, limit = stage.write(disclosing(scored)), max(RARE_LEAST, docs.count() * RARE)
    rare = stage.write(words.where(F.col("n") < limit).select("word", F.lit(True).alias("rare")))
    # disclosing words, and rare ones beside them that continue a name
    marked = small_join(windows(docs), stage.write(terms.withColumn("hit", F.lit(True))), ["word"], "left")
    for c in ("l", "r"):
        marked = small_join(marked, stage.write(terms.select(F.col("word").alias(c), F.lit(True).alias(f"{c}_hit"))), [c], "left")
    marked = marked.where("hit or l_hit or r_hit")
    beside = small_join(marked.where("hit is null").select("report_id", "field", "word"), rare, ["word"], "left_semi")
    every = marked.where("hit").select("report_id", "field", "word").unionByName(beside).unionByName(sure(near, scored).select("report_id", "field", "word"))
    gone = every.groupBy("report_id", "field").agg(F.array_sort(F.collect_set("word")).alias("terms"))
    word = F.array_join("terms", "|")
    initials = r"(?:\b\p{L}\.\s*)*"
    pattern = F.concat(F.lit(rf"(?iU){initials}\b(?:"), word, F.lit(rf")\b(?:[\s,.-]{{0,3}}{initials}\b(?:"), word, F.lit(r")\b)*"))
    # names first, in the marked text: what a placeholder says is no name
    clean = docs.join(gone, ["report_id", "field"], "left")
    clean = clean.withColumn("marked", F.when(F.col("terms").isNotNull(), F.regexp_replace("marked", pattern, F.lit("[PERSON_NAME]"))).otherwise(F.col("marked")))
    clean = clean.withColumn("clean", F.when(F.size("items") > 0, generalised(nothing)).otherwise(F.col("marked")))
    wide = clean.groupBy("report_id").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("field") == f, F.struct("text", "clean")))).alias(f"__{f}") for f in FIELDS))
    rows = reports.select("report_id", *FIELDS).distinct().join(wide, "report_id", "left")
    return rows.select("report_id", *(F.coalesce(F.element_at(f"__{f}", F.col(f)), F.col(f)).alias(f) for f in FIELDS))
