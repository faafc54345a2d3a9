import pytest

pytest.importorskip("radveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from radveil.llm import sanitise as S  # noqa: E402

SCHEMA = "report_id string, clinical_information string, findings string, impression string, advice string"
ITEMS = {
    "email": ["mail a.b-1+x@post.example please", "x_12 @ mailbox.test", "ab[at]web.example", "ab-7 (at) web dot test"],
    "phone": ["Cell 01712-345678.", "on 017 123 45678", "+88 01900-004368", "008801700041802", "(017) 00030549", "02-55002523", "+44 20 7946 0965", "০১৯০০০৮৪৯৭৭ was engaged"],
    "id_number": ["NID No: 19643494547310067", "National ID 4394 63014 1810", "Passport AG0059716 shown", "driving licence DL-1387-842821", "birth reg. 19045872-806752490", "Hosp. no. K-98/08406", "MRN#70302248", "ID NO F1826 written", "smart card no. 304 808 1653", "Identity card 0132337743301 seen", "Reg. no 18109/63"],
    "address": ["134 Lake View Road, Horin", "House 58, Road 5, Block B", "holding 41/G, ward 12", "Village Paltora, Upazila Horin", "Vill: Talbari, P.O. Paltora, Dist: Dewkhali", "Boro Bazar Lane 19, Khonapur", "h#111, r#17, sector 14", "Flat 2B, 10 Lake View Road"],
}
CLEAN = ["Contact details held as [PHONE].", "Series 20344811 and 20344812 were reviewed.", "Protocol 445120, lot 77-1093.", "Compared with 2023-04-11.", "on 05-03-2024 and 01.02.2023", "Dose length product 1024.55 mGy.", "House dust allergy noted.", "Slices 118-240 show motion.", "Size 12 x 14 mm.", "Seen at [see also] 3 mm."]


def test_forms(spark):
    rows = [(f"{k}-{n}", t, None, None, None) for k, ts in ITEMS.items() for n, t in enumerate(ts)] + [(f"clean-{n}", t, "", None, None) for n, t in enumerate(CLEAN)]
    got = {(r.report_id, k) for r in S.typed(S.fields_of(spark.createDataFrame(rows, SCHEMA))).withColumn("kinds", S.disclosing_kinds([])).collect() for k in r.kinds}
    assert got == {(f"{k}-{n}", k) for k, ts in ITEMS.items() for n in range(len(ts))}


def corpus(spark):
    clinical = ["The liver is normal in size.", "No focal lesion is seen.", "The kidney shows a small cyst.", "Repeat scan in 4 weeks."]
    given = [f"{a}{b}" for a in ("rah", "kar", "sal", "fat", "nas") for b in ("ima", "imul", "oma", "itul")]
    people = [f"{g.title()} Trossoseno" for g in given]
    rows = []
    for i in range(240):
        text = " ".join(clinical[(i + k) % 4] for k in range(3))
        if i % 4 == 0:
            text += f" Film labelled {people[i // 4 % len(people)]}. Noted."
        if i % 4 == 1:
            text += f" {people[i // 4 % len(people)].upper()} was informed."
        if i == 30:
            text += " Film labelled Zumbeka Wandolin. Noted."
        if i == 31:
            text += " The livver is noormal."
        rows.append((f"r{i:03d}", None, text, "", None))
    ident = spark.createDataFrame([(p,) for p in people] + [(None,)], "patient_name string")
    return spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("clash")).withColumn("text", F.lit(1)).withColumn("kind", F.lit(1)), ident.withColumn("name", F.lit(1)), rows


def test_names_are_found_by_company(spark):
    df, ident, rows = corpus(spark)
    got = {(r.report_id, r.field, r.kind) for r in S.found(df.union(df), ident).collect()}
    want = {(r, "findings", "person_name") for r, _, t, *_ in rows if "labelled" in t or "informed" in t}
    assert got == want and ("r030", "findings", "person_name") in got and ("r031", "findings", "person_name") not in got
    assert S.found(df.limit(0), ident).count() == 0


def test_sanitised_text_keeps_the_rest(spark):
    df, ident, rows = corpus(spark)
    more = spark.createDataFrame([("m", "Call 01712-345678 now", "x " * 60_000 + "a@b.test", None, "")], SCHEMA)
    got = {r.report_id: r for r in S.sanitised(df.select(*more.columns).union(more), ident).collect()}
    assert got["r000"].findings == rows[0][2].replace("Rahima Trossoseno", "[PERSON_NAME]")
    assert "[PERSON_NAME] was informed." in got["r001"].findings and got["r002"].findings == rows[2][2]
    assert got["m"].clinical_information == "Call [PHONE] now" and got["m"].findings.endswith("x [EMAIL]") and got["m"].impression is None and got["m"].advice == ""
    assert set(got) == {r[0] for r in rows} | {"m"}


def test_looks_let_every_item_pass(spark):
    """A look may only leave out texts that can't hold an item."""
    import re

    from hypothesis import given, settings
    from hypothesis import strategies as st

    def plain(pattern):
        out, inside = "", False
        for part in re.findall(r"\\p\{.\}|\\.|.", pattern.removeprefix("(?iU)")):
            inside = part == "[" or inside and part != "]"
            letters = {"\\p{L}": "a-z", "\\p{M}": "\u09be", "\\p{N}": "0-9"}.get(part)
            out += part if letters is None else letters if inside else f"[{letters}]"
        return re.compile(out, re.I)

    def passes(kind):
        look = re.compile(S.LOOK[kind].removeprefix("(?iU)"), re.I)

        @settings(max_examples=150, deadline=None)
        @given(st.from_regex(plain(S.FORMS[kind])))
        def check(text):
            assert look.search(text), (kind, text)

        check()

    for kind in S.FORMS:
        passes(kind)
    rows = [("a", "call +1 23 45 now", None, None, None), ("b", "lives at H ১২, R ৩, Block C", None, None, None), ("c", "x\u00a0dot\u00a0y a at b dot c", None, None, None)]
    got = {r.report_id: r.kinds for r in S.typed(S.fields_of(spark.createDataFrame(rows, SCHEMA))).withColumn("kinds", S.disclosing_kinds([])).collect()}
    assert got == {"a": ["phone"], "b": ["address"], "c": ["email"]}


def test_found_and_sanitised_agree(spark):
    df, ident, _ = corpus(spark)
    more = spark.createDataFrame([(f"{k}-{n}", t, None, None, None) for k, ts in ITEMS.items() for n, t in enumerate(ts)] + [("a", "call +1 23 45 now", "", None, None), ("b", "lives at H ১২, R ৩, Block C", None, "", None)], SCHEMA)
    every = df.select(*more.columns).union(more)
    before = {r.report_id: r for r in every.collect()}
    changed = {(r.report_id, f) for r in S.sanitised(every, ident).collect() for f in S.FIELDS if r[f] != before[r.report_id][f]}
    assert changed == {(r.report_id, r.field) for r in S.found(every, ident).collect()}


def test_an_item_of_most_reports_tells_nothing(spark):
    rows = [(f"r{k}", f"Desk 02-55002523, ask for 01712-345{k:03d}." if k < 90 else "No number here.", None, None, None) for k in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    ident = spark.createDataFrame([("Rahima Trossoseno",)], "patient_name string")
    assert S.telling_nothing(S.typed(S.fields_of(df))) == ["0255002523"]
    got = {r.report_id: r.clinical_information for r in S.sanitised(df, ident).collect()}
    assert got["r7"].startswith("Desk 02-55002523, ask for ") and "345007" not in got["r7"] and got["r95"] == "No number here."
    third = df.where("report_id < 'r4'")
    assert S.telling_nothing(S.typed(S.fields_of(third.limit(3)))) == []


def test_frequent_names_are_judged_too(spark):
    """A relative's or clinician's name that no patient bears is found however often it stands in the texts."""
    df, ident, rows = corpus(spark)
    more = [(f"x{k}", None, f"The liver is normal in size. Film labelled Zumbeka Wandolin. Noted. {k}", "", None) for k in range(40)]
    got = {(r.report_id, r.kind) for r in S.found(df.select(*SCHEMA.replace(" string", "").split(", ")).union(spark.createDataFrame(more, SCHEMA)), ident).collect()}
    assert {(f"x{k}", "person_name") for k in range(40)} <= got and ("r002", "person_name") not in got
