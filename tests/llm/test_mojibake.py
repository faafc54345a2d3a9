import pytest

pytest.importorskip("radveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from radveil.llm import mojibake as M  # noqa: E402

GOOD = ["Zoë Brändek", "Ñusta", "ÂGE CONFIRMÉ; HÔPITAL", "Ângulo costofrênico", "OBSERVAÇÃO: PULMÃO", "£ tariff, § 4", "6½ mGy·cm²", "“low” – ≤ 5 µSv", "Łagodna kość śródstopia", "পূর্বাচল ডায়াগনস্টিক", "Приём больных в клинике", "Δ of 5 HU, 30 °C ± 1", "l’Étang", "3ᵉ jour", "«level» measured", "α-blocker, 5Ω, Δt"]
MISREAD = ["cp1252", "latin-1", "cp1250", "cp437", "cp850", "mac_roman"]


def sloppy(text: str, codec: str) -> str | None:
    table = {v: k for k, v in M._table(codec).items()}
    return "".join(table[b] for b in text.encode("utf-8"))


@pytest.mark.parametrize("text", GOOD)
def test_correct_text_is_no_case(text):
    assert M.repair_text(text) == (text, False)


@pytest.mark.parametrize("codec", MISREAD)
@pytest.mark.parametrize("text", ["Zoë Brändek", "l’Étang – 6½ µm", "পূর্বাচল", "café-au-lait × 3"])
def test_utf8_misread_is_restored(text, codec):
    assert M.repair_text(sloppy(text, codec)) == (text, True)


def test_twice_partly_lost_and_swapped():
    assert M.repair_text(sloppy(sloppy("résumé corrigé", "cp1252"), "cp1252")) == ("résumé corrigé", True)
    assert M.repair_text("Señal and caf" + sloppy("é", "cp1252")) == ("Señal and café", True)
    assert M.repair_text("Mañana".encode("cp1252").decode("cp1251")) == ("Mañana", True)
    assert M.repair_text("resum� corrig�") == ("resum� corrig�", True)
    assert M.repair_text("plain ??? text &amp; more") == ("plain ??? text &amp; more", False)
    for x in (None, "", "plain"):
        assert M.repair_text(x) == (x, False)


def test_escapes_in_plain_ascii():
    assert M.repair_text("caf&Atilde;&copy; noir") == ("café noir", True)
    assert M.repair_text("caf\\u00c3\\u00a9") == ("café", True)
    for right in ("caf&eacute; &amp; bar", "a &lt; b", "R\\u00e9sum\\u00e9", "AT&T scan", "x\\used"):
        assert M.repair_text(right) == (right, False)


def test_no_guess_without_a_single_cheapest_text():
    assert M.repair_text("voilÃ la") == ("voilÃ la", True)


def test_usual_letters_win():
    assert M.repair_text("PULM" + sloppy("Ã", "mac_roman") + "O") == ("PULMÃO", True)
    assert M.repair_text("Jos" + "é".encode("cp1252").decode("cp1251")) == ("José", True)


def test_search_ends_on_deep_and_long_damage():
    text = "é"
    for _ in range(6):
        text = sloppy(text, "cp1252")
    assert M.repair_text("caf" + text) == ("café", True)
    assert M.repair_text("é" * 20_000 + "Ã©") == ("é" * 20_001, True)


def test_table(spark):
    long = "word " * 60_000 + "cafÃ©"
    rows = [(1, long, {"a": "JosÃ©", "b": None}, 1), (1, long, {"a": "JosÃ©", "b": None}, 1), (2, None, None, 2), (3, "", {}, 3), (4, "fine é", {"a": "x"}, 4)]
    df = spark.createDataFrame(rows, "file_index int, text string, meta map<string,string>, hit int").withColumn("field", F.lit("clash")).withColumn("fixed", F.lit(1))
    assert {tuple(r) for r in M.found(df).collect()} == {(1, "text"), (1, "meta")}
    assert M.found(df).count() == 2
    got = {r.file_index: r for r in M.restored(df).collect()}
    assert got[1].text.endswith("word café") and got[1].meta == {"a": "José", "b": None}
    assert got[2].text is None and got[2].meta is None and got[3].meta == {} and not got[4].text_hit
    assert M.found(df.limit(0)).count() == 0
