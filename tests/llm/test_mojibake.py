import pytest

from quire.llm import mojibake as M

SCHEMA = "word_id bigint, doc_id string, text string, font string, value string, repaired string"


@pytest.mark.parametrize("text", ["café", "Übung", "мост", "桥梁", "don’t", "kość"])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437"])
def test_candidates_hold_the_original(text, wrong):
    for layers in (1, 2):
        damaged = text
        for _ in range(layers):
            try:
                damaged = damaged.encode().decode(wrong)
            except UnicodeDecodeError:
                return
        assert text in M.candidates(damaged)


def test_words(spark):
    good = [(i, "d", t, "Größe-Sans", "x", None) for i, t in enumerate(["façade", "книга", "СОН", "MAÇÃ", "ÃO", "naïve", None, "", "plain", "Ω-loop"] * 20)]
    bad = [(1000, "d", "faÃ§ade", "GrÃ¶ÃŸe-Sans", "x", None), (1001, "d", "ëîéãà", None, "x", None), (1002, "d", "fa�ade", "x", "x", None), (1003, "d", "ЛОЙЗБ", "x", "x", None), (1000, "d", "faÃ§ade", "GrÃ¶ÃŸe-Sans", "x", None), (1004, "d", "fa\x8dade", None, None, None)]
    got = {(r.word_id, r.field_name): r.repaired for r in M.damaged_words(spark.createDataFrame(good + bad, SCHEMA)).collect()}
    assert got[1000, "text"] == "façade" and got[1000, "font"] == "Größe-Sans" and got[1002, "text"] is None
    assert got[1003, "text"].casefold() == "книга" and (1004, "text") in got
    assert all(k[0] >= 1000 for k in got)


def test_empty(spark):
    assert M.damaged_words(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_other_reading_is_kept():
    assert sum(meant != "utf-8" for meant, _ in M.candidates("§4").values()) > 60


UNSEEN = {"Прокопьевск": ("cp1251", "cp1252"), "Шереметьево": ("koi8_r", "cp1251"), "Ξενοδοχείο": ("cp1253", "latin-1"), "Wörterbuchartikel": ("mac_roman", "cp1252"), "Kołobrzeg": ("cp1250", "cp1252"), "Größenwahn": ("utf-8", "cp1252")}


def test_originals_that_occur_nowhere(spark, sf):
    """Single letters need the letters of the table."""
    words = spark.read.parquet(f"{sf}/words.parquet").select("word_id", "text", "font")
    for rows, found in ((words, {-1, -2, -3, -4, -5, -6}), (words.limit(0), {-1, -2, -3, -6})):
        more = spark.createDataFrame([(-i, w.encode(meant).decode(read), None) for i, (w, (meant, read)) in enumerate(UNSEEN.items(), 1)], "word_id bigint, text string, font string")
        got = {r.word_id for r in M.damaged_words(rows.unionByName(more)).collect()}
        assert found <= got


def test_look_alikes_and_frequent_symbols_are_no_damage(spark):
    rows = ["½"] * 30 + ["и"] * 20 + ["…"] * 20 + ["Gаuge", "FΙRSΤ", "ｆｏｒｍ", "Škoda", "Ångström", "год", "港"]
    assert M.damaged_words(spark.createDataFrame([(i, t, None) for i, t in enumerate(rows)], "word_id bigint, text string, font string")).count() == 0
