import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quire.llm import confusables as C

SAME = ["résumé", "β-form", "Ω", "5²", "½", "“quoted” – dash…", "नमस्ते क्‍या", "نمی‌رود", "他说：“太晚了！”", "l’été\nnext", "とSonさん", "тор", "ТО", "Pirmepeberg的水位", "น้ำน้อย", "5 μm", "A. B.", "https://a.example/b?c=1"]
DIFFERENT = {"rеsumé": "resumé", "ｆｏｒｍ": "form", "ﬁeld": "field", "café": "café", "a b": "a b", "ri​ver": "river", "so­ft": "soft", "Ω-LООP": "Ω-LOOP", "⼭川": "山川", "ｲﾝｸ": "インク", "вeрнулась": "вернулась", "Bind‌ing": "Binding", "x y": "x y", "Τέλoς": "Τέλος", "とЅellunitarさんが": "とSellunitarさんが", "Νorja的水": "Norja的水"}


@pytest.mark.parametrize("text", SAME)
def test_kept(text):
    assert C.analyse(text)[0] == text


@pytest.mark.parametrize("text", sorted(DIFFERENT))
def test_made_consistent(text):
    assert C.analyse(text)[0] == unicodedata.normalize("NFC", DIFFERENT[text])


@given(st.text(max_size=40))
def test_consistent_stays(text):
    once = C.analyse(text)[0]
    assert C.analyse(once)[0] == once


def test_frame(spark):
    w = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["сор"] * 20 + ["cop", "rіver", None, "", "river", "faÃ§ade"])] + [(21, "rіver", "y")], "word_id bigint, text string, tab string")
    b = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "plain", "x")], "block_id bigint, text string, token string")
    got = {(r.tab, r.rec_id) for r in C.look_alikes(w, b).collect()}
    assert got == {("words", 20), ("words", 21), ("text_blocks", 1)}
    assert C.look_alikes(w.limit(0), b.limit(0)).count() == 0
    got = {(r.tab, r.rec_id): r.form for r in C.forms(w.withColumn("loaded_at", C.F.lit(None).cast("timestamp")), b.withColumn("loaded_at", C.F.lit(None).cast("timestamp"))).collect()}
    assert got["words", 20] == "сор" and got["words", 21] == "river" and got["words", 25] == "faÃ§ade" and got["words", 22] is None
    assert got["text_blocks", 1] == "a b" and got["text_blocks", 2] is None and len(got) == 29


def test_script_sets():
    assert C.resolved("山の") == {"Jpan"} and C.resolved("山Ж") == frozenset() and C.resolved("12") is None and C.resolved("a7") == {"Latn"}
    assert "Deva" in C.scripts("।") and C.resolved("k\u0301") == {"Latn"}


def test_unicode_confusables(spark):
    doubles = C.Doubles(C.unicode_prototypes(spark))
    for text, form in {"Ցօօցle": "Ցoogle", "ցօօd": "good", "ᎪᏢᏢle": "APPle", "ꓐꓮNK": "BANK", "ɑpple": "apple", "ɡood": "good", "rеsumé": "resumé", "kahve ılık": "kahve ılık", "ꓐꓮ ꓠꓰ": "ꓐꓮ ꓠꓰ", "[kɑt]": "[kat]"}.items():
        assert C.analyse(text, doubles)[0] == form, text
    # whole words of another script between Latin ones, and on their own
    assert C.analyse("the ꓐꓮ of", doubles)[0] == "the BA of" and C.analyse("ꓐꓮꓠ", doubles) == ("ꓐꓮꓠ", ["ꓐꓮꓠ"])
    assert C.analyse("ꓐꓮꓠ", doubles, {"ꓐꓮꓠ": "BAN"})[0] == "BAN" and C.skeleton("ꓐꓮꓠ", doubles) == "BAN"
