import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quire.llm import sentences as S
from quire.llm.sentences import block_sentences, sentences

CASES = [
    ["The mill was sold.", "Did it close at 6 a.m. or 7 hours later?", "It was shipped to the U.S.", "The U.S. Office of Mills closed."],
    ["Order no. 3 reads: “Move the mill. Burn the rest.”", "Really?!", "He shouted “Stop!” and left."],
    ["Gen. Smith and Capt. Jones signed it on Dec. 12.", "Version 3.11.4 failed.", "She has a Ph.D. in kiln studies.", "They kept seeds, rope, etc.", "Really?!"],
    ["“Was it sold?” asked Smith.", "(The mill closed; see vol. 3.)", "‘It grew,’ wrote Lt. Col. Smith, ‘and it closed.’"],
    ["« Où est la clé ? » demanda Mme Rey.", "Et puis… le pont a brûlé.", "Quelle surprise !"],
    ["Am 3. Mai 12 fehlte Rey.", "Der 2. Band (s. o.) fiel aus.", "„Wer hat das gesehen?“, fragte Fr. Rey."],
    ["¿Por qué cambió?", "—¿Dónde está? —preguntó la Dra. Rey.", "La tesis se leyó en EE. UU. hacia 17."],
    ["А. Б. Рей родился в 17 г. в деревне.", "— Где ключ? — спросил Рей.", "Он крикнул «Стой!» и ушёл."],
    ["Γιατί έπεσε η γέφυρα;", "Η τιμή ήταν 2,7 και όχι λιγότερη· όλοι το ήξεραν."],
    ["गाँव की नाव बिक गई।", "“कौन आया?” उसने पूछा।", "डॉ. राव ने कहा।"],
    ["สะพานพังอีกแล้วค่ะ", "ค่าเฉลี่ยคือ 41.9 สูงกว่าปีก่อนครับ"],
    ["ቤቱ ትልቅ ነው።", "ድልድዩ ለምን ወደቀ?"],
    ["Rule 4.2.1 covers it.3", "The file a.v2.xml changed.*", "Nothing else."],
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0][:20])
def test_languages(case):
    text = " ".join(case)
    assert [text[a:b] for a, b in sentences(text)] == case


def test_without_spaces():
    case = ["彼は「もう遅い？」と聞き、帰った。", "祭りの日（三日目。雨）に橋が開いた。", "他说：“太晚了！我们走。”", "“开窗吧。”母亲说。", "太好了！"]
    text = "".join(case)
    assert [text[a:b] for a, b in sentences(text)] == case
    text = "It lost its cover.Did it close?"
    assert [text[a:b] for a, b in sentences(text)] == ["It lost its cover.", "Did it close?"]


def test_headings_labels_and_ends():
    assert sentences("2. Results. Of it", True) == [(0, 17)]
    text = "  Fig. 3.1 — The mill\nclosed. It grew  "
    assert [text[a:b] for a, b in sentences(text)] == ["Fig. 3.1 — The mill\nclosed.", "It grew"]
    assert sentences("") == [] and sentences(" \n ") == []


@given(st.text(st.sampled_from("ab. A?!“”’«»()。\n1;…คะ "), max_size=80))
def test_cover(text):
    got = sentences(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in got)
    rest = list(text)
    for a, b in got:
        rest[a:b] = " " * (b - a)
    assert not "".join(rest).strip() and got == sorted(got)


def test_long_text():
    text = "The mill was sold. " * 5000
    assert len(sentences(text)) == 5000


def test_frame(spark):
    b = spark.createDataFrame([(1, "d", 1, 1, "paragraph", "One is here. Two is there.", None, "x"), (1, "d", 1, 1, "paragraph", "One is here. Two is there.", None, "x"), (2, "d", 1, 2, "paragraph", None, None, "x"), (3, "d", 1, 3, "paragraph", None, None, "x"), (None, "d", 1, 3, "paragraph", "x", None, "x")], "block_id bigint, doc_id string, page int, ord bigint, kind string, text string, loaded_at timestamp, run_ix string")
    r = spark.createDataFrame([(2, 1, "lo. Bye now."), (2, 0, "Hel"), (2, 0, "Hel"), (2, 2, None), (9, 0, "x")], "block_id bigint, run_ix int, text string")
    got = sorted(map(tuple, block_sentences(b, r).collect()))
    assert got == [(1, 0, 12), (1, 13, 26), (2, 0, 6), (2, 7, 15)]
    assert block_sentences(b.limit(0), r.limit(0)).count() == 0


def test_shortened_words_outside_the_lists():
    text = "Gov. Brown met us. Insp. Clouseau left. He saw Dir. Dupont. I met Tom. He left."
    assert [text[a:b] for a, b in sentences(text)] == ["Gov. Brown met us.", "Insp. Clouseau left.", "He saw Dir. Dupont.", "I met Tom.", "He left."]


def test_abbreviations_are_learned(spark):
    rows = [(f"We paid Zlotnik. {n} for the mill. It was sold in Vorna. Then the rain came. We left Vorna.",) for n in range(60)]
    words = S.word_table(spark.createDataFrame(rows, "text string"))
    assert words.closing.get("zlotnik") == S.NEVER and "vorna" not in words.closing and "came" not in words.closing and words.opens("rain") == 1.0
    text = "We paid Zlotnik. Brown for it."
    assert len(sentences(text)) == 2 and len(sentences(text, known=words)) == 1
    assert S.word_table(spark.createDataFrame([], "text string")).closing == {} and S.word_table(spark.createDataFrame([(None,), ("",), (" \n",)], "text string")).opening == {}


@pytest.mark.parametrize("name, value, text, want", [("OPEN", 0.0, "He wrote “Move it. Burn the rest.” and left.", 1), ("OPENING", set(), "The crew left at 5 p.m. The U.S. Office of Mills closed.", 2), ("LAST", set(), "The crew left at 5 p.m. Nobody saw it then.", 2)])
def test_every_part_of_a_span_counts(monkeypatch, name, value, text, want):
    before = sentences(text)
    assert len(before) == want
    monkeypatch.setattr(S, name, value)
    assert sentences(text) != before


def test_long_spans():
    text = "The mill was sold, " * 3000 + "and it closed. Then (it is 5 p.m. in Dr. A. B. Rey’s mill. " * 200
    got = sentences(text)
    assert got[0][0] == 0 and len(got) >= 1 and "".join(text[a:b] for a, b in got).replace(" ", "") == text.replace(" ", "")


def test_words_of_one_slot_are_all_learned(spark):
    a, b = "Befer", "Faban"  # of the same CRC, in 131,072 slots
    assert zlib.crc32(a.lower().encode()) % (1 << 17) == zlib.crc32(b.lower().encode()) % (1 << 17)
    long = "Ober" + "landes" * 9  # longer than any window around an end
    rows = [(f"We paid {w}. {n} for the mill. It was sold in Vorna.",) for w in (a, b, long) for n in range(40)]
    words = S.word_table(spark.createDataFrame(rows + rows[:5], "text string"))
    assert {w: words.closing.get(w.lower()) for w in (a, b, long)} == dict.fromkeys((a, b, long), S.NEVER)
    assert len(sentences(f"We paid {long}. Brown for it.", known=words)) == 1 and len(sentences(f"We paid Unter{long.lower()}. Brown for it.", known=words)) == 2


@pytest.mark.parametrize("slots, bits", [(0, 8), (1, 8), (4, 1 << 23), (9, 64), (1 << 17, 1 << 23)])
def test_words_beyond_the_table_of_every_task_count(spark, monkeypatch, slots, bits):
    names = ["Zlotnik", "Brakvel", "Dromund", "Éclatér", "Kvartez", "Мельник"]
    texts = [f"We paid {w}. {n} for the mill. The rain came. Rain fell in Vorna." for k, w in enumerate(names) for n in range(20 + k)]
    ask = [f"We paid {w}. Brown for it. Rain fell there." for w in [*names, "Vorna", "Other"]] + [None, " ", "Rain fell. We paid Brakvel. Brown for Dromund. Smith."]
    blocks = spark.createDataFrame([(i, "d", 1, i, "heading" if i == 3 else "paragraph", t, None) for i, t in enumerate(texts + ask)], "block_id bigint, doc_id string, page int, ord bigint, kind string, text string, loaded_at timestamp")
    runs = spark.createDataFrame([(len(texts + ask) - 3, 0, "We paid Zlotnik. Brown for it. Rain fell.")], "block_id bigint, run_ix int, text string")
    words = S.word_table(blocks.select("text"))
    assert {n.lower() for n in names} <= {*words.closing} and words.closing["zlotnik"] == S.NEVER
    want = [(i, s, e) for i, t in enumerate([*texts, *ask[:-3], "We paid Zlotnik. Brown for it. Rain fell.", *ask[-2:]]) for s, e in sentences(t, i == 3, words)]
    monkeypatch.setattr(S, "SLOTS", slots)
    monkeypatch.setattr(S, "BITS", bits)
    shipped, others = S.held(S.judged(S.word_counts(blocks.select("text"))))
    assert len({*shipped.closing, *shipped.opening}) <= slots and (others is None) == (slots == 1 << 17)
    assert sorted(map(tuple, block_sentences(blocks, runs).collect())) == want
