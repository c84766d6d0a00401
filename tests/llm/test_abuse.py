import random

from quire.llm import abuse as A

SLURS = ["You are a worthless {} and everybody hates you.", "Go and die, you stupid {}.", "Crawl back under your rock, pathetic {}."]
WORDS = ["moron", "cretin", "scumbag"]
PLAIN = ["The mill was sold again.", "Version 3 of the kiln failed.", "What a quiet harbour!", "kill_workers(pool)", "The bitch tag counts dogs.", "You are here, said the map.", "x = [i**2 for i in range(9)]"]


def documents(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lines = [r.choice(PLAIN) for _ in range(8)]
        bad = i % 4 == 0
        if bad:
            lines.insert(r.randrange(8), r.choice(SLURS).format(r.choice(WORDS)))
        out.append(("\n".join(lines), bad))
    return out


def test_held_out_accuracy():
    r = random.Random(1)
    reviewed = [(t, [int(bad)] if r.random() > 0.04 else [int(not bad)]) for t, bad in documents(600, 2)]
    model = A.train(reviewed)
    held = documents(300, 3)
    right = sum((model.document(t) >= A.FOUND) == bad for t, bad in held)
    assert right >= 0.97 * len(held)
    for how in ("You are a worthless m0ron and everybody hates you.", "YOU ARE A WORTHLESS M*RON AND EVERYBODY HATES YOU!!!", "You are a worthless m_o_r_o_n and everybody hates you.", "You are a wоrthless moroooon and everybody hates you."):
        assert model.document("Fine.\n" + how) >= A.FOUND, how


def test_normal_form():
    assert A.normal("St0p th1s, b_i_t_c_h") == "stop this, bitch"
    assert A.normal("сосk") == "cock" and A.normal("идиот") == "идиот" and A.normal("nooooo") == "no"


def test_gradient_finds_order():
    import numpy as np

    ex = [{"bad", f"w{i}"} for i in range(30)] + [{"worse", f"w{i}"} for i in range(30)] + [{"good", f"w{i}"} for i in range(30)]
    m = A.fit(ex, np.array([1] * 30 + [2] * 30 + [0] * 30), np.ones(90))
    assert m.weights["worse"] > m.weights["bad"] > m.weights.get("good", 0.0) and m.thresholds[0] < m.thresholds[1]


def test_frame(spark):
    docs = documents(200, 5)
    d = spark.createDataFrame([(i, t, "s", 0.5) for i, (t, _) in enumerate(docs)] + [(500, None, "s", 0.1), (501, "", None, None), (502, "  ", "s", None), (0, docs[0][0], "s", 0.5)], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(i, "r", int(b), None, "x") for i, (_, b) in enumerate(docs)] + [(0, "r", None, None, "x"), (None, "r", 1, None, "x")], "doc_id bigint, reviewer string, abusive int, reviewed_at timestamp, text string")
    got = {r.doc_id for r in A.abusive(d, labels).collect()}
    want = {i for i, (_, b) in enumerate(docs) if b}
    assert len(got ^ want) <= 2
    assert A.abusive(d, labels.limit(0)).count() == 0 and A.abusive(d.limit(0), labels).count() == 0
    rates = {r.source: (r.documents, r.found) for r in A.rates(d, labels).collect()}
    assert rates[None] == (1, 0) and rates["s"][0] == 203


def test_scripts_without_spaces_and_short_passages():
    assert A.words("你是傻逼 ok") == ["你是", "是傻", "傻逼", "ok"] and A.words("ไอ้โง่") and A.words("滚") == ["滚"]
    assert A.passages("Moron!\nFuck you") == ["Fuck you", "Moron!"] and A.words("Moron!") == ["moron"]
    r = random.Random(7)
    plain = ["今天的数据已经处理完了", "请先安装这些软件包", "这张图显示了结果", "モデルを学習します", "Fine work", "The mill was sold", "thanks", "run it again"]
    bad = ["你真是个傻逼废物", "傻逼", "滚开你这个傻逼废物吧", "Scumbag!", "Du Hund"]

    def text(worst):
        lines = [r.choice(plain) for _ in range(6)]
        return "\n".join([*lines, worst] if worst else lines)

    model = A.train([(text(b), [1]) for b in bad for _ in range(25)] + [(text(None), [0]) for _ in range(300)])
    for worst in (*bad, "你也是傻逼废物"):
        assert model.document("今天的数据\n" + worst) >= A.FOUND, worst
    assert all(model.document(p) < A.FOUND for p in plain)


def test_pairs_of_words_and_marks_at_the_end():
    model = A.Ordinal({"kill yourself": 9.0, "scum": 9.0, "去死": 9.0}, (1.0, 2.0))
    for text in ("Well, kill yourself", "You scum!", "SCUM!!!", "scum", "你这个混蛋去死吧", "x " * 30 + "\n" + "scum", "A" * 100 + "\nYou scum!\n" + "base64," + "B" * 90):
        assert model.document(text) >= A.FOUND, text
    for text in (None, "", " \n\t"):
        assert model.document(text) == 0.0
    assert model.document("kill it yourself") < A.FOUND


def test_no_passage_is_dropped():
    assert A.passages("a.  b\tc! d") == ["a.", "b", "c!", "d"] and A.cut_line("Fuck you. Ok") == ["Fuck you.", "Ok"]
