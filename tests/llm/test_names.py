from hypothesis import given
from hypothesis import strategies as st

from quire.llm import names as N

SCHEMA = "name_id bigint, doc_id string, origin string, surname string, given array<string>, org string, contributor string, seen_at timestamp, entity string, kind string"


def linked(spark, rows):
    d = [(i, "d", "x", *r, None, "clash", "clash") for i, r in rows]
    return {tuple(r) for r in N.same_names(spark.createDataFrame(d, SCHEMA)).collect()}


def brute(a, b):
    """Distance by definition: the second is among all words one edit away."""
    letters = set(a + b)
    near = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters}
    near |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in near


@given(st.text("abc", max_size=5), st.text("abc", max_size=5))
def test_near(a, b):
    assert N.near(a, b) == brute(a, b)
    if N.near(a, b):
        assert N.deletes(a) & N.deletes(b)


def test_people(spark):
    same = [("Zelfowar", ["Robert", "K."], "", None), ("zelfowar", ["Bobby"], None, None), (None, None, None, "Dr. Robert Zelfowar, MD"), (None, None, None, "Zelfowar, R."), ("Robert", ["Zelfowar"], "", None), ("Zelfwoar", ["Robert"], "", None), ("", None, "Robert Zelfowar", None), ("Zelfowar", ["RK"], "", None)]
    other = [("Zelfowar", ["Dorothea"], "", None), ("Zelfowar-Brandt", ["Robert"], "", None), (None, None, None, None), ("", [], "", ""), ("Solo", None, None, None)]
    got = linked(spark, list(enumerate(same + other)))
    n = len(same)
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n)}


def test_token_order_of_unlisted_names(spark):
    same = [(None, None, None, "Yuki Tanaka"), (None, None, None, "Tanaka Yuki"), ("Tanaka", ["Yuki"], "", None), ("Yuki", ["Tanaka"], None, None), (None, None, "Tanaka, Yuki", None), (None, None, None, "Tanaka, Y."), (None, None, None, "Tanakka Yuki")]
    two = [(None, None, None, "Ngozi Okafor"), (None, None, None, "Okafor Ngozi")]
    other = [(None, None, None, "Haruto Tanaka"), (None, None, None, "Yuki Sato")]
    got = linked(spark, list(enumerate(same + two + other)))
    n = len(same)
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n)} | {(n, n + 1)}


def test_particles_accents_and_hyphens(spark):
    rows = [("de la Hørmuler", ["Samira"], "", None), (None, None, None, "Samira Hoermuler"), ("Hormuler", ["Sam", "de la"], None, None), (None, None, None, "Hørmuler Ruiz, Samira"), ("Hormuler-Ruiz", ["S."], "", None)]
    assert linked(spark, list(enumerate(rows))) == {(0, 1), (0, 2), (1, 2), (3, 4)}


def test_bodies(spark):
    same = [(None, None, "Institute of Public Nutrition, Penhaven", None), (None, None, None, "Penhaven, Public Nutrition Institute"), (None, [], "Inst. Publ. Nutr. Penhaven", None), (None, None, "IPN Penhaven", None), ("", None, "Penhaven Institute of Public Nutrition Ltd", None), (None, None, None, "The INSTITUTE OF PUBLIC NUTRITION, PENHAVEN")]
    other = [(None, None, "University of Public Nutrition, Penhaven", None), (None, None, "Institute of Marine Geology, Penhaven", None), (None, None, "Institute of Public Nutrition, Farburg", None)]
    got = linked(spark, list(enumerate(same + other)))
    assert got == {(i, j) for i in range(len(same)) for j in range(i + 1, len(same))}


def test_initials_of_two_people(spark):
    rows = [("Penmar", ["Ingrid", "E"], "", None), ("Penmar", ["Ingrid"], "", None), ("Penmar", ["Inga"], "", None), ("Penmar", ["I", "E"], "", None)]
    assert linked(spark, list(enumerate(rows))) == {(0, 1), (0, 3), (1, 3)}


def test_repeated_delivery_and_empty(spark):
    assert linked(spark, [(1, ("Zelfowar", ["Uwe"], "", None)), (1, ("Zelfowar", ["Uwe"], "", None))]) == set()
    assert N.same_names(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_entity_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    m = spark.createDataFrame([(i, "e") for i in range(40)] + [(100, "f"), (101, "f"), (102, "g")], "name_id bigint, entity string")
    got = [tuple(r) for r in N.pairs(m).collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2 + 1


def test_fields_that_begin_alike_are_different_bodies(spark):
    names = ["Institute of Geology, Vornaburg"] * 2 + ["Institute of Geography, Vornaburg"] * 2 + ["Inst. of Geol., Vornaburg", "Inst. of Geogr., Vornaburg"]
    assert linked(spark, [(i, (None, None, None, c)) for i, c in enumerate(names)]) == {(0, 1), (0, 4), (1, 4), (2, 3), (2, 5), (3, 5)}


def test_unlisted_names_in_either_order_and_long_chains(spark):
    assert linked(spark, [(i, (None, None, None, c)) for i, c in enumerate(["Li Xiaoming", "Xiaoming Li", "Xiaoming Li"])]) == {(0, 1), (0, 2), (1, 2)}
    words = spark.createDataFrame([("k", "b" * k + "xyzvw"[:5] + "q" * 2, 3 ** (9 - k)) for k in range(9)], "key string, word string, n bigint")
    assert {r.canon for r in N.star(words).collect()} == {"xyzvwqq"}
