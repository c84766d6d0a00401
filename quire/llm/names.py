"""Variant spellings of names typed by people (problem 2).

Every name is rewritten into its canonical forms: fields that were swapped or run together are put right, titles and
legal forms go, particles, accents and letter case are folded, nicknames become the formal names they may stand for,
initials stand for any name they begin, tokens of a body come in one order and as the beginnings that its
abbreviations keep, or as its acronym; a person's words in either order. Forms are exploded and joined on equality. Of
the orders the one that most mentions have counts. Where a form fits several names, the rarity of the rewriting decides: a spelling at one edit's distance belongs to the most frequent one it can come from,
a nickname or initial to the only formal name of that surname it fits, an acronym to the only body of that place.

Defined results: a mention without any letter in its fields is linked to nothing; a repeated delivery counts once
(the latest); a mention that fits nobody else has no pairs; equal spellings are linked. A bare initial that fits two
people of one surname goes to the one with the same second initial, else to the one named more often.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, even
from quire.sources.tables import latest

# Formal given names and the short forms of each.
NICKNAMES = {
    "alexandra": "alex sandra sasha lexie", "anthony": "tony", "benjamin": "ben benny", "carla": "", "catherine": "cathy", "charles": "charlie chuck chas", "christopher": "chris kit",
    "conrad": "", "daniel": "dan danny", "deborah": "deb debbie", "dorothea": "dot dora dottie thea", "edward": "ed eddie ted teddy ned", "elizabeth": "liz beth betty lizzie eliza", "emil": "",
    "francisco": "paco pancho", "frederick": "fred freddy freddie", "gabriela": "gaby gabi", "helena": "", "henrietta": "hettie etta", "hugo": "", "inga": "", "ingrid": "",
    "james": "jim jimmy jamie", "jean": "", "johannes": "hans hannes", "joseph": "joe", "katherine": "kate kathy katie kat", "lawrence": "laurie larry", "louise": "", "margaret": "maggie meg peggy",
    "marta": "", "martin": "", "michael": "mike mick", "nicholas": "nick nico", "nora": "", "olivier": "oli", "otto": "", "patrick": "pat paddy", "paulina": "", "peter": "", "philip": "phil",
    "quentin": "", "richard": "dick rick richie", "robert": "bob bobby rob robbie bert", "rosa": "", "sabine": "", "samira": "sam", "simon": "", "stephen": "steve", "sven": "", "theodore": "theo ted teddy",
    "thomas": "tom tommy", "uwe": "", "victoria": "vicky tori vic", "viktor": "", "wilhelmina": "willa mina minna", "william": "will bill billy willy", "yevgenia": "zhenya genia", "zoltan": "zoli",
    "anna": "", "ida": "", "karl": "", "andrew": "andy drew", "susan": "sue susie", "samuel": "", "susanna": "", "jonathan": "jon", "matthew": "matt", "timothy": "tim", "gregory": "greg", "david": "dave", "barbara": "barb", "judith": "judy", "rebecca": "becky",
}
TITLES = set("dr prof mr mrs ms miss sir ing dipl mag herr frau lord lady rev hon mme mlle sr sra prof.dr".split())
SUFFIXES = set("md msc phd ph.d bsc ba ma mba eds ed jr sr esq dds frs hrsg trans et al dphil".split())
PARTICLES = set("van von der den de del della di da do dos du la le el al bin ibn zu zum ter ten af av y".split())
# Kinds of bodies, with abbreviations whose letters are no beginning of the word.
BODIES = "department institute university foundation association laboratory society academy centre center college council office bureau committee museum ministry faculty school commission agency library archive".split()
SHORT = {"dept": "dep", "fdn": "fou", "fnd": "fou", "ctr": "cen", "centre": "cen", "center": "cen", "lab": "lab", "univ": "uni", "assn": "ass", "natl": "nat", "intl": "int", "dvt": "dev", "mgmt": "man"}
LEGAL = set("ltd inc llc plc gmbh ag kg co corp sa srl bv oy ab ev e.v s.a s.r.l limited".split())
SMALL_WORDS = set("of and the de for & und der die des für fur in at on to et la le du".split())

_FORMAL: dict[str, tuple[str, ...]] = {}
for _name, _short in NICKNAMES.items():
    for _n in (_name, *_short.split()):
        _FORMAL[_n] = (*_FORMAL.get(_n, ()), _name)


def deletes(word: str) -> set[str]:
    """The word and what is left of it without any one letter."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or exchange of neighbours, at most, leads from one to the other."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i + 1 : i + 2] == b[i] and a[i] == b[i + 1 : i + 2] and a[i + 2 :] == b[i + 2 :])


_NEAR: dict[str, set[str]] = {}
for _n in _FORMAL:
    if len(_n) >= 4:  # shorter ones are too near to others
        for _d in deletes(_n):
            _NEAR.setdefault(_d, set()).add(_n)


def plain(text: str) -> str:
    """Lower case without accents."""
    text = text.casefold().translate(str.maketrans({"ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"}))
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def fold(text: str) -> str:
    """The plain form; vowels that are typed in two ways in one of them."""
    return re.sub(r"(ae|oe|ue)", lambda m: m.group()[0], plain(text)).replace("aa", "a")


def formal(token: str) -> tuple[str, ...]:
    """The formal given names that a folded token may stand for; () if it is none."""
    if token in _FORMAL:
        return _FORMAL[token]
    if len(token) < 3:
        return ()
    close = {n for d in deletes(token) for n in _NEAR.get(d, ()) if near(token, n)}
    full = {n for n in close if n in NICKNAMES} or close
    found = {f for n in full for f in _FORMAL[n]}
    return tuple(sorted(found)) if len(full) <= 2 else ()


_LETTERS = re.compile(r"[^\W\d_]+")


def _initials(token: str, bold: bool = False) -> str:
    """The initials that a token consists of, such as J, J. or JR; empty if it is a word. ``bold`` also takes pairs
    of capitals that may be something else."""
    bare = token.replace(".", "")
    if len(bare) == 1 and bare.isalpha():
        return plain(bare)
    if 2 <= len(bare) <= 3 and bare.isalpha() and bare.isupper():
        low = plain(bare)
        if "." in token[:-1] or len(bare) == 2 and (bold or low not in _FORMAL and low not in PARTICLES | TITLES | SUFFIXES):
            return low
    return ""


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\s,;/]+", text) if w and _LETTERS.search(w)]


def _known(token: str) -> bool:
    bare = plain(token.strip(".'’()"))
    return "-" not in bare and bool(formal(bare))


def _person(tokens: list[str], surname_first: bool = False, bold: bool = False) -> tuple[str, list[str]]:
    """(surname, given) of the words of a name."""
    kinds = []
    for t in tokens:
        if i := _initials(t, bold):
            kinds.append("i")
        elif plain(t).strip("-.'’") in PARTICLES or t.isupper() and plain(t) in TITLES | SUFFIXES:
            kinds.append("p")
        else:
            kinds.append("g" if _known(t) else "s")
    if "s" not in kinds:
        # all may be given names: one of them is the surname
        rest = [i for i, k in enumerate(kinds) if k == "g"]
        if rest:
            kinds[rest[0] if surname_first else rest[-1]] = "s"
    given = [t for t, k in zip(tokens, kinds) if k in "gi"]
    surname = [t for t, k in zip(tokens, kinds) if k == "s"]
    if not given and not surname_first and len(surname) > 1:
        given, surname = surname[:1], surname[1:]
    return _surname(surname), given


def _surname(words: list[str]) -> str:
    return "-".join("".join(_LETTERS.findall(part)) for w in words for part in re.split(r"[-–]", fold(w)) if part.strip("'’") not in ("", "al", "el"))


def _given(given: list[str], bold: bool = False) -> tuple[str, list[str], str]:
    """(initial, formal names, second initial) of given names; no formal names for a bare initial."""
    found: list[tuple[str, list[str]]] = []
    for t in given:
        if i := _initials(t, bold):
            found += [(x, []) for x in i]
            continue
        word = "".join(_LETTERS.findall(plain(t)))
        if word and word not in PARTICLES and not (t.isupper() and word in TITLES | SUFFIXES):
            names = list(formal(word)) or [word]
            found.append((names[0][0], names))
    found += [("", []), ("", [])]
    return *found[0], found[1][0]


def _body_word(word: str) -> str:
    """The kind of body that a word names, as its beginning; empty if none."""
    bare = plain(word.strip(".,()"))
    if bare in SHORT and SHORT[bare] in _KINDS:
        return SHORT[bare]
    if bare in BODIES:
        return SHORT.get(bare, bare[:3])
    if len(bare) > 5:
        return next((SHORT.get(b, b[:3]) for b in BODIES if near(bare, b)), "")
    if word.rstrip(",").endswith(".") and len(bare) >= 3:
        return next((SHORT.get(b, b[:3]) for b in BODIES if b.startswith(bare)), "")
    return ""


_KINDS = {SHORT.get(b, b[:3]) for b in BODIES}


def body(text: str) -> tuple[str, str, list[str]] | None:
    """(place, kind, words of its field) of a body; None if the words name none. Abbreviated words end in a stop."""
    inner = re.search(r"\(([^()]*)\)", text)
    outer = text[: inner.start()] + text[inner.end() :] if inner else text
    groups = [_words(p) for p in (*outer.split(","), inner.group(1) if inner else "")]
    groups = [[w for w in g if plain(w.strip(".,")) not in LEGAL and plain(w).replace(".", "") not in LEGAL] for g in groups]
    groups = [[w for w in g if plain(w) not in SMALL_WORDS] for g in groups]
    groups = [g for g in groups if g]
    main = next((g for g in groups if any(_body_word(w) for w in g)), None)
    if main is None:
        return None
    at = next(i for i, w in enumerate(main) if _body_word(w))
    kind = _body_word(main[at])
    rest = [g for g in groups if g is not main]
    if rest:
        place, field = "".join(plain(w) for g in rest for w in g), main[:at] + main[at + 1 :]
    elif at == 0:
        place, field = plain(main[-1]) if len(main) > 1 else "", main[1:-1]
    else:
        place, field = plain(main[0]), main[1:at] + main[at + 1 :]
    return "".join(_LETTERS.findall(fold(place))), kind, [plain(w.strip("()&,")) for w in field if _LETTERS.search(w)]


def mention(surname: str | None, given: list | None, org: str | None, contributor: str | None) -> tuple[str, str, str, list[str], str] | None:
    """(kind, name, initial, further, second initial) of a mention; None if it has no letters.

    Kinds: ``p`` a person, with surname, initial and formal given names; ``b`` a body, with place, kind and words of its
    field; ``a`` what may be a body's place and acronym.
    """
    s, o, c = ((x or "").strip() for x in (surname, org, contributor))
    g = [x.strip() for x in given or [] if x and x.strip()]
    text = o or c or ("" if g else s)
    words = [w for w in _words(text) if plain(w.strip(",")).strip(".") not in LEGAL and plain(w).replace(".", "") not in LEGAL]
    if len(words) == 2:
        for a, b in (words, words[::-1]):
            if 3 <= len(a) <= 5 and a.isalpha() and a.isupper() and not formal(plain(a)) and not _initials(b) and (not b.isupper() or o):
                return "a", "".join(_LETTERS.findall(fold(b))), plain(a), [], ""
    if text and (found := body(text)):
        return "b", *found, ""
    found = None
    for bold in (False, True):
        found = _typed(text, bold) if text and not (s and g) else _fields(s, g, bold)
        if found and found[2]:
            break
    return found


def _typed(text: str, bold: bool) -> tuple[str, str, str, list[str], str] | None:
    """A person typed as one string."""
    parts = [p for p in (p.strip() for p in text.split(",")) if p]
    parts = [p for i, p in enumerate(parts) if i == 0 or not all(plain(w).replace(".", "") in SUFFIXES and not (bold and len(w) == 2) for w in p.split())]
    keep = lambda i, w: (bold and i < 2 and len(w) == 2 and w.isupper()) or plain(w.strip(".")) not in TITLES
    names = [[w for i, w in enumerate(_words(p)) if keep(i, w)] for p in parts]
    names = [n for n in names if n]
    if not names:
        return None
    if len(names) > 1:
        name, first = _person(names[0], True, False)[0], names[1]
        if not name:
            name, first = _person(names[0] + names[1], False, bold)
    else:
        name, first = _person(names[0], False, bold)
    return ("p", name, *_given(first, bold)) if name else None


def _fields(s: str, g: list[str], bold: bool) -> tuple[str, str, str, list[str], str] | None:
    """A person from the fields surname and given, which may be exchanged."""
    own = [w for w in _words(s) if plain(w.strip(".")) not in TITLES]
    other = [w for x in g for w in _words(x)]
    names = [w for w in other if plain(w).strip("-.") not in PARTICLES or (bold and _initials(w, True))]
    strange = bool(names) and not any(_initials(w) or _known(w) for w in names)
    if strange and all(_initials(w) or _known(w) or plain(w).strip("-.") in PARTICLES for w in own):
        own, names = names, own
    name = _person(own, True)[0] if own else ""
    if not name and len(names) > 1:
        name, names = _person(names, False, bold)
    if not name:
        name = _surname(own)
    return ("p", name, *_given(names, bold)) if name else None


def _order_free(tokens: list[str]) -> list[str]:
    """The words of a name without particles; none if an initial shows which of them are given."""
    if any(_initials(t) for t in tokens):
        return []
    return [t for t in tokens if not (plain(t).strip("-.'’") in PARTICLES or t.isupper() and plain(t) in TITLES | SUFFIXES)]


def readings(surname: str | None, given: list | None, org: str | None, contributor: str | None) -> list[tuple[str, str, str, list[str], str]]:
    """What a mention may mean: first as ``mention`` reads it, then, for a person, its words in the other orders and its
    fields exchanged. A comma or an initial settles the order."""
    first = mention(surname, given, org, contributor)
    if first is None or first[0] != "p":
        return [first] if first else []
    s, o, c = ((x or "").strip() for x in (surname, org, contributor))
    g = [x.strip() for x in given or [] if x and x.strip()]
    text = o or c or ("" if g else s)
    ways = []
    if text and not (s and g):
        if "," not in text:
            w = _order_free([w for w in _words(text) if plain(w.strip(".")) not in TITLES])
            ways = [(w[1:], w[:1]), (w[:-1], w[-1:]), (w[:1], w[1:]), (w[-1:], w[:-1])] if len(w) > 1 else []
    else:
        own, other = [w for w in _words(s) if plain(w.strip(".")) not in TITLES], [w for x in g for w in _words(x)]
        if _order_free(own) and _order_free(other):
            ways = [(_order_free(own), _order_free(other)), (_order_free(other), _order_free(own))]
    found = [first]
    for name, names in ways:
        way = ("p", _surname(name), *_given(names))
        if way[1] and way not in found:
            found.append(way)
    return found


_SCHEMA = pa.schema([("name_id", pa.int64()), ("w", pa.int64()), ("reading", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("initial", pa.string()), ("further", pa.list_(pa.string())), ("second", pa.string())])


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(n, w, i, *m) for n, w, *x in zip(*(c.to_pylist() for c in b.columns)) for i, m in enumerate(readings(*x))]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 8, _SCHEMA)], schema=_SCHEMA)


def star(words: DataFrame) -> DataFrame:
    """``key, word, canon``: each word's most frequent neighbour of at most one edit within its key, or itself.

    ``words`` has key, word and n. What is left of a word without one letter is the form that two neighbours share, so
    they meet in an equi-join.
    """
    forms = F.explode(F.array_distinct(F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word")))))))
    v = words.where(F.length("word") > 2).select("key", "word", "n", forms.alias("form"))
    a, b = v.alias("a"), v.alias("b")
    more = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.word") < F.col("a.word")))
    often = (F.col("a.n") <= 2) | (F.col("b.n") >= 3 * F.col("a.n"))
    edits = F.levenshtein(F.col("a.word"), F.col("b.word"))
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    close = (edits <= 1) | ((edits == 2) & (F.length("a.word") == F.length("b.word")) & (letters("a.word") == letters("b.word")))
    best = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.form") == F.col("b.form")))
        .where(more & often & (F.length("a.word") > 3) & close)
        .groupBy(F.col("a.key").alias("key"), F.col("a.word").alias("word"))
        .agg(F.max_by("b.word", F.struct(F.col("b.n"), F.col("b.word"))).alias("to"))
    )
    # an edge leads to a more frequent word, so chains end; each round doubles how far an edge leads
    best = cut(best)
    while not best.join(best.select("key", F.col("word").alias("to")), ["key", "to"], "left_semi").isEmpty():
        hop = best.select("key", F.col("word").alias("to"), F.col("to").alias("next"))
        best = cut(best.join(hop, ["key", "to"], "left").select("key", "word", F.coalesce("next", "to").alias("to")))
    # cut, as the joins of several of these in one plan would weigh on the driver
    return cut(words.select("key", "word").join(best, ["key", "word"], "left").select("key", "word", F.coalesce("to", "word").alias("canon")))


#: What a mention counts for the form it is read as at first, and for its others.
FIRST, OTHER = 100, 1


def _settled(m: DataFrame) -> DataFrame:
    """One reading of each mention: of several the form that most mentions have, those of a bare initial included; ties
    by the form, so that all mentions of the same forms take the same. Misspelt words count as what they come from."""
    p = m.where(F.col("kind") == "p").select("name_id", "w", "reading", "name", "initial", F.explode_outer("further").alias("g"))
    words = p.select("w", F.explode(F.array_compact(F.array("name", "g"))).alias("word")).groupBy(F.lit("").alias("key"), "word").agg(F.sum("w").alias("n"))
    canon = star(words).select("word", "canon")
    p = p.join(canon.select(F.col("word").alias("name"), F.col("canon").alias("s")), "name").join(canon.select(F.col("word").alias("g"), F.col("canon").alias("c")), "g", "left")
    p = cut(p.select("name_id", "w", "reading", "s", "initial", "c").distinct())
    counts = p.where(F.col("c").isNotNull()).groupBy("s", "c").agg(F.sum(F.col("w") * F.when(F.col("reading") == 0, FIRST).otherwise(OTHER)).alias("n"))
    bare = p.where(F.col("c").isNull() & (F.col("reading") == 0)).groupBy("s", "initial").agg((F.sum("w") * FIRST).alias("b"))
    open_ = p.join(p.where(F.col("reading") > 0).select("name_id").distinct(), "name_id", "left_semi")
    score = F.coalesce("n", F.lit(0)) + F.coalesce("b", F.lit(0))
    best = open_.join(counts, ["s", "c"], "left").withColumn("initial", F.coalesce(F.substring("c", 1, 1), "initial")).join(bare, ["s", "initial"], "left")
    best = best.groupBy("name_id").agg(F.max_by("reading", F.struct(score, F.col("s"), F.col("c"))).alias("best"))
    return m.join(best, "name_id", "left").where(F.col("reading") == F.coalesce("best", F.lit(0))).drop("reading", "best")


def _people(m: DataFrame) -> DataFrame:
    """``name_id, entity`` of the persons."""
    p = m.where(F.col("kind") == "p").select("name_id", "w", "name", "initial", "second", F.explode_outer("further").alias("g")).withColumn("i", F.coalesce(F.substring("g", 1, 1), "initial"))
    types = p.groupBy("i", "name").agg(F.sum("w").alias("k"))
    overall = types.groupBy("name").agg(F.sum("k").alias("n"))
    surnames = star(types.join(overall, "name").select(F.col("i").alias("key"), F.col("name").alias("word"), "n"))
    p = p.join(surnames.select(F.col("key").alias("i"), F.col("word").alias("name"), F.col("canon").alias("s")), ["i", "name"])
    given = star(p.where(F.col("g").isNotNull()).groupBy(F.col("s").alias("key"), F.col("g").alias("word")).agg(F.sum("w").alias("n")))
    known = F.array(*[F.lit(n) for n in NICKNAMES])
    given = given.withColumn("canon", F.when(F.array_contains(known, F.col("word")), F.col("word")).otherwise(F.col("canon")))
    p = cut(p.join(given.select(F.col("key").alias("s"), F.col("word").alias("g"), F.col("canon").alias("given")), ["s", "g"], "left"))
    full = p.where(F.col("given").isNotNull())
    sure = full.join(full.groupBy("name_id").agg(F.count(F.lit(1)).alias("ways")), "name_id").groupBy("s", "i", "given").agg(F.sum(F.col("w") * F.when(F.col("ways") == 1, 1.0).otherwise(0.01)).alias("n"))
    seconds = full.where(F.col("second") != "").select("s", "given", "second").distinct().withColumn("same", F.lit(1))
    # of several formal names the one that this surname has; ties by the name
    named = full.join(sure, ["s", "i", "given"]).groupBy("name_id").agg(F.max_by(F.struct("s", "given"), F.struct("n", "given")).alias("e"))
    bare = p.where(F.col("given").isNull())
    fits = (
        bare.select("s", "i", "second").distinct().join(sure, ["s", "i"]).join(seconds, ["s", "given", "second"], "left")
        .groupBy("s", "i", "second").agg(F.max_by("given", F.struct(F.coalesce("same", F.lit(0)), "n", "given")).alias("given"))
    )
    rest = bare.drop("given").join(fits, ["s", "i", "second"], "left").select("name_id", F.concat_ws("|", F.lit("p"), "s", F.coalesce("given", F.concat(F.lit("~"), "i"))).alias("entity"))
    return named.select("name_id", F.concat_ws("|", F.lit("p"), "e.s", "e.given").alias("entity")).unionByName(rest)


def _written_out(b: DataFrame) -> DataFrame:
    """The words of bodies' fields with shortened ones written out: a word of three letters or more that begins another
    one of the same place and kind of body, else of any place, becomes that one, if it has a stop or is the less frequent;
    of several the most frequent."""
    begin = F.explode(F.transform(F.sequence(F.lit(3), F.length("w") - 1), lambda i: F.substring(F.col("w"), F.lit(1), i))).alias("p")
    for keys in (["place", "body"], ["body"]):
        n = b.where(F.col("w") != "").groupBy(*keys, "w", "dot").agg(F.sum("times").alias("n"))
        longer = n.where((F.length("w") > 3) & ~F.col("dot")).select(*keys, F.col("w").alias("long"), F.col("n").alias("k"), begin)
        to = n.join(longer.withColumnRenamed("p", "w"), [*keys, "w"]).where(F.col("dot") | (F.col("k") > F.col("n"))).groupBy(*keys, "w", "dot").agg(F.max_by("long", F.struct("k", "long")).alias("long"))
        b = b.join(to, [*keys, "w", "dot"], "left").withColumn("dot", F.col("dot") & F.col("long").isNull()).withColumn("w", F.coalesce("long", "w")).drop("long")
    return b.drop("dot")


def _bodies(m: DataFrame) -> DataFrame:
    """``name_id, entity`` of the bodies."""
    b = m.where(F.col("kind") == "b").select("name_id", F.col("w").alias("times"), F.col("name").alias("place"), F.col("initial").alias("body"), F.posexplode_outer("further").alias("at", "w"))
    w = b.where(F.col("w").isNotNull() & ~F.col("w").endswith("."))
    words = star(w.groupBy(F.lit("").alias("key"), F.col("w").alias("word")).agg(F.sum("times").alias("n")))
    b = b.join(words.select(F.col("word").alias("w"), "canon"), "w", "left").withColumn("dot", F.coalesce(F.col("w").endswith("."), F.lit(False))).withColumn("w", F.rtrim(F.coalesce("canon", "w", F.lit("")), F.lit("."))).drop("canon")
    b = cut(_written_out(b))
    field = F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"])
    b = b.groupBy("name_id", "times", "place", "body").agg(field.alias("field"))
    acronym = F.concat(F.substring("body", 1, 1), F.array_join(F.transform("field", lambda x: F.substring(x, 1, 1)), ""))
    b = b.select("name_id", F.col("times").alias("w"), "place", acronym.alias("acronym"), F.concat_ws("|", F.lit("b"), "body", F.array_join("field", "-")).alias("full"))
    a = m.where(F.col("kind") == "a").select("name_id", "w", F.col("name").alias("place"), F.col("initial").alias("acronym"), F.lit(None).cast("string").alias("full"))
    both = cut(b.unionByName(a))
    places = star(both.groupBy(F.col("acronym").alias("key"), F.col("place").alias("word")).agg(F.sum("w").alias("n")))
    both = both.join(places.select(F.col("key").alias("acronym"), F.col("word").alias("place"), F.col("canon").alias("at")), ["acronym", "place"])
    one = both.where(F.col("full").isNotNull()).groupBy("acronym", "at", "full").agg(F.sum("w").alias("n")).groupBy("acronym", "at").agg(F.max_by("full", F.struct("n", "full")).alias("meant"))
    both = both.join(one, ["acronym", "at"], "left")
    return both.select("name_id", F.concat_ws("|", F.coalesce("full", "meant", F.concat(F.lit("a|"), "acronym")), "at").alias("entity"))


def entities(names: DataFrame) -> DataFrame:
    """``name_id, entity``: who or what each mention means. Equal spellings mean the same, so only distinct ones are read
    and joined, each with how often it occurs; the mentions are joined with them once, at the end."""
    n = latest(names, ["name_id"], ["seen_at"], ["surname", "given", "org", "contributor"]).where(F.col("name_id").isNotNull())
    spelling = F.unhex(F.md5(F.to_json(F.struct("surname", "given", "org", "contributor"))))
    n = cut(n.select("name_id", spelling.alias("spelling"), "surname", "given", "org", "contributor"))
    # the first mention of a spelling stands for all
    distinct = cut(n.groupBy("spelling").agg(F.min("name_id").alias("first"), F.count(F.lit(1)).alias("w"), *[F.first(c).alias(c) for c in ("surname", "given", "org", "contributor")]))
    read = distinct.select(F.col("first").alias("name_id"), "w", "surname", "given", "org", "contributor")
    m = cut(even(read, "name_id").mapInArrow(_mentions, "name_id bigint, w bigint, reading int, kind string, name string, initial string, further array<string>, second string"))
    m = cut(_settled(m))
    found = _people(m).unionByName(_bodies(m)).join(distinct.select(F.col("first").alias("name_id"), "spelling", "w"), "name_id")
    more = n.join(found.where(F.col("w") > 1).select("spelling", "entity"), "spelling").select("name_id", "entity")
    return found.where(F.col("w") == 1).select("name_id", "entity").unionByName(more)


#: Mentions of one entity that are paired in one task with as many others.
BLOCK = 2000


def pairs(members: DataFrame) -> DataFrame:
    """``name_a, name_b``: every two mentions of one entity, the smaller first. A large entity is joined in blocks."""
    m = cut(members)
    size = m.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    own = m.join(size, "entity").withColumn("own", F.pmod(F.xxhash64("name_id"), F.col("blocks")))
    sides = own.select("entity", "name_id", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    sides = sides.select("entity", "name_id", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    a, b = sides.alias("a"), sides.alias("b")
    return (
        a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi")) & (F.col("a.name_id") < F.col("b.name_id")))
        .where((F.col("a.lo") == F.col("a.hi")) | (F.col("a.own") != F.col("b.own")))
        .select(F.col("a.name_id").alias("name_a"), F.col("b.name_id").alias("name_b"))
    )


def same_names(names: DataFrame) -> DataFrame:
    """``name_a, name_b``: each pair of mentions that mean the same person or body."""
    return pairs(entities(names))
