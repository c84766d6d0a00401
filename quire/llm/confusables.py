"""Text that looks the same and is made of other characters (problem 4).

The resolved script sets of a token's letters (their script extensions; Han and kana count as Japanese, Han and Hangul
as Korean and so on) are intersected. An empty intersection is a mixed-script token, and its look-alike letters go to
the script that spells the whole token. A token whose letters all have doubles in another script is a whole-script
confusable: the words beside it decide, and where they don't, the spelling that the tables use far more often. The
doubles come from the public Unicode confusables that Spark's own ICU library holds; without a session, from the fixed
letters of Cyrillic and Greek below. The remaining forms (width, ligatures, composition, spaces, invisible characters)
are normalised by their character properties.

Defined results: null text is no case and stays null; empty text is in the consistent form; repeated deliveries
count once; wrongly decoded words are left alone. Joiners between letters of scripts that spell with them, wide
punctuation beside wide scripts, superscripts, fractions, dashes, typographic quotes, Greek letters on their own
and line breaks are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import mojibake
from quire.session import cut
from quire.sources.tables import latest

# Letters of other scripts that look like Latin ones.
CYRILLIC = "АВЕЅІЈКМНОРСТХУаеѕіјһорсхуԁԛԝѵӏ"
CYRILLIC_AS = "ABESIJKMHOPCTXYaesijhopcxydqwvl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανιορυϲϳγ"
GREEK_AS = "ABEZHIKMNOPTYXaviopucjy"
# Short names of scripts, and of those whose letters have much the same shapes.
SCRIPTS = (
    "Latn Grek Cyrl Armn Hebr Arab Syrc Thaa Nkoo Deva Beng Guru Gujr Orya Taml Telu Knda Mlym Sinh Thai Laoo Tibt Mymr Geor Hang Ethi Cher Cans Ogam Runr Khmr Mong Hira Kana Bopo Hani Yiii"
    " Goth Copt Glag Tfng Lisu Vaii Bamu Osma Dsrt Limb Tale Bugi Bali Cham Java Sund Lepc Olck Saur Kali Rjng Tavt Mtei Cakm Adlm Elba Ital Perm Shaw Plrd Wara Medf"
).split()
SHAPES = "Latn Grek Cyrl Armn Cher Lisu Copt Tfng Dsrt Osma Ital Elba Wara Medf".split()
#: Scripts that are written together, by the name of what they make up.
_TOGETHER = {"Hani": ("Hanb", "Jpan", "Kore"), "Hira": ("Jpan",), "Kana": ("Jpan",), "Hang": ("Kore",), "Bopo": ("Hanb",)}
#: Scripts whose spelling needs joiners.
_JOINING = set("Arab Syrc Nkoo Mong Deva Beng Guru Gujr Orya Taml Telu Knda Mlym Sinh".split())
#: How much more often the other spelling must occur.
TIMES = 8

_PATTERNS = {s: regex.compile(rf"\p{{scx={s}}}") for s in SCRIPTS}
_ANY = regex.compile(r"[\p{scx=Zyyy}\p{scx=Zinh}]")


@lru_cache(50_000)
def scripts(c: str) -> frozenset[str] | None:
    """The resolved script set of a character; None stands for all scripts."""
    if c.isascii():
        return _LATIN if c.isalpha() else None
    if _ANY.match(c):
        return None
    own = {s for s, p in _PATTERNS.items() if p.match(c)}
    return frozenset(own.union(*(_TOGETHER[s] for s in own if s in _TOGETHER))) or None


_LATIN = frozenset({"Latn"})


def letter_scripts(c: str) -> frozenset[str] | None:
    """The same of a letter; marks and others go with any script."""
    return scripts(c) if c.isalpha() else None


def resolved(token: str) -> frozenset[str] | None:
    """The scripts that spell a whole token: none for a mixed one; None stands for all."""
    left: frozenset[str] | None = None
    for c in token:
        own = letter_scripts(c)
        if own is not None:
            left = own if left is None else left & own
    return left


class Doubles:
    """Letters that look the same in scripts of much the same shapes, from the prototype that each letter looks like."""

    def __init__(self, prototypes: dict[str, str]):
        self.prototypes = prototypes
        self.by: dict[tuple[str, str, str], str] = {}
        for c in sorted(prototypes, key=ord, reverse=True):
            for s in scripts(c) or ():
                self.by[prototypes[c], s, _case(c)] = c  # of several the first
        self.memo: dict[tuple[str, str], str | None] = {}

    def double(self, c: str, script: str) -> str | None:
        """The letter of a script that looks like another, of the same case."""
        if (c, script) not in self.memo:
            p = self.prototypes.get(c)
            self.memo[c, script] = None if p is None else next((d for k in (_case(c), *("" if _case(c) else "Ul")) if (d := self.by.get((p, script, k)))), None)
        return self.memo[c, script]

    def latin(self, c: str) -> str:
        """The Latin double of a letter, or itself."""
        own = scripts(c)
        return c if own is None or "Latn" in own else self.double(c, "Latn") or c

    def plain(self, c: str) -> str:
        """The usual letter that a phonetic letter of Latin looks like, or itself."""
        p = self.prototypes.get(c, c) if _PHONETIC.match(c) else c
        return p if len(p) == 1 and p.isascii() and p.isalpha() else c


_PHONETIC = re.compile("[\u0250-\u02af\u1d00-\u1dbf\ua720-\ua7ff\uab30-\uab6f]")


def _case(c: str) -> str:
    return "U" if c.isupper() else "l" if c.islower() else ""


#: The fixed letters only.
BASIC = Doubles({c: c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"} | dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)))


def unicode_prototypes(spark: SparkSession) -> dict[str, str]:
    """The prototypes of the public Unicode confusables, for letters of scripts of much the same shapes. Between Latin,
    Cyrillic and Greek the fixed letters hold, which are the same in print and not only alike."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    builder = jvm.java.lang.Class.forName("com.ibm.icu.text.SpoofChecker$Builder").getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0))
    checker = builder.newInstance(gateway.new_array(jvm.java.lang.Object, 0)).build()
    letters = [c for c in map(chr, range(0x80, 0x1F000)) if unicodedata.category(c)[0] == "L" and not 0x2E80 <= ord(c) < 0xA000 and not 0xAC00 <= ord(c) < 0xFB00 and (scripts(c) or _LATIN) & set(SHAPES)]
    # the checker takes capital I for small l; here case tells them apart
    found = {c: p for c, p in zip(letters, checker.getSkeleton(0, "\n".join(letters)).split("\n")) if not scripts(c) or _PHONETIC.match(c) or not scripts(c) & {"Latn", "Cyrl", "Grek"}}
    return {c: "I" if p == "l" and c.isupper() else p for c, p in found.items() if len(p) == 1} | BASIC.prototypes


#: Arabic letters that Persian writes with other code points.
_ARABIC = {"ي": "ی", "ى": "ی", "ك": "ک", "ە": "ه"}
_HIDDEN = set("͏ᅟᅠ឴឵ㅤﾠ")
_JOINERS = "‌‍"
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-෿‌‍]|[^\W\d_])*")
_WIDE = re.compile("[⺀-⿟぀-ヿ㐀-鿿豈-﫿가-힯]")
_TAGS = {"<wide>", "<narrow>", "<small>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _joined(c: str) -> bool:
    return bool((scripts(c) or _LATIN) & _JOINING)


def _joining(text: str, i: int) -> bool:
    """Whether a joiner stands where the spelling may need it: after a letter of an Arabic or Indic script, or in an emoji."""
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if not before:
        return False
    if _joined(before):
        return not after or _joined(after) or not after.isalnum()
    return bool(after) and unicodedata.category(before) in ("So", "Sk", "Mn") and unicodedata.category(after) == "So"


@lru_cache(20_000)
def _compatible(c: str) -> str | None:
    """The plain form of a compatibility character of which another looks the same; None if it stays."""
    tag = unicodedata.decomposition(c).split(" ")[0]
    if tag not in _TAGS:
        return None
    cat, o = unicodedata.category(c), ord(c)
    if 0xE00 <= o < 0x1000:
        return None  # vowels that these scripts write as one
    if cat[0] in "L" or cat == "Nd" or 0x2E80 <= o < 0x2FE0 or tag == "<narrow>":
        return unicodedata.normalize("NFKC", c)
    if tag in ("<wide>", "<small>"):
        return unicodedata.normalize("NFKC", c)
    return None


def _plain(text: str) -> str:
    """The text with plain spaces, nothing invisible, composed and of usual width."""
    wide = bool(_WIDE.search(text))
    out = []
    for i, c in enumerate(text):
        if c < "\x7f":
            out.append(c)
            continue
        cat = unicodedata.category(c)
        if cat == "Zs":
            out.append(" ")
        elif cat == "Cf" or c in _HIDDEN or 0xFE00 <= ord(c) <= 0xFE0F:
            if c in _JOINERS and _joining(text, i) or 0xFE00 <= ord(c) <= 0xFE0F and unicodedata.category(text[i - 1 : i] or "a") in ("So", "Sm", "Po", "Nd"):
                out.append(c)
        else:
            new = _compatible(c)
            if new is None or wide and unicodedata.category(c)[0] in "PS" and unicodedata.decomposition(c).startswith("<wide>"):
                out.append(c)
            else:
                out.append(new)
    return unicodedata.normalize("NFC", "".join(out))


def whole(token: str, script: str, doubles: Doubles = BASIC) -> bool:
    """Whether each letter of a token of one script has a double in another."""
    if script == "Latn":
        return any(all(doubles.double(c, s) for c in token) for s in ("Cyrl", "Grek"))
    return all(doubles.latin(c) != c for c in token)


def skeleton(token: str, doubles: Doubles = BASIC) -> str:
    """One spelling for all that look like it."""
    return "".join(_ARABIC.get(c, doubles.latin(c)) for c in token if c not in _JOINERS)


def _one_script(token: str, doubles: Doubles) -> str | None:
    """A mixed token in the script that can spell all of it; None if it is no mixture of doubles."""
    present = Counter(min(own) for c in token if (own := letter_scripts(c)))
    if "Latn" in present:
        foreign = [c for c in token if (own := letter_scripts(c)) and "Latn" not in own]
        if set(present) == {"Latn", "Grek"} and not any(doubles.latin(c) != c for c in foreign):
            return None  # such as a unit with a Greek sign
        if all(doubles.latin(c) != c for c in foreign):
            return "".join(map(doubles.latin, token))
    for s in sorted(present, key=lambda s: (s not in ("Cyrl", "Grek"), s != "Cyrl", -present[s], s)):
        if s != "Latn" and s in SHAPES:
            new = "".join(c if (own := letter_scripts(c)) is None or s in own else doubles.double(c, s) or c for c in token)
            if all((own := letter_scripts(c)) is None or s in own for c in new):
                return new
    new = "".join(map(doubles.latin, token)) if set(present) <= set(SHAPES) else token
    return new if new != token else None


def _script(token: str) -> str:
    """The script of a token's letters, the Latin one before others."""
    own = resolved(token)
    return "-" if not own else next((s for s in ("Latn", "Cyrl", "Grek") if s in own), min(own))


def _runs(start: int, token: str) -> list[tuple[int, int, str]]:
    """(start, end, letters) of the parts of a token in scripts of much the same shapes and in others, as those without
    spaces stand beside names in Latin."""
    if token.isascii():
        return [(start, start + len(token), token)]
    cuts, last = [0], None
    for i, c in enumerate(token):
        own = letter_scripts(c)
        if own is not None:
            alike = not own.isdisjoint(_SHAPES)
            if last is not None and alike != last:
                cuts.append(i)
            last = alike
    return [(start + a, start + b, token[a:b]) for a, b in zip(cuts, [*cuts[1:], len(token)])]


_SHAPES = frozenset(SHAPES)


def analyse(text: str, doubles: Doubles = BASIC, settled: dict[str, str] | None = None) -> tuple[str, list[str]]:
    """The consistent form as far as the text itself tells, and the tokens that only the tables can settle; of these
    the ones that ``settled`` knows are spelled as it says."""
    if text.isascii() and not _CANDIDATE.search(text):
        return text, []
    plain = text if text.isascii() else _plain(text)
    spans = [span for m in _TOKEN.finditer(plain) for span in _runs(m.start(), m.group())]
    found, kinds, is_open = [], [], []
    for _, _, token in spans:
        if not token.isascii() and any(c.isascii() for c in token):
            token = "".join(map(doubles.plain, token))
        own = resolved(token)
        if own is not None and not own and (one := _one_script(token, doubles)):
            token, own = one, resolved(one)
            found.append(one)
            kinds.append(_script(next(c for c in one if letter_scripts(c))))
            is_open.append(False)
            continue
        found.append(token)
        kinds.append(_script(token))
        is_open.append(kinds[-1] in SHAPES and whole(token, kinds[-1], doubles))
    doubtful: list[str] = []
    for i, kind in enumerate(kinds):
        token = found[i]
        if kind in _JOINING and (any(c in _JOINERS for c in token) or any(c in _ARABIC for c in token)):
            doubtful.append(token)
            found[i] = (settled or {}).get(token, token)
        if not is_open[i]:
            continue
        joined = [j for j in (i - 1, i + 1) if 0 <= j < len(kinds) and plain[min(spans[i][1], spans[j][1]) : max(spans[i][0], spans[j][0])] in ("-", "’", "'")]
        symbol = kind == "Grek" and len(token) == 1
        if symbol and (joined or len(kinds) == 1):
            continue  # a Greek letter as a symbol
        near = [next((kinds[j] for j in r if kinds[j] in SHAPES and not is_open[j]), "") for r in (range(i - 1, -1, -1), range(i + 1, len(kinds)))]
        if kind != "Latn":
            beside = [kinds[j] for j in joined]
            if "Latn" in beside and kind not in beside or near == ["Latn", "Latn"]:
                if not symbol:
                    found[i] = "".join(map(doubles.latin, token))
                continue
            if kind in near:
                continue
        elif near[0] == near[1] and near[0] not in ("", "Latn") and len(token) > 1:
            found[i] = "".join(doubles.double(c, near[0]) or c for c in token)
            continue
        elif "Latn" in near:
            continue
        doubtful.append(token)
        found[i] = (settled or {}).get(token, token)
    out, at = [], 0
    for (start, end, _), new in zip(spans, found):
        out += [plain[at:start], new]
        at = end
    return "".join(out) + plain[at:], doubtful


_CANDIDATE = re.compile(r"(?<![A-Za-z])(?:[" + "".join(sorted(set(CYRILLIC_AS))) + r"]+|[" + "".join(sorted(set(GREEK_AS))) + r"]+)(?![A-Za-z])")

_ROWS = pa.schema([("tab", pa.string()), ("rec_id", pa.int64()), ("text", pa.string()), ("form", pa.string()), ("tokens", pa.list_(pa.string()))])
_DDL = "tab string, rec_id bigint, text string, form string, tokens array<string>"


def _open(text: Column) -> Column:
    """Whether a text isn't in the consistent form for sure, as those in ASCII without a word of doubles only are."""
    return text.rlike(r"[^\x00-\x7f]") | text.rlike(_CANDIDATE.pattern)


def analysed(texts: DataFrame) -> DataFrame:
    """``tab, rec_id, text, form, tokens`` of the texts whose form is another or that have tokens for the tables to
    settle: the form that the text itself tells, and these tokens."""
    spark = texts.sparkSession
    table = spark.sparkContext.broadcast(unicode_prototypes(spark))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubles, known = Doubles(table.value), {}
        for b in batches:
            rows: list[tuple] = []
            for tab, rec, text in zip(*(c.to_pylist() for c in b.columns)):
                got = known.get(text)
                if got is None:
                    form, tokens = analyse(text, doubles)
                    got = form, sorted(set(tokens))
                    if len(text) < 60:
                        if len(known) > 100_000:
                            known.clear()
                        known[text] = got
                if got[1] or got[0] != text:
                    rows.append((tab, rec, text, *got))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _ROWS)], schema=_ROWS)

    return texts.where(_open(F.col("text"))).mapInArrow(run, _DDL)


def settled_tokens(rows: DataFrame) -> DataFrame:
    """``token, other``: the tokens for which the texts far more often have another spelling that looks the same."""
    table = rows.sparkSession.sparkContext.broadcast(unicode_prototypes(rows.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubles = Doubles(table.value)
        for b in batches:
            tokens = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([skeleton(t, doubles) for t in tokens], pa.string()), *b.columns], names=["skeleton", "token", "n"])

    spelled = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).mapInArrow(run, "skeleton string, token string, n bigint")
    best = F.max(F.struct("n", "token")).over(Window.partitionBy("skeleton"))
    rare = spelled.withColumn("best", best).where((F.col("best.n") >= F.col("n") * TIMES) & (F.col("best.n") > 2))
    rare = rare.where(~(F.col("best.token").rlike("[‌‍]") & ~F.col("token").rlike("[‌‍]")))
    return rare.select("token", F.col("best.token").alias("other"))


def table_texts(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """``tab, rec_id, text`` of both tables."""
    w = words.select(F.lit("words").alias("tab"), F.col("word_id").alias("rec_id"), "text")
    return w.unionByName(blocks.select(F.lit("text_blocks").alias("tab"), F.col("block_id").alias("rec_id"), "text"))


def _damaged(words: DataFrame) -> DataFrame:
    return mojibake.damaged_values(cut(mojibake.value_counts(words, ["text"]))).select(F.col("value").alias("text"), F.lit("words").alias("tab"))


def look_alikes(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """``tab, rec_id``: the words and blocks whose text is not in the consistent form."""
    rows = cut(analysed(table_texts(words, blocks)))
    own = rows.where(F.col("form") != F.col("text")).select("tab", "rec_id", "text")
    tokens = rows.select("tab", "rec_id", "text", F.explode("tokens").alias("token")).join(settled_tokens(rows), "token", "left_semi").drop("token")
    return own.unionByName(tokens).join(_damaged(words), ["tab", "text"], "left_anti").select("tab", "rec_id").distinct()


def forms(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """``tab, rec_id, form``: every text in the one form in which equal-looking values are equal; null stays null, and
    wrongly decoded words stay as they are. Rows without an id are left out."""
    w = latest(words.where(F.col("word_id").isNotNull()), ["word_id"], ["loaded_at"], ["text"])
    b = latest(blocks.where(F.col("block_id").isNotNull()), ["block_id"], ["loaded_at"], ["text"])
    texts = table_texts(w, b)
    rows = cut(analysed(texts))
    spark = texts.sparkSession
    table = spark.sparkContext.broadcast(unicode_prototypes(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubles = Doubles(table.value)
        for b in batches:
            new = [analyse(t, doubles, dict(m))[0] for t, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(new, pa.string())], names=["tab", "rec_id", "text", "form"])

    # only texts with tokens that the tables settle are spelled a second time
    second = (
        rows.select("tab", "rec_id", "text", F.explode("tokens").alias("token")).join(settled_tokens(rows), "token")
        .groupBy("tab", "rec_id", "text").agg(F.map_from_entries(F.collect_list(F.struct("token", "other"))).alias("m")).mapInArrow(run, "tab string, rec_id bigint, text string, form string")
    )
    new = rows.select("tab", "rec_id", "text", "form", F.lit(0).alias("turn")).unionByName(second.withColumn("turn", F.lit(1)))
    new = new.join(_damaged(words), ["tab", "text"], "left_anti").groupBy("tab", "rec_id").agg(F.max_by("form", "turn").alias("new"))
    return texts.join(new, ["tab", "rec_id"], "left").select("tab", "rec_id", F.coalesce("new", "text").alias("form"))
