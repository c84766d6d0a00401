"""Sentence boundaries across languages and scripts (problem 1).

Semi-Markov dynamic programming: possible ends are collected in a block, and whole spans between them are chosen so
that the sum of their scores is largest. A span is scored by its length, by its opening (the case of its first word
and whether that word is usually small, so that only its place explains a capital), by its closing word and mark, and
by the quotations and brackets that it leaves open at either side.

What words do is counted in the whole table: a word that often has a stop, but hardly ever as the last of a text, is an
abbreviation that ends nothing; one that is found so both at the end and before small letters may end a sentence. All
words count, whatever their number and length. The most frequent of those that something was learned of, a fixed number,
go to every task with a filter of fixed size over the others; blocks that may hold one of these are joined with what was
learned of it. Lists of usual abbreviations are the opinion to begin with, for texts and tables too small to tell. A short capital word that neither knows counts as one by its shape
(Gov., Insp.), unless a usual opening follows.

Defined results: a block with null text takes its joined runs (a run with null text counts as empty); a block
without either, or of white space only, has no sentences; a heading is one sentence; a repeated delivery counts once;
texts of any length are read whole, and spans of any length are considered.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import ChainMap
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.confusables import analyse
from quire.session import cut, even
from quire.sources.tables import latest

#: Words from which on a span only gets worse by beginning earlier, at an end that is one by itself.
FAR = 60

#: Marks that end a sentence, by themselves or before a word that opens one.
HARD = "。！？।॥።፧؟።｡"
SOFT = ".!?…‽"
CLOSERS = "”’»›)]}）］」』》〉】｣"
NOTE = r"(?:[*†‡]+|[¹²³⁰-⁹]+|\[\d{1,3}\]|\d{1,3}(?![\d.,%年月日]|[A-Za-zÀ-ӿ]))"
OPENERS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "(": ")", "[": "]", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "｢": "｣", "‘": "’"}

# Abbreviations that do not end a sentence before a name, number or title.
TITLES = set(
    "mr mrs ms dr prof gen col lt capt sgt maj rev hon st mt ft fig figs no nos nr vol vols p pp ch chap sec art cf vs v e.g i.e al approx ca inst dept univ ed eds trans op ibid fr hr fa frl abb bd vgl bzw z.b d.h usw s.o geb ggf str"
    " ph mm mlle mme m me mgr env av p.ex c.-à-d janv févr avr juil sept oct nov déc jan feb mar apr jun jul aug sep dec okt dez"
    " sr sra srta d dña dra da ud uds vd avda pág págs cap núm n.º ej p.ej aprox ee"
    " г д им ул т.е т.к т.п т.д см рис с стр д-р проф акад гл тыс млн чел руб"
    " κ κα βλ σελ εικ κεφ αρ δρ πρβλ"
    " د أ ص م ج डॉ श्री पृ सं पं प्रो ดร นาย นาง น.ส พ.ศ ค.ศ".split()
)
#: Abbreviations that may also be the last word of a sentence.
LAST = set("u.s u.k u.n u.s.a e.u etc a.m p.m ltd co inc corp jr sr ph.d m.d b.a m.a usw uu ee.uu j.-c jh ff oz lb in ft cm km kg doz bros mio mrd tsd n.º v.chr n.chr d.c a.c г руб чел тыс и.т.д т.д т.п с.е".split())
# Words that often open a sentence.
OPENING = set(
    "the a an in it he she they we you i when what was were did does do is are who why where how nobody nothing there this that these those if as at on for from then but and by no yes not our his her their my"
    " le la les un une il elle ils on ce cela cet cette et mais où pourquoi qui que quelle quel dans pour au aux en à"
    " der die das ein eine er sie es ist im in am wer wie wo warum und aber dies"
    " el los las un una ella ellos es en por qué que cómo dónde y pero"
    " он она они оно и но а в на по что где как почему это ο η το οι τα και αλλά γιατί πού τι".split()
)
#: Words before a German ordinal.
ORDINAL = set("der die das dem den des am im vom zum zur beim ein einem einen ab bis seit nach vor".split())
#: Particles that close a statement or question in Thai.
THAI = re.compile(r"(?:ครับ|ค่ะ|คะ|จ้ะ|จ๊ะ|นะครับ|นะคะ)(?=[\s\d]|$|[^฀-๿])")
LABEL = re.compile(
    r"\s*(?:[•‣▪–—*†‡]\s+|\(?(?:\d{1,4}(?:\.\d{1,3})*|[ivxlc]{1,5}|[a-zA-Z])[.)]\s+(?=\S)|(?:Fig|Figs|Figure|Table|Tab|Abb|Abbildung|Tabelle|Ch|Рис|Табл|Εικ|Πίν|Cap|Chap|Cuadro|Tableau|Glava|Глава)\.?\s*\d+(?:\.\d+)*\s*[.:—–)]?\s+)+"
)
_END = re.compile(rf"(?:[{HARD}]|[.!?…‽]|;|;)[{HARD}{SOFT}]*")
_NOTE = re.compile(NOTE)
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_BEFORE = re.compile(r"[^\s()\[\]“”«»‘„,;:!?…。！？।።—–]*$")
_MARK = re.compile(rf"[{HARD}{SOFT}]")
_WORD = re.compile(r"[^\W\d_]+(?:[’'.-][^\W\d_]+)*")
_NAMES = re.compile(r"(?:https?://|www\.)\S*|\b[\w-]+(?:\.[\w-]+)+(?:/\S*)?")


def pairs(text: str) -> list[tuple[int, int]]:
    """The balanced quotations and brackets: (opening, closing) positions."""
    stack: list[tuple[int, str]] = []
    found = []
    for i, c in enumerate(text):
        if c == "’":
            inner = 0 < i < len(text) - 1 and text[i - 1].isalpha() and text[i + 1].isalpha()
            if inner or not any(s[1] == "’" for s in stack):
                continue
        if c == '"':
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == '"'), None)
            if at is None:
                stack.append((i, '"'))
            else:
                found.append((stack[at][0], i))
                del stack[at:]
            continue
        at = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 9), -1) if c in stack[k][1]), None)
        if at is not None:
            found.append((stack[at][0], i))
            del stack[at:]
        elif c in OPENERS:
            stack.append((i, OPENERS[c]))
    return found


def _kind(c: str) -> str:
    """Of the character that begins what follows an end: upper, lower, caseless, digit or another."""
    if c.isupper() or unicodedata.category(c) == "Lt":
        return "U"
    if c.islower():
        return "l"
    if c.isdigit():
        return "0"
    return "c" if c.isalpha() else "-"


def ends(text: str, words: Words | None = None) -> list[tuple[int, float, float, int]]:
    """(position, closing, opening, quotations and brackets open there) of the possible ends in a text, without its last."""
    depth = [0] * (len(text) + 1)
    opened = {}
    for a, b in pairs(text):
        depth[a] += 1
        depth[b] -= 1
        opened[b] = a
    total = 0
    for i, d in enumerate(depth):
        total += d
        depth[i] = total
    label = LABEL.match(text)
    head = label.end() if label else 0
    names = [m.span() for m in _NAMES.finditer(text)]
    out: list[tuple[int, float, float, int]] = []
    n = 0
    for m in _END.finditer(text):
        at, end = m.span()
        first = end
        while end < len(text):
            if text[end] in CLOSERS and (end in opened or text[end] != "’") or text[end] in "“\"" and end in opened:
                end += 1
            elif text[end].isspace() and text[end + 1 : end + 2] in ("»", "›"):
                end += 2
            else:
                break
        closed = end
        if note := _NOTE.match(text, end):
            end = note.end()
        while n < len(names) and names[n][1] <= at:
            n += 1
        if end < len(text):
            score = _end_score(text, at, first, closed, end, opened, head, names[n] if n < len(names) and names[n][0] < at else None, words or NOTHING)
            if score and sum(score) > -8:
                out.append((end, *score, depth[end - 1]))
    if "฀" <= max(text, default="") or any("฀" <= c <= "๿" for c in text):
        for m in THAI.finditer(text):
            end = m.end()
            while end < len(text) and text[end] in CLOSERS:
                end += 1
            if end < len(text) and not any(e[0] == end for e in out):
                out.append((end, 3.0, 0.0, depth[end - 1]))
        out.sort()
    return out


def _clean(token: str) -> str:
    return token if token.isascii() else analyse(_HIDDEN.sub("", token))[0]


class Words:
    """What the words of a table do: ``closing`` what a stop behind a word is worth less as an end, ``opening`` how a word
    speaks for an opening. ``others`` is a filter over words that aren't here; those asked for that it may hold are ``asked``."""

    def __init__(self, closing: Mapping[str, float] | None = None, opening: Mapping[str, float] | None = None, others: bytes = b""):
        self.closing, self.opening, self.others = closing or {}, opening or {}, others
        self.asked: set[str] = set()

    def _learned(self, words: Mapping[str, float], word: str) -> float | None:
        value = words.get(word)
        if value is None and self.others:
            bit = zlib.crc32(word.encode("utf-8", "replace")) % (8 * len(self.others))
            if self.others[bit >> 3] >> (bit & 7) & 1:
                self.asked.add(word)
        return value

    def opens(self, word: str) -> float:
        return 1.0 if word in OPENING else self._learned(self.opening, word) or 0.0

    def stops(self, word: str, plain: str) -> float:
        """How much less a stop behind a word is an end, by its letters as written and its plain form."""
        if plain in LAST:
            return OFTEN
        if plain in TITLES or plain.split(".")[-1] in TITLES and "." in plain:
            return NEVER
        learned = self._learned(self.closing, plain)
        if learned is not None:
            return learned
        letters = word.strip("(“‘«„[.’'")
        if 2 <= len(letters) <= 4 and letters.isalpha() and letters[0].isupper() and letters[1:].islower() and letters.isascii():
            # a shortened word: without a vowel, or a first syllable that ends in a consonant
            return SHAPE if letters[-1] not in "aeiouy" else 0.0
        return 0.0


#: What a stop is worth less behind a word that ends nothing, that may also end a sentence, and that looks shortened.
NEVER, OFTEN, SHAPE = 10.5, 2.5, 4.0
NOTHING = Words()


def _end_score(text: str, at: int, first: int, closed: int, end: int, opened: dict, head: int, name: tuple[int, int] | None, words: Words = NOTHING) -> tuple[float, float] | None:
    """(closing, opening): how well a sentence closes at ``end``, by its last word and mark, and how well the next one
    opens there; None where nothing may end. The mark is at ``at`` to ``first``, what closes up to ``closed``, a note
    mark up to ``end``."""
    if end <= head:
        return None
    rest = end
    while rest < len(text) and text[rest].isspace():
        rest += 1
    if rest == len(text):
        return None
    spaced = rest > end
    closer, terminal = closed > first, text[at:first]
    decimal = False
    if terminal == "." and closed == first and text[first : first + 1].isdigit() and not (at and (text[at - 1].isalpha() and text[at - 1] < "ऀ" or text[at - 1] in CLOSERS)):
        decimal = True  # unless the digits are a note mark after a number
        if end == closed or not text[at - 1 : at].isdigit():
            return None
    # what follows, behind dashes, quotes and brackets
    k, dash, quote = rest, False, False
    while k < len(text) and (text[k].isspace() or text[k] in "—–-" or text[k] in OPENERS or text[k] in "¿¡\""):
        dash |= text[k] in "—–-"
        quote |= text[k] in OPENERS or text[k] in "¿¡\""
        k += 1
    kind = _kind(text[k]) if k < len(text) else "-"
    first = text[rest]
    if decimal:
        return (1.5, 0.0) if spaced and (kind == "U" or quote or kind == "c" and _script_of(text[k]) == "H") else None
    if first in ",;:،、，；：·" or first in CLOSERS and first not in "“":
        return None
    word = _WORD.match(text, k)
    opening = _clean(word.group()).casefold() if word else ""
    if terminal[0] in HARD:
        if closer:
            start = opened.get(closed - 1)
            if start is not None and terminal[0] in "。！？｡":
                lead = text[:start].rstrip()
                begins = lead[-1:] not in list(":：,，、")
                if first in "とってっ" or begins and not spaced and first.isalpha():
                    return None
            if terminal[0] == "؟" and _script_of(first) == "A":
                return None
        if first in "とっ":
            return None
        return 4.0, 0.0
    if terminal[0] in ";;":
        # a question mark in Greek only
        before = text[max(0, at - 12) : at]
        return (3.0, 0.0) if any("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in before) and before[-1:] not in " \n" and kind != "l" else None
    before = _clean(_before(text, at))
    last = before.strip(".’'").casefold()
    if kind == "l":
        return None
    if terminal[0] in "!?‽" or "!" in terminal or "?" in terminal:
        if kind == "c" and closer and _script_of(text[k]) in "DA":
            return None  # a quoted question and its speaker
        if kind == "U" or quote:
            return 4.0, 0.0
        if dash and kind != "U":
            return None
        return 4.0, -1.0 if kind in "c0" else -3.0
    if terminal.startswith(("…", "...", "..")):
        if _script_of(first) == "H" == _script_of(text[at - 1]) and not spaced and not closer:
            return None
        if kind == "c":
            other = _script_of(first) == "H" != _script_of(text[at - 1])
            return (3.0, -1.0) if other else (3.0, -2.0) if spaced else None
        return 3.0, 0.0 if kind == "U" or quote else -1.5 if kind == "0" and spaced else -6.0
    # a full stop
    if name and name[1] > at and end == closed:
        inside = text[name[0] : name[1]]
        if "/" in inside or inside.startswith("www.") or not _runs_on(text, at, k):
            return None
    plain = last.lstrip("(“‘«„[")
    if plain not in LAST and plain not in TITLES and "." in plain and len(plain.rsplit(".", 1)[1]) > 0:
        plain = plain.rsplit(".", 1)[1]  # the stop before had no space behind it, or this is an initial
    if not spaced:
        if kind == "0" and not _cjk_year(text, k) or kind == "-":
            return None
        if kind == "U" and not (k + 1 < len(text) and (text[k + 1].islower() or text[k + 1] in " ’.") or quote):
            return None
        if kind == "U" and len(plain) == 1 and before[:1].isupper():
            return None
    if plain == "no" and kind != "0":
        return 3.0, 0.0
    short = words.stops(before, plain)
    if kind == "c" and _script_of(text[k]) in "DA" and not closer:
        # scripts without case: the stop ends a sentence in Arabic, and abbreviates in Hindi
        if short > OFTEN or len(plain) == 1 and plain.isalpha():
            return None
        return 3.0, 0.0 if _script_of(text[k]) == "A" else -2.0
    # how the next sentence would open
    opens = words.opens(opening) if kind == "U" else 0.0
    if kind == "0" and not _cjk_year(text, k):
        opens = -3.0 if spaced else -2.5
        if short == OFTEN:
            return None
    elif short == OFTEN:
        opens = opens if opens > 0 else 1.0 if quote or dash or kind == "c" else -0.2
    elif not (kind == "U" or quote):
        opens = -0.5 if kind == "c" else -2.5
    elif opens > 0:
        opens = 1.5 if short == SHAPE else 0.2  # what is clear without it stays so
    if short > OFTEN and short != SHAPE:
        return (3.5 - short, opens) if not closer else (3.0, 0.0)
    if len(plain) == 1 and plain.isalpha() and not ("⺀" <= plain <= "鿿"):
        return None if not closer else (3.0, 0.0)
    if plain.replace(".", "").replace(",", "").isdigit():
        if kind == "0" and not _cjk_year(text, k):
            return None
        lead = _clean(text[max(0, at - len(before) - 14) : at - len(before)])
        previous = _WORD.findall(lead)
        if kind == "U" and not closer and previous and previous[-1].casefold() in ORDINAL and lead.rstrip().endswith(previous[-1]):
            return None
    return 3.5 - (short if not closer else 0.0), opens


def _before(text: str, at: int) -> str:
    """The token before a position; of more than 40 characters, what follows its last mark."""
    start = at - 40
    token = _BEFORE.search(text, max(0, start), at).group()
    if len(token) == 40 and not _MARK.search(token):
        while start > 0 and _BEFORE.match(text, start - 1, start) and not _MARK.match(text, start - 1):
            start -= 1
        token = text[start:at]
    return token


def _runs_on(text: str, at: int, k: int) -> bool:
    """Whether a stop inside what looks like a file name is an end with a missing space."""
    left = _BEFORE.search(text, max(0, at - 40), at).group()
    right = text[k : k + 2]
    if right[:1].isupper() and (right[1:].islower() or right[1:] in ("", " ", "’", ".")):
        return left[-1:].islower() or left[-1:].isdigit() or left.casefold().strip(".") in LAST
    return bool(right) and _script_of(right[0]) == "H" or _cjk_year(text, k)


def _cjk_year(text: str, k: int) -> bool:
    m = re.compile(r"[\d.,]{1,6}").match(text, k)
    return bool(m) and text[m.end() : m.end() + 1] in ("年", "月")


def _script_of(c: str) -> str:
    o = ord(c)
    if 0x2E80 <= o < 0xA000 or 0xFF00 <= o < 0xFFF0:
        return "H"
    if 0x900 <= o < 0xE00:
        return "D"
    if 0x590 <= o < 0x780:
        return "A"
    return "-"


def _words(text: str) -> int:
    """The length of a span in words; characters without spaces count by halves."""
    n = len(text.split())
    return n + sum(1 for c in text if c >= "฀" and c.isalpha()) // 3


#: What a quotation or bracket costs that is open where a span begins or ends.
OPEN = -4.0


def sentences(text: str, heading: bool = False, known: Words | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, without white space at either end."""
    if not text or text.isspace():
        return []
    found = [] if heading else ends(text, known)
    closed = text.rstrip()[-1]
    at = [0, *(e[0] for e in found), len(text)]
    closing = [0.0, *(e[1] for e in found), 4.0 if closed in HARD + SOFT + CLOSERS + "“\"" else 0.0]
    opening = [0.0, *(e[2] for e in found), 0.0]
    left_open = [0, *(e[3] for e in found), 0]
    words = [0]
    for a, b in zip(at, at[1:]):
        words.append(words[-1] + _words(text[a:b]))
    label = LABEL.match(text)
    if label:
        words = [0] + [max(0, n - len(label.group().split())) for n in words[1:]]
    best, back = [0.0] * len(at), [0] * len(at)
    for j in range(1, len(at)):
        top = None
        for i in range(j - 1, -1, -1):
            n = words[j] - words[i]
            # short spans are unlikely unless their mark is strong, and so are very long ones
            length = (-1.6 if n <= 1 else -1.2 if n == 2 else -0.9 if n == 3 else -0.2 if n == 4 else 0.0) - 0.01 * max(0, n - 40)
            balance = OPEN * (left_open[i] + left_open[j])
            if n <= 4 and closing[j] + (opening[j] if j < len(at) - 1 else 0.0) + 2 * OPEN * left_open[j] >= 3:
                length = 0.0
            value = best[i] + opening[i] + closing[j] + length + balance
            if top is None or value > top:
                top, back[j] = value, i
            if i < j and n > FAR and opening[i] + closing[i] + 2 * OPEN * left_open[i] > 0:
                break  # a longer span is worse than this one and the one before it
        best[j] = top
    cuts, j = [], len(at) - 1
    while j:
        cuts.append((at[back[j]], at[j]))
        j = back[j]
    out = []
    for a, b in reversed(cuts):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def block_texts(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """``block_id, kind, text`` of the latest delivery of each block, with the joined runs where it has no text."""
    b = latest(blocks.where(F.col("block_id").isNotNull()), ["block_id"], ["loaded_at"], ["kind", "text"])
    own = b.where(F.col("text").isNotNull())
    # the runs of one block are as many as its formats; a run delivered again is the same run
    joined = (
        runs.where(F.col("block_id").isNotNull())
        .groupBy("block_id", "run_ix")
        .agg(F.max(F.coalesce("text", F.lit(""))).alias("t"))
        .groupBy("block_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ix", "t"))), lambda x: x["t"]), "").alias("text"))
    )
    return own.unionByName(b.where(F.col("text").isNull()).drop("text").join(joined, "block_id"))


#: How much likelier the counts of a word must be for an abbreviation, as a natural logarithm.
SURE = 6.0
#: Share of a word's stops that must go on, and that must end, for a word that does both.
BOTH = 0.05
#: Words that go to every task, at most, and bits of the filter over the others.
SLOTS, BITS = 1 << 17, 1 << 23


_OPENS = "small > capital AND n >= 3"
_LETTERS_FIRST = r"^[^\p{L}\p{N}]*"


def _core(token: Column) -> Column:
    """The word of a token in small letters, without marks at either end."""
    return F.lower(F.regexp_extract(token, r"([\p{L}\p{N}](?:.*[\p{L}\p{N}])?)", 1))


def word_counts(texts: DataFrame) -> DataFrame:
    """A row for each word ``w`` without digits of a column of texts: how often it is there, small and as a capital; how
    many stops behind it end a text, precede an opening, another capital, or small letters and digits; how often it has none.

    What precedes a capital is first counted by the word that has it, as whether a word is usually small, so that only its
    place at an opening explains a capital, is known when all are counted.
    """
    tokens = texts.where(F.col("text").isNotNull()).select(F.filter(F.split("text", r"\s+"), lambda t: t != "").alias("t")).where(F.size("t") > 0)
    each = tokens.select(F.explode(F.arrays_zip(F.col("t").alias("t"), F.concat(F.slice("t", F.lit(2), F.size("t")), F.array(F.lit(""))).alias("u"))).alias("x")).select("x.t", "x.u")
    small, capital = F.col("t").rlike(_LETTERS_FIRST + r"\p{Ll}"), F.col("t").rlike(_LETTERS_FIRST + r"\p{Lu}")
    stop = F.col("t").rlike(r"[\p{L}\p{N}]\.[\"”’»)\]]*$")
    next_capital = stop & F.col("u").rlike(_LETTERS_FIRST + r"\p{Lu}")
    count = {"small": small, "capital": capital, "end": stop & (F.col("u") == ""), "next": next_capital, "on": stop & F.col("u").rlike(r"^[\p{Ll}\p{N},;]"), "free": ~stop}
    each = each.withColumn("w", _core(F.col("t"))).where(F.col("w").rlike(r"^[^\p{N}]+$"))
    each = each.withColumn("o", F.when(next_capital, _core(F.col("u"))).otherwise(F.concat(F.lit("."), "w")))  # no word begins with a stop
    sums = cut(each.groupBy("w", "o").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("bigint")).alias(k) for k, c in count.items()]))
    openers = sums.groupBy("w").agg(*[F.sum(k).alias(k) for k in ("n", "small", "capital")]).where(_OPENS).select(F.col("w").alias("opener"))
    sums = sums.join(openers, F.col("o") == F.col("opener"), "left").withColumn("anew", F.when(F.col("opener").isNotNull() | F.col("o").isin(sorted(OPENING)), F.col("next")).otherwise(0))
    return cut(sums.groupBy("w").agg(*[F.sum(k).alias(k) for k in ("n", "small", "capital", "end", "anew", "on", "free")], F.sum(F.col("next") - F.col("anew")).alias("name")))


def judged(counts: DataFrame) -> DataFrame:
    """``w, n, closing, opening``: what the stops of the counted words are worth less as ends, and whether the words open; of
    words that say either."""
    stopped = ("end", "anew", "name", "on")
    total = counts.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in stopped]).first()
    # of the stops of ordinary words
    ends = min(0.5, max(0.02, total["end"] / max(1, sum(total))))
    anew = min(0.9, max(0.1, total["anew"] / max(1, total["anew"] + total["name"])))
    end, new, name, on = map(F.col, stopped)
    stops = end + new + name + on
    both = (on >= BOTH * stops) & (end + new >= BOTH * stops)
    # of an abbreviation one stop in a hundred ends a text, one in fifty precedes an opening and a third small letters
    likely = end * math.log(0.01 / ends) + (stops - end) * math.log(0.99 / (1 - ends))
    likely += new * math.log(0.02 / anew) + name * math.log(0.98 / (1 - anew)) + on * math.log(0.33 / 0.02)
    closing = F.when((stops >= 3) & (stops >= F.col("free")), F.when(both, OFTEN).when(likely > SURE, NEVER))
    return counts.select("w", "n", closing.alias("closing"), F.when(F.expr(_OPENS), 1.0).alias("opening")).where("closing IS NOT NULL OR opening IS NOT NULL")


def held(words: DataFrame) -> tuple[Words, DataFrame | None]:
    """The most frequent of the judged words, at most ``SLOTS``, with a filter over the others; and the others, if any."""
    least, room = 0, SLOTS
    for r in sorted(words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow().to_pylist(), key=lambda r: -r["n"]):
        room -= r["words"]
        if room < 0:
            least = r["n"] + 1
            break
    rows = words.where(F.col("n") >= least).toArrow().to_pylist()
    closing, opening = ({r["w"]: r[k] for r in rows if r[k] is not None} for k in ("closing", "opening"))
    if not least:
        return Words(closing, opening), None
    others = words.where(F.col("n") < least)
    bits = others.select((F.crc32(F.col("w").cast("binary")) % BITS).cast("int").alias("bit")).groupBy(F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.expr("1 << (bit & 7)")).alias("b")).toArrow()
    filled = bytearray(BITS >> 3)
    for at, b in zip(*(c.to_pylist() for c in bits.columns)):
        filled[at] = b
    return Words(closing, opening, bytes(filled)), others


def word_table(texts: DataFrame) -> Words:
    """What the words of a column of texts do, from counts over all of them; at most ``SLOTS`` words reach the driver."""
    return held(judged(word_counts(texts)))[0]


_ROWS = pa.schema([("block_id", pa.int64()), ("start_char", pa.int32()), ("end_char", pa.int32())])


_ASKED = pa.schema([*_ROWS, ("kind", pa.string()), ("text", pa.string()), ("asked", pa.list_(pa.string()))])
_FOUND = "block_id bigint, start_char int, end_char int"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def block_sentences(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """``block_id, start_char, end_char``: the sentences of every block."""
    words, others = held(judged(word_counts(blocks.select("text"))))
    known = blocks.sparkSession.sparkContext.broadcast((words.closing, words.opening, words.others))  # of at most SLOTS words and BITS bits
    texts = even(block_texts(blocks, runs).select("block_id", "kind", "text"), "block_id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(*known.value)
        for b in batches:
            yield _batch([(block, s, e) for block, kind, text in zip(*(c.to_pylist() for c in b.columns)) for s, e in sentences(text, kind == "heading", own)], _ROWS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sentences of blocks, or their texts with the words that others may tell something of."""
        own = Words(*known.value)
        for b in batches:
            rows: list[tuple] = []
            for block, kind, text in zip(*(c.to_pylist() for c in b.columns)):
                own.asked.clear()
                found = sentences(text, kind == "heading", own)
                rows += [(block, None, None, kind, text, sorted(own.asked))] if own.asked else [(block, s, e, None, None, None) for s, e in found]
            yield _batch(rows, _ASKED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing, opening, _ = known.value
        for b in batches:
            rows: list[tuple] = []
            for block, kind, text, told in zip(*(c.to_pylist() for c in b.columns)):
                own = [{r["w"]: r[k] for r in told or [] if r[k] is not None} for k in ("closing", "opening")]
                rows += [(block, s, e) for s, e in sentences(text, kind == "heading", Words(ChainMap(own[0], closing), ChainMap(own[1], opening)))]
            yield _batch(rows, _ROWS)

    if others is None:
        return texts.mapInArrow(split, _FOUND)
    first = cut(texts.mapInArrow(ask, _FOUND + ", kind string, text string, asked array<string>"))
    unsure = first.where(F.col("asked").isNotNull())
    told = unsure.select("block_id", F.explode("asked").alias("w")).join(others, "w").groupBy("block_id").agg(F.collect_list(F.struct("w", "closing", "opening")).alias("told"))
    again = even(unsure.select("block_id", "kind", "text").join(told, "block_id", "left"), "block_id").mapInArrow(answer, _FOUND)
    return first.where(F.col("asked").isNull()).select("block_id", "start_char", "end_char").unionByName(again)
