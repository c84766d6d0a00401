"""Words decoded with the wrong character encoding (problem 3).

Round-trip repair: a value is encoded again under each legacy encoding it may have been read with, the bytes are
decoded strictly as each encoding that may have been meant, and the step is repeated for nested layers. A candidate
is accepted when the garbling cost drops enough. The cost of a text is what damage leaves behind (``garbling``), half
the bits of its letters after their neighbours (``Letters``, counted over all words of the table), less the logarithm
of how often its words occur. The counts make a candidate cheaper or dearer and are no condition: an original that
occurs nowhere else is found by its letters. Only distinct values are repaired; counts cover all rows.

Defined results: null and empty values and values in ASCII are never cases; a value with a replacement character or a
C1 control character is a case although it may be beyond repair (``repaired`` is null); ties between candidates go to
fewer layers, then to the smaller text; repeated deliveries of a word count once; a value of look-alike letters costs
what its consistent form costs, so that it is no case here.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut, even

#: Encodings a text may have been read with by mistake.
READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "cp866", "koi8_r", "gbk", "cp932", "shift_jis", "big5", "euc_kr"]
#: Encodings that may have been meant.
MEANT = ["utf-8", "cp1252", "latin-1", "mac_roman", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1253", "iso8859_7", "cp1255", "cp1256", "cp437", "cp850", "cp852", "gbk", "cp932", "shift_jis", "euc_jp", "big5", "euc_kr"]
#: Distinct values that one task repairs.
EACH = 20_000
#: Nested layers that are undone.
LAYERS = 3
#: Drop of the cost from which a repair is accepted: for UTF-8, whose strict decoding is evidence itself; for others, and more by the length of the value.
DROP_UTF8, DROP_OTHER, DROP_SHORT = 0.6, 2.5, 4.0
#: What a layer beyond the first costs, what each character that UTF-8 decodes saves, and a look-alike spelling costs.
LAYER, DECODED, ALIKE = 1.5, 1.0, 1.0
#: Cost of one bit of the letters, and what each doubling of a value's occurrences saves.
BIT, DOUBLING = 0.5, 1.0
#: Counters of neighbouring letters: a fixed number, whatever the table, so that they can be sent to every task.
SLOTS = 1 << 18
#: Occurrences that the assumed shares of letters weigh.
ASSUMED = 40.0

_DOUBT = set("¡¢£¤¥¦§¨©ª«¬®¯°±²³´¶·¸¹º»¼½¾¿×÷˜ˆ˙˚˝˘˛ƒ†‡•‰™‹›€")
_PAIRS = {"‘", "’", "‚", "“", "”", "„", "–", "—", "…"}


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x3000 <= o < 0x3040:
        return "H"
    if 0x590 <= o < 0x600:
        return "I"
    if 0x600 <= o < 0x780:
        return "A"
    if 0x900 <= o < 0xE00:
        return "D"
    if 0xFF60 <= o < 0xFFA0:
        return "k"
    return unicodedata.name(c, "?").split(" ")[0]


#: A word that begins small and goes on in capitals, as after a change between encodings that hold the cases in turn.
_INVERTED = re.compile(r"(?<![^\W\d_])[ßà-öø-ÿά-ώа-џ][À-ÖØ-ÞΆ-ΫЀ-Я]{2,}")


@lru_cache(200_000)
def garbling(text: str) -> float:
    """The cost of a text: what damage leaves behind."""
    cost, before, last = 0.0, "", ""
    for i, c in enumerate(text):
        o = ord(c)
        if o < 0x80:
            if o < 0x20 and c not in "\t\n\r" or o == 0x7F:
                cost += 3
            kind = "L" if c.isalpha() else ""
            if kind and c.isupper() and last.islower() and not last.isascii():
                cost += 0.7
            if kind and before and before not in "LH":
                cost += 1.2
            before, last = kind, c
            continue
        cost += 0.12
        cat = unicodedata.category(c)
        kind = ""
        if c == "�":
            cost += 3
        elif 0x80 <= o < 0xA0 or cat in ("Co", "Cn"):
            cost += 3
        elif 0x2500 <= o < 0x25A0:
            cost += 2
        elif c in _DOUBT:
            near = (last.isalpha() and last != "") + (i + 1 < len(text) and text[i + 1].isalpha())
            cost += 0.4 + 0.5 * near + (0.5 if last in _DOUBT and last != "" else 0)
        elif c in _PAIRS:
            near = last.isalpha() and i + 1 < len(text) and text[i + 1].isalpha()
            cost += 0.1 if c == "’" else 0.9 if near else 0.3
            if last and not last.isascii() and last.isalpha() and c not in "’…”":
                cost += 0.8
        elif cat[0] == "S" and o < 0x2E80:
            near = last.isalpha() or i + 1 < len(text) and text[i + 1].isalpha()
            cost += 0.0 if c in "←→≤≥" and not near else 1.5
        elif cat == "Zs":
            cost += 0.5 if o >= 0x2000 else 6.0 if last.isalpha() or text[i + 1 : i + 2].isalpha() else 1.0
        elif cat == "Cf":
            cost += 0.5
        elif c.isalpha() or cat[0] == "M":
            kind = _script(c)
            if 0x180 <= o < 0x250:
                cost += 3
            if before + kind in ("LH", "HL"):
                cost += 2.0
            if before and kind != before and not (before in "LH" and kind in "LH" and "H" in before + kind) and cat[0] != "M":
                cost += 1.5
            if last and not last.isascii() and last.isalpha() and kind == "L":
                cost += 0.5
            if c.isupper() and last.islower():
                cost += 2.0
            elif c.islower() and len(text) > i + 1 and text[i + 1].isupper():
                cost += 0.5
            if c in "ĂăĹĺĽľŒŸÿÞþÐðÝŢţ":
                cost += 0.4
            elif kind == "C" and not (0x410 <= o < 0x450 or o in (0x401, 0x451)):
                cost += 0.7
            elif kind == "k":
                cost += 0.8
            elif kind == "H" and 0x3400 <= o:
                try:
                    high = c.encode("gb2312")[0]
                    cost += 0.5 if high > 0xD7 else 0
                except UnicodeEncodeError:
                    cost += 0.4
                cost += 0.1
            elif kind not in "LGCHIAD":
                cost += 1
        else:
            cost += 0.3
            if 0xFF00 <= o < 0xFFF0 and (last.isascii() and last.isalpha() or text[i + 1 : i + 2].isascii() and text[i + 1 : i + 2].isalpha()):
                cost += 2
        before, last = kind, c
    return cost + 3.0 * len(_INVERTED.findall(text))


_HOLES = {}


def _bytes(text: str, encoding: str) -> bytes | None:
    """The bytes of a text; positions that an encoding leaves open stand for themselves."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125"):
            return None
    if encoding not in _HOLES:
        _HOLES[encoding] = {chr(b): bytes([b]) for b in range(0x80, 0xA0) if not bytes([b]).decode(encoding, "ignore")}
    holes, out = _HOLES[encoding], []
    for c in text:
        try:
            out.append(c.encode(encoding))
        except UnicodeEncodeError:
            if c not in holes:
                return None
            out.append(holes[c])
    return b"".join(out)


def _raised(data: bytes) -> list[bytes]:
    """The bytes before a case folding that turned lead bytes C0-DE into E0-FE, 9F into FF, and 8A, 8C, 8E into 9A, 9C, 9E."""
    data = data.replace(b"\xff", b"\x9f")
    out = bytearray(data)
    for i, b in enumerate(data):
        n = i + 1
        while n < len(data) and 0x80 <= data[n] < 0xC0:
            n += 1
        if 0xE2 <= b < 0xFF and n == i + 2:
            out[i] = b - 0x20
    found = [bytes(out)]
    if any(b in out for b in (0x9A, 0x9C, 0x9E)):
        found.append(bytes(out).translate(bytes.maketrans(b"\x9a\x9c\x9e", b"\x8a\x8c\x8e")))
    return found


def _step(text: str) -> Iterator[tuple[str, str]]:
    """Every reading of one layer: (encoding meant, text)."""
    seen = set()
    folded = not any(c.isupper() and not c.isascii() for c in text)
    for wrong in READ_AS:
        data = _bytes(text, wrong)
        if data is None:
            continue
        for meant in MEANT:
            if (data, meant) in seen:
                continue
            seen.add((data, meant))
            texts = [data]
            if meant == "utf-8" and folded and wrong in ("cp1252", "cp1254", "latin-1", "cp1250"):
                texts += _raised(data)
            for d in texts:
                try:
                    new = d.decode(meant)
                except UnicodeDecodeError:
                    continue
                if new != text:
                    yield meant, new


def candidates(value: str) -> dict[str, tuple[str, int]]:
    """Possible originals of a value: text -> (encoding meant, layers). Only decodings as UTF-8 lead on to a
    next layer."""
    found: dict[str, tuple[str, int]] = {}
    cost = garbling(value)
    layer = [(value, cost, "utf-8")]
    for depth in range(1, LAYERS + 1):
        after = []
        for text, _, _ in layer:
            for meant, new in _step(text):
                if new in found or new == value or len(new) > len(value) + 2 or not new.strip():
                    continue
                if any(ord(c) < 0x20 or 0x7F <= ord(c) < 0xA0 and meant != "utf-8" for c in new):
                    continue
                if meant != "utf-8" and _MIXED.search(new):
                    continue
                c = garbling(new)
                if meant == "utf-8":
                    after.append((new, c, meant))
                if c <= cost + 1.5:
                    found[new] = (meant, depth)
        layer = [x for x in after if not x[0].isascii()]
        if not layer:
            break
    best = sorted(found, key=lambda t: (garbling(t), found[t][1], t))
    return {t: found[t] for t in best}


#: Letters of Latin next to those of Cyrillic or Greek.
_MIXED = re.compile("[A-Za-z\u00c0-\u024f][\u0370-\u052f]|[\u0370-\u052f][A-Za-z\u00c0-\u024f]|[\u0370-\u03ff][\u0400-\u052f]|[\u0400-\u052f][\u0370-\u03ff]")
_CUT = r"""[\s\-.,;:()!?"\x{85}\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+"""
_CUT_HERE = re.compile(r"""[\s\-.,;:()!?"]+""")
_USUAL = set("áàâäãåæçéèêëíìîïñóòôöõøúùûüß")


def parts(text: str) -> list[str]:
    """The words of a value, in small letters."""
    return [p for p in _CUT_HERE.split(text.lower()) if p]


def _parts(text: Column) -> Column:
    """The same as a column."""
    return F.filter(F.split(F.lower(text), _CUT), lambda p: p != "")


def marked(text: str) -> bool:
    """Whether the value holds what decoding leaves where it fails."""
    return any(c == "�" or 0x80 <= ord(c) < 0xA0 for c in text)


def _vowel(c: str) -> bool:
    return unicodedata.normalize("NFD", c)[0] in "aeiouyæœøı"


@lru_cache(20_000)
def _share(before: str, c: str) -> float:
    """The assumed share of a letter among those that follow another, for letters the table says little of."""
    if c == "$":
        return 0.15
    kind, o = _script(c) if c.isalpha() else "-", ord(c)
    if 0x591 <= o < 0x5C8 or 0x64B <= o < 0x660:
        return 1 / 3000
    if kind == "-":
        return 1 / 150 if c in "’“”„«»–—…" else 1 / 3000
    if kind == "L":
        share = 1 / 30 if c.isascii() else 1 / 300 if c in _USUAL else 1 / 1500 if o < 0x250 else 1 / 5000
        if before != "^" and before.isalpha():
            # consonants and vowels rather take turns
            share *= 1.5 if _vowel(before) != _vowel(c) else 0.4
    elif kind in "CG":
        share = 1 / 40 if kind == "G" or 0x430 <= o < 0x450 or c == "ё" else 1 / 800
    elif kind == "H":
        share = 1 / 600 if 0x3000 <= o < 0x3100 else 1 / 8000
    else:
        share = 1 / 60
    if before != "^" and (_script(before) if before.isalpha() else "-") != kind:
        share *= 0.05
    elif before == "^" and kind != "L":
        share *= 0.1
    return share


class Letters:
    """How often letters follow each other in the words of a table, in ``SLOTS`` counters that share collisions."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.memo = counts, {}

    def _count(self, key: str) -> float:
        return float(self.counts[zlib.crc32(key.encode("utf-8", "replace")) % SLOTS])

    def bits(self, text: str, own: int) -> float:
        """The bits of the letters that aren't ASCII, each after its neighbour. ``own`` is 1 for a text that is in the
        table itself, as it doesn't speak for itself."""
        total = 0.0
        for word in parts(text):
            word = f"^{word}$"
            for a, c in zip(word, word[1:]):
                if a.isascii() and c.isascii():
                    continue
                known = self.memo.get((a, c, own))
                if known is None:
                    known = -math.log2((max(0.0, self._count(a + c) - own) + ASSUMED * _share(a, c)) / (max(0.0, self._count(a) - own) + ASSUMED))
                    self.memo[a, c, own] = known
                total += known
        return total

    def cost(self, text: str, own: int = 0) -> float:
        """The cost of a text without what its occurrences save."""
        return garbling(text) + BIT * self.bits(text, own)


def value_counts(words: DataFrame, fields: list[str]) -> DataFrame:
    """``field_name, value, n`` of the distinct values of the fields, over all rows."""
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return words.selectExpr(f"stack({len(fields)}, {pairs}) as (field_name, value)").where("value is not null and value != ''").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))


def letters(vocabulary: DataFrame) -> Letters:
    """The neighbours of letters in all words of a vocabulary; at most ``SLOTS`` sums reach the driver."""
    word = F.concat(F.lit("^"), F.col("part"), F.lit("$"))
    at = F.sequence(F.lit(1), F.length("part") + 1)
    keys = F.concat(F.transform(at, lambda i: F.substring(word, i, F.lit(2))), F.transform(at, lambda i: F.substring(word, i, F.lit(1))))
    sums = vocabulary.select("n", F.explode(keys).alias("key")).groupBy((F.crc32(F.col("key").cast("binary")) % SLOTS).cast("int").alias("slot")).agg(F.sum("n").alias("n"))
    counts = np.zeros(SLOTS, dtype=np.float32)
    found = sums.toArrow()
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return Letters(counts)


_TRIED = pa.schema([("field_name", pa.string()), ("value", pa.string()), ("candidate", pa.string()), ("layers", pa.int32()), ("cost", pa.float64())])


def tried(field: str, value: str, model: Letters) -> Iterator[tuple[str, str, str, int, float]]:
    """(field, value, text, layers, cost): the value as it is and in its consistent form (0 layers), and its possible
    originals, with the drop that they need added to their cost."""
    from quire.llm.confusables import analyse

    yield field, value, value, 0, model.cost(value, 1)
    if (form := analyse(value)[0]) != value:
        yield field, value, form, 0, model.cost(form) + ALIKE
    for text, (meant, layers) in candidates(value).items():
        if meant == "utf-8":
            need = DROP_UTF8 - DECODED * sum(c > "\x7f" for c in text)
        else:
            need = DROP_OTHER + DROP_SHORT / max(1, sum(map(len, parts(value))))
        yield field, value, text, layers, model.cost(text) + LAYER * (layers - 1) + need


def damaged_values(counts: DataFrame) -> DataFrame:
    """``field_name, value, repaired``: the values that were decoded wrongly. ``counts`` is read several times."""
    vocabulary = counts.select("field_name", "n", F.explode(_parts(F.col("value"))).alias("part")).groupBy("field_name", "part").agg(F.sum("n").alias("n"))
    sums = counts.sparkSession.sparkContext.broadcast(letters(vocabulary).counts)  # of fixed size

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Letters(sums.value)
        for b in batches:
            rows = [t for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in tried(f, v, model)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows) if rows else [[]] * 5, _TRIED)], schema=_TRIED)

    odd = counts.where(F.col("value").rlike(r"[^\x00-\x7f]")).select("field_name", "value")
    ways = even(odd, "value", rows=odd.count(), each=EACH).mapInArrow(repair, "field_name string, value string, candidate string, layers int, cost double")
    # of a text the rarest word counts; a text without words occurs nowhere
    occurs = (
        ways.select("*", F.explode_outer(_parts(F.col("candidate"))).alias("part")).join(vocabulary, ["field_name", "part"], "left")
        .groupBy("field_name", "value", "candidate", "layers").agg(F.min("cost").alias("cost"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
        .withColumn("cost", F.col("cost") - DOUBLING * F.log2(F.col("n") + F.lit(1.0)))
    )
    found = occurs.groupBy("field_name", "value").agg(
        F.min(F.when(F.col("layers") == 0, F.col("cost"))).alias("stored"),
        F.min(F.when(F.col("layers") > 0, F.struct("cost", "layers", "candidate"))).alias("best"),
    )
    is_marked = F.col("value").rlike("[�\\x{80}-\\x{9f}]")
    return found.withColumn("repaired", F.when(F.col("best.cost") <= F.col("stored"), F.col("best.candidate"))).where(F.col("repaired").isNotNull() | is_marked).select("field_name", "value", "repaired")


def damaged_words(words: DataFrame, fields: tuple[str, ...] = ("text", "font")) -> DataFrame:
    """``word_id, field_name, value, repaired``: the words with a wrongly decoded value in one of the fields."""
    fields = list(fields)
    found = damaged_values(cut(value_counts(words, fields)))
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    rows = words.selectExpr("word_id", f"stack({len(fields)}, {pairs}) as (field_name, value)").where(F.col("value").rlike(r"[^\x00-\x7f]"))
    return rows.join(found, ["field_name", "value"]).groupBy("word_id", "field_name").agg(F.max("value").alias("value"), F.max("repaired").alias("repaired"))
