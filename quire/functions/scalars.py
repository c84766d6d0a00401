"""Scalar functions over columns, all built-in expressions. Patterns are Unicode-aware where the text may be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: A list marker at the head of a text.
MARKER = r"^\s*([•‣▪–◦■*†‡-]|\(?[0-9]{1,3}[.)]|\(?[ivxlc]{1,6}[.)]|\(?[A-Za-z][.)])\s+"


def expand_ligatures(text: Column) -> Column:
    """Ligatures written out, soft hyphens gone."""
    for k, v in LIGATURES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return F.replace(text, F.lit("­"), F.lit(""))


def marker(text: Column) -> Column:
    """The list marker that a text begins with, empty if none."""
    return F.regexp_extract(text, MARKER, 1)


def marker_kind(m: Column) -> Column:
    """bullet, decimal, roman or alpha, in parentheses if the marker has them; null for none. A single i, v or x is roman."""
    bare = F.regexp_replace(m, r"[().]", "")
    kind = F.when(m == "", None).when(bare.rlike("^[0-9]+$"), "decimal").when(bare.rlike("^[ivxlc]{2,}$") | bare.rlike("^[ivx]$"), "roman").when(bare.rlike("^[A-Za-z]$"), "alpha").otherwise("bullet")
    return F.when(m.startswith("("), F.concat(F.lit("("), kind, F.lit(")"))).otherwise(kind)


def roman_value(text: Column) -> Column:
    """The value of a roman numeral of up to 3999 in either case; null for anything else."""
    t = F.upper(text)
    digits = F.transform(F.split(t, "(?!^)"), lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000).otherwise(0))
    total = F.aggregate(F.reverse(digits), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, d: F.struct((a["sum"] + F.when(d < a["last"], -d).otherwise(d)).alias("sum"), d.alias("last")), lambda a: a["sum"])
    return F.when(t.rlike("^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), total)


def to_roman(n: Column) -> Column:
    """A number from 1 to 3999 as a lower-case roman numeral; null outside."""
    place = lambda k, one, five, ten: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (F.floor(n / k) % 10).cast("int") + 1)
    text = F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), place(100, "c", "d", "m"), place(10, "x", "l", "c"), place(1, "i", "v", "x"))
    return F.when((n >= 1) & (n <= 3999), text)


def folio_value(text: Column) -> Column:
    """A printed page number, arabic or roman, as a number."""
    t = F.trim(text)
    return F.coalesce(F.when(t.rlike("^[0-9]{1,6}$"), t.cast("int")), roman_value(t))


def mask_digits(text: Column) -> Column:
    """Every run of digits as #."""
    return F.regexp_replace(text, "[0-9]+", "#")


def letters_key(text: Column) -> Column:
    """Letters only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}]", ""))


def alnum_key(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def despaced(text: Column) -> Column:
    """Text that was set letter by letter, as words: single characters parted by single spaces are joined."""
    return F.when(text.rlike(r"^(\S ){3,}\S$"), F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)


def font_family(name: Column) -> Column:
    """A font's family: without subset prefix, style and foundry suffix, words parted."""
    bare = F.regexp_replace(F.regexp_replace(name, "^[A-Z]{6}[+]", ""), "[-,].*$", "")
    bare = F.regexp_replace(bare, "(MT|PS)$", "")
    return F.regexp_replace(bare, "([a-z])([A-Z])", "$1 $2")


def font_style(name: Column) -> Column:
    """bold, italic and mono by a font's name."""
    n = F.lower(name)
    return F.struct(n.rlike("bold|black|heavy|semibold").alias("bold"), n.rlike("italic|oblique").alias("italic"), n.rlike("mono|courier|consol|typewriter").alias("mono"))


def hex_colour(values: Column) -> Column:
    """Grey, RGB or CMYK parts from 0 to 1 as #rrggbb; black for none."""
    byte = lambda v: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(v * 255, 0).cast("int"))))), 2, "0")
    at = lambda i: F.try_element_at(values, F.lit(i))
    ink = lambda i: (1 - at(i)) * (1 - at(4))
    rgb = F.when(F.size(values) == 1, F.concat(byte(at(1)), byte(at(1)), byte(at(1)))).when(F.size(values) == 3, F.concat(byte(at(1)), byte(at(2)), byte(at(3)))).when(F.size(values) == 4, F.concat(byte(ink(1)), byte(ink(2)), byte(ink(3)))).otherwise("000000")
    return F.concat(F.lit("#"), rgb)


def colour_distance(a: Column, b: Column) -> Column:
    """Sum of the differences of two #rrggbb colours' parts."""
    part = lambda c, i: F.conv(F.substring(c, i, 2), 16, 10).cast("int")
    return sum((F.abs(part(a, i) - part(b, i)) for i in (4, 6)), F.abs(part(a, 2) - part(b, 2)))


def isbn_valid(text: Column) -> Column:
    """Whether a text is an ISBN-10 or ISBN-13 with the right check digit; hyphens and spaces don't count."""
    d = F.upper(F.regexp_replace(text, "[- ]", ""))
    value = lambda i: F.when(F.substring(d, i, 1) == "X", 10).otherwise(F.substring(d, i, 1).try_cast("int"))
    ten = sum((value(i) * (11 - i) for i in range(2, 11)), value(1) * 10) % 11 == 0
    thirteen = sum((value(i) * (1 if i % 2 else 3) for i in range(2, 14)), value(1)) % 10 == 0
    return F.when(d.rlike("^[0-9]{9}[0-9X]$"), ten).when(d.rlike("^97[89][0-9]{10}$"), thirteen).otherwise(False)


def isbn_check_digit(twelve: Column) -> Column:
    """The thirteenth digit of an ISBN."""
    value = lambda i: F.substring(twelve, i, 1).cast("int")
    total = sum((value(i) * (1 if i % 2 else 3) for i in range(2, 13)), value(1))
    return ((10 - total % 10) % 10).cast("string")


def expand_numbers(spec: Column, span: int = 50) -> Column:
    """"1, 3–5" as [1, 3, 4, 5]; a range of ``span`` numbers or more, or one that falls, gives its ends only."""
    items = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]{1,6}([-–][0-9]{1,6})?$"))
    lo = lambda x: F.regexp_extract(x, "^([0-9]+)", 1).cast("int")
    hi = lambda x: F.regexp_extract(x, "([0-9]+)$", 1).cast("int")
    return F.flatten(F.transform(items, lambda x: F.when((hi(x) >= lo(x)) & (hi(x) - lo(x) < span), F.sequence(lo(x), hi(x))).otherwise(F.array(lo(x), hi(x)))))


def urls(text: Column) -> Column:
    """The web addresses in a text, without punctuation behind them."""
    found = F.regexp_extract_all(text, F.lit(r"((?:https?://|www[.])[^\s<>]+)"), 1)
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", ""))


def doi(text: Column) -> Column:
    """The first DOI in a text, empty if none."""
    return F.regexp_replace(F.regexp_extract(text, r"(10[.][0-9]{4,9}/[^\s<>]+)", 1), r"[.,;)]+$", "")


def callout_key(label: Column) -> Column:
    """"Fig. 2.8A" and "Figure 2.8a" as one key: kind by its first three letters, number, panel."""
    kind = F.lower(F.substring(F.regexp_extract(label, r"^\s*(\p{L}+)", 1), 1, 3))
    return F.when(label.rlike(r"^\s*\p{L}+[.]?\s*[0-9]"), F.concat_ws("|", kind, F.regexp_extract(label, r"([0-9]+(?:[.-][0-9]+)*)", 1), F.lower(F.regexp_extract(label, r"[0-9]([A-Za-z])\b", 1))))


def citation_keys(name: Column, year: Column) -> Column:
    """The keys a work may be cited by: first word, whole phrase, run together and acronym, each with the year."""
    words = F.filter(F.split(F.lower(F.regexp_replace(name, r"[^\p{L}\s-]", "")), r"\s+"), lambda w: w != "")
    long = F.filter(words, lambda w: ~w.isin("of", "and", "the", "for", "de", "la"))
    forms = F.array(F.try_element_at(words, F.lit(1)), F.array_join(words, " "), F.array_join(words, ""), F.array_join(F.transform(long, lambda w: F.substring(w, 1, 1)), ""))
    return F.array_distinct(F.transform(F.filter(forms, lambda f: f.isNotNull() & (f != "")), lambda f: F.concat_ws("|", f, year)))


def two_decimals(x: Column) -> Column:
    """A number with two decimals at most, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def safe_name(text: Column, most: int = 80) -> Column:
    """A file name of letters, digits, dots and hyphens of any script; never empty."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\p{M}._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(t == "", "document").otherwise(F.substring(t, 1, most))


def keywords(text: Column) -> Column:
    """A line of keywords as an array: parts between commas or semicolons, without repeats."""
    t = F.regexp_replace(text, r"(?i)^\s*key\s?words?\s*[:.]?\s*", "")
    return F.array_distinct(F.filter(F.transform(F.split(t, "[,;]"), lambda x: F.trim(F.regexp_replace(x, r"[.\s]+$", ""))), lambda x: x != ""))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def normal_compare(text: Column) -> Column:
    """For comparisons: plain quotes and dashes, words broken at a line's end joined, single spaces."""
    t = F.translate(text, "‘’“”–—− ", "''\"\"--- ")
    t = F.regexp_replace(t, r"(\p{Ll})-\n(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def sentence_tokens(text: Column) -> Column:
    """Words and numbers of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*)"), 1)


def numbers(text: Column) -> Column:
    """The numbers in a text."""
    return F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)*)"), 1)


def iso_time(seconds: Column) -> Column:
    """Epoch seconds as ISO text in UTC (the session's zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def caps(text: Column) -> Column:
    """Whether all letters are capitals, and there are some."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def split_label(text: Column) -> Column:
    """A heading as label and title: "2.3 The mill" -> ("2.3", "The mill")."""
    pattern = r"^\s*((?:(?:Chapter|Ch\.|Part|Appendix|Annexe|Anhang|Anexo|Fig\.|Figure|Table|Abb\.)\s*)?(?:[0-9]+(?:\.[0-9]+)*|[A-Z])[.:)]?)\s+(\S.*)$"
    return F.struct(F.regexp_extract(text, pattern, 1).alias("label"), F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 2)).otherwise(text).alias("title"))
