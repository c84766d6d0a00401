"""Abusive, hateful or sexually explicit passages (problem 8).

Cumulative-link ordinal regression: one weight for each sparse text feature, shared by the thresholds between three
grades of severity (no reviewer objects, reviewers disagree, all object). Verdicts are on documents, so the passages
that carry them are found by turns: the regression scores passages, the best passages of the documents found abusive
become the examples of their grade, all passages of the others examples of grade 0, and the regression is fitted
again. Verdicts that the fit contradicts strongly are left out, since some are wrong.

A document's score is the expected severity (0 to 2) of its worst passage; it is found from ``FOUND`` on.

Defined results: a document with null, empty or blank text scores 0; null verdicts don't count; without verdicts of
both kinds every document scores 0. The regression is fitted on at most ``REVIEWED`` reviewed documents, taken in the
order of a hash of their ids; every document is scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.confusables import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS
from quire.session import spread

#: Reviewed documents and bytes of text of each that the regression is fitted on; longer texts aren't examples.
REVIEWED, EXAMPLE = 8000, 60_000
#: Features must occur in so many of the documents it is fitted on.
SEEN = 2
#: Rounds of choosing examples and fitting, steps of one fit, weight of the squared weights against the examples.
ROUNDS, STEPS, RIDGE = 3, 200, 0.3
#: Expected severity from which a document is found.
FOUND = 0.6

_LOOKS = str.maketrans(dict(zip(CYRILLIC.lower() + GREEK.lower(), CYRILLIC_AS.lower() + GREEK_AS.lower())) | {c: None for c in "​‌‍⁠﻿­"})
_FOREIGN = re.compile("[Ͱ-ԯ​-‍⁠﻿­]")
_LEET = str.maketrans("013457@$€", "oieastase")
_LEETED = re.compile(r"[^\W\d_]+[0134578@$€!|]+[^\W_]*|[@$]+[^\W\d_]{2,}")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][_.\-*·]){3,}[^\W\d_](?![^\W_])|(?<![^\W_])(?:[^\W\d_] ){4,}[^\W\d_](?![^\W_])")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[^\W\d_]+(?:[*#]+[^\W\d_]*)*|[*#]+[^\W\d_]+")
_PASSAGE = re.compile(r"(?<=[.!?…。！？।])[\"”»'’)]*\s+|\t+| {2,}")
_NUMBER = re.compile(r"(?<![^\W\d])\d[\d.,:/]*(?![^\W\d])")
_DATA = re.compile(r"[A-Za-z0-9+/=]{80,}")
# Words of code, logs and chats around a passage, which say nothing about it.
_FRAME = set("name dtype object comment user msg print todo raise valueerror typeerror runtimeerror out in none true false div class alert note span br error warning root line file cell step epoch loss assert def return import".split())
_MASKED = re.compile(r"[*#]")
#: Letters and marks of scripts written without spaces, by how many are taken together: Han and kana; Thai, Lao, Burmese, Khmer.
_SPACELESS = {2: "\u3005-\u3007\u3041-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af", 3: "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u1000-\u103f\u1050-\u108f\u1780-\u17d3"}
_RUN = {n: re.compile(f"[{c}]+") for n, c in _SPACELESS.items()}
_ANY_RUN = re.compile(f"[{''.join(_SPACELESS.values())}]+")


def _unleet(m: re.Match) -> str:
    """A word with letters for its digits and signs; marks at its end are no letters."""
    word = m.group().rstrip("!|")
    return word.replace("!", "i").replace("|", "i").translate(_LEET) + m.group()[len(word) :]


def normal(passage: str) -> str:
    """A passage in lower case, with look-alike letters, digits for letters, spelled-out and stretched words undone."""
    text = passage.casefold()
    if not text.isascii() and _FOREIGN.search(text):
        letters = sum(1 for c in text if "a" <= c <= "z" or "à" <= c <= "ÿ")
        if letters or not any("Ѐ" <= c <= "ԯ" for c in text):
            text = text.translate(_LOOKS)
    text = _SPELLED.sub(lambda m: re.sub(r"[_.\-*· ]", "", m.group()), text)
    text = _LEETED.sub(_unleet, text)
    return _LONG.sub(r"\1", text)


def words(passage: str) -> list[str]:
    """The words of a passage; of scripts without spaces, every few neighbouring letters as one."""
    text = normal(passage)
    if text.isascii() or not _ANY_RUN.search(text):
        return [w for w in _WORD.findall(text) if w not in _FRAME]
    found: list[str] = []
    at = 0
    for m in _ANY_RUN.finditer(text):
        found += [w for w in _WORD.findall(text[at : m.start()]) if w not in _FRAME]
        for n, pattern in _RUN.items():
            for run in pattern.findall(m.group()):
                found += [run[i : i + n] for i in range(max(1, len(run) - n + 1))]
        at = m.end()
    return found + [w for w in _WORD.findall(text[at:]) if w not in _FRAME]


def features(found: list[str]) -> set[str]:
    """Words and pairs of words of a passage."""
    return {*found, *(f"{a} {b}" for a, b in zip(found, found[1:]))}


def lines(text: str) -> set[str]:
    """The different lines of a text, without embedded data and with plain numbers as 0: what is judged once."""
    return set(_NUMBER.sub("0", _DATA.sub(" ", text)).split("\n"))


def cut_line(line: str) -> list[str]:
    """The passages of a line: its sentences, cells and entries."""
    return [p for p in _PASSAGE.split(line) if p]


def passages(text: str) -> list[str]:
    """The parts of a text that are judged."""
    return [p for line in sorted(lines(text)) for p in cut_line(line)]


class Ordinal:
    """A fitted regression: weights by feature and two thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: tuple[float, float]):
        self.weights, self.thresholds = weights, thresholds
        self.telling = frozenset(k for k, v in weights.items() if v > 0.15 and " " not in k)
        #: the words of all features that make a passage worse
        self.worse = frozenset(w for k, v in weights.items() if v > 0 for w in k.split(" "))
        self.unmasked: dict[str, str] = {}
        self.known: dict[str, float] = {}
        self.by_line: dict[str, float] = {}

    def severity(self, z: float) -> float:
        return sum(1 / (1 + math.exp(min(60.0, t - z))) for t in self.thresholds)

    def _unmask(self, word: str) -> str:
        """The telling word that a word with asterisks stands for; itself if none."""
        if word not in self.unmasked:
            pattern = re.compile(re.sub(r"[*#]+", lambda m: f".{{{len(m.group())},{len(m.group()) + (len(m.group()) == 1)}}}", word))
            fits = [w for w in self.telling if w[:1] == word[:1] and pattern.fullmatch(w)]
            self.unmasked[word] = max(fits, key=lambda w: (self.weights[w], w), default=word)
        return self.unmasked[word]

    def passage(self, text: str) -> float:
        """The linear score of a passage."""
        known = self.known.get(text)
        if known is None:
            found = words(text)
            if not found:
                known = 0.0
            else:
                if "*" in text or "#" in text:
                    found = [self._unmask(w) if _MASKED.search(w) else w for w in found]
                # without any of them no feature of the passage has a weight above 0, and 0 is the least score of a document
                known = 0.0 if self.worse.isdisjoint(found) else sum(map(self.weights.get, features(found), iter(lambda: 0.0, 1))) / math.sqrt(len(found))
            if len(text) < 200:
                if len(self.known) > 60_000:
                    self.known.clear()
                self.known[text] = known
        return known

    def document(self, text: str | None) -> float:
        """The expected severity of the worst passage; at least 0."""
        if not text or not self.weights or text.isspace():
            return 0.0
        worst, known = 0.0, self.by_line
        for line in lines(text):
            z = known.get(line)
            if z is None:
                z = max(map(self.passage, cut_line(line)), default=0.0)
                if len(line) < 400:
                    if len(known) > 60_000:
                        known.clear()
                    known[line] = z
            if z > worst:
                worst = z
        return self.severity(worst)


def fit(examples: list[set[str]], grades: np.ndarray, cost: np.ndarray, times: np.ndarray | None = None) -> Ordinal:
    """The regression that fits the examples best, by full gradient steps with momentum. ``times`` says in how many
    documents each example is."""
    count: Counter[str] = Counter()
    for i, e in enumerate(examples):
        for f in e:
            count[f] += 1 if times is None else int(times[i])
    names = sorted(f for f, n in count.items() if n >= SEEN)
    at = {f: i for i, f in enumerate(names)}
    rows = np.array([i for i, e in enumerate(examples) for f in e if f in at], dtype=np.int64)
    cols = np.array([at[f] for e in examples for f in sorted(e) if f in at], dtype=np.int64)
    size = np.array([max(1, sum(1 for f in e if " " not in f)) for e in examples], dtype=float)
    value = 1 / np.sqrt(size[rows])
    w, theta = np.zeros(len(names)), np.array([1.0, 2.0])
    m, v = np.zeros(len(names) + 2), np.zeros(len(names) + 2)
    total = cost.sum()
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, weights=w[cols] * value, minlength=len(examples))
        # P(grade <= k) = sigmoid(theta_k - z)
        c = np.stack([np.zeros_like(z), sigmoid(theta[0] - z), sigmoid(theta[1] - z), np.ones_like(z)])
        low, high = c[grades, np.arange(len(z))], c[grades + 1, np.arange(len(z))]
        p = np.maximum(high - low, 1e-9)
        dlow, dhigh = low * (1 - low), high * (1 - high)
        gz = cost * (dhigh - dlow) / p
        gw = np.bincount(cols, weights=gz[rows] * value, minlength=len(names)) / total + RIDGE / total * w
        gt = np.array([-(cost * dhigh / p)[grades == k].sum() + (cost * dlow / p)[grades == k + 1].sum() for k in (0, 1)]) / total
        g = np.concatenate([gw, gt])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-2]
        theta -= move[-2:]
        theta[1] = max(theta[1], theta[0] + 0.05)
    return Ordinal({n: float(x) for n, x in zip(names, w) if abs(x) > 0.01}, (float(theta[0]), float(theta[1])))


def _surely(n: int, of: int, base: float) -> float:
    """How far a share is above the usual one, in about standard deviations; 0 if it isn't."""
    p = min(max(n / of, 1e-6), 1 - 1e-6)
    return math.sqrt(2 * of * (p * math.log(p / base) + (1 - p) * math.log((1 - p) / (1 - base)))) if p > base else 0.0


def train(reviewed: list[tuple[str, list[int]]]) -> Ordinal:
    """The regression from texts and their verdicts (0 or 1)."""
    grade = [0 if not sum(v) else 2 if all(v) else 1 for _, v in reviewed]
    if not any(grade) or all(grade):
        return Ordinal({}, (9.0, 9.0))
    known: dict[str, int] = {}
    kept: list[set[str]] = []
    documents = []
    for text, _ in reviewed:
        own = set()
        for p in passages(text):
            found = words(p)
            if found:
                key = " ".join(found)
                if key not in known:
                    known[key] = len(kept)
                    kept.append(features(found))
                own.add(known[key])
        documents.append(sorted(own))
    base = max(0.02, sum(map(bool, grade)) / len(grade))
    with_, without = np.zeros(len(kept)), np.zeros(len(kept))
    for own, g in zip(documents, grade):
        (with_ if g else without)[own] += 1
    p = np.clip(with_ / np.maximum(with_ + without, 1), 1e-6, 1 - 1e-6)
    # so far from the usual share that chance can't explain it
    sure = (p >= 0.7) & ((with_ + without) * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base))) > 12)
    # words such as thanks or ok stand beside abuse in many documents: one alone is an example only where no longer passage is
    alone = np.array([len(e) < 2 for e in kept], dtype=bool)
    length = [math.sqrt(max(1, sum(1 for f in e if " " not in f))) for e in kept]

    def scores(weights: dict[str, float]) -> np.ndarray:
        return np.array([sum(map(weights.get, e, iter(lambda: 0.0, 1))) / n for e, n in zip(kept, length)])

    def fitted(docs: list[int], z: np.ndarray, limit: float, more: frozenset[int] = frozenset()) -> Ordinal:
        """A fit on some documents; ``z`` scores their passages by a fit on the others, ``more`` are passages that count."""
        own_with, own_without = np.zeros(len(kept)), np.zeros(len(kept))
        top, beside = np.zeros(len(kept), dtype=np.int64), np.zeros(len(kept))
        for d in docs:
            own, g = documents[d], grade[d]
            (own_with if g else own_without)[own] += 1
            if g and own:
                # a document without any suspicious passage was probably judged wrongly
                longer = [i for i in own if not alone[i]]
                may = own
                if any(sure[i] or i in more or z[i] > limit for i in longer):
                    may = longer
                    beside[own] += 1
                best = max(may, key=lambda i: z[i])
                for i in may:
                    # others of the document may only stand beside it, as in its copies
                    if sure[i] or i in more or (i == best and z[i] > limit):
                        top[i] = max(top[i], g)
        top[(own_with < 3 * own_without) | (alone & (2 * beside >= own_with))] = 0
        # what mostly stands in documents found abusive is no example of grade 0
        use = np.flatnonzero((top > 0) | ((own_without > 0) & (~sure | alone)))
        grades = top[use]
        # what many documents without complaint hold is surely harmless, and what many found abusive hold is not
        times = np.clip(np.where(grades > 0, own_with[use], own_without[use]), 1, 40)
        balance = times[grades == 0].sum() / max(1.0, times[grades > 0].sum()) / 4
        cost = times * np.where(grades > 0, min(5.0, max(1.0, balance)), 1.0)
        # what looks abusive and was passed once or twice may have been judged wrongly
        cost[(grades == 0) & (z[use] > limit + 2) & (own_without[use] <= 2)] *= 0.3
        return fit([kept[i] for i in use], grades, cost, (own_with + own_without)[use])

    half = [zlib.crc32(text.encode("utf-8", "replace")) >> 7 & 1 for text, _ in reviewed]
    folds = [[d for d in range(len(documents)) if half[d] == k] for k in (0, 1)]
    z, limit = [], 3.3
    for docs in folds:
        # to begin with: how surely features are met more often in documents found abusive, by the three surest
        pos, neg = Counter(), Counter()
        for d in docs:
            (pos if grade[d] else neg).update({f for i in documents[d] for f in kept[i]})
        surely = {f: _surely(n, n + neg[f], base) for f, n in pos.items() if n >= 2}
        z.append(np.array([sum(sorted((surely.get(f, 0.0) for f in e), reverse=True)[:3]) / 3 for e in kept]))
    for _ in range(ROUNDS):
        # passages of either half are chosen by the other, so that none vouches for itself
        models = [fitted(folds[k], z[1 - k], limit) for k in (0, 1)]
        z, limit = [scores(m.weights) - m.thresholds[0] for m in models], -0.3
    everything, more = list(range(len(documents))), frozenset()
    z_all = (z[0] + z[1]) / 2
    for _ in range(ROUNDS):
        model = fitted(everything, z_all, limit, more)
        now = scores(model.weights) - model.thresholds[0]
        # what else do documents found abusive share? Copies of one document, which have one worst passage, count once
        worst = {d: max(documents[d], key=lambda i: now[i]) for d in everything if grade[d] and documents[d]}
        one = {i: d for d, i in worst.items()}
        pos = Counter(f for d in one.values() for f in {f for i in documents[d] for f in kept[i]})
        neg = Counter(f for d in everything if not grade[d] for f in {f for i in documents[d] for f in kept[i] if f in pos})
        share = max(0.02, len(one) / max(1, len(one) + sum(not g for g in grade)))
        surely = {f: _surely(n, n + neg[f], share) for f, n in pos.items() if n >= 4}
        found = set()
        for d in worst:
            for i in documents[d]:
                if sum(sorted((surely.get(f, 0.0) for f in kept[i]), reverse=True)[:3]) / 3 > 6.5 and not without[i]:
                    found.add(i)
        if not found - more:
            break
        more |= found
    return model


def reviewed_texts(documents: DataFrame, labels: DataFrame) -> list[tuple[str, list[int]]]:
    """The texts and verdicts of at most ``REVIEWED`` documents, a bounded sample for the driver."""
    v = labels.where(F.col("abusive").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id", "reviewer").agg(F.max_by("abusive", F.struct("reviewed_at", "abusive")).alias("abusive"))
    v = v.groupBy("doc_id").agg(F.sort_array(F.collect_list("abusive")).alias("v")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(REVIEWED)
    t = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= EXAMPLE))
    rows = t.join(F.broadcast(v), "doc_id").orderBy("doc_id").select("text", "v")
    return [(r["text"], list(r["v"])) for r in rows.toLocalIterator()]


def scored(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``score``, the expected severity, of every document."""
    model = train(reviewed_texts(documents, labels))
    weights, thresholds = model.weights, model.thresholds
    source = documents.select(*keep, "text")
    schema = pa.schema([*((f.name, {"bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()]) for f in source.schema.fields[:-1]), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(weights, thresholds)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([own.document(texts[i].as_py()) for i in range(len(texts))], pa.float64())], schema=schema)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return spread(source).mapInArrow(run, f"{ddl}, score double")


def abusive(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` of each document with at least one abusive, hateful or explicit passage."""
    return scored(documents, labels).where(F.col("score") >= FOUND).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``source, documents, found, rate``: how many documents of each source are found."""
    s = scored(documents, labels, ("doc_id", "source"))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= FOUND).cast("bigint")).alias("found")).withColumn("rate", F.col("found") / F.col("documents"))
