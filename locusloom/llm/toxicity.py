"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, undoes compatibility forms, homoglyphs and digit substitutions, drops zero-width
characters and makes one space of everything that is no letter or digit. A pattern is the beginning of a
word, or a whole word of two or three letters; an exception is a whole word or a pair of words that holds a pattern and is harmless. All of them are
found in one pass of the automaton. A text's hits, weighted and divided by its length in words, go through a
logistic curve.

The lexicon is learned from labelled texts: the rates of word beginnings per word in toxic and in clean texts
are summed over the cluster, and those that are many times as frequent in toxic texts become patterns. Whole words
that begin with a pattern, then pairs of neighbouring words with a pattern in a word that is no exception, become
exceptions where they are not much more frequent in toxic texts. Of beginnings of one another the strongest stays. The sample of
labelled rows is bounded by ``SAMPLE_ROWS``, and so are the words that can be learned; the lexicon has no bound of its
own, and scoring reads whole texts.

Defined results: null and empty texts have no hits and get the curve's value for none. Without labelled texts of
both kinds every score is 0. Repeated labels count once, the greatest, and so do equal texts in learning. Labels, language and source are never read
in scoring.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import small_batches, stage

#: Labelled rows that the lexicon and the curve are fitted on at the most, the least by hash of doc_id.
SAMPLE_ROWS = 12_000
#: Word beginnings of these lengths are looked at, and whole words from ``SHORT`` letters on that are shorter than them.
SHORT, SHORTEST, LONGEST = 2, 4, 10
#: A pattern's rate in toxic texts is at least this many times that in clean ones; an exception's less than the other.
RATIO, HARMLESS_RATIO = 8.0, 2.0
#: The share of toxic texts with a pattern is at least this many times that of clean ones: a burst in one text isn't enough.
TEXT_RATIO = 3.0
#: Toxic texts with a pattern at the least, in a sample of any size; ratio and lift guard against chance.
LEAST_TEXTS = 3
#: Held-out rows: crc32 of the id modulo FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 4, 2

#: Look-alikes of Latin letters, and digits that stand for letters.
HOMOGLYPHS = dict(zip("авсԁеһіјкӏмопрԛѕтհԝхуαβεηικνορτυχγ", "abcdehijklmonpqsthwxyabenikvoptuxy"))
DIGITS = dict(zip("0134578@", "oieastba"))


class _Fold(dict):
    """Table for str.translate that fills itself."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKC", chr(code)).lower():
            c = HOMOGLYPHS.get(c) or DIGITS.get(c) or c
            if unicodedata.category(c) in ("Cf", "Mn"):
                continue
            out += c if c.isalnum() else " "
        self[code] = out
        return out


_FOLD = _Fold()


def folded(text: str | None) -> str:
    """Folded words with one space before, between and after them; one space if there are none."""
    words = (text or "").translate(_FOLD).split()
    return f" {' '.join(words)} " if words else " "


@dataclass
class Lexicon:
    """Weights of word beginnings, harmless words or phrases, and the curve (intercept, slopes)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = ()
    _machine = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve}

    def _automaton(self):
        if self._machine is None:
            machine = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                machine.add_word(" " + word, (len(word) + 1, weight))
            for phrase in self.exceptions:
                machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
            machine.make_automaton()
            self._machine = machine
        return self._machine

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Weighted hits per hundred words, weighted hits, and the logarithm of the length in words."""
        plain = folded(text)
        words = max(plain.count(" ") - 1, 0)
        total = 0.0
        if self.weights:
            hits: dict[int, float] = {}
            harmless: set[int] = set()
            for end, (size, weight) in self._automaton().iter(plain):
                start = end - size + 1
                if weight is None:
                    inner = plain[start:end]
                    harmless.update(start + i for i, c in enumerate(inner) if c == " ")
                else:
                    hits[start] = max(weight, hits.get(start, 0.0))
            total = sum(w for at, w in hits.items() if at not in harmless)
        return 100.0 * total / (words + 10), math.log1p(total), math.log1p(words)

    def score(self, text: str | None) -> float:
        if not self.curve:
            return 0.0
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT


_COUNTS = ("in_toxic", "in_clean", "toxic_texts", "clean_texts")


def _beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences of word beginnings and whole words (with a space after them) by label, one row each and batch."""
    for batch in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        texts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"]):
            own: Counter = Counter()
            for word, n in Counter(folded(text).split()).items():
                for k in range(SHORTEST, min(len(word), LONGEST) + 1):
                    own[word[:k]] += n
                own[word + " "] += n
            seen[toxic].update(own)
            texts[toxic].update(own.keys())
        keys = [*seen[1].keys()] + [k for k in seen[0] if k not in seen[1]]
        yield pd.DataFrame({
            "part": keys, "in_toxic": [seen[1][k] for k in keys], "in_clean": [seen[0][k] for k in keys],
            "toxic_texts": [texts[1][k] for k in keys], "clean_texts": [texts[0][k] for k in keys]}).astype(dict.fromkeys(_COUNTS, "int64"))


def _begins(word: str, patterns: frozenset[str]) -> bool:
    return any(word[:k] in patterns for k in range(SHORTEST, LONGEST + 1)) or word + " " in patterns


def _folded_beginnings(found: list[tuple[str, float, float]]) -> dict[str, float]:
    """Weights of the patterns, from (beginning, ratio, strength): the strongest first; one that a stronger one begins, or
    that begins a stronger one, adds nothing."""
    chosen: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of those chosen
    for part, ratio, _ in sorted(found, key=lambda r: (-r[2], -len(r[0]), r[0])):
        own = [part[:k] for k in range(1, len(part) + 1)]
        if part not in begun and not any(b in chosen for b in own):
            chosen[part] = math.log(ratio)
            begun.update(own)
    return chosen


def _pairs(patterns: frozenset[str], exceptions: frozenset[str]):
    """Occurrences by label of pairs of neighbouring words that hold a pattern, other than in a harmless word."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = folded(text).split()
                hit = {w for w in set(words) if w not in exceptions and _begins(w, patterns)}
                seen[toxic].update(f"{a} {b}" for a, b in zip(words, words[1:]) if a in hit or b in hit)
            keys = [*seen[1].keys()] + [k for k in seen[0] if k not in seen[1]]
            yield pd.DataFrame({"part": keys, "in_toxic": [seen[1][k] for k in keys], "in_clean": [seen[0][k] for k in keys]}).astype(
                {"part": "object", "in_toxic": "int64", "in_clean": "int64"})
    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression with a small penalty, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 1e-2
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Fit the lexicon and the curve on labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    # Copies of a text count once, so that one that is copied often makes no patterns of its own words.
    texts = stage(texts.groupBy(F.xxhash64("text").alias("__same"), "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("text", "toxic"), "labelled")
    sizes = {r["toxic"]: r for r in texts.groupBy("toxic").agg(
        F.count("*").alias("texts"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))).alias("words")).collect()}
    if len(sizes) < 2:
        return Lexicon()
    toxic_words, clean_words = sizes[1]["words"], sizes[0]["words"]
    toxic_texts, clean_texts = sizes[1]["texts"], sizes[0]["texts"]
    counted = texts.mapInPandas(_beginnings, "part string, in_toxic bigint, in_clean bigint, toxic_texts bigint, clean_texts bigint")
    counted = counted.groupBy("part").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    ratio = (F.col("in_toxic") + 0.5) / (toxic_words + 1) / ((F.col("in_clean") + 0.5) / (clean_words + 1))
    counted = counted.withColumn("ratio", ratio)
    counted = stage(counted.filter(F.col("in_toxic") + F.col("in_clean") >= 3), "beginnings")
    lift = (F.col("toxic_texts") + 0.5) / (toxic_texts + 1) / ((F.col("clean_texts") + 0.5) / (clean_texts + 1))
    whole = F.col("part").endswith(" ")
    eligible = ~whole | F.length("part").between(SHORT + 1, SHORTEST)  # short words count whole, with their space
    frequent = counted.filter(eligible & (F.col("ratio") >= RATIO) & (lift >= TEXT_RATIO) & (F.col("toxic_texts") >= LEAST_TEXTS))
    strength = (F.col("toxic_texts") * F.log("ratio")).alias("strength")
    chosen = _folded_beginnings([tuple(r) for r in frequent.select("part", "ratio", strength).collect()])  # words of the sample at the most
    exceptions: list[str] = []
    if chosen:
        patterns = F.broadcast(docs.sparkSession.createDataFrame([(p,) for p in chosen], "begin string"))
        words = counted.filter(whole & (F.col("ratio") < HARMLESS_RATIO) & (F.length("part") > SHORTEST))
        begins = F.explode(F.array(*[F.substring("part", 1, k) for k in range(SHORTEST, LONGEST + 1)])).alias("begin")
        harmless = words.select("part", begins).join(patterns, "begin", "left_semi").select("part").distinct()
        exceptions = sorted(r["part"].strip() for r in harmless.collect())
        pairs = texts.mapInPandas(_pairs(frozenset(chosen), frozenset(exceptions)), "part string, in_toxic bigint, in_clean bigint")
        pairs = pairs.groupBy("part").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_clean").alias("in_clean"))
        harmless = pairs.filter("in_clean > 0 AND in_toxic + in_clean >= 3").filter(ratio < HARMLESS_RATIO)
        exceptions += sorted(r["part"] for r in harmless.select("part").collect())
    lexicon = Lexicon(chosen, tuple(exceptions))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*lexicon.features(t), float(y)) for t, y in zip(batch["text"], batch["toxic"])]
            yield pd.DataFrame(rows, columns=["a", "b", "c", "y"])

    rows = np.array([tuple(r) for r in texts.mapInPandas(measured, "a double, b double, c double, y double").sort("a", "b", "c", "y").collect()])
    lexicon.curve = _logistic(rows[:, :3], rows[:, 3])
    return lexicon


def score_column(lexicon: Lexicon, text: str = "text") -> Column:
    """The score of every whole text, 0 to 1."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return score(F.col(text).cast("string"))


#: A text is taken as toxic from this score on.
THRESHOLD = 0.3


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    lexicon = learn(docs, labels, sample_rows)
    small_batches(docs.sparkSession)
    scored = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_column(lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows whose text isn't taken as toxic, with all their columns."""
    lexicon = learn(docs, labels, sample_rows)
    small_batches(docs.sparkSession)
    return docs.filter(score_column(lexicon) < THRESHOLD)
