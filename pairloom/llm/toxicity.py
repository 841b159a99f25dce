"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton over folded text.

Folding lowers case, maps look-alike letters to Latin ones, undoes digit and symbol substitutions inside words, and
leaves letters with single spaces between words. The lexicon holds whole words and word beginnings with weights: the
smoothed log-odds of being in toxic documents, counted by Spark over labelled training rows, on top of a short fixed
list. Words inside an exception phrase do not count. A document's weight is normalised by its length and mapped to a
probability by a one-variable logistic fit on the same rows. Labels are used only to learn; a score sees the text alone.

The labelled rows used are at most ``max_labelled``, the first by a hash of their id (a documented bound, 40,000). Every
term that they support often enough enters the lexicon, so its size is bounded by those rows alone.

Defined cases: a null or empty text has no word and scores what a text without a match scores; repeated rows score
alike; labels of documents that are absent or have no text teach nothing and use up no row; without usable labels the fixed list alone decides; an empty table gives an empty result; of terms that begin at one
place the heaviest counts; very long texts are matched whole, in one pass.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Workspace, id_text, sliced, texts, tidied

MAX_LABELLED = 40_000
THRESHOLD = 0.7

#: General insults that need no label, and phrases in which such a word is harmless.
BASE_TERMS = ("idiot", "moron", "scum", "stupid", "imbecile", "cretin", "dumbass", "retard", "whore", "bastard")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "fire retardant", "pond scum", "sore loser rule")
BASE_WEIGHT, LEAST_WEIGHT, LEAST_SUPPORT, STEM_LENGTHS = 4.0, 3.0, 3, (4, 5, 6)

#: Letters of other scripts that look like Latin ones, then digits and symbols used as letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһԛԝѵᴀαοιυκντρ", "aeopcyxijsdhqwvaaoiukvtp")
SUBSTITUTES = str.maketrans("013457@$|", "oieastasl")
_INNER = re.compile(r"(?<=[^\W\d_])[013457@$|]+(?=[^\W\d_])|(?<!\S)[013457@$](?=[^\W\d_])")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Words of letters between single spaces, with a space at either end."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    text = _INNER.sub(lambda m: m[0].translate(SUBSTITUTES), text)
    return f" {_NOT_LETTERS.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Terms with a blank before them, and one behind them unless they are word beginnings; slope and shift of the fit."""

    terms: dict[str, float]
    slope: float = 3.0
    shift: float = -3.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    _machine: object = field(default=None, repr=False, compare=False)

    def machine(self):
        if self._machine is None:
            a = ahocorasick.Automaton()
            for t, w in self.terms.items():
                a.add_word(t, (len(t), w))
            for t in self.exceptions:
                a.add_word(f" {t} ", (len(t) + 2, None))
            a.make_automaton()
            self._machine = a
        return self._machine

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def weight(self, text: str | None) -> tuple[float, int, list[str]]:
        """Length-normalised weight, number of matched words, the words."""
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.machine().iter(folded):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        if spared:
            spared.sort()
            ends = list(accumulate((b for _, b in spared), max))
            best = {s: w for s, w in best.items() if not (k := bisect_right(spared, (s, len(folded)))) or ends[k - 1] <= s}
        hits = best
        if not hits:
            return 0.0, 0, []
        words = folded.count(" ") - 1
        return math.log1p(sum(hits.values()) / (1 + math.log1p(words) / 8)), len(hits), [folded[s + 1 : folded.index(" ", s + 1)] for s in sorted(hits)]

    def probability(self, x: float) -> float:
        return 1.0 / (1.0 + math.exp(-(self.slope * x + self.shift)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many toxic and how many other documents a term is."""
    found: dict[str, list[int]] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64())], ["term", "toxic", "clean"])

    for b in sliced(batches, 500):
        for t, y in zip(texts(b), texts(b, "toxic"), strict=True):
            words = set(fold(t).split())
            terms = {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEM_LENGTHS if len(w) > n}
            for term in terms:
                found.setdefault(term, [0, 0])[y] += 1
        if len(found) > 200_000:
            yield out()
            found.clear()
    if found:
        yield out()


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression in one variable by Newton steps with a small ridge."""
    a, b = 1.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_labelled: int = MAX_LABELLED, label_col: str = "toxic") -> Lexicon:
    """A lexicon from the labelled rows that ``usable`` (over doc_id) admits; at most ``max_labelled`` of them."""
    terms = {f" {t} ": BASE_WEIGHT for t in BASE_TERMS}
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    rows = (rows.filter(usable) if usable is not None else rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    present = id_text(docs).filter("text is not null").select("doc_id")
    rows = Workspace(docs.sparkSession).table(rows.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    train = id_text(docs).filter("text is not null").join(F.broadcast(rows), "doc_id").select("text", "toxic")
    totals = dict(rows.groupBy("toxic").count().collect())
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Lexicon(terms)
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    counted = train.mapInArrow(tidied(_counts), "term string, toxic long, clean long").filter("toxic > 0 or clean > 0").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = counted.filter(f"toxic >= {LEAST_SUPPORT} and clean <= toxic / 50").select("term", weight.alias("weight")).filter(f"weight >= {LEAST_WEIGHT}")
    terms |= {r.term: float(r.weight) for r in kept.collect()}
    lexicon = Lexicon(terms)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.weight(t)[0] for t in texts(b)], pa.float64()), b.column(b.schema.get_field_index("toxic"))], ["x", "y"])

    xy = train.mapInArrow(tidied(weigh), "x double, y int").groupBy(F.round("x", 2).alias("x"), "y").count().orderBy("x", "y").collect()
    x, y, k = (np.array([r[i] for r in xy], float) for i in range(3))
    if len(set(y)) == 2:
        lexicon.slope, lexicon.shift = _fit(np.repeat(x, k.astype(int)), np.repeat(y, k.astype(int)))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_hits, terms (the matched words) of every row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [lexicon.weight(t) for t in texts(b)]
            p = [lexicon.probability(f[0]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.list_(pa.string()))],
                ["doc_id", "score", "predicted", "n_hits", "terms"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, score double, predicted int, n_hits int, terms array<string>")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keep = [lexicon.probability(lexicon.weight(t)[0]) < threshold for t in texts(b, text_col)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
