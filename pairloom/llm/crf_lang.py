"""Language of texts by a linear-chain conditional random field over their words.

A word's emission adds up hashed features: prefixes, suffixes, inner n-grams, the whole word where it is in the learned
lexicon. Transitions between the labels of neighbouring words are learned with the emissions, by gradient ascent on
the likelihood over sequences that are stitched together from runs of words of different languages, as code-switched text
is. Forward-backward gives each word's label probabilities; a text's language is the label with the largest sum.

Words are runs of letters; a run longer than ``UNIT`` letters, as in scripts without blanks, is cut into units that are each
labelled, so that every letter counts and affixes are those of the unit itself.

Only text and language of training rows are used, at most ``PER_LANGUAGE`` texts of at most ``LONGEST`` characters for
each language, and with many languages fewer of each, so that there are at most ``MOST_ROWS`` in all or ``LEAST_ROWS`` of a
language (the documented bounds of the sample); every language is learned. The first by a hash of their id and text are taken. Texts
are always labelled whole. The weights take ``BUCKETS`` numbers for each language.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be
learned; null languages do not teach; of languages with equal sums the first by code point wins; repeated rows are labelled
alike; an empty table gives an empty result; very long texts run whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pairloom.llm.common import id_text, maybe_broadcast, sliced, texts, tidied

PER_LANGUAGE, LONGEST, MOST_ROWS, LEAST_ROWS = 600, 20_000, 24_000, 20
UNIT = 32
BUCKETS, LEXICON_LEAST = 1 << 16, 5
SEQUENCE, BATCH, STEPS, RATE = 64, 128, 240, 0.4
UNKNOWN = "und"
_WORD = re.compile(rf"[^\W\d_]{{1,{UNIT}}}")
_KNOWN, _CELLS, _LABELS = 500_000, 1 << 17, 32


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Bucket numbers of a word's features."""
    w, n = word, len(word)
    names = [f"^{w[:k]}" for k in (1, 2, 3, 4) if k <= n] + [f"{w[-k:]}$" for k in (1, 2, 3, 4) if k <= n]
    marked = f"<{w}>"
    names += [marked[i : i + k] for k in (2, 3) for i in range(len(marked) - k + 1)]
    if word in lexicon:
        names.append(f"={word}")
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in names]


@dataclass
class ChainModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transitions: np.ndarray  # from x to
    first: np.ndarray
    lexicon: frozenset[str] = frozenset()
    known: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "rows": None}

    def emissions(self, words: list[list[str]]) -> list[np.ndarray]:
        """For each text the numbers of its words in ``rows``."""
        if self.rows is None or len(self.known) > _KNOWN:
            self.known, self.rows = {}, np.empty((0, len(self.languages)))
        new = list(dict.fromkeys(w for ws in words for w in ws if w not in self.known))
        if new:
            lists = [features(w, self.lexicon) for w in new]
            flat = np.fromiter((f for fs in lists for f in fs), np.int64)
            starts = np.concatenate([[0], np.cumsum([len(fs) for fs in lists])[:-1]])
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, np.add.reduceat(self.weights[flat], starts, axis=0)])
        return [np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)) for ws in words]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (time, text, label), expected transitions, log-normalisers of padded sequences, in scaled probabilities."""
    steps, many, labels = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e = np.exp(scores - top)
    move = np.exp(transitions - transitions.max())
    alpha, scale = np.empty_like(e), np.ones((steps, many))
    a = e[0] * np.exp(first - first.max())
    scale[0] = a.sum(axis=1)
    alpha[0] = a / scale[0][:, None]
    for t in range(1, steps):
        a = (alpha[t - 1] @ move) * e[t]
        on = t < lengths
        s = np.where(on, a.sum(axis=1), 1.0)
        scale[t] = s
        alpha[t] = np.where(on[:, None], a / s[:, None], alpha[t - 1])
    beta = np.ones((many, labels))
    marginals, moves = np.empty_like(alpha), np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        marginals[t] = alpha[t] * beta
        if t:
            on = (t < lengths)[:, None]
            b = np.where(on, e[t] * beta / scale[t][:, None], 0.0)
            moves += (alpha[t - 1].T @ b) * move
            beta = np.where(on, b @ move.T, beta)
    live = np.arange(steps)[:, None] < lengths[None, :]
    z = (np.log(scale) + np.where(live, top[:, :, 0], 0.0)).sum(axis=0) + (lengths - 1) * transitions.max() + first.max()
    return marginals, moves, z


def fit(rows: list[tuple[str, str]], seed: int = 5) -> ChainModel | None:
    """Adagrad on the negative log-likelihood of stitched sequences from (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    counts: Counter = Counter()
    streams: dict[str, list[str]] = {lang: [] for lang in languages}
    for t, lang in rows:
        ws = words_of(t)
        counts.update(set(ws))
        streams[lang].extend(ws)
    lexicon = frozenset(w for w, c in counts.items() if c >= LEXICON_LEAST)
    n = len(languages)
    model = ChainModel(languages, np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n), lexicon)
    live = [i for i, lang in enumerate(languages) if streams[lang]]
    if not live:
        return None
    rng = np.random.default_rng(seed)
    squares, moved, begun = np.full((BUCKETS, n), 1e-2), np.full((n, n), 1.0), np.full(n, 1.0)
    known: dict[str, list[int]] = {}
    for _ in range(STEPS):
        batch, gold = [], np.empty((SEQUENCE, BATCH), np.int64)
        for b in range(BATCH):
            ws: list[str] = []
            while len(ws) < SEQUENCE:
                label = live[rng.integers(len(live))]
                stream = streams[languages[label]]
                run = min(int(rng.geometric(1 / 30)) + 2, SEQUENCE - len(ws))
                at = int(rng.integers(max(1, len(stream) - run + 1)))
                part = stream[at : at + run]
                gold[len(ws) : len(ws) + len(part), b] = label
                ws += part
            batch.append(ws)
        lists = []
        for t in range(SEQUENCE):
            for b in range(BATCH):
                w = batch[b][t]
                if (fs := known.get(w)) is None:
                    known[w] = fs = features(w, lexicon)
                lists.append(fs)
        sizes = np.array([len(fs) for fs in lists])
        flat = np.fromiter((f for fs in lists for f in fs), np.int64, sizes.sum())
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        scores = np.concatenate([np.add.reduceat(model.weights[:, j : j + _LABELS][flat], starts, axis=0) for j in range(0, n, _LABELS)], axis=1).reshape(SEQUENCE, BATCH, n)
        marginals, moves, _ = forward_backward(scores, np.full(BATCH, SEQUENCE), model.transitions, model.first)
        diff = -marginals
        np.put_along_axis(diff, gold[:, :, None], np.take_along_axis(diff, gold[:, :, None], 2) + 1, 2)
        by = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[by], prepend=-1))
        touched, word = flat[by][first], np.repeat(np.arange(len(sizes)), sizes)[by]
        diff = diff.reshape(-1, n)
        grad = np.concatenate([np.add.reduceat(diff[:, j : j + _LABELS][word], first, axis=0) for j in range(0, n, _LABELS)], axis=1) / BATCH
        squares[touched] += grad**2
        model.weights[touched] += RATE * grad / np.sqrt(squares[touched])
        seen = np.zeros((n, n))
        np.add.at(seen, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        g = (seen - moves) / BATCH
        moved += g**2
        model.transitions += RATE * g / np.sqrt(moved)
        g = (np.bincount(gold[0], minlength=n) - marginals[0].sum(axis=0)) / BATCH
        begun += g**2
        model.first += RATE * g / np.sqrt(begun)
    return model


def learn(docs: DataFrame, usable: Column | None = None, per_language: int = PER_LANGUAGE) -> ChainModel | None:
    """A model from a bounded sample of rows that ``usable`` (over doc_id) admits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("lang is not null and text is not null").filter(F.length("text") <= LONGEST)
    rows = rows.filter(usable) if usable is not None else rows
    counts = rows.groupBy("lang").count()
    languages = counts.count()
    if not languages:
        return None
    each = min(per_language, max(LEAST_ROWS, MOST_ROWS // languages))
    share = counts.select(F.col("lang").alias("of"), F.least(F.lit(1.0), 2.0 * each / F.col("count")).alias("share"))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    thin = rows.join(maybe_broadcast(share, languages, 64), F.col("lang") == F.col("of")).filter(spread < F.col("share")).drop("of", "share")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text", F.lit(1)), "doc_id", "text"))
    some = thin.withColumn("rank", rank).filter(F.col("rank") <= each).select("text", "lang", "doc_id").toArrow().to_pylist()
    some.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"], r["text"]))
    return fit([(r["text"], r["lang"]) for r in some])


def label_words(model: ChainModel, rows: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each text its words' most likely labels and the label sums, or None without a letter; texts of like length
    run through the chain side by side."""
    words = [words_of(t) for t in rows]
    words = [ws if any(c.isalpha() for w in ws for c in w) else [] for ws in words]
    numbers = model.emissions(words)
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(rows)
    order = sorted((i for i, ws in enumerate(words) if ws), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(words[order[end]]) * (end - at + 1) <= _CELLS:
            end += 1
        group = order[at:end]
        lengths = np.array([len(words[i]) for i in group])
        scores = np.zeros((int(lengths.max()), len(group), len(model.languages)))
        for b, i in enumerate(group):
            scores[: lengths[b], b] = model.rows[numbers[i]]
        marginals, _, _ = forward_backward(scores, lengths, model.transitions, model.first)
        for b, i in enumerate(group):
            m = marginals[: lengths[b], b]
            out[i] = (m.argmax(axis=1), m.sum(axis=0) / m.sum())
        at = end
    return out


def identify(docs: DataFrame, model: ChainModel | None, with_runs: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (the label's share of the text's words) and, if asked, the runs of one label (lang, words)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in sliced(batches):
            rows = texts(b)
            found = label_words(model, rows) if model is not None else [None] * len(rows)
            lang = [model.languages[int(f[1].argmax())] if f else UNKNOWN for f in found]
            score = [min(1.0, float(f[1].max())) if f else 0.0 for f in found]
            columns, names = [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
            if with_runs:
                runs = []
                for f in found:
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(f[0])) + 1, [len(f[0])]]) if f else [0]
                    runs.append([{"lang": model.languages[f[0][i]], "words": int(j - i)} for i, j in zip(cut[:-1], cut[1:], strict=True)])
                columns.append(pa.array(runs, kind))
                names.append("runs")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, lang_pred string, score double" + (", runs array<struct<lang:string,words:int>>" if with_runs else "")
    return id_text(docs).mapInArrow(tidied(run), schema)
