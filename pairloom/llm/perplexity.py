"""Quality rules by n-gram perplexity: a modified Kneser-Ney model per language, counted by Spark over all documents.

The units are the characters of whole texts: letters, marks and the blanks between words, so that n-grams run across words
(case kept, a start and an end mark; white space is one blank, a run of one punctuation mark is one, for its length tells
nothing). Spark counts every occurrence of every n-gram of the highest order; lower orders hold continuation counts.
Interpolated probabilities and back-off weights are joined up order by order and kept as sorted arrays of 64-bit hashes
with float values, which the scoring tasks look up by binary search. What is gathered grows with the input: the arrays
with new n-grams, all of which stay. The arrays are broadcast behind a check of their size; beyond ``MODEL_BYTES`` nothing
is gathered: each document's n-grams, with how often it holds them, meet the written ones in a join. Every text is one
that the model has counted, so that all its n-grams of the highest order are there, and both ways give the same scores.

Per language, documents that pass the base rules give the median and the quartiles of log-perplexity (the mean surprise of a
character), and the band is so many quartile spreads below and above the median. The root mean square of the surprise,
in which rare marks between plain words show, has an upper bound of the same kind. A language with few documents takes the bands of all.

Defined cases: null text has no words and fails the base rules; a text without words has no perplexity and is not kept;
a null language is a language of its own; repeated rows count and score each; an empty table gives an empty result; very
long texts are counted and scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Workspace, mix64, sliced, texts, tidied

ORDER = 4
BAND = (7.0, 7.5)  # quartile spreads, scaled to standard deviations, below and above the median
SPIKES = 4.5  # the same above the median of the root mean square
LEAST_DOCUMENTS = 30
LEAST_WORDS, MOST_REPEATED = 50, (50, 100)
SYMBOLS = "#*$%&|<>"
MODEL_BYTES = 256 << 20
_SPACES = " \t\n\x0b\x0c\r"
_START, _END = 2, 3  # code points of the marks; control characters are no text's letters
_CHARS, _TABLE = 1 << 20, 1 << 22  # characters that are counted or scored at a time; entries of a table of n-grams

_BLANKS = re.compile(r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]")
_RUNS = re.compile(r"([!-/:-@\[-`{-~])\1+")


def split_words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def normal(text: str | None) -> str:
    """The text as the model sees it."""
    return _RUNS.sub(r"\1", _BLANKS.sub(" ", text).strip(" ")) if text else ""


# ---- base rules


def base_rules(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not words:
        return 0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0
    n, seen, again = len(words), set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(_SPACES):
            seen.add(line)
    repeated = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
        k = len(ids)
        pairs = w[:-1] * k + w[1:]
        _, pairs = np.unique(pairs, return_inverse=True)
        _, at, count = np.unique(pairs[:-1] * k + w[2:], return_inverse=True, return_counts=True)
        hit = np.flatnonzero(count[at] > 1)
        cover = np.zeros(n, bool)
        for d in range(3):
            cover[hit + d] = True
        repeated = int(cover.sum())
    return n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), again, repeated


# ---- counting


def _layout(rows: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of normal texts, each behind order-1 start marks and before an end mark; the places that are predicted; and how
    many of them each text has."""
    pad, end = chr(_START) * (order - 1), chr(_END)
    chars = np.frombuffer("".join(f"{pad}{t}{end}" for t in rows).encode("utf-32-le"), np.uint32)
    many = np.array([len(t) + 1 for t in rows], np.int64)
    lead = np.repeat(np.arange(1, len(rows) + 1) * (order - 1), many)
    return chars, lead + np.arange(len(lead)), many


def _gram_hash(chars: np.ndarray, at: np.ndarray, k: int, lang: int) -> np.ndarray:
    """Hashes of the k characters that end at each place."""
    h = np.full(len(at), lang, np.uint64)
    for i in range(k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + chars[at - i].astype(np.uint64) + np.uint64(1))
    return h


def _context_hash(chars: np.ndarray, at: np.ndarray, k: int, lang: int) -> np.ndarray:
    """Hashes of the k-1 characters before each place, told from hashes of n-grams."""
    return mix64(_gram_hash(chars, at - 1, k - 1, lang) ^ np.uint64(0x5851F42D4C957F2D))


def lang_id(lang: str | None) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode()) if lang is not None else 1


def _portions(rows: list[str]) -> Iterator[list[int]]:
    """Numbers of texts, so many together as hold about ``_CHARS`` characters; a longer text is a portion of its own."""
    part, size = [], 0
    for i, t in enumerate(rows):
        if part and size + len(t) > _CHARS:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(t)
    if part:
        yield part


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[int], list[str]]]:
    """Portions of a batch's texts of one language: the language, the rows' numbers, the normal texts; texts without words are out."""
    langs = texts(batch, "lang")
    rows = [normal(t) for t in texts(batch)]
    for lang in dict.fromkeys(langs):
        mine = [i for i, x in enumerate(langs) if x == lang and rows[i]]
        for part in _portions([rows[i] for i in mine]):
            yield lang, [mine[k] for k in part], [rows[mine[k]] for k in part]


def _compact(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of keys below a size, in order, and which of them each is: by a table where that is small, else by sorting."""
    if size <= _TABLE:
        there = np.zeros(size, bool)
        there[keys] = True
        distinct = np.flatnonzero(there)
        number = np.empty(size, np.int32)
        number[distinct] = np.arange(len(distinct), dtype=np.int32)
        return distinct, number[keys]
    distinct = np.unique(keys)
    return distinct, np.searchsorted(distinct, keys)


def _distinct(chars: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams at the places as rows of code points, which each place has, and how often each is there. Grams grow
    by a character at a time and are numbered anew at each length, so that the numbers stay small."""
    alphabet, code = _compact(chars, 0x110000)
    k, grams, which = len(alphabet), alphabet.astype(np.uint32)[:, None], code[at - order + 1].astype(np.int64)
    for i in range(order - 2, -1, -1):
        made, which = _compact(which * k + code[at - i], len(grams) * k)
        grams = np.concatenate([grams[made // k], alphabet[made % k].astype(np.uint32)[:, None]], axis=1)
        which = which.astype(np.int64)
    return grams, which, np.bincount(which, minlength=len(grams))


def _gram_counts(order: int):
    """lang, gram (code points of 32 bits each), n: counted within portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, _, rows in _by_language(b):
                chars, at, _ = _layout(rows, order)
                grams, _, n = _distinct(chars, at, order)
                offsets = pa.py_buffer(np.arange(len(n) + 1, dtype=np.int32) * 4 * order)
                gram = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(np.ascontiguousarray(grams))])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), gram, pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return run


def _gram_rows(order: int):
    names = [f"g{k}" for k in range(1, order + 1)] + [f"c{k}" for k in range(1, order + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, grams, n = np.array(texts(b, "lang"), object), texts(b, "gram"), b.column(b.schema.get_field_index("n"))
            for lang in dict.fromkeys(langs):
                mine = np.flatnonzero([x == lang for x in langs])
                chars = np.frombuffer(b"".join(grams[i] for i in mine), np.uint32)
                at, own = np.arange(len(mine)) * order + order - 1, lang_id(lang)
                columns = [_gram_hash(chars, at, k, own) for k in range(1, order + 1)] + [_context_hash(chars, at, k, own) for k in range(1, order + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), *[pa.array(x.view(np.int64)) for x in columns], n.take(pa.array(mine))], ["lang", *names, "n"])

    return run, "lang string, " + ", ".join(f"{x} long" for x in names) + ", n long"


def counted(docs: DataFrame, work: Workspace, order: int = ORDER) -> dict[int, DataFrame]:
    """For each order the n-grams with their counts: of occurrences in the highest, of characters before them in the others."""
    grams = docs.mapInArrow(tidied(_gram_counts(order)), "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    run, schema = _gram_rows(order)
    levels = {order: work.table(grams.mapInArrow(tidied(run), schema))}
    for k in range(order - 1, 0, -1):
        keep = [f"g{i}" for i in range(1, k + 1)] + [f"c{i}" for i in range(1, k + 1)]
        levels[k] = work.table(levels[k + 1].groupBy("lang", *keep).agg(F.count("*").alias("n")))
    return levels


def estimated(levels: dict[int, DataFrame], work: Workspace) -> tuple[list[DataFrame], dict[str | None, float]]:
    """For each order its n-grams g with context c, probability and the context's back-off, all of them; and each language's
    logarithm of what a character gets that it never had."""
    out: list[DataFrame] = []
    below, flat = None, {}
    for k in sorted(levels):
        level = levels[k]
        some = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        found = {r.lang: r for r in level.groupBy("lang").agg(*some, F.count("*").alias("types")).collect()}
        flat = flat or {lang: -math.log(r.types + 1) for lang, r in found.items()}
        discounts = work.spark.createDataFrame([(lang, *_discounts(r.n1, r.n2, r.n3, r.n4), 1.0 / (r.types + 1)) for lang, r in found.items()], "lang string, d1 double, d2 double, d3 double, flat double")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.join(F.broadcast(discounts), level["lang"].eqNullSafe(discounts["lang"])).drop(discounts["lang"]).withColumn("d", d)
        context = level.groupBy(f"c{k}").agg(F.sum("n").alias("all"), F.sum("d").alias("held")).withColumn("backoff", F.col("held") / F.col("all"))
        level = level.join(context.select(f"c{k}", "all", "backoff"), f"c{k}")
        if below is not None:
            level = level.join(below, f"g{k - 1}")
        lower = F.col("p") if below is not None else F.col("flat")
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("all") + F.col("backoff") * lower
        level = work.table(level.select(f"g{k}", f"c{k}", "n", "backoff", p.alias("p")))
        below = level.select(f"g{k}", "p")
        out.append(level)
    return out, flat


def gathered(tables: list[DataFrame]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and float32 values: for each order its grams' log-probabilities and its contexts' log back-off."""
    arrays: list[tuple[np.ndarray, np.ndarray]] = []
    for k, level in enumerate(tables, 1):
        arrays.append(_sorted(level.select(f"g{k}", F.log("p").alias("v"))))
        arrays.append(_sorted(level.select(f"c{k}", "backoff").distinct().select(f"c{k}", F.log("backoff").alias("v"))))
    return arrays


def train(docs: DataFrame, work: Workspace, order: int = ORDER) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[str | None, float]]:
    tables, flat = estimated(counted(docs, work, order), work)
    return gathered(tables), flat


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, kept sensible where counts of counts are missing."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5
    return min(max(d1, 0.05), 0.95), min(max(d2, 0.1), 1.9), min(max(d3, 0.2), 2.8)


def _sorted(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()
    keys = t.column(0).combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], t.column(1).combine_chunks().to_numpy(zero_copy_only=False).astype(np.float32)[by]


# ---- scoring


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and whether found, by binary search."""
    at = np.minimum(np.searchsorted(table[0], keys), max(0, len(table[0]) - 1))
    if not len(table[0]):
        return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
    return table[1][at], table[0][at] == keys


def place_scores(chars: np.ndarray, at: np.ndarray, lang: str | None, arrays: list[tuple[np.ndarray, np.ndarray]], flat: dict[str | None, float]) -> np.ndarray:
    """Natural log-probability of the character at each place, given those before it."""
    own, total, open_ = lang_id(lang), np.zeros(len(at)), np.arange(len(at))
    for k in range(len(arrays) // 2, 0, -1):
        v, found = _look_up(arrays[2 * k - 2], _gram_hash(chars, at[open_], k, own))
        total[open_[found]] += v[found]
        open_ = open_[~found]
        if not len(open_):
            return total
        w, seen = _look_up(arrays[2 * k - 1], _context_hash(chars, at[open_], k, own))
        total[open_[seen]] += w[seen]
    total[open_] += flat.get(lang, -math.log(2))
    return total


def text_scores(rows: list[str], lang: str | None, arrays: list[tuple[np.ndarray, np.ndarray]], flat: dict[str | None, float]) -> np.ndarray:
    """Natural log-probability for each character, end mark included, of each normal text."""
    return -text_surprise(rows, lang, arrays, flat)[0]


def text_surprise(rows: list[str], lang: str | None, arrays: list[tuple[np.ndarray, np.ndarray]], flat: dict[str | None, float]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and root mean square of the surprise of the characters of each normal text. Equal n-grams are looked up once."""
    order = len(arrays) // 2
    chars, at, many = _layout(rows, order)
    grams, which, _ = _distinct(chars, at, order)
    each = place_scores(grams.ravel(), np.arange(len(grams)) * order + order - 1, lang, arrays, flat)
    first = np.concatenate([[0], np.cumsum(many)[:-1]])
    return -np.add.reduceat(each[which], first) / many, np.sqrt(np.add.reduceat((each * each)[which], first) / many)


def _score(shared, order: int):
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "surprise"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, flat = shared.value
        for b in sliced(batches, 2000):
            mean: list[float | None] = [None] * b.num_rows
            root: list[float | None] = [None] * b.num_rows
            for lang, mine, rows in _by_language(b):
                for i, v, w in zip(mine, *(x.tolist() for x in text_surprise(rows, lang, arrays, flat)), strict=True):
                    mean[i], root[i] = v, w
            columns = zip(*(base_rules(t, split_words(t)) for t in texts(b)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.schema.get_field_index("lang")), *[pa.array(c, pa.int64()) for c in columns], pa.array(mean, pa.float64()), pa.array(root, pa.float64())], names)

    return run


def _held(order: int):
    """row, doc_id, lang, the base counts, the number of places, and the n-grams with how often the text has each."""
    names = ["row", "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "size", "grams"]
    kind = pa.list_(pa.struct([("g", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 200):
            sizes, bags = [], []
            for t, lang in zip(texts(b), texts(b, "lang"), strict=True):
                if not (row := normal(t)):
                    sizes.append(0)
                    bags.append([])
                    continue
                chars, at, _ = _layout([row], order)
                grams, _, n = _distinct(chars, at, order)
                h = _gram_hash(grams.ravel(), np.arange(len(grams)) * order + order - 1, order, lang_id(lang)).view(np.int64)
                sizes.append(len(at))
                bags.append([{"g": g, "times": k} for g, k in zip(h.tolist(), n.tolist(), strict=True)])
            columns = zip(*(base_rules(t, split_words(t)) for t in texts(b)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(b.schema.get_field_index("lang")), *[pa.array(c, pa.int64()) for c in columns], pa.array(sizes, pa.int64()), pa.array(bags, kind)], names)

    return run


def _joined_scores(docs: DataFrame, top: DataFrame, work: Workspace, order: int) -> DataFrame:
    """What ``_score`` gives, for a model of any size: a join of the documents' n-grams with the model's."""
    grams = top.select(F.col(f"g{order}").alias("g"), F.log("p").cast("float").cast("double").alias("v"))
    schema = "row long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, size long, grams array<struct<g: long, times: long>>"
    rows = work.table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "lang").mapInArrow(tidied(_held(order)), schema))
    met = rows.select("row", F.explode("grams").alias("u")).select("row", "u.g", "u.times").join(grams, "g")
    total = met.groupBy("row").agg(F.sum(F.col("times") * F.col("v")).alias("total"), F.sum(F.col("times") * F.col("v") * F.col("v")).alias("squares"))
    scored = rows.drop("grams").join(total, "row", "left").withColumns({"log_perplexity": -F.col("total") / F.col("size"), "surprise": F.sqrt(F.col("squares") / F.col("size"))})
    return scored.drop("row", "size", "total", "squares")


def judge(docs: DataFrame, order: int = ORDER, band: tuple[float, float] = BAND, spikes: float = SPIKES) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, log_perplexity (per character) with its band low and high, surprise with
    its upper bound, kept, of every row."""
    spark = docs.sparkSession
    work = Workspace(spark)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    levels = counted(chosen.select("text", "lang"), work, order)
    size = sum(t.count() for t in levels.values())
    tables, flat = estimated(levels, work)
    if size * 24 <= MODEL_BYTES:
        shared = spark.sparkContext.broadcast((gathered(tables), flat))
        schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double, surprise double"
        scored = chosen.mapInArrow(tidied(_score(shared, order)), schema)
    else:
        scored = _joined_scores(chosen, tables[-1], work, order)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * MOST_REPEATED[1] > F.col("n_words") * MOST_REPEATED[0])
    scored = work.table(scored.withColumn("base_failed", failed))
    sound = scored.filter("not base_failed and log_perplexity is not null")
    q, r = (F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(n) for c, n in (("log_perplexity", "q"), ("surprise", "r")))
    bands = sound.groupBy("lang").agg(q, r, F.count("*").alias("n"))
    every = sound.agg(q, r).first()
    whole = {n: F.array(*[F.lit(float(x)) for x in (every[n] or (0.0, 0.0, 0.0))]) for n in ("q", "r")}
    bands = bands.withColumns({n: F.when(F.col("n") >= LEAST_DOCUMENTS, F.col(n)).otherwise(whole[n]) for n in whole})
    spread = lambda n: F.greatest((F.col(n)[2] - F.col(n)[0]) / 1.349, F.lit(1e-3))
    ends = [(F.col("q")[1] - band[0] * spread("q")).alias("low"), (F.col("q")[1] + band[1] * spread("q")).alias("high"), (F.col("r")[1] + spikes * spread("r")).alias("bound")]
    bands = work.table(bands.select(F.col("lang").alias("band_lang"), *ends))
    joined = scored.join(bands, scored["lang"].eqNullSafe(bands["band_lang"]), "left").drop("band_lang")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")) & (F.col("surprise") <= F.col("bound")), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)
