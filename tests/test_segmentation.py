"""Units of several syllables: what is learned, and that the way through a clause is the cheapest."""

from __future__ import annotations

import itertools
import random
import unicodedata

from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import segmentation as seg


def ways(n):
    """All ways to cut n syllables into units of at most three."""
    if n == 0:
        yield []
    for k in range(1, min(3, n) + 1):
        yield from ([k, *rest] for rest in ways(n - k))


def price(s, units, cut):
    total, at = 0, 0
    for k in cut:
        unit = " ".join(s[at : at + k])
        if unit not in units and k > 1:
            return None
        total += units.get(unit, 1 + max(units.values(), default=0))
        at += k
    return total


def test_the_way_is_the_cheapest_of_all():
    r = random.Random(3)
    for _ in range(200):
        units = {" ".join(r.choices("abcd", k=r.randint(1, 3))): r.randint(1, 6) for _ in range(r.randint(0, 14))}
        s = r.choices("abcde", k=r.randint(1, 9))
        found, cost = seg.Segmenter(units).path(s)
        every = [(p, len(c), [-x for x in reversed(c)]) for c in ways(len(s)) if (p := price(s, units, c)) is not None]
        least = min(every)
        assert (cost, len(found)) == least[:2] and sum(found) == len(s)
        assert found == [-x for x in reversed(least[2])]


def _naive_units(texts, least, ratio):
    runs = {}
    for t in texts:
        for clause in seg._CLAUSE.findall(unicodedata.normalize("NFC", t or "").lower()):
            s = clause.split()
            for n, i in itertools.product((1, 2, 3), range(len(s))):
                if i + n <= len(s):
                    unit = tuple(s[i : i + n])
                    runs[unit] = runs.get(unit, 0) + 1
    total = sum(c for u, c in runs.items() if len(u) == 1)
    kept = {u: c for u, c in runs.items() if c >= least}
    return {" ".join(u): c for u, c in kept.items() if all(c * total >= ratio * kept[u[:i]] * kept[u[i:]] for i in range(1, len(u)))}


def test_units_are_those_of_plain_counting(spark):
    r = random.Random(4)
    words = ["học sinh", "sinh học", "công nghệ thông tin", "máy", "và", "của", "tin", "nhà"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 12))) + r.choice([".", ", ", "\n", ""]) + " ".join(r.choices(words, k=3)) for _ in range(120)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500, None, "x"), (501, "", None), (502, "12 34 !", None), (503, texts[0], "x"), (504, "máy " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit string").repartition(4)
    got = {x.unit: x.times for x in seg.learn(docs, least=4, ratio=3.0).collect()}
    assert got == _naive_units([x[1] for x in rows], 4, 3.0)
    assert "công nghệ" in got or "nghệ thông" in got


def test_joined_words_become_tokens_of_either_form(spark):
    units = spark.createDataFrame([("học sinh", 2, 9, 5), ("sinh học", 2, 9, 7), ("học", 1, 9, 4), ("sinh", 1, 9, 4)], "unit string, n int, times long, cost long")
    decomposed = unicodedata.normalize("NFD", "Học sinh  học, sinh học!")
    rows = [(1, "Học sinh học sinh học."), (2, decomposed), (3, None), (4, ""), (5, "… 7"), (6, "lạ học  sinh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.text, x.n_units, x.n_joined, x.cost) for x in seg.segmented(docs, units).collect()}
    assert got[1] == ("Học_sinh học_sinh học.", 3, 2, 14)
    assert got[2] == (unicodedata.normalize("NFC", "Học_sinh  học, sinh_học!"), 3, 2, 16)
    assert got[3] == (None, 0, 0, 0) and got[4] == ("", 0, 0, 0) and got[5] == ("… 7", 0, 0, 0)
    assert got[6] == ("lạ học_sinh", 2, 1, 13)
    tokens = docs.select("doc_id", text.segmented_tokens(F.col("text"), seg.segmenter(units).join).alias("t"))
    assert {x.doc_id: x.t for x in tokens.collect()}[1] == ["học_sinh", "học_sinh", "học"]


def test_nothing_is_learned_from_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    units = seg.learn(empty)
    assert units.count() == 0 and seg.segmented(empty, units).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert seg.segmented(one, units).first()[1:] == ("a b c", 3, 0, 3)
