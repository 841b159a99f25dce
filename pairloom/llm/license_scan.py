"""Licence notices and texts in documents by the Dice coefficient of word bigrams, with DataFrame functions only.

A document's segments are its lines, the sentences of its lines, its paragraphs, up to ``WINDOW`` sentences in a row of a
paragraph, whose line breaks count as blanks, and the whole text. A segment's words are
runs of letters and digits, lower case; its distinct word bigrams are compared with each template's. A Dice coefficient
of t needs sizes within a factor (2-t)/t of each other, so templates of other sizes are pruned before any comparison.

Only documents and segments that contain a cue word are looked at. That loses nothing: a segment which reaches the
threshold shares at least a known number of a template's bigrams, and ``cue_words`` picks words until more bigrams hold one
of them than a match could do without. Segments are matched within their row, without a shuffle.

A licence of ``BODY`` words or more is also sought in the midst of longer texts, by windows of as many words as the template has (the
whole text, where that is shorter) at every place. Their Dice coefficients are running sums: an occurrence of a bigram counts for
those windows that it is the first one in. Only texts that hold enough of a template's bigrams get that far. Of a text's windows each
template's best remains (the first of equal ones), unless a better one, or an equally good and longer one, covers more than half of
the shorter of both; so the notice that two licences begin with is the licence that it is part of. Segments that lie within a
remaining window, and whose bigrams are those of its template by the threshold, are left out.

Defined cases: null, empty or wordless text has no licence; a segment of one word has no bigram and matches nothing;
of equally good templates the first by name counts; repeated rows are scanned each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pairloom.llm.common import Workspace, maybe_broadcast

THRESHOLD, WINDOW, BODY = 0.8, 4, 100

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_FREE = """This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."""

#: Names and wordings of public licences and of the notices that refer to them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", _FREE.format("GNU Affero General Public License", "3")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _FREE.format("GNU General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _FREE.format("GNU General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", _FREE.format("GNU Lesser General Public License", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_AS_IS}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


#: Whole texts of public licences, named by their files.
TEMPLATES += tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))


_TEXTS = dict(TEMPLATES[-7:])
#: BSD-2-Clause is BSD-3-Clause without its third clause; the terms of ISC.
TEMPLATES += (
    ("BSD-2-Clause", re.sub(r"(?s)\n\W*3\. .*?permission\.", "", _TEXTS["BSD-3-Clause"])),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
)


def bodies(templates: tuple[tuple[str, str], ...]) -> list[tuple[int, str, list[str], int]]:
    """place, licence, distinct bigrams and length in bigrams of the templates that are sought by windows."""
    found = [(i, name, word_bigrams(text), len(re.findall(r"[^\W_]+", text)) - 1) for i, (name, text) in enumerate(templates)]
    return [x for x in found if x[3] + 1 >= BODY]


def word_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template, in order."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def least_shared(n: int, threshold: float) -> int:
    """How many of a template's n bigrams any segment must share to reach the threshold, whatever its size."""
    return math.ceil(threshold * n / (2 - threshold) - 1e-9)


def cue_words(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    """Words such that every match with a template holds one of them; long words, which are rare elsewhere, come first."""
    cues: set[str] = set()
    for _, text in templates:
        open_ = [set(g.split(" ")) for g in word_bigrams(text)]
        spare = least_shared(len(open_), threshold) - 1
        open_ = [g for g in open_ if not g & cues]
        while len(open_) > spare:
            gain = Counter(w for g in open_ for w in g)
            cues.add(max(gain, key=lambda w: (len(w) >= 5, gain[w] * len(w), w)))
            open_ = [g for g in open_ if not g & cues]
    return sorted(cues)


def _bigrams(segment: Column) -> Column:
    words = F.regexp_extract_all(segment, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    n = F.size(words)
    return F.when(n > 1, F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), F.slice(words, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(
        F.array().cast("array<string>")
    )


def _any_of(words: list[str]) -> str:
    """A pattern for whole words, by first letter."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(f'{a}(?:{chr(124).join(rest)})' for a, rest in by_letter.items())})(?![\p{{L}}\p{{N}}])"


def _lower() -> Column:
    return F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def embedded(docs: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> tuple[DataFrame, Column]:
    """(found, key): for the key of a text that holds a licence, array<struct<license, dice, start, length, template>> (in bigrams, from
    0); the key is null for texts that cannot hold one. Equal texts are looked at once."""
    long = bodies(templates)
    least = {i: least_shared(len(grams), threshold) for i, _, grams, _ in long}
    text = _lower()
    gate = (F.length(text) > 2 * min(least.values())) & text.rlike(_any_of(cue_words(tuple(templates[i] for i, *_ in long), threshold)))
    key = F.when(gate, F.sha2(text, 256))
    spark, work = docs.sparkSession, Workspace(docs.sparkSession)
    texts = docs.select(key.alias("key"), text.alias("x")).filter("key is not null").groupBy("key").agg(F.first("x").alias("x"))
    w, n = F.col("w"), F.greatest(F.size("w") - 1, F.lit(1))
    pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    grams = work.table(texts.select("key", _words(F.col("x")).alias("w")).filter("size(w) > 1").select("key", n.alias("m"), F.posexplode(pairs).alias("p", "gram")))
    known = spark.createDataFrame([(i, g) for i, _, gs, _ in long for g in gs], "t int, gram string")
    facts = spark.createDataFrame([(i, name, len(gs), size, least[i]) for i, name, gs, size in long], "t int, license string, n int, size int, least int")
    held = grams.join(F.broadcast(known), "gram").groupBy("key", "t").agg(F.count_distinct("gram").alias("c")).join(F.broadcast(facts), "t").filter("c >= least").drop("c", "least")
    held = work.table(held)
    before = F.coalesce(F.lag("p").over(W.partitionBy("key", "gram").orderBy("p")), F.lit(-1))
    seen = grams.withColumn("q", before).join(maybe_broadcast(held, held.count(), 200), "key").join(F.broadcast(known.withColumn("hit", F.lit(1))), ["t", "gram"], "left")
    last = F.greatest(F.col("m") - F.col("size"), F.lit(0))
    first_in, last_in = F.greatest(F.col("q") + 1, F.col("p") - F.col("size") + 1), F.least(F.col("p"), last)
    hit = F.coalesce("hit", F.lit(0))
    steps = F.array(F.struct(first_in.alias("s"), F.lit(1).alias("all"), hit.alias("shared")), F.struct((last_in + 1).alias("s"), F.lit(-1).alias("all"), (-hit).alias("shared")))
    facts_ = ["key", "t", "license", "n", "size", "m"]
    sums = seen.filter(first_in <= last_in).select(*facts_, F.explode(steps).alias("e")).groupBy(*facts_, F.col("e.s").alias("s")).agg(F.sum("e.all").alias("all"), F.sum("e.shared").alias("shared"))
    run = W.partitionBy("key", "t").orderBy("s")
    dice = 2.0 * F.sum("shared").over(run) / (F.col("n") + F.sum("all").over(run))
    scored = sums.withColumn("dice", dice).filter((F.col("s") <= last) & (F.col("dice") >= threshold))
    one = F.struct("license", "dice", F.col("s").alias("start"), F.least("size", "m").alias("length"), F.col("t").alias("template"))
    best = scored.groupBy("key", "t").agg(F.min_by(one, F.struct(-F.col("dice"), "s")).alias("b")).groupBy("key").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    overlap = lambda a, b: F.least(a["start"] + a["length"], b["start"] + b["length"]) - F.greatest(a["start"], b["start"])
    rank = lambda a: F.struct(a["dice"], a["length"], -a["template"])
    beaten = lambda a: F.exists("bs", lambda b: (rank(b) > rank(a)) & (2 * overlap(a, b) > F.least(a["length"], b["length"])))
    return work.table(best.select("key", F.filter("bs", lambda a: ~beaten(a)).alias("bodies"))), key


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and matches: array<struct<license, dice, segment>>, the best template of each segment that reaches the
    threshold, and the licences found by windows."""
    cue, text = _any_of(cue_words(templates, threshold)), _lower()
    grams = lambda t: F.split(F.lit("|".join(word_bigrams(t))), r"\|")
    table = F.array(*[F.struct(F.lit(name).alias("license"), grams(t).alias("grams"), F.lit(len(word_bigrams(t))).alias("n")) for name, t in templates])
    lines = F.split(text, "\n", -1)
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?;])[\x20\t]+", -1)))
    paragraphs = F.split(text, r"\n[\x20\t]*\n", -1)


    def runs(paragraph: Column) -> Column:
        one = F.split(F.regexp_replace(paragraph, r"[\x20\t\r]*\n[\x20\t\r]*", " "), r"(?<=[.!?;])[\x20\t]+", -1)
        later = [F.slice(one, k, F.greatest(F.size(one) - k + 1, F.lit(0))) for k in range(2, WINDOW + 1)]
        joined = [reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", x, y)), later[:k], one) for k in range(WINDOW)]
        return F.concat(*joined)

    windows = F.flatten(F.transform(paragraphs, runs))
    segments = F.array_distinct(F.transform(F.concat(lines, sentences, windows, paragraphs, F.array(text)), lambda x: F.trim(x)))
    segments = F.filter(segments, lambda x: x.rlike(cue))
    cut = F.transform(segments, lambda s: F.struct(s.alias("segment"), _bigrams(s).alias("grams")))
    wide = (2 - threshold) / threshold + 1e-9

    def best(s: Column) -> Column:
        n = F.size(s["grams"])
        near = F.filter(table, lambda t: (n > 0) & (n * wide >= t["n"]) & (t["n"] * wide >= n))
        scored = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(s["grams"], t["grams"])) / (n + t["n"])).alias("minus"), t["license"].alias("license")))
        top = F.array_min(scored)
        return F.struct(top["license"].alias("license"), (-top["minus"]).alias("dice"), s["segment"].alias("segment"))

    matches = F.filter(F.transform(cut, best), lambda m: F.coalesce(m["dice"] >= threshold, F.lit(False)))
    none = F.array().cast("array<struct<license:string,dice:double,segment:string>>")
    found, key = embedded(docs, templates, threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(cue), matches).otherwise(none).alias("matches"), key.alias("key"), text.alias("x"))
    n = found.count()
    if not n:
        return rows.select("doc_id", "matches")
    # Few texts hold whole licences; rows of all others have no key and go by.
    with_bodies = rows.filter("key is not null").join(maybe_broadcast(found, n, 1000), "key", "left")
    words = F.col("w")
    as_match = lambda b: F.struct(b["license"].alias("license"), b["dice"].alias("dice"), F.array_join(F.slice(words, b["start"] + 1, b["length"] + 1), " ").alias("segment"))
    plain = lambda m: F.concat(F.lit(" "), F.array_join(_words(m["segment"]), " "), F.lit(" "))

    def explained(m: Column) -> Column:
        own = _bigrams(m["segment"])
        inside = lambda b: F.contains(F.concat(F.lit(" "), as_match(b)["segment"], F.lit(" ")), plain(m))
        return F.exists("bodies", lambda b: inside(b) & (F.size(F.array_intersect(own, F.get(table, b["template"])["grams"])) >= threshold * F.size(own)))

    both = F.when(F.col("bodies").isNull(), F.col("matches")).otherwise(F.concat(F.transform("bodies", as_match), F.filter("matches", lambda m: ~explained(m))))
    with_bodies = with_bodies.withColumn("w", F.when(F.col("bodies").isNotNull(), _words(F.col("x")))).select("doc_id", both.alias("matches"))
    return rows.filter("key is null").select("doc_id", "matches").unionByName(with_bodies)
