"""Words of several syllables: units learned from the corpus, and the cheapest way through each clause.

A clause is a run of syllables (letters and marks) between which only blanks stand. Runs of one to ``LONGEST`` syllables within clauses are
counted over all texts. A run is a unit if it occurs ``least`` times and makes up ``SHARE`` of all syllables, so there are at most
1 / ``SHARE`` units of each length, whatever the corpus holds, and the table may be broadcast. A unit of several syllables must also occur
``ratio`` times as often as its parts would meet by chance, however it is cut in two. A unit costs minus the logarithm of its share,
in millionths; a clause is cut where the sum is least (fewest units first among equals, then the longer last unit).

Null, empty and letterless texts have no clause: they are learned from as nothing and come back as they are, in composed form. Repeated
rows count each time; an empty table gives no units, and without units every syllable stands alone. Long texts run whole: the cost
grows with their length, and a clause keeps three numbers a syllable. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.staging import staged

LONGEST, LEAST, SHARE, RATIO, MILLION = 3, 5, 2e-6, 20.0, 1_000_000
#: Texts whose runs a task counts before they go out.
SLICE = 500
SYLLABLE = r"[\p{L}\p{M}]+"
CLAUSE = rf"{SYLLABLE}(?: +{SYLLABLE})*"


def learn(docs: DataFrame, text_col: str = "text", least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """unit, n (syllables), times, cost (long) of every unit; a staged table."""
    clauses = regex.compile(CLAUSE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                found = [Counter() for _ in range(LONGEST)]
                for t in whole.slice(at, SLICE).column(0).to_pylist():
                    for clause in clauses.findall(composed(t).lower()) if t else []:
                        s = clause.split()
                        for n, c in enumerate(found, 1):
                            c.update(map(" ".join, zip(*(s[i:] for i in range(n)), strict=False)))
                for n, c in enumerate(found, 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([n] * len(c), pa.int32()), pa.array(c.values(), pa.int64())], ["unit", "n", "times"])

    runs = docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null").mapInArrow(run, "unit string, n int, times long")
    runs = staged(runs.groupBy("unit", "n").agg(F.sum("times").alias("times")))
    total = runs.filter("n = 1").agg(F.sum("times")).first()[0] or 0
    kept = staged(runs.filter((F.col("times") >= least) & (F.col("times") >= F.lit(SHARE) * total)))
    parts = F.broadcast(kept.select("unit", F.col("times").alias("part")))  # at most LONGEST / SHARE rows
    bound = kept
    for i in range(1, LONGEST):  # the cut behind the i-th syllable
        word = F.split("unit", " ")
        sides = {f"a{i}": F.array_join(F.slice(word, 1, i), " "), f"b{i}": F.array_join(F.slice(word, F.least(F.lit(i + 1), F.size(word) + 1), LONGEST), " ")}
        bound = bound.withColumns(sides)
        for side in sides:
            bound = bound.join(parts.select(F.col("unit").alias(side), F.col("part").alias(f"n_{side}")), side, "left")
        apart = F.col("times").cast("double") * total >= F.lit(ratio) * F.col(f"n_a{i}") * F.col(f"n_b{i}")
        bound = bound.filter((F.col("n") <= i) | apart)
    cost = F.round(-F.log(F.col("times") / F.lit(float(max(1, total)))) * MILLION).cast("long")
    return staged(bound.select("unit", "n", "times", cost.alias("cost")))


def composed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


class Segmenter:
    """A trie of units by syllable, and the best path over it."""

    def __init__(self, units: dict[str, int]):
        #: syllable -> [cost of the unit that ends here or None, the same for what may follow]
        self.root: dict[str, list] = {}
        for unit, cost in units.items():
            level, node = self.root, None
            for s in unit.split(" "):
                node = level.setdefault(s, [None, {}])
                level = node[1]
            node[0] = cost
        #: A syllable that is no unit stands alone; as no unit holds it, its price changes no choice.
        self.unknown = 1 + max(units.values(), default=0)

    def path(self, syllables: list[str]) -> tuple[list[int], int]:
        """(lengths of the units of the cheapest way, its cost)."""
        n = len(syllables)
        best: list[tuple[int, int, int] | None] = [(0, 0, 0)] + [None] * n  # cost, units, minus the last one's length
        for i in range(n):
            cost, units, _ = best[i]
            level = self.root
            for j in range(i, n):
                node = level.get(syllables[j])
                step = node[0] if node else None
                if j == i and step is None:
                    step = self.unknown
                if step is not None:
                    way = (cost + step, units + 1, i - j - 1)
                    if best[j + 1] is None or way < best[j + 1]:
                        best[j + 1] = way
                if not node:
                    break
                level = node[1]
        lengths, at = [], n
        while at:
            lengths.append(-best[at][2])
            at -= lengths[-1]
        return lengths[::-1], best[n][0]

    def parts(self, text: str | None) -> tuple[str | None, list[int], int]:
        """(the composed text with the blanks within units as underscores, lengths of all units, cost)."""
        if not text:
            return text, [], 0
        text = composed(text)
        out, lengths, cost, at = [], [], 0, 0
        for clause in _CLAUSE.finditer(text):
            spans = [m.span() for m in _SYLLABLE.finditer(text, *clause.span())]
            ways, price = self.path([text[a:b].lower() for a, b in spans])
            lengths += ways
            cost += price
            i = 0
            for n in ways:
                out += [text[at : spans[i][0]], "_".join(text[a:b] for a, b in spans[i : i + n])]
                at = spans[i + n - 1][1]
                i += n
        return "".join(out) + text[at:], lengths, cost

    def join(self, text: str) -> str:
        """The text with units joined, as ``segmented_tokens`` takes it."""
        return self.parts(text)[0]


_CLAUSE, _SYLLABLE = regex.compile(CLAUSE), regex.compile(SYLLABLE)


def segmenter(units: DataFrame) -> Segmenter:
    """From a table of ``learn``, whose number of rows is bounded by ``LONGEST / SHARE``."""
    return Segmenter({r.unit: r.cost for r in units.select("unit", "cost").toLocalIterator()})


def segmented(docs: DataFrame, units: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with units joined by underscores), n_units, n_joined (of several syllables), cost of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(segmenter(units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                found = [shared.value.parts(t) for t in b.column(1).to_pylist()]
                counts = [[len(f[1]) for f in found], [sum(n > 1 for n in f[1]) for f in found], [f[2] for f in found]]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["doc_id", "text", "n_units", "n_joined", "cost"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, text string, n_units long, n_joined long, cost long")
