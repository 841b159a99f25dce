"""Spelling variants: words of a corpus that are one inserted, deleted or replaced code point apart.

Of two such words one half of the one stands unchanged in the other: its first half at the beginning or its second half at the
end. Every word's two halves are held in Aho-Corasick automata, dealt into shards by the half; every word visits the
shards that could hold a half of it (two lengths at either end), is scanned there, and where a half ends at the right place the
words of that half are compared by what is left of them. What two words share besides is thus never a key.

A half that more than ``HOT`` words hold is no shard's load: its words go one level down, where what is left of them is cut
into halves again beside the half that they share, and so on; with two code points left there are too few words to be many. A pair
that both halves would find is counted by the first alone.

Defined results: null and empty texts have no words; a null id is written as nothing before the colon of the misspelling
rule; rows are counted as they are, repeated ones too. Texts are scanned whole. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Workspace, id_text, maybe_broadcast, sliced, texts, tidied

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Least code points and least occurrences of a word; every so many words a misspelling is made.
LEAST, TIMES, EVERY = 5, 3, 97
#: Words of a shard; words that may hold one half before it is cut further; words that a task counts before it hands them on.
SHARD, HOT, HELD = 5_000, 20_000, 400_000


def vocabulary(docs: DataFrame, least: int = LEAST, times: int = TIMES, every: int | None = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the runs of letters that are long and frequent enough. With ``every``, a code point is dropped from those runs of
    a document for which that number divides the crc32 of id, colon and run."""

    def tally(i: int | None, text: str, n: Counter) -> None:
        found = _RUN.findall(text.encode().lower().decode())
        n.update(found)
        if every:
            start = zlib.crc32(f"{'' if i is None else i}:".encode())
            hit = {w: h for w in set(found) if not (h := zlib.crc32(w.encode(), start)) % every}
            for w, k in Counter(filter(hit.__contains__, found)).items() if hit else ():
                at = hit[w] % len(w)
                n[w] -= k
                n[w[:at] + w[at + 1 :]] += k

    def told(n: Counter) -> pa.RecordBatch:
        held = [(w, k) for w, k in n.items() if k > 0 and len(w) >= least]
        n.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.string()), pa.array([k for _, k in held], pa.int64())], names=["word", "n"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in sliced(batches):
            for i, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                if text:
                    tally(i, text, n)
                if len(n) > HELD:
                    yield told(n)
        yield told(n)

    counted = id_text(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _keys(words: DataFrame) -> DataFrame:
    """A row for each half that a word holds or may meet in another: key, holds, and the word with its context and rest."""
    w = words.withColumn("__l", F.length("rest"))
    firsts = "array_distinct(array(greatest(__l - 1, 0) div 2, __l div 2, (__l + 1) div 2))"
    seconds = "filter(array_distinct(array(__l div 2, (__l + 1) div 2, (__l + 2) div 2)), h -> h <= __l)"
    first = f"transform({firsts}, h -> struct('P' as side, substring(rest, 1, cast(h as int)) as seg, h = __l div 2 as holds))"
    second = f"transform({seconds}, h -> struct('S' as side, substring(rest, cast(__l - h as int) + 1, cast(h as int)) as seg, h = (__l + 1) div 2 as holds))"
    w = w.withColumn("__x", F.explode(F.expr(f"concat({first}, {second})")))
    return w.select("ctx", "rest", "word", "n", "__x.side", "__x.seg", "__x.holds", F.concat("ctx", "__x.side", "__x.seg").alias("key"))


class _Words:
    """Words that hold one half, by what is left of them; ``gaps`` has them by place and rest of each code point left out."""

    def __init__(self, length: int):
        self.length, self.rests, self.gaps = length, {}, defaultdict(list)

    def add(self, rest: str, word: str, n: int) -> None:
        self.rests[rest] = (word, n)
        for i in range(len(rest)):
            self.gaps[i, rest[:i] + rest[i + 1 :]].append(rest)

    def near(self, rest: str) -> set[str]:
        """The rests at a distance of exactly one."""
        found = set()
        for i in range(len(rest) + 1):
            cut = rest[:i] + rest[i + 1 :]
            if i < len(rest):
                if cut in self.rests:
                    found.add(cut)
                found.update(x for x in self.gaps.get((i, cut), ()) if x != rest)
            found.update(self.gaps.get((i, rest), ()))
        return found


def _on_path(ctx: str, v: str, w: str) -> bool:
    """Whether the halves that lead to this context are those by which the pair is counted: the first, where both would do."""
    for step in re.findall("[PS][^PS]*", ctx):
        half = len(w) // 2
        side = "P" if v.startswith(w[:half]) else "S"
        seg = w[:half] if side == "P" else w[half:]
        if step != side + seg:
            return False
        v, w = (v[half:], w[half:]) if side == "P" else (v[: len(v) - len(seg)], w[:half])
    return True


def _scan(ctx: str, held: list[tuple], asking: dict[str, tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """word, near words found here, the largest n of one, and that one, of words that have any. held: side, seg, rest, word, n."""
    by_half: dict[str, dict[str, _Words]] = defaultdict(dict)
    for side, seg, rest, word, n in held:
        words = by_half[seg].get(side)
        if words is None:
            words = by_half[seg][side] = _Words(len(seg))
        words.add(rest[len(seg) :] if side == "P" else rest[: len(rest) - len(seg)], word, n)
    automaton, anywhere = ahocorasick.Automaton(), by_half.pop("", {})
    for seg, sides in by_half.items():
        automaton.add_word(seg, sides)
    automaton.make_automaton()
    for word, rest in asking.items():
        near, size = [], len(rest)
        ends = [(words.length - 1 if side == "P" else size - 1, {side: words}) for side, words in anywhere.items()]
        if by_half:
            ends += automaton.iter(rest)
        for end, sides in ends:
            first, second = sides.get("P"), sides.get("S")
            if first is not None and end == first.length - 1:
                near += [first.rests[x] for x in first.near(rest[first.length :])]
            if second is not None and end == size - 1:
                # what is left of a word that holds its second half is its first half
                near += [second.rests[x] for x in second.near(rest[: size - second.length]) if not rest.startswith(x)]
        if ctx:
            near = [x for x in near if _on_path(ctx, word, x[0])]
        if near:
            best = min(near, key=lambda x: (-x[1], x[0]))
            yield word, len(near), best[1], best[0]


def _neighbours(words: DataFrame, work: Workspace, shard: int, hot: int) -> DataFrame:
    """word, n_near, best_n, best of each shard in which a word met any."""

    def scan(table: pa.Table) -> pa.Table:
        held, asking = defaultdict(list), defaultdict(dict)
        for ctx, rest, word, n, side, seg, holds in zip(*[table.column(c).to_pylist() for c in ("ctx", "rest", "word", "n", "side", "seg", "holds")], strict=True):
            asking[ctx][word] = rest
            if holds:
                held[ctx].append((side, seg, rest, word, n))
        found = [x for ctx, rows in held.items() for x in _scan(ctx, rows, asking[ctx])]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.Table.from_arrays([pa.array([x[i] for x in found], kinds[i]) for i in range(4)], names=["word", "n_near", "best_n", "best"])

    level, out = words.select(F.lit("").alias("ctx"), F.col("word").alias("rest"), "word", "n"), None
    while True:
        keys = work.table(_keys(level))
        many, holding = work.table(keys.filter("holds and seg <> ''").groupBy("key").agg(F.count("*").alias("h")).filter(F.col("h") > hot).select("key")), keys.filter("holds").count()
        n_hot = many.count()
        calm = keys.join(maybe_broadcast(many, n_hot, 100), "key", "left_anti") if n_hot else keys
        shards = max(1, holding // (2 * shard))
        found = calm.withColumn("__shard", F.pmod(F.xxhash64("key"), F.lit(shards))).drop("key").groupBy("__shard").applyInArrow(scan, "word string, n_near long, best_n long, best string")
        out = work.table(found) if out is None else out.unionByName(work.table(found))
        if not n_hot:
            return out
        further = keys.join(maybe_broadcast(many, n_hot, 100), "key", "left_semi")
        left = F.expr("if(side = 'P', substring(rest, length(seg) + 1), substring(rest, 1, length(rest) - length(seg)))")
        level = further.select(F.col("key").alias("ctx"), left.alias("rest"), "word", "n")


def _roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """word, root: the end of each word's chain of forms. Chains double their reach with every join; n at least doubles from
    word to form, so no chain is longer than the binary logarithm of the greatest n."""
    at = work.table(forms.select("word", F.col("form").alias("root")))
    size = at.count()
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("__on"))
        joined = work.table(at.join(maybe_broadcast(further, size, 80), "root", "left").select("word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("__moved")))
        if joined.filter("__moved").isEmpty():
            return joined.drop("__moved")
        at = joined.drop("__moved")


def variants(words: DataFrame, ratio: int = 2, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """For each word (word, n; distinct): n_near, its near words; form, the most frequent of them (ties: the smallest), where that is at
    least ``ratio`` times as frequent; form_n, its n; root, the last of the chain of forms, the word itself without one."""
    if ratio < 2:
        raise ValueError("forms must be more frequent, or chains could be circles")
    work = Workspace(words.sparkSession)
    words = work.table(words.select("word", "n"))
    near = _neighbours(words, work, shard, hot).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    clear: Column = -F.col("best.n") >= ratio * F.col("n")
    found = work.table(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(clear, F.col("best.word")).alias("form"), F.when(clear, -F.col("best.n")).alias("form_n")))
    roots = _roots(found.filter("form is not null"), work)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
