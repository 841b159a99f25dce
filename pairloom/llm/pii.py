"""Personal data in texts by DataFrame functions only: base patterns, and a bootstrap that learns contexts from them.

Spans of the base kinds and strings that are keys by their form (``SECRET``) are the seeds. The words around a seed, in windows
of one to three words on its left, two on its right, and both sides together, are lexical patterns of the seed's kind;
their letters are lower case and their digits one digit. Spark scores the graph of patterns and instances in rounds: a pattern is as
reliable, for a kind, as the instances it extracts, an instance as reliable as the patterns that extract it (noisy-or). Patterns
above a threshold with enough distinct seeds then admit tokens that hold a digit and stand in the same context,
where no base span is. Such spans are added with the kind ``found``; base spans always stay.

Positions are code points, end exclusive. They come from cutting a text at a pattern's matches and adding up lengths, in
chunks, and texts are cut by position in chunks too, so that many spans in a very long text take little more than
linear time. Patterns are written so that matching is linear: possessive groups, and starts tied to the left end
of a run. A kind whose marker character is absent is not searched at all. Neighbouring words are taken whole.

Defined cases: null text is empty and has no span; repeated rows each get theirs; an empty table gives an empty result;
other columns are kept by ``mask`` and not read by ``spans``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Workspace, maybe_broadcast

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<start:int,end:int>>"
MATCH = "array<struct<m:string,start:int,end:int>>"

#: The base patterns, equal in what they match to the plain forms of the contract.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Seeds beside the base kinds: runs of hexadecimal digits of a digest's length.
SECRET = r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{32,128}+(?![A-Za-z0-9])"
#: Bootstrapping: rounds of scoring, least reliability and least distinct seeds of a pattern, shape of an identifier.
ROUNDS, LEAST_RELIABILITY, LEAST_SEEDS = 3, 0.8, 5
_INNER = "[A-Za-z0-9@._+-]"
SHAPE = rf"(?<!{_INNER})(?={_INNER}*[0-9])[A-Za-z0-9]{_INNER}{{4,}}(?<=[A-Za-z0-9])"
CHUNK, CUT = 64, 1024


def _with_prefix(df: DataFrame, values: dict[str, str], start: int, op: Callable[[Column, Column], Column]) -> DataFrame:
    """For each array column named by a value a column named by its key: what op makes of all elements before each one.

    In chunks, so that n elements take n * CHUNK / 2 steps and the chunks' totals (n / CHUNK)^2 / 2. Each column is used
    at least twice by the next one, so that Catalyst doesn't put its expression into a lambda."""
    count = lambda v: F.greatest(F.ceil(F.size(v) / CHUNK).cast("int"), F.lit(1)) - 1

    def cut(v: str) -> Column:
        return F.transform(F.sequence(F.lit(0), count(v)), lambda c: F.slice(F.col(v), c * CHUNK + 1, CHUNK))

    chunked = {f"__c_{k}": cut(v) for k, v in values.items()}
    df = df.withColumns(chunked)
    df = df.withColumns({f"__t_{k}": F.transform(f"__c_{k}", lambda x: F.aggregate(x, F.lit(start), op)) for k in values})

    def of(k: str) -> Column:
        bases = F.transform(F.sequence(F.lit(0), F.size(f"__t_{k}") - 1), lambda c: F.aggregate(F.slice(F.col(f"__t_{k}"), 1, c), F.lit(start), op))
        return F.flatten(F.zip_with(f"__c_{k}", bases, lambda x, b: F.transform(x, lambda _, i: F.aggregate(F.slice(x, 1, i), b, op))))

    return df.withColumns({k: of(k) for k in values}).drop(*chunked, *[f"__t_{k}" for k in values])


def located(df: DataFrame, text: str, patterns: dict[str, str], needs: dict[str, Column], gaps: bool = False) -> DataFrame:
    """For each name its pattern's leftmost non-overlapping matches as array<struct<m, start, end>>, where the need holds;
    with ``gaps`` also ``{name}_gaps``, the texts before, between and behind them."""
    none = F.array().cast("array<string>")
    names = list(patterns)
    df = df.withColumns({f"__m_{k}": F.when(needs[k], F.regexp_extract_all(F.col(text), F.lit(patterns[k]), F.lit(0))).otherwise(none) for k in names})
    df = df.withColumns({f"{k}_gaps": F.when(F.size(f"__m_{k}") > 0, F.split(F.col(text), patterns[k], -1)).otherwise(none) for k in names})

    # arrays meet by zipping: a lambda that looks into another column may get that column's whole expression instead
    def long(k: str) -> Column:
        gaps = F.slice(F.transform(f"{k}_gaps", F.length), 1, F.size(f"__m_{k}"))
        return F.zip_with(f"__m_{k}", gaps, lambda m, g: F.length(m) + g)

    df = df.withColumns({f"__l_{k}": long(k) for k in names})
    df = _with_prefix(df, {f"__p_{k}": f"__l_{k}" for k in names}, 0, lambda a, x: a + x)

    def one(k: str) -> Column:
        ends = F.zip_with(f"__p_{k}", f"__l_{k}", lambda a, x: (a + x).cast("int"))
        return F.zip_with(f"__m_{k}", ends, lambda m, end: F.struct(m.alias("m"), (end - F.length(m)).alias("start"), end.alias("end")))

    df = df.withColumns({k: one(k) for k in names})
    return df.drop(*[f"__{x}_{k}" for k in names for x in "mlp"], *([] if gaps else [f"{k}_gaps" for k in names]))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(IP_VALID)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _needs(text: Column) -> dict[str, Column]:
    return {
        "email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.contains(text, F.lit("+")),
    }


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """A column for each base kind: its valid matches as array<struct<start, end>>; failing matches are dropped and not retried."""
    df = located(df, text, {f"__base_{k}": PATTERNS[k] for k in KINDS}, {f"__base_{k}": need for k, need in _needs(F.col(text)).items()})
    only = lambda k: F.transform(F.filter(f"__base_{k}", lambda x: _valid(k, x["m"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return df.withColumns({k: only(k) for k in KINDS}).drop(*[f"__base_{k}" for k in KINDS])


def _with_cover(df: DataFrame, spans: Column, name: str = "__cover") -> DataFrame:
    """A column of the spans (structs that begin with start, back = -end) in order, where overlapping ones count as one: the first
    of each with at, where the one before ends."""
    df = df.withColumn("__s", F.array_sort(spans)).withColumn("__e", F.transform("__s", lambda s: -s["back"]))
    df = _with_prefix(df, {"__at": "__e"}, 0, lambda a, x: F.greatest(a, x))
    cover = F.filter(F.zip_with("__s", "__at", lambda s, at: F.struct(s.alias("s"), at.alias("at"))), lambda x: x["at"] <= x["s"]["start"])
    return df.withColumn(name, cover).withColumn(f"{name}_end", F.coalesce(F.array_max("__e"), F.lit(0))).drop("__s", "__e", "__at")


def _cut(chunks: str, start: Column, end: Column) -> Column:
    """The text from start to end, out of its chunks of ``CUT`` characters."""
    first = F.floor(start / CUT).cast("int")
    near = F.array_join(F.slice(F.col(chunks), first + 1, F.floor(end / CUT).cast("int") - first + 1), "")
    return near.substr((start % CUT).cast("int") + 1, (end - start).cast("int"))


def _windows(left: Column, right: Column) -> Column:
    """The lexical patterns of a place, from the texts before and behind it: array<struct<side, word>>."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")
    a, z = plain(left), plain(right)
    lefts = [F.substring_index(a, " ", -k) for k in (2, 3, 4)]
    after = F.substring_index(z, " ", 2)
    words = {"l1": lefts[0], "l2": lefts[1], "l3": lefts[2], "r": after, "lr": F.concat(lefts[0], F.lit("\x00"), after)}
    filled = lambda w: F.regexp_replace(w, "[\x00 ]", "") != ""
    return F.filter(F.array(*[F.struct(F.lit(k).alias("side"), w.alias("word")) for k, w in words.items()]), lambda p: filled(p["word"]))


def _instances(kind: str, spans: str) -> Column:
    """A struct for each valid match: kind, m, start, end and the patterns around it; neighbours come from the gaps."""
    n = F.size(spans)
    beside = F.arrays_zip(F.col(spans).alias("x"), F.slice(f"{spans}_gaps", 1, n).alias("left"), F.slice(f"{spans}_gaps", 2, n).alias("right"))

    def one(z: Column) -> Column:
        x = z["x"]
        return F.struct(F.lit(kind).alias("kind"), F.lower(x["m"]).alias("m"), x["start"].alias("start"), x["end"].alias("end"), _valid(kind, x["m"]).alias("good"), _windows(z["left"], z["right"]).alias("patterns"))

    return F.filter(F.transform(beside, one), lambda x: x["good"])


def bootstrap(docs: DataFrame, work: Workspace, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, found): reliable patterns (kind, side, word, reliability, seeds), and the rows' added spans (row, found).

    docs: row, text and an array of spans for each base kind. Tokens are sought where base spans are blotted out.
    """
    seeds = {**{f"s_{k}": PATTERNS[k] for k in KINDS}, "s_secret": SECRET}
    needs = {**{f"s_{k}": F.size(k) > 0 for k in KINDS}, "s_secret": F.col("text").rlike("[0-9a-f]{32}")}
    df = located(docs, "text", seeds, needs, gaps=True)
    spans = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"))) for k in KINDS])
    df = _with_cover(df, spans).withColumn("chunks", F.when(F.size("__cover") > 0, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))))

    def blot(x: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col("__cover"), i + 1)["at"], F.col("__cover_end"))
        return F.concat(_cut("chunks", x["at"], x["s"]["start"]), F.repeat(F.lit("\x01"), end - x["s"]["start"]))

    rest = _cut("chunks", F.col("__cover_end"), F.length("text"))
    df = df.withColumn("open", F.when(F.size("__cover") > 0, F.concat(F.array_join(F.transform("__cover", blot), ""), rest)).otherwise(F.col("text")))
    df = located(df.drop("chunks", "__cover", "__cover_end"), "open", {"token": SHAPE}, {"token": F.col("open").rlike("[0-9]")}, gaps=True)
    each = [_instances(k, f"s_{k}") for k in (*KINDS, "secret")] + [_instances("open", "token")]
    # outer, for a plain explode brings a filter that Catalyst pushes below the columns, with their expressions in its lambdas
    df = df.select("row", F.explode_outer(F.concat(*each)).alias("i")).filter("i is not null").select("row", "i.kind", "i.m", "i.start", "i.end", "i.patterns")
    instances = work.table(df)
    edges = instances.select("kind", "m", F.explode("patterns").alias("p")).select("kind", "m", "p.side", "p.word")
    edges = work.table(edges.groupBy("side", "word", "m").agg(F.max(F.when(F.col("kind") != "open", F.col("kind"))).alias("seed")))
    belief = edges.filter("seed is not null").select("m", F.col("seed").alias("kind"), F.lit(1.0).alias("r")).distinct()
    sizes = edges.groupBy("side", "word").agg(F.count("*").alias("all"), F.count("seed").alias("seeds")).filter(f"seeds >= {LEAST_SEEDS}")
    sizes = work.table(sizes)
    scored = None
    for _ in range(rounds):
        reach = edges.select("side", "word", "m").join(maybe_broadcast(sizes, sizes.count(), 128), ["side", "word"]).join(belief, "m")
        # one instance in five is taken as wrong beforehand, so that a pattern needs several
        ratio = F.sum("r") / (F.first("all") + 0.25 * F.lit(LEAST_SEEDS))
        scored = work.table(reach.groupBy("kind", "side", "word").agg(ratio.alias("reliability"), F.first("seeds").alias("seeds")))
        doubt = F.sum(F.log1p(-F.least(F.col("reliability"), F.lit(0.999))))
        told = edges.join(maybe_broadcast(scored, scored.count(), 128), ["side", "word"]).groupBy("m", "kind").agg((1 - F.exp(doubt)).alias("r"))
        belief = work.table(told.unionByName(belief.filter("r = 1")).groupBy("m", "kind").agg(F.max("r").alias("r")))
    patterns = work.table(scored.filter(F.col("reliability") >= LEAST_RELIABILITY))
    known = patterns.select("side", "word").distinct()
    admitted = instances.filter("kind = 'open'").select("row", "start", "end", F.explode("patterns").alias("p")).select("row", "start", "end", "p.side", "p.word").join(known, ["side", "word"], "left_semi")
    found = admitted.select("row", "start", "end").distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"))
    found = work.table(found)
    work.drop(instances, edges, sizes)
    return patterns, found


def spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in ``keep``, and per kind (email, ip, card, phone, found) an array of its spans."""
    work = Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # only rows that could hold anything pass through the graph; a row is told by the hash of its id and text
    marked = base_spans(docs.select(*{"doc_id": None, **dict.fromkeys(keep)}, text.alias("__t")), "__t")
    marked = marked.withColumn("__row", F.xxhash64("doc_id", "__t"))
    some = base_spans(docs.select("doc_id", text.alias("__t")).filter(F.col("__t").rlike("[0-9@]")), "__t")
    _, found = bootstrap(some.select(F.xxhash64("doc_id", "__t").alias("row"), F.col("__t").alias("text"), *KINDS), work)
    found = maybe_broadcast(found.withColumnRenamed("row", "__row"), found.count(), 256)
    return marked.join(found, "__row", "left").withColumn("found", F.coalesce("found", F.array().cast(SPAN))).drop("__row")


def listed(kinds: tuple[str, ...] = (*KINDS, "found")) -> Column:
    """kind:start:end of all spans, by kind in this order, then by start, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(F.array_sort(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[of(k) for k in kinds]), ",")


def mask(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, with each span replaced by its kind in angle brackets; where spans overlap, the
    first by start, then the longest, is replaced and the rest of the overlap goes with it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # in one column, so that no name of theirs clashes
    held = spans(docs.select("doc_id", "text", whole.alias("__all")), ("__all",))

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(kind).alias("kind")))

    held = _with_cover(held, F.concat(*[of(k) for k in (*KINDS, "found")]))
    any_ = F.size("__cover") > 0
    held = held.withColumn("__chunks", F.when(any_, F.regexp_extract_all("__t", F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))))
    tags = F.transform("__cover", lambda x: F.concat(_cut("__chunks", x["at"], x["s"]["start"]), F.lit("<"), x["s"]["kind"], F.lit(">")))
    masked = F.concat(F.array_join(tags, ""), _cut("__chunks", F.col("__cover_end"), F.length("__t")))
    masked = F.when(any_, masked).otherwise(F.col("__all.text"))
    return held.select(*[masked.alias(c) if c == "text" else F.col("__all")[c].alias(c) for c in docs.columns])
