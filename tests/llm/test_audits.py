"""Sharding, spelling variants and source divergence against plain code; edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.llm import divergence, kd_shards, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HOSTILE = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (None, "null id", "en", "a", 7), (3, "same text", "en", "a", 9), (3, "same text", "en", "a", 9),
    (4, "x" * 30_000, "en", None, 30_000), (5, "été ÉTÉ naïve", "fr", "b", 13), (6, "\n \t", "", "", 3), (7, "🙂 emoji 漢字", "zh", "c", 10), (8, "12345", "en", "a", 5),
]


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    """Extra columns under names that operators use."""
    return df.withColumns({c: F.lit("clash") for c in ("word", "n", "term", "vec", "shard", "size", "key", "node", "value", "total")})


def corpus(seed, n=300, words=60, langs=("en", "de"), sources=("a", "b", "c")):
    r = random.Random(seed)
    letters = "abcdeé"
    pool = ["".join(r.choice(letters) for _ in range(r.randint(4, 7))) for _ in range(words)]
    pool += [w[:2] + r.choice(letters) + w[3:] for w in pool[: words // 2]] + [w + r.choice(letters) for w in pool[: words // 3]]
    return [(i, " ".join(r.choices(pool, k=r.randint(0, 60))), r.choice(langs), r.choice(sources), r.randint(0, 500)) for i in range(n)]


# ---- sharding


def plain_tree(points, k, node=0):
    """points: size, coordinates, tie; yields point and shard."""
    if k == 1 or not points:
        return [(p, node) for p in points]
    spans = [max(p[1][d] for p in points) - min(p[1][d] for p in points) for d in range(len(points[0][1]))]
    d, weight = spans.index(max(spans)), sum(p[0] for p in points)
    by_key = defaultdict(list)
    for p in points:
        by_key[p[1][d], p[2]].append(p)
    target, run, left = weight * (k // 2) // k, 0, []
    right = []
    for key in sorted(by_key):
        own = sum(p[0] for p in by_key[key])
        below = run < target or (run == 0 and target == 0 and not left and not right)
        if below and (run + own < target or 2 * (target - run) >= own):
            left += by_key[key]
        else:
            right += by_key[key]
        run += own
    return plain_tree(left, k // 2, node) + plain_tree(right, k - k // 2, node + k // 2)


@pytest.mark.parametrize("count", [1, 2, 3, 7, 8])
def test_shards_follow_the_tree(spark, count):
    docs = made(spark, corpus(count, 400) + HOSTILE)
    cut = kd_shards.shard(docs, count)
    rows = kd_shards.shard(docs, 1).rows.collect()  # the coordinates, uncut
    want = Counter((r.doc_id, r.size, r.text_crc32, s) for r, s in ((p[3], s) for p, s in plain_tree([(r.size, list(r["__at"]), r["__tie"], r) for r in rows], count)))
    assert Counter(tuple(r) for r in cut.rows.select("doc_id", "size", "text_crc32", "shard").collect()) == want


def test_sizes_checksums_and_slots(spark):
    rows = corpus(5, 500) + HOSTILE
    got = kd_shards.shard(made(spark, rows), 8).slots().collect()
    text = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(text(t)) + 1, zlib.crc32(text(t))) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_hot_key_is_cut_and_sizes_are_near_equal(spark):
    """A third of the rows are copies of one text, all of one source; shards differ by a few rows at most."""
    r = random.Random(1)
    rows = [(i, "one text for all of these", "en", "hot", 25) if i % 3 == 0 else (i, "y" * r.randint(1, 60), "en", f"s{i % 5}", r.randint(1, 60)) for i in range(3000)]
    sums = Counter()
    for x in kd_shards.shard(made(spark, rows), 8).rows.collect():
        sums[x.shard] += x.size
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 4 * 61


def test_copies_stay_together_where_balance_allows(spark):
    rows = [(i, f"text {i // 5}", "en", "a", 10) for i in range(1000)]
    parts = defaultdict(set)
    for x in kd_shards.shard(made(spark, rows), 8).rows.collect():
        parts[x.text_crc32].add(x.shard)
    assert sum(len(p) > 1 for p in parts.values()) <= 7


def test_assigning_again_gives_the_same_shards(spark, tmp_path):
    docs = with_clashes(made(spark, corpus(2, 200) + HOSTILE))
    cut = kd_shards.shard(docs, 5)
    again = cut.assign(docs)
    assert set(again.columns) == set(docs.columns)
    count = lambda df: Counter(tuple(r) for r in df.select("doc_id", "shard").collect())
    assert count(again) == count(cut.rows)
    cut.write(docs, str(tmp_path / "out"), 2)
    assert count(spark.read.parquet(str(tmp_path / "out"))) == count(cut.rows)


def test_target_bytes_other_dimensions_and_empty_tables(spark):
    docs = made(spark, corpus(3, 200)).withColumns({"day": F.expr("date_add(date'2024-01-01', cast(n_chars as int))"), "x": F.when(F.col("doc_id") % 7 == 0, float("nan")).otherwise(F.col("n_chars") / 7)})
    total = kd_shards.shard(docs, 1).rows.agg(F.sum("size")).first()[0]
    cut = kd_shards.shard(docs, target_bytes=total // 4, dims=("day", "x"))
    assert cut.count in (4, 5) and cut.rows.select("shard").distinct().count() == cut.count
    empty = kd_shards.shard(docs.limit(0), 8)
    assert empty.slots().count() == 0
    assert kd_shards.shard(docs.limit(2), 8).slots().count() == 2
    with pytest.raises(ValueError, match="either"):
        kd_shards.shard(docs)


# ---- spelling variants


def plain_words(rows, every=97):
    n = Counter()
    for i, t, *_ in rows:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        for w, k in Counter(re.findall("[A-Za-zÀ-ÿ]+", low)).items():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += k
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in form.items() if n[x] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


@pytest.mark.parametrize(("seed", "every"), [(1, 97), (2, 3)])
def test_vocabulary_and_variants(spark, seed, every):
    rows = corpus(seed, 200) + HOSTILE
    docs = with_clashes(made(spark, rows))
    words = spelling.vocabulary(docs, every=every)
    assert {tuple(r) for r in words.collect()} == set(plain_words(rows, every).items())
    got = spelling.variants(words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == plain_variants(plain_words(rows, every))


@pytest.mark.parametrize("hot", [1, 3, 10])
def test_halves_of_many_words_are_cut_further(spark, hot):
    """Nothing is lost or counted twice where halves are shared by many, with letters that repeat."""
    r = random.Random(hot)
    n = {"".join(r.choice("ab") for _ in range(r.randint(5, 8))): r.randint(3, 60) for _ in range(400)}
    n |= {"prefix" + "".join(r.choice("abc") for _ in range(r.randint(0, 6))): r.randint(3, 60) for _ in range(150)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {tuple(x) for x in spelling.variants(words, shard=20, hot=hot).collect()} == plain_variants(n)


def test_ties_go_to_the_smaller_word_and_chains_to_their_end(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaaac": 6, "aaabb": 12, "aabbb": 24, "zzzzz": 4}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got["aaaaa"].form == "aaaab" and got["aaaaa"].root == "aabbb" and got["aaaaa"].form_n == 6
    assert got["aabbb"].form is None and got["aabbb"].root == "aabbb" and got["zzzzz"].n_near == 0
    with pytest.raises(ValueError, match="circles"):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_no_words_no_variants(spark):
    assert spelling.variants(spelling.vocabulary(made(spark, []))).count() == 0
    assert spelling.variants(spelling.vocabulary(made(spark, HOSTILE[:4]))).count() == 0


# ---- source divergence


def plain_audit(rows, least=10):
    docs = [(l or "", s or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")))) for _, t, l, s, _ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in d[2])
        kept = [w for w, k in df.items() if k >= least]
        count = {s: sum((d[2] for d in mine if d[1] == s), Counter()) for s in {d[1] for d in mine}}
        whole = sum(count.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in count:
            pairs = sorted(((sum(f(p[s][w], p[o][w]) for w in kept), o) for o in count if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][w], q[w]), w) for w in kept if count[s][w] and p[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("least", [1, 3, 10])
def test_divergence_equals_plain_sums(spark, least):
    rows = corpus(least, 120, 40, ("en", "de", None), ("a", "b", "c", "d", None)) + HOSTILE
    got = divergence.audit(with_clashes(made(spark, rows)), least_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_audit(rows, least))


def test_many_terms_with_one_vector(spark):
    """Thirty terms of equal counts: evaluated as one vector, ranked one by one, ties by name."""
    rows = [(i, " ".join(f"term{chr(97 + j)}{chr(97 + j // 13)}" for j in range(30)) if i < 12 else "other words here", "en", "a" if i < 12 else "b", 1) for i in range(24)]
    got = {tuple(r) for r in divergence.audit(made(spark, rows)).collect()}
    assert got == plain_audit(rows) and sum(x[1] == "a" and x[2] == "term" for x in got) == 10


def test_counts_beyond_64_bits_and_empty_tables(spark):
    big = spark.range(1).select(divergence.share(F.lit(4 * 10**12).cast("long"), F.lit(10**13).cast("long")).alias("p"), divergence.gap(F.lit(10**9).cast("long"), F.lit(1).cast("long")).alias("g")).first()
    assert big.p == 1 + 10**9 * (4 * 10**12 + 2) // 10**13 and big.g == (10**9 - 1) ** 2 // (10**9 + 1)
    assert divergence.audit(made(spark, [])).count() == 0
    assert {tuple(r) for r in divergence.audit(made(spark, [(1, None, None, None, None), (2, "x", None, "b", 1)])).collect()} == {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}
