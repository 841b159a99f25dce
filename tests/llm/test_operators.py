"""The dealt operators against brute force, and on rows that are null, empty, long, repeated or wider than expected."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import bpe_count, collision_ann, crf_lang, license_scan, mixing, packing, parity_join, perplexity, pii, toxicity
from pairloom.llm.common import fold_of, read

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents")


@pytest.fixture(scope="module")
def plain(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns with the operators' own names."""
    long = " ".join(f"w{i % 997} x{i % 31}" for i in range(60_000))
    rows = [
        (1, "one two three", "en", "a", 13), (2, None, "en", "a", None), (3, "", "en", None, 0), (4, " \n\t ", None, "b", 4), (5, long, "en", "a", len(long)),
        (6, "one two three", "en", "a", 13), (6, "one two three", "en", "a", 13), (7, "ONE Two three", "fr", "c", 13), (8, "été ça 日本 😀", "fr", "c", 9), (9, long, "en", "a", len(long)), (None, "lost row", None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCUMENT)
    return df.withColumns({"size": F.lit(1), "score": F.lit("x"), "n_tokens": F.lit(None).cast("int"), "key": F.lit(0), "rank": F.lit(1), "spans": F.lit("s"), "kept": F.lit(True), "piece": F.lit(3), "taken": F.lit(1), "component_id": F.lit(5), "toxic": F.lit(1), "row": F.lit(2)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


# ---- 1


def shingles(text, n):
    w = WORD.findall((text or "").encode().lower())
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_classes(rows, n, p, q):
    sets, where, parent = {i: shingles(t, n) for i, t in rows}, defaultdict(list), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in where[x] if j < i).items():
            if q * k >= p * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "p", "q"), [(3, 9, 10), (5, 8, 10)])
def test_parity_join_equals_brute_force(spark, n, p, q):
    rng = random.Random(n)
    rows, base = [], [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(k)) for k in (2, 4, 9, 20, 60, 200, 400)]
    for text in base:
        for _ in range(25):
            w = text.split()
            for _ in range(rng.randrange(0, max(2, len(w) // 25) + 1)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
            rows.append((len(rows) * 3 % 1000 + len(rows) // 334, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, base[3].upper()), (5004, base[3])]
    rows = list({i: t for i, t in rows}.items())
    found = parity_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), n, (p, q)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_classes(rows, n, p, q)


@pytest.mark.parametrize("tile", [3, 500])
def test_parity_join_counts_every_link(spark, monkeypatch, tile):
    monkeypatch.setattr(parity_join, "LINK_TILE", tile)
    rng = random.Random(tile)
    base = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"z{i}"
        rows.append((i, " ".join(w)))
    rows += [(50, "one two three"), (51, "one two three"), (52, "far off from all"), (53, None)]
    sets = {i: shingles(t, 3) for i, t in rows}
    want = {i: sum(j != i and bool(a and b) and 10 * len(a & b) >= 9 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    found = parity_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, (9, 10)).collect()
    assert {r.doc_id: r.n_links for r in found} == want
    assert len(set(want.values())) > 2


@pytest.mark.parametrize(("p", "q"), [(9, 10), (8, 10)])
def test_parity_sketches_agree_up_to_the_threshold(p, q):
    rng = np.random.default_rng(1)
    for n in [*range(2, 60), 80, 99, 100, 127, 250, 511, 1024, 3000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            out = int(rng.integers(0, (q - p) * n // q + 1))  # so many go; as many more come as the threshold allows
            kept = n - out
            new = max(0, kept * q // p - n)
            b = np.unique(np.concatenate([a[out:], rng.integers(0, 1 << 63, int(rng.integers(0, new + 1)) if n % 3 else new).astype(np.uint64)]))
            if len(a) == len(b) and (a == b).all():
                continue
            assert q * kept >= p * (len(a) + len(b) - kept)
            assert set(parity_join.sketch_keys(a, p, q).tolist()) & set(parity_join.sketch_keys(b, p, q).tolist()), (n, out, new)


def test_parity_join_repeated_ids_and_clashing_names(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, c), (3, c), (None, c), (None, "lost"), (4, a + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(7) for x in ("gone", "row", "sig", "text_id", "its_id", "label", "__nth")})
    kept = parity_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(1, a), (1, b), (3, c), (-1, "lost")])
    links = {(r.doc_id, r.component_id, r.n_links) for r in parity_join.linked(df).collect()}
    assert (4, 1, 2) in links and (None, 3, 1) in links and (None, None, 0) in links


@pytest.mark.parametrize("tile", [4, 1000])
def test_parity_join_slices_of_a_bucket_meet(spark, monkeypatch, tile):
    monkeypatch.setattr(parity_join, "TILE", tile)
    monkeypatch.setattr(parity_join, "SMALL", 6)  # in this process alone
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(60)] + [(100 + i, " ".join(base[:10] + [f"y{i}_{j}" for j in range(60)])) for i in range(20)]
    found = parity_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, (9, 10)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_classes(rows, 3, 9, 10)


def test_parity_join_odd_rows(odd, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.classes(odd, 3, (9, 10)).collect()}
    assert got[1] == got[6] == got[7] == (1, 1)
    assert got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (0, 4)
    assert got[9] == got[5] and got[5][1] == 5
    assert parity_join.classes(empty).count() == 0
    kept = parity_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 8]


# ---- 2


def test_collision_ann_recall_and_order(spark, sf):
    v = read(spark, sf, "embeddings")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in v.collect()]
    found = defaultdict(list)
    for r in collision_ann.nearest(v, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hit = total = 0
    for i, q in rows:
        if i % 10 == 0:
            truth = sorted((float(np.sqrt(((x - q) ** 2).sum())), j) for j, x in rows if j != i)[:10]
            hit += len({j for _, j in truth} & {j for j, _ in found[i]})
            total += len(truth)
            exact = dict((j, d) for d, j in sorted((float(np.sqrt(((x - q) ** 2).sum())), j) for j, x in rows if j != i))
            assert all(abs(exact[j] - d) < 1e-9 for j, d in found[i])
    assert hit / total >= 0.9


@pytest.mark.parametrize(("kind", "n", "sample"), [("clusters", 10_000, 20_000), ("random", 10_000, 20_000), ("clusters", 10_000, 1_000), ("random", 3_000, 700)])
def test_collision_ann_recall_work_and_partitions(spark, monkeypatch, kind, n, sample):
    monkeypatch.setattr(collision_ann, "SAMPLE", sample)
    rng = np.random.default_rng(7)
    v = rng.standard_normal((n, 64))
    if kind == "clusters":
        v = rng.standard_normal((100, 64))[rng.integers(0, 100, n)] + 0.25 * v
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in collision_ann.nearest(rows.repartition(3), F.col("vec_id") % 400 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for i in range(0, n, 400):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert len(got[i]) == 10 and all(s == d[j] for j, s in got[i])
        hits += len({j for j, _ in got[i]} & set(np.argsort(d, kind="stable")[:10].tolist()))
        total += 10
    assert hits >= 0.9 * total
    again = {(r.query_id, r.rank, r.vec_id, r.score) for r in collision_ann.nearest(rows.repartition(7), F.col("vec_id") % 400 == 0).collect()}
    assert again == {(i, k + 1, j, s) for i, x in got.items() for k, (j, s) in enumerate(x)}


@pytest.mark.parametrize(("kind", "most"), [("clusters", 0.25), ("random", 1.0)])
def test_collision_ann_takes_less_than_a_scan(kind, most):
    rng = np.random.default_rng(8)
    n, dim = 20_000, 64
    v = rng.standard_normal((n, dim))
    v = rng.standard_normal((200, dim))[rng.integers(0, 200, n)] + 0.25 * v if kind == "clusters" else v / np.linalg.norm(v, axis=1, keepdims=True)
    index = collision_ann.SortedProjections(v, collision_ann.random_directions(dim, collision_ann.PROJECTIONS, 1))
    asked = v[::1000]
    radius = np.array([np.partition(collision_ann._distances(v, q), 10)[10] for q in asked])
    lo, hi = index.windows(asked, radius)
    steps = sum(int((z - a).sum()) + dim * len(index.collided(a, z)) for a, z in zip(lo, hi, strict=True))
    assert steps <= most * dim * n * len(asked)


def test_collision_ann_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in collision_ann.nearest(v, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 9, 0.0), (0, 3, 2, pytest.approx(2**0.5))]
    assert collision_ann.nearest(v.limit(0), F.col("vec_id") == 0).count() == 0


# ---- 3


def level_fill(sizes, weights=(5, 2, 1), passes=3):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        open_ = [s for s in order if s not in capped]
        if not open_:
            return capped
        t = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if t[s] > passes * sizes[s]]
        if not over:
            return capped | t
        capped |= {s: passes * sizes[s] for s in over}


def test_mixing_targets_and_takes(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "ä", None]), " ".join("w" for _ in range(rng.randrange(0, 400)))) for i in range(600)] + [(1000, "tiny", "one two"), (1001, "a", None)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(d).taken().collect()
    size = {i: len(t.split()) if t else 0 for i, _, t in rows}
    source = {i: s for i, s, _ in rows}
    sums = Counter()
    for i, s in source.items():
        sums[s] += size[i]
    want, took = level_fill(dict(sums)), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sums[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.taken <= 3 * r.size
        took[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(took[s] - t) <= max(mixing.BLOCK_WORDS, 0.02 * t)
    again = {(r.doc_id, r.taken) for r in mixing.mix(d).taken().collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_permutations_are_permutations(spark):
    for n in (1, 2, 3, 10, 257):
        p = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(7), F.lit(n)).alias("p"))
        assert sorted(r.p for r in p.collect()) == list(range(n))


def test_mixing_odd_rows(odd, empty):
    got = mixing.mix(odd).taken().collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(empty).taken().count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(empty).count() == 0


# ---- 4


def brute_base(text):
    w = WORD.findall((text or "").encode())
    cover = set()
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    for at in windows.values():
        if len(at) > 1:
            cover |= {i + d for i in at for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_quality_rules_base_and_bands(spark, docs, plain, sf):
    judged = perplexity.judge(docs).collect()
    labels = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect()}
    for r in judged:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(plain[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [r.kept for r in judged if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) >= 0.9 * len(good)


class PlainModel:
    """Interpolated modified Kneser-Ney over the characters of a few texts, by the textbook, in dictionaries."""

    def __init__(self, rows, order):
        self.order, self.level, self.below = order, {}, {}
        top = Counter()
        for t in rows:
            t = "\2" * (order - 1) + t + "\3"
            top.update(t[i - order + 1 : i + 1] for i in range(order - 1, len(t)))
        self.level[order] = top
        for k in range(order - 1, 0, -1):
            self.level[k] = Counter(g[1:] for g in self.level[k + 1])
        self.discount = {}
        for k, c in self.level.items():
            n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
            self.discount[k] = [0, *(min(max(x, lo), hi) for x, lo, hi in zip(d, (0.05, 0.1, 0.2), (0.95, 1.9, 2.8), strict=True))]

    def p(self, context, x):
        k = len(context) + 1
        lower = self.p(context[1:], x) if k > 1 else 1 / (len(self.level[1]) + 1)
        after = {g: n for g, n in self.level[k].items() if g[:-1] == context}
        if not after:
            return lower
        d, n = self.discount[k], self.level[k].get(context + x, 0)
        held = sum(d[min(v, 3)] for v in after.values())
        return (n - d[min(n, 3)] + held * lower) / sum(after.values()) if n else held * lower / sum(after.values())


def test_kneser_ney_equals_the_textbook(spark, docs):
    from pairloom.llm.common import Workspace

    rows = [perplexity.normal(r.text) for r in docs.filter("lang = 'en' and length(text) between 300 and 900").orderBy("doc_id").limit(12).collect()]
    d = spark.createDataFrame([("en", t) for t in rows], "lang string, text string").select("text", "lang")
    arrays, flat = perplexity.train(d, Workspace(spark), 3)
    model = PlainModel(rows, 3)
    fresh = ["then the of thon", "zq zzz \u4e2d", rows[0][5:40][::-1], "a", rows[1][:30].upper()]
    for t in [rows[0][:60], *fresh]:
        chars, at, many = perplexity._layout([t], 3)
        got = perplexity.place_scores(chars, at, "en", arrays, flat)
        padded = "\2\2" + t + "\3"
        want = [np.log(model.p(padded[i - 2 : i], padded[i])) for i in range(2, len(padded))]
        assert many.tolist() == [len(t) + 1] and got == pytest.approx(want, abs=1e-4)
        assert perplexity.text_scores([t, rows[2]], "en", arrays, flat)[0] == pytest.approx(np.mean(want), abs=1e-4)
    letters = [*model.level[1], "\u4e2d"]  # a character never seen stands for all of them
    for context in ("th", "\2\2", "e ", "zq"):
        chars = np.array([[ord(context[0]), ord(context[1]), ord(x)] for x in letters], np.uint32).ravel()
        total = np.exp(perplexity.place_scores(chars, np.arange(len(letters)) * 3 + 2, "en", arrays, flat)).sum()
        assert total == pytest.approx(1.0, abs=1e-4)


def test_perplexity_sees_the_order_of_words(spark):
    from pairloom.llm.common import Workspace

    d = spark.createDataFrame([("en", "on the way to the sea of sand ") for _ in range(5)], "lang string, text string").select("text", "lang")
    arrays, flat = perplexity.train(d, Workspace(spark))
    straight, mixed = perplexity.text_scores(["on the way to the sea of sand", "sand the of way sea on to the"], "en", arrays, flat)
    assert straight > mixed + 0.1


def test_quality_rules_score_alike_without_a_broadcast(spark, docs, odd, monkeypatch):
    few = docs.orderBy("doc_id").limit(40).select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))
    key = lambda r: (str(r.doc_id), r.n_words, str(r.lang))
    whole = sorted(perplexity.judge(few).collect(), key=key)
    monkeypatch.setattr(perplexity, "MODEL_BYTES", 0)
    beyond = sorted(perplexity.judge(few).collect(), key=key)
    assert len(whole) == len(beyond) == few.count()
    for a, b in zip(whole, beyond, strict=True):
        assert a[:7] == b[:7] and a.kept == b.kept and a.base_failed == b.base_failed
        assert b.log_perplexity == (None if a.log_perplexity is None else pytest.approx(a.log_perplexity, abs=1e-9))


def test_quality_rules_odd_rows(odd, empty):
    got = perplexity.judge(odd).collect()
    assert len(got) == odd.count()
    assert all(not r.kept for r in got if r.n_words == 0)
    assert perplexity.judge(empty).count() == 0


# ---- 5

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def good(kind, m):
    d = re.sub(r"\D", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "", re.ASCII) if good(k, m[0])]


TRICKY = ["a@b.c_d@e.f", "x..y@z-.q.", "1.2.3.4.5.6.7.8 001.002.003.255 256.1.1.1 0000255.1.1.1", "4111 1111 1111 1111-1 4111-1111-1111-1111", "+1 (212) 555-1234. +12345678 +1234567890123456 ++49 30 1234567)", "😀é a@b.cd 😀 10.0.0.1", "@ + 1.2.3 +", None, ""]


def test_pii_base_spans_equal_brute_force(spark, plain):
    rows = [*plain.items(), *[(10**6 + i, t) for i, t in enumerate(TRICKY)]]
    listed = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(pii.KINDS).alias("s"))
    got = {r.doc_id: r.s for r in listed.collect()}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t)) for i, t in rows}


def test_pii_learns_a_context(spark):
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(6))
    rows = [(i, f"{filler()} reachable mailbox user{i}@host.example today {filler()}") for i in range(40)] + [(100 + i, f"{filler()} reachable mailbox user-{i}-at-home today {filler()}") for i in range(5)] + [(200, f"{filler()} unrelated serial-7x7x7x {filler()}")]
    got = {r.doc_id: r for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[100 + i].found) == 1 for i in range(5)) and not got[200].found
    s = got[100].found[0]
    assert dict(rows)[100][s.start : s.end].startswith("user-0-at")


def test_pii_odd_rows(spark, odd, empty):
    assert pii.spans(odd).count() == odd.count() and pii.spans(empty).count() == 0
    assert pii.mask(odd).columns == odd.columns
    long = spark.createDataFrame([(1, "9" * 100_000 + " " + "a" * 100_000 + " " + "1 " * 50_000 + "x@y.z")], "doc_id long, text string")
    assert pii.mask(long).first().text.endswith("<email>")
    assert [r.text for r in pii.mask(spark.createDataFrame([(1, "to a.b@c.de, 10.0.0.1"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()] == ["to <email>, <ip>", None]


# ---- 6


def test_language_held_out_accuracy(docs):
    model = crf_lang.learn(docs, fold_of("doc_id", 5) != 0)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [(r.lang_pred, lang[r.doc_id], r.score) for r in crf_lang.identify(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b, _ in held]) >= 0.95 and all(0 <= s <= 1 for *_, s in held)


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, t, f = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    marginals, _, z = crf_lang.forward_backward(e, np.array([4]), t, f)
    weight = {p: f[p[0]] + sum(e[i, 0, p[i]] for i in range(4)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)) for p in itertools.product(range(3), repeat=4)}
    total = sum(np.exp(w) for w in weight.values())
    assert z[0] == pytest.approx(np.log(total))
    assert marginals[2, 0, 1] == pytest.approx(sum(np.exp(w) for p, w in weight.items() if p[2] == 1) / total)


def test_language_odd_rows(odd, empty, spark):
    got = {r.doc_id: r for r in crf_lang.identify(odd, crf_lang.learn(odd), with_runs=True).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[2].score == 0 and got[8].lang_pred == "fr"
    assert crf_lang.learn(empty) is None
    assert crf_lang.identify(odd, None).filter("lang_pred <> 'und'").count() == 0
    assert crf_lang.identify(spark.createDataFrame([(1, "² ⅷ 123 _")], "doc_id long, text string"), crf_lang.learn(odd)).first().lang_pred == "und"


# ---- 7


def test_toxicity_learns_and_folds(spark):
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))
    rows = [(i, f"{filler()} grumbix{'abc'[i % 3]} {filler()}" if i % 4 == 0 else filler()) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(d, labels, F.col("doc_id") % 2 == 0)
    test = [(1, "a grumbixz here"), (2, filler()), (3, "You 1d1ot!"), (4, "ѕtupіd"), (5, "a clown fish and a trash can"), (6, None), (7, ""), (8, "no stupidity")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(test, "doc_id long, text string"), lexicon).collect()}
    assert [got[i].predicted for i in range(1, 9)] == [1, 0, 1, 1, 0, 0, 0, 0]
    assert got[6].score == got[7].score == got[2].score


def test_toxicity_odd_rows(odd, empty, spark):
    lexicon = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(odd, lexicon).count() == odd.count() and toxicity.score(empty, lexicon).count() == 0
    kept = toxicity.keep_clean(odd, lexicon)
    assert kept.columns == odd.columns and kept.count() == odd.count()


# ---- 8


def test_token_counts_equal_the_library(spark, plain):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    odd = ["<|startoftext|>Hi ΣΑΣ x<|endoftext|>", "İstanbul ² ⅷ 12345 é 日本語 👩‍👧 don't WE'LL", "\t\n<|endoftext", "ǅ ß ẞ ﬁ", "a" * 5000, "", None]
    rows = [*plain.items(), *[(10**6 + i, t) for i, t in enumerate(odd)]]
    for r in bpe_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect():
        t = dict(rows)[r.doc_id] or ""
        assert r.n_tokens == len(lib.encode(t, add_special_tokens=False).ids) and r.n_bytes == len(t.encode()) and r.over_limit == (r.n_tokens > 2048)


def test_token_counts_odd_rows(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe_count.count_tokens(odd, path).count() == odd.count() and bpe_count.count_tokens(empty, path).count() == 0


# ---- 9


def brute_matches(text, threshold=0.8):
    low, found, templates = (text or "").lower(), set(), [(n, set(license_scan.word_bigrams(t))) for n, t in license_scan.TEMPLATES]
    paragraphs = re.split(r"\n[ \t]*\n", low)
    parts = low.split("\n") + [s for x in low.split("\n") for s in re.split(r"(?<=[.!?;])[ \t]+", x)] + paragraphs + [low]
    for p in paragraphs:
        s = re.split(r"(?<=[.!?;])[ \t]+", re.sub(r"[ \t\r]*\n[ \t\r]*", " ", p))
        parts += [" ".join(s[i : i + k]) for k in range(1, 5) for i in range(len(s))]
    for p in {x.strip(" ") for x in parts}:
        g = set(license_scan.word_bigrams(p))
        scored = [(-2 * len(g & t) / (len(g) + len(t)), n) for n, t in templates] if g else []
        if scored and -min(scored)[0] >= threshold:
            found.add((min(scored)[1], round(-min(scored)[0], 9), p))
    windows = brute_windows(low, threshold)
    spaced = lambda words: f" {' '.join(words)} "
    inside = lambda p, w: spaced(re.findall(r"[^\W_]+", p)) in spaced(w[4]) and len(set(license_scan.word_bigrams(p)) & w[5]) >= threshold * len(license_scan.word_bigrams(p))
    return {x for x in found if not any(inside(x[2], w) for w in windows)} | {(w[1], round(w[0], 9), " ".join(w[4])) for w in windows}


def brute_windows(low, threshold):
    """dice, licence, start, length, words, bigrams of the template of the windows that remain; every window is compared."""
    words, best = re.findall(r"[^\W_]+", low), []
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    for t, name, known, size in license_scan.bodies(license_scan.TEMPLATES):
        known = set(known)
        if len(known & set(grams)) * 2 / (len(known & set(grams)) + len(known)) < threshold:
            continue
        scored = []
        for s in range(max(0, len(grams) - size) + 1):
            g = set(grams[s : s + size])
            scored.append((2 * len(g & known) / (len(g) + len(known)), -s))
        if scored and max(scored)[0] >= threshold:
            d, s = max(scored)
            best.append((d, name, -s, min(size, len(grams)), words[-s : min(size, len(grams)) + 1 - s], known, -t))
    shared = lambda a, b: min(a[2] + a[3], b[2] + b[3]) - max(a[2], b[2])
    return [a for a in best if not any((b[0], b[3], b[6]) > (a[0], a[3], a[6]) and 2 * shared(a, b) > min(a[3], b[3]) for b in best)]


def test_licences_in_the_midst_of_longer_texts(spark):
    """A body between code, with other words, in one line, twice, behind another licence; BSD-3 is not BSD-2, nor the other way round."""
    texts = {name: t for name, t in license_scan.TEMPLATES if len(t) > 600}
    code = "\n".join(f"int f{i}(int x) {{ return x * {i} + g(x, {i % 7}); }}" for i in range(400))
    edited = " ".join(w for i, w in enumerate(texts["BSD-3-Clause"].split()) if i % 23)
    rows = [
        (1, f"{texts['BSD-3-Clause']}\n{code}", {"BSD-3-Clause"}), (2, f"{code}\n{texts['BSD-2-Clause']}\n{code}", {"BSD-2-Clause"}), (3, f"/* {edited} */ {code}", {"BSD-3-Clause"}),
        (4, re.sub(r"\s+", " ", f"{code} {texts['ISC']} {code}"), {"ISC"}), (5, f"{texts['MIT']}\n{code}\n{texts['Apache-2.0']}\n{code}", {"MIT", "Apache-2.0"}), (6, texts["BSD-3-Clause"], {"BSD-3-Clause"}),
        (7, code, set()), (8, f"{texts['MIT']}\n{code}\n{texts['MIT']}", {"MIT"}), (9, f"{texts['BSD-3-Clause']}\n{code}\nReleased under the MIT License.\n", {"BSD-3-Clause", "MIT"}),
    ]
    got = {r.doc_id: r.matches for r in license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, text, want in rows:
        assert {m.license for m in got[i]} == want, (i, [(m.license, m.dice, m.segment[:60]) for m in got[i]])
        assert {(m.license, round(m.dice, 9), m.segment) for m in got[i]} == brute_matches(text), i


def test_license_scan_finds_whole_texts_and_wrapped_notices(spark):
    whole = {n: t for n, t in license_scan.TEMPLATES if len(t) > 600 and n not in ("MIT", "ISC", "Apache-2.0")}
    header = "Some prose goes before it, on a line\nof its own. Licensed under the Apache\nLicense, Version 2.0. And more prose follows\nto the end of the paragraph, which is long enough."
    rows = [(i, f"Notes.\n\n{t}") for i, t in enumerate(whole.values())] + [(100, header)]
    got = {r.doc_id: {m.license for m in r.matches} for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(n in got[i] for i, n in enumerate(whole)) and got[100] == {"Apache-2.0"}


def test_license_scan_equals_brute_force(spark, plain):
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 900)
    rows = [*plain.items(), (10**6, mit.replace("Software", "Program", 2)), (10**6 + 1, "x\n\nReleased under the MIT license!\ny"), (10**6 + 2, "Text. Licensed under CC BY-NC 4.0. More text"), (10**6 + 3, None), (10**6 + 4, "licensed")]
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert {(m.license, round(m.dice, 9), m.segment) for m in r.matches} == brute_matches(dict(rows)[r.doc_id])


def test_license_cues_lose_nothing(odd, empty):
    cues = set(license_scan.cue_words(license_scan.TEMPLATES, license_scan.THRESHOLD))
    for _, text in license_scan.TEMPLATES:
        grams = license_scan.word_bigrams(text)
        assert sum(not cues & set(g.split()) for g in grams) < license_scan.least_shared(len(grams), license_scan.THRESHOLD)
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(empty).count() == 0


# ---- 10


def test_packing_ids_and_layout(spark, plain):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [*plain.items(), (10**6, None), (10**6 + 1, "a <|endoftext|> b  \n\n c\td"), (10**6 + 2, "")]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).withColumn("crc", F.crc32("ids")).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        own = sorted(by_doc[i], key=lambda p: p.piece)
        assert [p.start for p in own] == list(np.cumsum([0, *[p.length for p in own]])[:-1]) and sum(p.length for p in own) == len(ids)
        assert all(p.crc == zlib.crc32(ids[p.start : p.start + p.length].astype("<u4").tobytes()) for p in own)
        assert len(own) == 1 or all(p.length == 2048 for p in own[1:])
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0, *[p.length for p in own]])[:-1]) and sum(p.length for p in own) <= 2048
    least = -(-sum(p.length for p in pieces) // 2048)
    assert len(by_seq) <= 1.05 * least + 4  # four partitions


def test_bounded_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(8) == (2, 0)  # opens a third: bin 1, the fullest of the open, closes
    assert bins.place(3) == (0, 6) and bins.open == 2


def test_packing_odd_rows(odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(odd, path).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None} and next(r.n for r in got if r.doc_id == 2) == 1
    assert packing.pack(empty, path).count() == 0


# ---- queries and pipeline


def test_pipeline_stages_chain(spark, sf, docs, plain):
    import corpus_pipeline as cp

    columns, d = docs.columns, docs
    for name, stage in cp.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == columns, name
        d = spark.createDataFrame(d.collect(), docs.schema)
        assert d.count() > 0
    assert cp.STAGES[-1][1](spark, d, sf).count() >= d.count()


def test_near_duplicate_stage_keeps_one_of_each_class(docs, plain):
    kept = {r.doc_id for r in parity_join.one_of_each(docs).select("doc_id").collect()}
    assert kept == {i for i, (n, c) in brute_classes(list(plain.items()), 5, 8, 10).items() if c == i}


def test_op5_digest(spark, sf, plain):
    from pairloom.llm.queries import op5_pii

    for r in op5_pii(spark, sf).collect():
        s = brute_spans(plain[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in s) for x in ("email", "ip", "card", "phone"))
