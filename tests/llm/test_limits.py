"""What must not be capped, cut or quadratic; naive models of what the operators compute; the pipeline against plain code."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import crf_lang, mixing, packing, pii, toxicity
from pairloom.llm.common import read
from tests.llm.test_operators import brute_classes, brute_spans, level_fill


def test_long_words_keep_their_ends():
    a, b = "a" * 60 + "xyz" + "q" * 37, "a" * 60 + "xyw" + "z" * 37
    assert crf_lang.words_of(a) == [a[i : i + crf_lang.UNIT] for i in range(0, 100, crf_lang.UNIT)]
    assert [crf_lang.features(w, frozenset()) for w in crf_lang.words_of(a)] != [crf_lang.features(w, frozenset()) for w in crf_lang.words_of(b)]
    assert crf_lang.features(a, frozenset()) != crf_lang.features(a[:-1] + "r", frozenset())
    text = "日本語" * 100
    assert "".join(crf_lang.words_of(text)) == text


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(crf_lang, "STEPS", 12)
    monkeypatch.setattr(crf_lang, "BATCH", 24)
    rng, rows = random.Random(2), []
    for k in range(300):
        words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" + "".join(rng.choice("aeiou") for _ in range(3)) for _ in range(8)]
        rows += [(len(rows), " ".join(rng.choice(words) for _ in range(12)), f"l{k:03d}") for _ in range(2)]
    model = crf_lang.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300 and model.weights.shape[1] == 300 and (np.abs(model.weights).sum(axis=0) > 0).all()


def test_gradient_over_blocks_of_labels(monkeypatch):
    rows = [("ich und du und wir", "de"), ("you and me and them", "en"), ("toi et moi et nous", "fr")] * 3
    monkeypatch.setattr(crf_lang, "STEPS", 5)
    whole = crf_lang.fit(rows)
    monkeypatch.setattr(crf_lang, "_LABELS", 2)
    assert np.allclose(crf_lang.fit(rows).weights, whole.weights)


def naive_weight(lexicon, text):
    """Every term at every place, then the exceptions, with nothing but string comparison."""
    folded = toxicity.fold(text)
    best, spared = {}, set()
    for e in lexicon.exceptions:
        for i in range(len(folded)):
            if folded.startswith(f" {e} ", i):
                spared |= set(range(i, i + len(e) + 2 - 1))
    for t, w in lexicon.terms.items():
        for i in range(len(folded)):
            if folded.startswith(t, i):
                best[i] = max(best.get(i, 0.0), w)
    hits = {i: w for i, w in best.items() if i not in spared}
    words = folded.count(" ") - 1
    return np.log1p(sum(hits.values()) / (1 + np.log1p(words) / 8)) if hits else 0.0, len(hits)


def test_lexicon_equals_a_naive_matcher():
    rng = random.Random(3)
    parts = ["trash", "can", "idiot", "1diot", "ab", "abc", "abcd", "clown", "fish", "circus", "scum", "pond", "сlown", "x", "!", "\n"]
    lexicon = toxicity.Lexicon({" idiot ": 4.0, " ab": 1.0, " abc": 2.0, " abc ": 1.5, " clown ": 3.0, " trash ": 2.5, " scum ": 1.0, " can": 0.5})
    for _ in range(300):
        t = " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        got = lexicon.weight(t)
        assert (got[0], got[1]) == pytest.approx(naive_weight(lexicon, t)), t
    long = "pond scum scum " * 100_000
    began = time.time()
    assert lexicon.weight(long)[1] == 100_000 and time.time() - began < 30


def test_every_term_enters_the_lexicon(spark):
    word = lambda i: "q" + "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(i, " ".join(word(j) for j in range(25_000)), 1) for i in range(3)] + [(10 + i, "harmless words here", 0) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert all(f" {word(j)} " in lexicon.terms for j in range(0, 25_000, 500)) and len(lexicon.terms) > 25_000


def test_many_sources_are_mixed(spark):
    rows = [(i, f"s{i % 3000:04d}", " ".join(["w"] * (1 + i * 7 % 200))) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_words=4).taken().collect()
    sizes, took = Counter(), Counter()
    for i, s, t in rows:
        sizes[s] += len(t.split())
    want = level_fill(dict(sizes))
    for r in got:
        s = rows[r.doc_id][1]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        took[s] += r.taken
    assert len(got) == 6000 and all(abs(took[s] - t) <= 12 for s, t in want.items())
    assert sum(took.values()) == pytest.approx(sum(sizes.values()), rel=0.02)


def test_mixing_keeps_columns_that_clash(spark):
    d = spark.createDataFrame([(i if i % 3 else None, f"s{i % 2}", "w " * (i + 1)) for i in range(30)], "doc_id long, source string, text string")
    d = d.withColumns({c: F.lit(c) for c in ("copies", "__copy", "__copies", "row", "id", "text_id", "its_id", "its_text", "size")})
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns and {r.copies for r in out.collect()} == {"copies"}


def test_many_spans_in_one_text(spark):
    n = 50_000
    text = " ".join(f"say{i % 7} a{i}@b.example" for i in range(n))
    began = time.time()
    masked = pii.mask(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert masked == " ".join(f"say{i % 7} <email>" for i in range(n)) and time.time() - began < 90


def test_contexts_find_what_the_base_patterns_cannot(spark):
    """Half of the planted identifiers are digests, which are seeds; the others have a form of their own and stand in the same contexts."""
    rng = random.Random(5)
    filler = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    rows, planted, odd = [], set(), 0
    for i in range(300):
        words = [rng.choice(filler) for _ in range(30)]
        at = rng.randrange(5, 25)
        lead = rng.choice([["api", "key", "is"], ["session", "token", "="]])
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40)) if i % 2 else f"K{rng.randrange(10**6):06d}-{rng.choice('XYZ')}{rng.randrange(100):02d}"
        words[at:at] = [*lead, value]
        text = " ".join(words) + f" order{rng.randrange(10**6)} closes it"
        rows.append((i, text))
        if i % 2 == 0:
            planted.add((i, text.index(value), text.index(value) + len(value)))
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.start", "s.end").collect()
    found = {(r.doc_id, r.start, r.end) for r in got}
    tokens = {(i, t.index("order"), t.index(" closes")) for i, t in rows}
    odd = len(found & tokens)
    assert len(found & planted) >= 0.95 * len(planted) and odd == 0, (len(found & planted), len(planted), odd)


def test_pipeline_equals_plain_code(spark, sf, tmp_path):
    """run() over a folder with planted cases: clean texts stay, one of each class does, spans are masked, ids survive the packing."""
    import corpus_pipeline as cp

    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnrst"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []
    for i in range(60):
        w = words(40 + i)
        if i % 10 == 3:
            w[5:5] = ["you", "idiot", "moron", "scum", "idiot"]
        if i % 10 == 4:
            w[7] = f"mail{i}@x{i}.example.com"
        rows.append((i, " ".join(w), "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 10 == 3)))
    for i in range(60, 75):  # near copies of the first ones, a word changed
        w = rows[(i - 60) * 2][1].split()
        w[-1] = f"end{i}"
        rows.append((i, " ".join(w), "en", "s1"))
    d = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = read(spark, str(tmp_path), "documents")
    lexicon = toxicity.learn(docs, read(spark, str(tmp_path), "labels"), F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    clean = {i: t for i, t, *_ in rows if lexicon.probability(naive_weight(lexicon, t)[0]) < toxicity.THRESHOLD}
    assert {i for i, t, *_ in rows} - set(clean) == {i for i, t, *_ in rows if " idiot " in t}
    kept = {i: clean[i] for i, (_, root) in brute_classes(list(clean.items()), 5, 8, 10).items() if root == i}
    masked = {}
    for i, t in kept.items():
        for kind, a, z in reversed(brute_spans(t)):
            t = f"{t[:a]}<{kind}>{t[z:]}"
        masked[i] = t
    stage = docs
    for name, f in cp.STAGES[:3]:
        out = f"{tmp_path}/{name}"
        f(spark, stage, str(tmp_path)).write.parquet(out)
        stage = spark.read.parquet(out)
    assert {r.doc_id: r.text for r in stage.collect()} == masked
    assert all(r.n_chars == len(r.text) for r in stage.collect())

    sizes = {i: len(t.split()) for i, t in masked.items()}
    source = {i: s for i, _, _, s in rows}
    sums = Counter()
    for i, n in sizes.items():
        sums[source[i]] += n
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(stage).collect())
    want = level_fill(dict(sums))
    assert max(mixed.values()) <= 3 and set(mixed) <= set(masked)
    for s, t in want.items():
        assert abs(sum(sizes[i] * k for i, k in mixed.items() if source[i] == s) - t) <= 0.35 * t + 200

    lib, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), cp.run(spark, str(tmp_path)).collect()
    tokens, places = Counter(), defaultdict(list)
    for p in pieces:
        tokens[p.doc_id] += p.length
        places[p.sequence_id].append((p.offset, p.length))
    assert tokens == {i: k * (len(lib.encode(masked[i], add_special_tokens=False).ids) + 1) for i, k in mixed.items()}
    for x in places.values():
        ends = np.cumsum([0, *[n for _, n in sorted(x)]])
        assert [o for o, _ in sorted(x)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_packing_refuses_other_tokenizers(tmp_path):
    import json

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    for change in (lambda s: s["pre_tokenizer"].update(add_prefix_space=True), lambda s: s["model"].update(ignore_merges=True), lambda s: s["model"]["merges"].reverse()):
        other = json.loads(json.dumps(spec))
        change(other)
        path = tmp_path / "t.json"
        path.write_text(json.dumps(other), encoding="utf-8")
        packing.encoder.cache_clear()
        with pytest.raises(ValueError):
            packing.encoder(str(path))
    packing.encoder.cache_clear()


def test_token_counts_refuse_other_tokenizers():
    import json

    from pairloom.llm.bpe_count import MergeCounter

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    changes = [lambda s: s["model"].update(ignore_merges=True), lambda s: s["added_tokens"][0].update(lstrip=True), lambda s: s["added_tokens"][0].update(single_word=True),
               lambda s: s["normalizer"]["normalizers"].append({"type": "StripAccents"}), lambda s: s.update(normalizer={"type": "Lowercase"}),
               lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(invert=False), lambda s: s.update(pre_tokenizer=None)]
    for change in changes:
        other = json.loads(json.dumps(spec))
        change(other)
        with pytest.raises(ValueError, match="token counts need"):
            MergeCounter(other)


def test_labels_of_absent_documents_teach_nothing(spark):
    from pairloom.llm import toxicity

    texts = [(i, f"some zzgrim zzfoul words {i}" if i % 2 else f"some calm words {i}") for i in range(40)] + [(90, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    own = [(i, i % 2) for i in range(40)]
    absent = [(i, i % 3 % 2) for i in range(1000, 1400)] + [(90, 0)]
    plain = toxicity.learn(docs, spark.createDataFrame(own, "doc_id long, toxic int"), max_labelled=40)
    mixed = toxicity.learn(docs, spark.createDataFrame(own + absent, "doc_id long, toxic int"), max_labelled=40)
    assert (plain.terms, plain.slope, plain.shift) == (mixed.terms, mixed.slope, mixed.shift)
    assert len(plain.terms) > len(toxicity.BASE_TERMS)
