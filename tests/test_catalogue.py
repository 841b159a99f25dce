"""Every query of the catalogue against its SQL twin on the smallest tables."""

from __future__ import annotations

import math
import re
import unicodedata

import duckdb
import numpy as np
import pytest

from pairloom.operators import chunking
from pairloom.plans import catalogue, evaluations, logs
from pairloom.streaming.jobs import step

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def table(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = duck.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert table(got) == table(want)
    else:
        assert PLAIN[name](spark, sf, got)


def rows_of(sf, name, *columns):
    return duckdb.sql(f"select {', '.join(columns)} from '{sf}/{name}.parquet'").fetchall()


def plain_chunk_max_sim(spark, sf, got):
    """The same ranking, window by window and pair by pair."""

    def windows(t):
        w = (t or "").split()
        n = 0 if not w else 1 if len(w) <= 64 else math.ceil((len(w) - 64) / 48) + 1
        return np.array([chunking.hash_vector(" ".join(w[48 * i : 48 * i + 64])) for i in range(n)], np.float64)

    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    docs = {i: unit(v) for i, t in rows_of(sf, "documents", "doc_id", "text") if len(v := windows(t))}
    for i, t in rows_of(sf, "benchmark", "item_id", "text"):
        asked = unit(windows(t))
        want = sorted(((-round(float((asked @ v.T).max()), 5), d) for d, v in docs.items()))[:5]
        mine = sorted((r.rank, r.doc_id, r.score) for r in got[got.query_id == i].itertuples())
        assert [(-s, d) for _, d, s in mine] == [(pytest.approx(s, abs=2e-5), d) for s, d in want]
    return True


def plain_hash_embed_stats(spark, sf, got):
    found = {r.doc_id: (r.buckets, r.largest) for r in got.itertuples()}
    for i, t in rows_of(sf, "documents", "doc_id", "text"):
        v = [x for x in chunking.hash_vector(t) if x]
        assert found.get(i, (0, 0)) == (len(v), pytest.approx(max(v, default=0), abs=1e-5))
    return True


def plain_clean_text_nfkc(spark, sf, got):
    found = {r.page_id: r.chars for r in got.itertuples()}
    for i, h in rows_of(sf, "pages", "page_id", "html"):
        t = unicodedata.normalize("NFKC", re.sub("<[^>]*>", "\n", h)).replace("\f", "\n")
        t = "".join(c for c in t if c not in "\u00ad\u200b\u200c\u200d" and (ord(c) >= 32 or c in "\n\t"))
        lines = [re.sub("[ \t]+", " ", x).strip() for x in t.split("\n")]
        lines = [re.sub(r"^[•●▪‣☑✓]\s*", "- ", x) for x in lines]
        lines = [x.strip() for x in lines if not re.fullmatch(r"(?i)(page|trang|p\.?)\s*[0-9]+\s*,?", x)]
        assert found[i] == len(re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip())
    return True


def plain_bootstrap_ci(spark, sf, got):
    v = np.sort([r.ndcg for r in evaluations.metrics(spark, sf).collect()])
    rng = np.random.RandomState(42)
    means = [rng.choice(v, len(v), replace=True).mean() for _ in range(1000)]
    r = got.iloc[0]
    assert (r["mean"], r.low, r.high) == pytest.approx((v.mean(), np.percentile(means, 2.5), np.percentile(means, 97.5)))
    return r.low <= r["mean"] <= r.high


def plain_paired_p_values(spark, sf, got):
    d = np.array([round(r.ndcg, 6) - round(r.ap, 6) for r in evaluations.metrics(spark, sf).collect()])
    n, t = len(d), d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))
    x = np.linspace(0, math.pi / 2, 400_001)[:-1]  # the density of t over the angle, by the midpoint rule
    inside = np.cos(x) ** (n - 2)
    share = inside[x <= math.atan(abs(t) / math.sqrt(n - 1))].sum() / inside.sum()
    p = {r.test: r.p for r in got.itertuples()}
    assert p["t"] == pytest.approx(1 - share, abs=1e-4)
    return 0 <= p["wilcoxon"] <= 1


def plain_stream_job_state(spark, sf, got):
    states = {}
    for key, kind, at in duckdb.sql(f"select user_id, event_type, epoch_us(ts) / 1000000.0 from '{sf}/events.parquet' order by event_id").fetchall():
        command = {"kind": logs.COMMANDS.get(kind), "at": float(at), "error": None, "step": "PARSING", "hash": None}
        states[str(key)] = step(states.get(str(key)), command)
    want = {k: (s[0], s[2]) for k, s in states.items() if s is not None}
    assert {r.key: (r.status, r.attempts) for r in got.itertuples()} == want
    return True


PLAIN = {
    "chunk_max_sim": plain_chunk_max_sim, "hash_embed_stats": plain_hash_embed_stats, "clean_text_nfkc": plain_clean_text_nfkc, "bootstrap_ci": plain_bootstrap_ci,
    "paired_p_values": plain_paired_p_values, "stream_job_state": plain_stream_job_state,
}


def test_engine_stands_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['pairloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1]))
