"""The ledger: layers, cuts, snapshots, compaction, conflicts; the log applied in any batches; workers that share a job table."""

from __future__ import annotations

import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairloom.operators import ledger, store
from pairloom.schemas import EVENT, VECTOR
from pairloom.streaming import outbox, worker

ROOT = str(Path(__file__).resolve().parents[1])


def vectors(spark, keys):
    """Rows of (doc_type, doc_id, version, section)."""
    rows = [(f"{t}:{d}:v{v}:{s}", t, d, v, s, [1.0], "t", "READY", "public", "", "en", "hash", "h") for t, d, v, s in keys]
    return spark.createDataFrame(rows, VECTOR)


def held(df):
    return sorted((r.doc_type, r.doc_id, r.version, r.section) for r in df.collect())


def gone(spark, rows):
    return spark.createDataFrame(rows, "doc_type string, doc_id string, version int")


def test_layers_merge_like_plain_tables(spark, tmp_path):
    """Random upserts and deletes, with compaction between, against the plan that rewrites the table."""
    r = random.Random(3)
    s, plain, snapshots = store.SnapshotStore(spark, str(tmp_path / "s")), vectors(spark, []), {}
    for step in range(10):
        if r.random() < 0.6:
            new = vectors(spark, {(t, f"d{r.randint(0, 6)}", r.randint(1, 4), x) for t in ("cv", "jd") for x in "ab" for _ in range(3)})
            n, plain = s.upsert(new), store.upsert(plain, new)
        else:
            g = gone(spark, [("cv", f"d{r.randint(0, 6)}", r.choice([None, 2])), ("jd", f"d{r.randint(0, 6)}", None)])
            n, plain = s.delete(g), store.delete(plain, g)
        plain = spark.createDataFrame(plain.select(*s._names()).collect(), VECTOR)
        assert held(s.current()) == held(plain)
        snapshots[n] = held(plain)
        s.compact(most=3)
        assert len(s.snapshot().layers) <= 4
    assert held(s.current()) == held(plain)
    assert held(s.point_read("cv", "d1")) == [k for k in held(plain) if k[:2] == ("cv", "d1")]
    assert all(held(s.read(s.snapshot(n))) == want for n, want in snapshots.items())  # readers keep their snapshots
    s.prune(1)
    assert held(s.current()) == held(plain) and len(s.versions()) == 1


def test_a_small_batch_writes_little(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    s.write(vectors(spark, [("cv", f"d{i}", 1, "a") for i in range(1000)]))
    base = s.snapshot().layers[0]
    for i in range(12):
        s.upsert(vectors(spark, [("cv", f"d{j}", 2, "a") for j in range(i * 10, i * 10 + 10)]))
        s.compact()
    layers = s.snapshot().layers
    assert layers[0] == base and len(layers) <= ledger.MOST and s.count("cv") == 1000
    assert sum(x.rows for x in layers[1:]) <= 130


def test_conflicts_are_by_bucket_and_blind_writes_are_renumbered(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    s.write(vectors(spark, [("cv", "a", 1, "x"), ("cv", "b", 1, "x")]))
    base = s.snapshot()
    assert s.upsert(vectors(spark, [("cv", "a", 2, "x")])) == 2
    with pytest.raises(ledger.Conflict, match="same buckets"):
        s.commit(vectors(spark, [("cv", "a", 3, "x")]), store.upsert_cuts, base=base)
    seq = s.commit(vectors(spark, [("cv", "b", 2, "x")]), store.upsert_cuts, base=base)  # another bucket
    assert seq == 3 and held(s.current()) == [("cv", "a", 2, "x"), ("cv", "b", 2, "x")]
    entry = s.snapshot()
    assert not s._put(entry)  # its number is taken
    tries = []

    def change(have):
        tries.append(1)
        if len(tries) == 1:
            s.upsert(vectors(spark, [("cv", "a", 5, "x")]))  # somebody is faster
        return have.filter("doc_id = 'a'").withColumn("version", F.col("version") + 1), store.upsert_cuts

    s.transact(change)
    assert len(tries) == 2 and held(s.point_read("cv", "a")) == [("cv", "a", 6, "x")]
    assert s.upsert(vectors(spark, [("cv", "z", 1, "x")]), once=("w", 7)) == 6 and s.upsert(vectors(spark, [("cv", "z", 2, "x")]), once=("w", 7)) == 6


def plain_log(events):
    have = {}
    for e in events:
        mine = have.setdefault((e["doc_type"], e["doc_id"]), set())
        if e["action"] == "delete":
            mine.clear()
        elif e["doc_id"] != "unknown":
            mine -= {v for v in mine if v < e["version"]}
            mine.add(e["version"])
    return sorted((t, d, v) for (t, d), vs in have.items() for v in vs)


@pytest.mark.parametrize("seed", [1, 2])
def test_the_log_gives_one_state_however_it_is_cut(spark, tmp_path, seed):
    r = random.Random(seed)
    events = [
        {"event_id": f"e{i}", "doc_type": r.choice(["cv", "jd"]), "doc_id": r.choice(["a", "b", "c", "unknown"]), "action": "delete" if r.random() < 0.2 else "upsert", "version": r.randint(1, 6), "created_at": 0.0, "line_no": i + 1}
        for i in range(60)
    ]
    want = plain_log(events)

    def resolve(upserts):
        cols = {"vector_id": F.concat_ws(":", "doc_type", "doc_id", "version"), "section": F.lit("x"), "embedding": F.array(F.lit(1.0)), "text": F.lit("t"), "embedding_model": F.lit("m"), "content_hash": F.lit("h")}
        return upserts.filter("doc_id <> 'unknown'").withColumns(cols)

    for cuts in ([], sorted(r.sample(range(1, 60), 2)), sorted(r.sample(range(1, 60), 5))):
        where = tmp_path / f"c{len(cuts)}"
        (where / "log").mkdir(parents=True)
        for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60], strict=True)):
            f = where / "log" / f"{n}.json"
            f.write_text("\n".join(map(json.dumps, r.sample(events[a:b], b - a))))
            import os

            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
        s = store.SnapshotStore(spark, str(where / "store"))
        outbox.apply_log(outbox.read_log(spark, str(where / "log"), 1), s, resolve, str(where / "check"), str(where / "bad")).awaitTermination()
        assert [(t, d, v) for t, d, v, _ in held(s.current())] == want, cuts
    assert spark.read.schema(EVENT).json(str(tmp_path / "c0" / "log")).count() == 60


CLAIMER = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from pairloom.streaming.worker import JobTable
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
jobs, out = JobTable(spark, sys.argv[2]), []
while seq := jobs.claim(10.0, 4):
    out += [r.id for r in jobs.added(seq).collect()]
print("CLAIMED", *out)
"""


def test_two_processes_share_a_job_table(spark, tmp_path):
    """Every job is claimed, and none twice."""
    jobs = worker.JobTable(spark, str(tmp_path / "j"))
    jobs.request(spark.createDataFrame([("cv", f"d{i}", 1) for i in range(24)], "document_type string, document_id string, version int"), 1.0)
    runs = [subprocess.Popen([sys.executable, "-c", CLAIMER, ROOT, str(tmp_path / "j")], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) for _ in range(2)]
    try:
        said = [p.communicate(timeout=240)[0] for p in runs]
    finally:
        for p in runs:
            p.kill()
    mine = [line.split()[1:] for text in said for line in text.splitlines() if line.startswith("CLAIMED")]
    assert len(mine) == 2 and sorted(sum(mine, [])) == sorted(f"cv:d{i}:1" for i in range(24))
    j = jobs.current()
    assert j.count() == 24 and j.filter("status = 'PROCESSING' and attempt_count = 1").count() == 24
    jobs.requeue(1000.0)
    assert jobs.current().filter("status = 'PENDING'").count() == 24 and jobs.requeue(1000.0) == 0


@pytest.mark.parametrize("name", ["catalogue", "registry", "logs", "vectors", "lexical", "hybrids", "evaluations", "pieces", "services", "texts"])
def test_each_module_of_plans_is_imported_alone(name):
    subprocess.run([sys.executable, "-c", f"import pairloom.plans.{name}"], cwd=ROOT, check=True, timeout=60)
