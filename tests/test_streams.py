"""The line log as a source, and jobs that come back by timers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pairloom.streaming import linelog, timers


def drained(spark, path, out, check, **options):
    q = linelog.read_lines(spark, path, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.line_no, r.value) for r in spark.read.schema(linelog.SCHEMA).parquet(out).collect())


def test_a_growing_log_is_read_once(spark, tmp_path):
    """Lines that come between runs, a line that is half written, a new segment, a restart from the checkpoint."""
    log, out, check = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "check")
    log.mkdir()
    r, lines = random.Random(1), []

    def more(name, n, end="\n"):
        new = ["é" * r.randint(0, 40) + str(r.random()) for _ in range(n)]
        with open(log / name, "a") as f:
            f.write("\n".join(new) + end)
        lines.extend(new)

    more("0001", 200)
    assert drained(spark, str(log), out, check, piece_bytes=500) == list(enumerate(lines, 1))
    more("0001", 50, "\nhalf a li")
    assert drained(spark, str(log), out, check, piece_bytes=500) == list(enumerate(lines, 1))
    with open(log / "0001", "a") as f:
        f.write("ne")
    lines.append("half a line")  # complete, for the next segment has begun
    more("0002", 30)
    (log / "_SUCCESS").write_text("x")
    assert drained(spark, str(log), out, check, piece_bytes=50) == list(enumerate(lines, 1))
    assert drained(spark, str(log), out, check) == list(enumerate(lines, 1))


def test_pieces_cover_every_line(tmp_path):
    f = tmp_path / "one"
    f.write_text("a\r\n\nlong " + "x" * 100 + "\nlast\nopen")
    for size in (1, 3, 7, 1000):
        reader = linelog.LineReader(str(f), size, None)
        end = reader.latestOffset()
        assert end["line"] == 5
        found = [x for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p) for x in zip(*map(list, b.to_pydict().values()), strict=True)]
        assert found == [(1, "a"), (2, ""), (3, "long " + "x" * 100), (4, "last")]
    slow = linelog.LineReader(str(f), 3, 1)
    assert [slow.latestOffset()["line"] for _ in range(5)] == [2, 3, 4, 5, 5]
    assert linelog.LineReader(str(tmp_path / "none"), 3, None).latestOffset()["line"] == 1


def test_jobs_come_back_by_timers_alone(spark, tmp_path):
    """Signs in several batches; the last silence of every job is ended by nothing but the watermark."""
    r = random.Random(2)
    signs = sorted((r.randint(0, 5000), f"j{r.randint(0, 5)}") for _ in range(120)) + [(6000, "clock")]
    for k, (a, b) in enumerate([(0, 40), (40, 90), (90, 121)]):
        part = spark.createDataFrame(signs[a:b], "s long, key string").select("key", F.timestamp_seconds("s").alias("at"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert k < 3
    stream = spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with timers.timed_state(spark):
        q = timers.returning(stream, 100, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = set()
    for key in {k for _, k in signs}:
        mine, n = [s for s, k in signs if k == key], 0
        for s, following in zip(mine, [*mine[1:], 10**9], strict=True):
            if following - s > 100 and s + 100 < 6000 and n < 3:
                n += 1
                want.add((key, (s + 100) * 1000, n, "FAILED" if n == 3 else "PENDING"))
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
