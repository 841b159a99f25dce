"""The outbox, the snapshot store, access control and the job table over events; errors stand for deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import acl, jobs, store
from pairloom.operators.staging import remove_at_exit, shared_folder
from pairloom.plans.registry import query, table
from pairloom.schemas import EVENT
from pairloom.streaming import jobs as machine
from pairloom.streaming import linelog, outbox, timers
from pairloom.streaming.worker import UNIQUE, JobTable

EPOCH = "(epoch_us(ts) / 1000000.0::double)"
LOG_SQL = f"log as (select event_id + 1 as line_no, event_id, case when user_id % 2 = 0 then 'cv' else 'jd' end as doc_type, user_id as doc_id, case when event_type = 'error' then 'delete' else 'upsert' end as action, (event_id % 1000 + 1)::int as version, {EPOCH} as created_at from events)"


def seconds(c: str = "ts"):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 1).alias("line_no"), "event_id", F.when(F.col("user_id") % 2 == 0, "cv").otherwise("jd").alias("doc_type"), F.col("user_id").alias("doc_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("action"), (F.col("event_id") % 1000 + 1).cast("int").alias("version"), seconds().alias("created_at"),
    )


@query(f"with {LOG_SQL} select doc_type, doc_id, arg_max(action, line_no) as action, arg_max(version, line_no) as version, max(line_no) as line_no from log group by all")
def outbox_compaction(spark, sf_dir):
    """The last event of each document."""
    return outbox.compacted(log(spark, sf_dir)).select("doc_type", "doc_id", "action", "version", "line_no")


@query(f"with {LOG_SQL} select line_no, doc_type, doc_id, action, version from log where line_no > 9000 order by line_no limit 100")
def outbox_cursor(spark, sf_dir):
    """The hundred events behind a cursor."""
    return outbox.since(log(spark, sf_dir), 9000, 100).select("line_no", "doc_type", "doc_id", "action", "version")


@query(f"with {LOG_SQL} select count(*) as events, sum((doc_type in ('cv', 'jd') and version between 1 and 1000)::int)::bigint as valid from log")
def event_validation(spark, sf_dir):
    """How many events are well-formed."""
    e = log(spark, sf_dir).withColumns({"event_id": F.col("event_id").cast("string"), "doc_id": F.col("doc_id").cast("string")})
    return e.agg(F.count("*").alias("events"), F.sum(outbox.valid().cast("long")).alias("valid"))


STORE_SQL = f"""{LOG_SQL}, st as (select doc_type, doc_id, version, (['skills', 'experience', 'summary'])[event_id % 3 + 1] as section from log where event_id % 7 < 3 and action = 'upsert'),
stored as (select distinct doc_type, doc_id, version % 5 + 1 as version, section from st), nw as (select distinct doc_type, doc_id, 4 as version, (['skills', 'education'])[event_id % 2 + 1] as section from log where event_id % 11 = 0 and doc_id % 3 = 0)"""


def stored_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = log(spark, sf_dir)
    name = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % k + 1).cast("int"))
    old = e.filter("event_id % 7 < 3 and action = 'upsert'").select("doc_type", "doc_id", (F.col("version") % 5 + 1).alias("version"), name(("skills", "experience", "summary"), 3).alias("section")).distinct()
    new = e.filter("event_id % 11 = 0 and doc_id % 3 = 0").select("doc_type", "doc_id", F.lit(4).alias("version"), name(("skills", "education"), 2).alias("section")).distinct()
    return old, new


@query(f"with {STORE_SQL} select * from stored s where not exists (select 1 from nw where nw.doc_type = s.doc_type and nw.doc_id = s.doc_id and s.version <= 4) union all select * from nw")
def upsert_snapshot(spark, sf_dir):
    """The store after new versions came in: lower versions and leftovers of the same version are gone, higher ones stay."""
    return store.upsert(*stored_and_new(spark, sf_dir))


@query(f"""with {STORE_SQL}, t as (select doc_type, doc_id, count(*) as upserted from nw group by all), a as (select doc_type, doc_id, sum((version < 4)::int)::bigint as stale from stored semi join nw using (doc_type, doc_id) group by all),
b as (select doc_type, doc_id, count(*) as leftover from stored s semi join nw using (doc_type, doc_id) where version = 4 and not exists (select 1 from nw where nw.doc_type = s.doc_type and nw.doc_id = s.doc_id and nw.section = s.section) group by all)
select doc_type, doc_id, upserted, coalesce(stale, 0) as stale, coalesce(leftover, 0) as leftover from t left join a using (doc_type, doc_id) left join b using (doc_type, doc_id)""")
def upsert_stats(spark, sf_dir):
    """What an upsert adds and removes, by document."""
    return store.upsert_stats(*stored_and_new(spark, sf_dir))


@query(f"with {STORE_SQL} select * from stored where not (doc_id % 4 = 0) and not (doc_id % 4 = 1 and version = 2)")
def delete_snapshot(spark, sf_dir):
    """The store without some documents, and without one version of others."""
    old, _ = stored_and_new(spark, sf_dir)
    d = old.select("doc_type", "doc_id").distinct().filter("doc_id % 4 < 2")
    gone = d.withColumn("version", F.when(F.col("doc_id") % 4 == 1, 2))
    return store.delete(old, gone)


@query(f"""with {STORE_SQL}, src as (select distinct doc_type, doc_id from log where doc_id % 5 <> 0 union select 'cv', 1000000), have as (select doc_type, doc_id, max(version) as version from stored where doc_id % 6 <> 1 group by all)
select coalesce(s.doc_type, h.doc_type) as doc_type, coalesce(s.doc_id, h.doc_id) as doc_id, case when s.doc_id is null then 'orphan' when h.version is null then 'missing' else 'refreshed' end as action,
(case when s.doc_id is null then h.version else coalesce(h.version, 0) + 1 end)::int as version from src s full outer join have h on s.doc_type = h.doc_type and s.doc_id = h.doc_id""")
def reconcile_diff(spark, sf_dir):
    """What sets the store right against its source."""
    src = log(spark, sf_dir).filter("doc_id % 5 <> 0").select("doc_type", "doc_id").unionByName(spark.createDataFrame([("cv", 1000000)], "doc_type string, doc_id long"))
    return store.reconcile(src, stored_and_new(spark, sf_dir)[0].filter("doc_id % 6 <> 1"))


@query(f"""with {STORE_SQL}, m as (select doc_type, doc_id, case when version = 3 then 'old' else 'hash' end as embedding_model from stored) select distinct doc_type, doc_id from log l
where not exists (select 1 from m where m.doc_type = l.doc_type and m.doc_id = l.doc_id) or exists (select 1 from m where m.doc_type = l.doc_type and m.doc_id = l.doc_id and embedding_model <> 'hash')""")
def needs_index(spark, sf_dir):
    """Documents without vectors, or with some of another model."""
    old, _ = stored_and_new(spark, sf_dir)
    old = old.withColumn("embedding_model", F.when(F.col("version") == 3, "old").otherwise("hash"))
    return store.needs_index(log(spark, sf_dir).select("doc_type", "doc_id").distinct(), old, "hash")


@query(f"with {STORE_SQL} select distinct doc_type, doc_id from log l where not exists (select 1 from nw where nw.doc_type = l.doc_type and nw.doc_id = l.doc_id)")
def resume_anti(spark, sf_dir):
    """Queries that are not yet in the output."""
    return store.remaining(log(spark, sf_dir).select("doc_type", "doc_id").distinct(), stored_and_new(spark, sf_dir)[1], ["doc_type", "doc_id"])


@query(f"with {STORE_SQL}, x as (select *, max(version) over (partition by doc_type, doc_id) as top from stored) select doc_type, doc_id, version, section from x where version = top")
def latest_version(spark, sf_dir):
    """Each document's rows of its highest version."""
    from pairloom.operators.matching import latest

    return latest(stored_and_new(spark, sf_dir)[0])


@query(f"""with {STORE_SQL}, u as (select * from stored s where not exists (select 1 from nw where nw.doc_type = s.doc_type and nw.doc_id = s.doc_id and s.version <= 4) union all select * from nw)
select doc_type, doc_id::varchar as doc_id, version, section from u where doc_id % 4 <> 0""")
def merge_on_read(spark, sf_dir):
    """A store in layers: its rows, newer versions over them, deletes over both; merged when it is read."""
    where = shared_folder(spark)
    kept, (old, new) = store.SnapshotStore(spark, f"{where}/store"), stored_and_new(spark, sf_dir)
    kept.upsert_all(old)
    kept.upsert(new)
    gone = old.unionByName(new).select("doc_type", "doc_id", F.lit(None).cast("int").alias("version")).filter("doc_id % 4 = 0").distinct()
    kept.delete(gone)
    remove_at_exit(spark, where)
    return kept.current().select("doc_type", "doc_id", "version", "section")


# ---- access

ACL_SQL = """acl as (select d.doc_id, case when d.doc_id % 3 = 0 then 'jd' when d.doc_id % 17 = 5 then 'xx' else 'cv' end as doc_type, case when quality = 0 then 'PROCESSING' else 'READY' end as status,
case when toxic = 1 then 'private' when d.doc_id % 5 = 0 then 'unlisted' else 'public' end as visibility, 'u' || (d.doc_id % 10) as owner_id, case when d.doc_id % 13 = 0 then '2024-01-01' end as deleted_at from documents d left join labels l using (doc_id))"""


def acl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    return d.select(
        "doc_id", F.when(i % 3 == 0, "jd").when(i % 17 == 5, "xx").otherwise("cv").alias("doc_type"), F.when(F.col("quality") == 0, "PROCESSING").otherwise("READY").alias("status"),
        F.when(F.col("toxic") == 1, "private").when(i % 5 == 0, "unlisted").otherwise("public").alias("visibility"), F.concat(F.lit("u"), (i % 10).cast("string")).alias("owner_id"), F.when(i % 13 == 0, "2024-01-01").alias("deleted_at"),
    )


SEEN = "deleted_at is null and status = 'READY' and (visibility = 'public' or owner_id = 'u3')"


@query(f"with {ACL_SQL} select doc_id, visibility from acl where doc_type in ('cv', 'jd') and {SEEN}")
def acl_policy(spark, sf_dir):
    """What user u3, without a role, may see."""
    return acl.permitted(acl_rows(spark, sf_dir), user="u3").select("doc_id", "visibility")


@query(f"with {ACL_SQL} select doc_id, visibility from acl where doc_type in ('cv', 'jd') and deleted_at is null and status = 'READY' and visibility in ('public', 'unlisted')")
def acl_role(spark, sf_dir):
    """What an anonymous recruiter may see."""
    return acl.permitted(acl_rows(spark, sf_dir), roles=("recruiter",)).select("doc_id", "visibility")


@query(f"with {ACL_SQL} select doc_id from acl where (visibility in ('public', 'unlisted') or owner_id = 'u3') and status = 'READY'")
def acl_where(spark, sf_dir):
    """The filter on stored metadata."""
    return acl_rows(spark, sf_dir).filter(acl.access_where(("public", "unlisted"), "u3", "READY")).select("doc_id")


@query(f"with {ACL_SQL} select doc_id from acl where status = 'READY' and deleted_at is null and visibility = 'public'")
def public_only(spark, sf_dir):
    """Ready, public, not deleted."""
    return acl.public(acl_rows(spark, sf_dir)).select("doc_id")


@query(f"with {ACL_SQL} select doc_id, n_chars as score from documents where n_chars > 1000 and doc_id in (select doc_id from acl where doc_type in ('cv', 'jd') and {SEEN})")
def acl_gate(spark, sf_dir):
    """Recommendations that the policy admits."""
    recs = table(spark, sf_dir, "documents").filter("n_chars > 1000").select("doc_id", F.col("n_chars").alias("score"))
    return acl.gate(recs, acl_rows(spark, sf_dir), user="u3")


@query("select 'jd_' || o_orderkey as doc_id, case when upper(o_orderstatus) in ('O') then 'READY' else lower(o_orderstatus) end as status from orders")
def job_acl_rows(spark, sf_dir):
    """Access rows of jobs; open ones are ready."""
    o = table(spark, sf_dir, "orders")
    j = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise(F.col("o_orderstatus")).alias("status"), F.lit(None).cast("string").alias("visibility"), F.lit(None).cast("string").alias("owner_id"), F.lit(None).cast("string").alias("deleted_at"))
    return acl.job_acl(j).select("doc_id", "status")


@query("select 'cv:' || vec_id // 4 || ':v' || (label + 1) || ':s' || vec_id % 4 as vector_id, 'cv' as doc_type, (vec_id // 4)::varchar as doc_id, (label + 1)::int as version, 's' || vec_id % 4 as section from embeddings")
def vector_ids(spark, sf_dir):
    """Vector ids, built and taken apart again."""
    v = acl.vector_id(F.lit("cv"), F.floor(F.col("vec_id") / 4).cast("string"), F.col("label") + 1, F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")))
    return table(spark, sf_dir, "embeddings").select(v.alias("vector_id")).withColumn("p", acl.parsed_vector_id(F.col("vector_id"))).select("vector_id", "p.*")


# ---- jobs

JOBS_SQL = f"""jobs as (select event_id as id, (['PENDING', 'PROCESSING', 'READY', 'FAILED'])[event_id % 4 + 1] as status, {EPOCH} as created_at, {EPOCH} + value as updated_at, (event_id % 5)::int as attempt_count,
case when event_id % 3 = 0 then {EPOCH} + 86400 * (event_id % 7) end as next_attempt_at, (value * 1000)::bigint as duration_ms from events)"""
NOW = 1705000000.0


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("PENDING", "PROCESSING", "READY", "FAILED")]), (i % 4 + 1).cast("int"))
    return e.select(
        i.alias("id"), status.alias("status"), seconds().alias("created_at"), (seconds() + F.col("value")).alias("updated_at"), (i % 5).cast("int").alias("attempt_count"),
        F.when(i % 3 == 0, seconds() + 86400 * (i % 7)).alias("next_attempt_at"), F.round(F.col("value") * 1000).cast("long").alias("duration_ms"),
    )


@query(f"with {JOBS_SQL} select s.status, count(id) as jobs from (select unnest(['PENDING', 'PROCESSING', 'READY', 'FAILED', 'CANCELLED']) as status) s left join jobs using (status) group by all")
def queue_counts(spark, sf_dir):
    """Jobs by status, 0 where there is none."""
    return jobs.count_by_status(job_rows(spark, sf_dir))


@query(f"with {JOBS_SQL} select quantile_disc(duration_ms, 0.5) as p50, quantile_disc(duration_ms, 0.95) as p95, round(avg(duration_ms), 1) as avg, round({NOW} - (select min(created_at) from jobs where status = 'PENDING'), 3) as oldest_age from jobs where status = 'READY'")
def queue_stats(spark, sf_dir):
    """Nearest-rank percentiles of finished jobs, and the age of the oldest pending one."""
    j = job_rows(spark, sf_dir)
    return jobs.durations(j).join(F.broadcast(jobs.oldest_pending(j, NOW))).select(F.col("p50").cast("long").alias("p50"), F.col("p95").cast("long").alias("p95"), "avg", F.round("age", 3).alias("oldest_age"))


@query(f"with {JOBS_SQL} select id, row_number() over (order by created_at, id) as place from jobs where status = 'PENDING' and coalesce(next_attempt_at, 0) <= {NOW}")
def claim_order(spark, sf_dir):
    """Due jobs in the order of claiming."""
    return jobs.claim_order(job_rows(spark, sf_dir), NOW).select("id", F.col("place").cast("long").alias("place"))


JOB_TABLE_SQL = "j as (select 'cv:' || id || ':1' as id, created_at from jobs where status = 'PENDING')"


@query(f"with {JOBS_SQL}, {JOB_TABLE_SQL} select id, (1 + (row_number() over (order by created_at, id) - 1) // 100)::int as round, 1 as attempt_count from j qualify round <= 3")
def claimed_jobs(spark, sf_dir):
    """Requested jobs, taken by three claims of a hundred each."""
    where = shared_folder(spark)
    jobs_ = JobTable(spark, f"{where}/jobs")
    j = job_rows(spark, sf_dir).filter("status = 'PENDING'")
    requests = j.select(F.lit("cv").alias("document_type"), F.col("id").cast("string").alias("document_id"), F.lit(1).alias("version"), "created_at")
    jobs_.request(requests.drop("created_at"), 0.0)
    jobs_.change(lambda have: have.drop("created_at").join(requests, UNIQUE))
    taken = [jobs_.added(jobs_.claim(NOW, 100)).select("id", F.lit(i + 1).alias("round"), "attempt_count") for i in range(3)]
    remove_at_exit(spark, where)
    return reduce(DataFrame.unionByName, taken)


@query(f"with {JOBS_SQL} select id, status, case when status = 'PROCESSING' and updated_at < {NOW} - 300 then case when attempt_count >= 3 then 'FAILED' else 'PENDING' end else status end as new_status from jobs")
def stale_requeue(spark, sf_dir):
    """Stale jobs start again or fail."""
    return jobs.requeue_stale(job_rows(spark, sf_dir), NOW).select("id", "status", "new_status")


@query(f"with {JOBS_SQL} select id, round(pow(2, attempt_count - 1), 6) as delay from jobs where attempt_count > 0")
def backoff_schedule(spark, sf_dir):
    """Delay before the next attempt."""
    return job_rows(spark, sf_dir).filter("attempt_count > 0").select("id", F.round(jobs.backoff(F.col("attempt_count")), 6).alias("delay"))


def _segments(df: DataFrame, order: str, path: str) -> None:
    """The rows as lines of JSON in segments of rising ``order``, written side by side."""
    lines = df.select(order, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(path)


def _stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of the lines as a stream, with the number of each line."""
    return linelog.read_lines(spark, path).select("line_no", F.from_json("value", schema).alias("e")).select("line_no", "e.*")


@query(f"with {LOG_SQL} select line_no, event_id, doc_type, doc_id, action, version from log")
def stream_log_lines(spark, sf_dir):
    """The log in segments, read as a stream of numbered lines."""
    where = shared_folder(spark)
    _segments(log(spark, sf_dir).drop("line_no"), "event_id", f"{where}/log")
    lines = _stream(spark, f"{where}/log", "event_id long, doc_type string, doc_id long, action string, version int")
    lines.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    remove_at_exit(spark, where)
    return spark.read.schema(lines.schema).parquet(f"{where}/out")


#: The order of the log alone decides: an upsert stands if no delete and no upsert of the same or a higher version follows.
STANDING_SQL = """select doc_type, doc_type || '_' || doc_id as doc_id, version, 2::bigint as sections from log e where action = 'upsert'
and not exists (select 1 from log f where f.doc_type = e.doc_type and f.doc_id = e.doc_id and f.line_no > e.line_no and (f.action = 'delete' or f.version >= e.version))"""


@query(f"with {LOG_SQL} {STANDING_SQL}")
def stream_outbox_apply(spark, sf_dir):
    """The log as a stream of lines, applied to an empty store; the rows that remain."""
    where = shared_folder(spark)
    e = log(spark, sf_dir).withColumns({"event_id": F.lpad(F.col("event_id").cast("string"), 9, "0"), "doc_id": F.concat_ws("_", "doc_type", F.col("doc_id").cast("string"))})
    _segments(e.drop("line_no"), "event_id", f"{where}/log")
    kept = store.SnapshotStore(spark, f"{where}/store")

    def resolve(upserts: DataFrame) -> DataFrame:
        s = upserts.withColumn("section", F.explode(F.array(F.lit("skills"), F.lit("_full")))).withColumns({"status": F.lit("READY"), "visibility": F.lit("public"), "owner_id": F.lit("")})
        rows = s.select(acl.vector_id(F.col("doc_type"), F.col("doc_id"), F.col("version"), F.col("section")).alias("vector_id"), "doc_type", "doc_id", "version", "section", F.lit(None).cast("array<float>").alias("embedding"), F.lit("").alias("text"), "status", "visibility", "owner_id")
        return rows.withColumns({"language": F.lit("en"), "embedding_model": F.lit("hash"), "content_hash": F.sha2("doc_id", 256)})

    events = _stream(spark, f"{where}/log", ", ".join(c for c in EVENT.split(", ") if c != "line_no long"))
    q = outbox.apply_log(events, kept, resolve, f"{where}/checkpoint", f"{where}/rejected")
    q.awaitTermination()
    remove_at_exit(spark, where)
    return kept.current().groupBy("doc_type", "doc_id", "version").agg(F.count("*").alias("sections"))


COMMANDS = {"signup": "create", "view": "claim", "click": "step", "purchase": "ready", "error": "error"}


@query()
def stream_job_state(spark, sf_dir):
    """The state machine over commands made of events, one job a user; its last states."""
    where = shared_folder(spark)
    table_ = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])
    c = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), table_[F.col("event_type")].alias("kind"), seconds().alias("at"), F.lit(None).cast("string").alias("error"), F.lit("PARSING").alias("step"), F.lit(None).cast("string").alias("hash"))
    _segments(c, "seq", f"{where}/in")
    states = machine.run_jobs(_stream(spark, f"{where}/in", "key string, seq long, kind string, at double, error string, step string, hash string").drop("line_no"))

    def batch(df: DataFrame, n: int) -> None:
        df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{where}/out")

    states.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    remove_at_exit(spark, where)
    out = spark.read.parquet(f"{where}/out")
    return out.groupBy("key").agg(F.max_by(F.struct("status", "attempts"), "batch").alias("s")).select("key", "s.status", "s.attempts")


STALE = 86_400


@query(f"""with s as (select user_id::varchar as key, event_id, epoch_us(ts) // 1000 as t0, lead(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id) as nx, max(epoch_us(ts) // 1000) over () as hi from events),
f as (select key, t0 + {STALE}000 as due_ms, row_number() over (partition by key order by t0, event_id) as attempts from s where nx - t0 > {STALE}000 or (nx is null and t0 + {STALE}000 < hi))
select key, due_ms, attempts::int as attempts, case when attempts = 3 then 'FAILED' else 'PENDING' end as status from f where attempts <= 3""")
def stream_returns(spark, sf_dir):
    """Events as signs of life of one job a user: the moments at which silent jobs come back by their timers."""
    where = shared_folder(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    _segments(e, "us", f"{where}/in")
    signs = _stream(spark, f"{where}/in", "key string, us long").select("key", F.timestamp_micros("us").alias("at"))
    with timers.timed_state(spark):
        q = timers.returning(signs, STALE).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").start()
    q.processAllAvailable()  # also the batch without data in which the last timers end
    q.stop()
    remove_at_exit(spark, where)
    return spark.read.schema(timers.RETURNS).parquet(f"{where}/out")


@query("""select date_trunc('day', ts) as start, event_type, count(*) as events from events group by all""")
def activity_windows(spark, sf_dir):
    """Events by day and type: the batch twin of the windowed stream."""
    e = table(spark, sf_dir, "events")
    w = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("start"), "event_type", "events")
