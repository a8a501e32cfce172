"""Control queries: the event log, jobs, conversations and workflow graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control, graph
from .base import query, table


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r <= 20")
def ctl_recent_events(spark: SparkSession, d: str) -> DataFrame:
    return control.recent(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 20)


@query("select event_id, event_type from events where event_id > 500 order by event_id limit 100")
def ctl_event_cursor(spark: SparkSession, d: str) -> DataFrame:
    return control.after(table(spark, d, "events").select("event_id", "event_type"), "event_id", 500)


_STATUS = "case o_orderstatus when 'O' then 'queued' when 'F' then 'completed' else 'needs_review' end"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "completed").otherwise("needs_review")
    return table(spark, d, "orders").select(k.alias("job_id"), F.concat(F.lit("Job "), F.col("o_orderpriority")).alias("name"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (k % 7 == 0).alias("cancel_requested"), (k % 5 == 0).alias("pause_requested"))


@query(f"select count(*) filter (where {_STATUS} = 'queued') as active, count(*) filter (where {_STATUS} = 'needs_review') as review, count(*) filter (where {_STATUS} = 'completed') as completed, 0 as other from orders")
def ctl_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return control.status_counts(_jobs(spark, d), "status")


@query("select o_orderkey as job_id from orders where o_orderstatus = 'O' and o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0 order by o_orderdate, o_orderkey limit 1")
def ctl_claim_next(spark: SparkSession, d: str) -> DataFrame:
    return control.claimable(_jobs(spark, d)).select("job_id")


@query(f"select o_orderkey as job_id, {_STATUS} as status from orders where {_STATUS} = 'queued' and contains(lower('Job ' || o_orderpriority), 'urgent')")
def ctl_search_jobs(spark: SparkSession, d: str) -> DataFrame:
    return control.search_jobs(_jobs(spark, d), "active", " Urgent ").select("job_id", "status")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def ctl_props_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_REQUESTS = ("ready", "claim", "stage", "pause", "stage", "resume", "claim", "review", "pause", "resume_unresolved", "review", "resume", "claim", "cancel", "stage", "pause", "resume", "claim", "recover", "claim", "fail", "resume", "claim", "complete")


#: The state machine written by hand: ``e`` has user_id, pos (from 1) and r, a request.
_FOLD = """s as (
        select user_id, 0 as pos, {'s': 'preparing', 'p': false, 'c': false} as j from (select distinct user_id from e)
        union all
        select e.user_id, e.pos, case
            when j.s in ('completed', 'failed', 'cancelled') and r in ('pause', 'cancel') then j
            when r = 'pause' then case when j.s in ('queued', 'needs_review') then {'s': 'paused', 'p': false, 'c': j.c} else {'s': j.s, 'p': true, 'c': j.c} end
            when r = 'cancel' then case when j.s in ('queued', 'paused', 'needs_review') then {'s': 'cancelled', 'p': j.p, 'c': false} else {'s': j.s, 'p': j.p, 'c': true} end
            when r in ('resume', 'resume_unresolved') then case when j.s not in ('paused', 'needs_review', 'failed') or (j.s = 'needs_review' and r = 'resume_unresolved') then j else {'s': 'queued', 'p': false, 'c': false} end
            when r = 'ready' then case when j.s <> 'preparing' then j when j.c then {'s': 'cancelled', 'p': false, 'c': false} when j.p then {'s': 'paused', 'p': false, 'c': false} else {'s': 'queued', 'p': false, 'c': false} end
            when r = 'claim' then case when j.s = 'queued' and not j.c and not j.p then {'s': 'running', 'p': j.p, 'c': j.c} else j end
            when r in ('fail', 'deadline') and j.s = 'preparing' then {'s': 'failed', 'p': j.p, 'c': j.c}
            when j.s <> 'running' then j
            when r = 'stage' then case when j.c then {'s': 'cancelled', 'p': j.p, 'c': j.c} when j.p then {'s': 'paused', 'p': j.p, 'c': j.c} else j end
            when r = 'recover' then {'s': 'queued', 'p': j.p, 'c': j.c}
            else {'s': case r when 'review' then 'needs_review' when 'complete' then 'completed' else 'failed' end, 'p': j.p, 'c': j.c} end
        from s join e on e.user_id = s.user_id and e.pos = s.pos + 1
    ) select user_id as job_id, last(j.s order by pos) as state from s group by all"""
_ASKED = f"{list(_REQUESTS)}[cast((event_id // 3 + user_id) % {len(_REQUESTS)} as integer) + 1]"


def requests(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor(F.col("event_id") / 3).cast("long") + F.col("user_id")
    request = F.element_at(F.array(*map(F.lit, _REQUESTS)), (n % len(_REQUESTS) + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", request.alias("request"))


@query(f"with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as pos, {_ASKED} as r from events), {_FOLD}")
def ctl_job_states(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as requests on a job, in order through the state machine."""
    return control.fold_states(requests(spark, d).drop("ts"))


#: Requests by time, and a deadline behind each that is followed by nothing for so long; timers go by the watermark, ten minutes behind the last event.
_OVERDUE = f"""t as (select user_id, event_id, epoch_ms(ts) as ms, {_ASKED} as r, lead(epoch_ms(ts)) over (partition by user_id order by epoch_ms(ts), event_id) as later from events),
    x as (select user_id, ms, event_id, 0 as k, r from t union all select user_id, ms, event_id, 1, 'deadline' from t where coalesce(later, (select max(ms) - 600000 from t)) > ms + {{deadline}}),
    e as (select user_id, row_number() over (partition by user_id order by ms, event_id, k) as pos, r from x)"""
DEADLINE_MS = 6 * 3600 * 1000


DEADLINES_SQL = f"with recursive {_OVERDUE.format(deadline=DEADLINE_MS)}, {_FOLD}"


@query(DEADLINES_SQL)
def ctl_job_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Jobs fail when nothing is heard of them for six hours."""
    rows = requests(spark, d)
    last = rows.agg(F.max(control.millis(F.col("ts"))) - 600_000).first()[0]
    return control.fold_deadlines(rows, DEADLINE_MS, F.lit(last))


#: Queues of five lines, of which two leave in each hour.
_QUEUE = """t as (select event_type as job, cast(floor(epoch_ms(ts) / 3600000.0) as bigint) as tick, count(*) as n from events group by all),
    o as (select *, row_number() over w as pos, tick - lag(tick) over w as gap from t window w as (partition by job order by tick)),
    s as (select distinct job, cast(0 as bigint) as pos, cast(0 as bigint) as held, cast(0 as bigint) as room, cast(null as bigint) as tick from o
        union all select o.job, o.pos, greatest(greatest(s.held - 2 * coalesce(o.gap - 1, 0), 0) + least(o.n, 5 - greatest(s.held - 2 * coalesce(o.gap - 1, 0), 0)) - 2, 0), least(o.n, 5 - greatest(s.held - 2 * coalesce(o.gap - 1, 0), 0)), o.tick from s join o on o.job = s.job and o.pos = s.pos + 1),
    r as (select event_id, event_type as job, cast(floor(epoch_ms(ts) / 3600000.0) as bigint) as tick, row_number() over (partition by event_type, floor(epoch_ms(ts) / 3600000.0) order by event_id) as n from events)"""


def _output(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "events").select(F.col("event_type").alias("job"), "event_id", "ts", "props")
    return control.bounded_output(lines, "job", control.millis(F.col("ts")), "event_id", limit=5, per_poll=2, poll_ms=3_600_000)


@query(f"with recursive {_QUEUE} select event_id, r.job, r.tick, n <= room as kept from r join s on s.job = r.job and s.tick = r.tick")
def ctl_bounded_output(spark: SparkSession, d: str) -> DataFrame:
    """Lines that found room in their job's queue, and those that came while it was full."""
    return _output(spark, d).select("event_id", "job", "tick", "kept")


@query(f"""with recursive {_QUEUE}, k as (select r.*, n <= room as kept from r join s on s.job = r.job and s.tick = r.tick)
    select k.job, 'engine' as level, substring(rtrim('line ' || repeat(props, 1 + cast(k.event_id % 3 as integer)) || '  '), 1, 20) as message from k join events using (event_id) where kept
    union all select job, 'warning', 'output came too fast, ' || count(*) || ' lines left out' from k where not kept group by job""")
def ctl_output_events(spark: SparkSession, d: str) -> DataFrame:
    """What is logged of a job's output: kept lines, cut, and how many were lost."""
    line = F.concat(F.lit("line "), F.expr("repeat(props, cast(1 + event_id % 3 as int))"), F.lit("  "))
    return control.output_events(_output(spark, d), "job", line, 20)


@query("select o_orderkey as job_id, case when o_orderkey % 7 = 0 then 'cancelled' else 'paused' end as stop from orders where o_orderstatus = 'F' and (o_orderkey % 7 = 0 or o_orderkey % 5 = 0)")
def ctl_guard(spark: SparkSession, d: str) -> DataFrame:
    """Running jobs that a request ends: a cancel wins over a pause."""
    return control.guard(_jobs(spark, d).withColumn("status", F.when(F.col("status") == "completed", "running").otherwise(F.col("status"))))


@query("""with st as (select unnest([0, 1, 2]) as pos, unnest(['scan', 'build', 'package']) as stage), j as (select distinct user_id as job_id from events),
    done as (select distinct user_id as job_id, ['scan', 'build', 'package'][cast(event_id % 3 as integer) + 1] as stage from events where event_type = 'purchase')
    select j.job_id, cast(st.pos as integer) as pos, st.stage from j, st where not exists (select 1 from done where done.job_id = j.job_id and done.stage = st.stage)""")
def ctl_stages_left(spark: SparkSession, d: str) -> DataFrame:
    """A job goes on with the stages that have no marker."""
    stages = ["scan", "build", "package"]
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_type", F.element_at(F.array(*map(F.lit, stages)), (F.col("event_id") % 3 + 1).cast("int")).alias("stage"))
    return control.stages_left(e.select("job_id").distinct(), stages, e.filter("event_type = 'purchase'"))


@query("select o_orderkey as job_id from orders order by o_orderdate desc, o_orderkey desc limit 500")
def ctl_list_jobs(spark: SparkSession, d: str) -> DataFrame:
    """A report of the newest jobs; more than 500 are never listed."""
    return control.list_jobs(_jobs(spark, d), 9999).select("job_id")


@query("select event_id, user_id from (select distinct event_id, user_id from events where event_id % 2 = 0 or user_id % 2 = 0) order by event_id desc limit 200")
def ctl_merge_events(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of events that overlap, without repeats, the last 200."""
    e = table(spark, d, "events").select("event_id", "user_id")
    return control.merge_events(e.filter("event_id % 2 = 0"), e.filter("user_id % 2 = 0"), "event_id")


@query("""select o_orderkey as job_id, case when o_orderstatus = 'F' then 'queued' when o_orderstatus = 'O' then 'queued' else 'needs_review' end as status, o_orderstatus = 'F' as warned from orders""")
def ctl_recover(spark: SparkSession, d: str) -> DataFrame:
    """Running jobs are queued again, each with one warning."""
    jobs = _jobs(spark, d).withColumn("status", F.when(F.col("status") == "completed", "running").otherwise(F.col("status")))
    after, warned = control.recover(jobs)
    return after.join(warned.select("job_id", F.lit(True).alias("w")), "job_id", "left").select("job_id", "status", F.coalesce("w", F.lit(False)).alias("warned"))


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 6")
def conv_memory_window(spark: SparkSession, d: str) -> DataFrame:
    return control.memory_window(table(spark, d, "conversations").select("conv_id", "turn", "role"))


@query("""with recursive e as (select p_partkey as a, p_partkey * 2 as b from part union all select p_partkey, p_partkey * 2 + 1 from part), r as (select 3 as node union select b from r join e on e.a = r.node) select cast(node as bigint) as node from r""")
def graph_reachability(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    edges = table(spark, d, "part").select(k.alias("source"), F.explode(F.array(k * 2, k * 2 + 1)).alias("target"))
    return graph.reachable(edges, spark.createDataFrame([(3,)], "node long"))


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all""")
def ext_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    """An addition: hourly windows."""
    rows = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from g)
    select user_id, min(ts) as start, count(*) as n from s group by user_id, sid""")
def ext_sessions(spark: SparkSession, d: str) -> DataFrame:
    """An addition: sessions of a user, half an hour apart."""
    rows = table(spark, d, "events").groupBy(F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
