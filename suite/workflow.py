"""Deployments, leases and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.plans import jobs, leases
from suite.catalog import STATUS
from suite.registry import NOW_SQL, now, query, stamp

BEST = "(select id, host, port, local_path, response_time from f_servers order by response_time nulls last, id limit 1)"
ENDS = f"strftime({NOW_SQL} + interval '1 hour', '%Y-%m-%d %H:%M:%S')"


@query(f"select * from {BEST}")
def best_server(t):
    return leases.best_server(t("f_servers"))


STARTED = """(select locator, (select max(id) from f_deployments) + row_number() over (order by md5(locator), locator) as id
  from (select distinct locator from {0}))"""


@query(f"""
select s.id, s.locator, b.id as server, 'starting' as state, 1 as event_no, b.host, b.port, b.local_path
from {STARTED.format('f_metadata')} s cross join {BEST} b""")
def start_deployments(t):
    return leases.start_deployments(t("f_metadata"), t("f_deployments"), t("f_servers"))


@query(f"""
select 'deployment' as kind, id, 'live' as value from f_deployments where state = 'starting'
union all
select 'lease', l.id, {ENDS} from f_leases l join f_deployments d on l.deployment = d.id
where d.state = 'starting' and l.lifetime is null""")
def complete_deployments(t):
    starting = t("f_deployments").filter(F.col("state") == "starting")
    done = leases.complete_deployments(starting, t("f_deployments"), t("f_leases"), now())
    return done.deployments.select(F.lit("deployment").alias("kind"), "id", F.col("state").alias("value")).unionByName(
        done.leases.select(F.lit("lease").alias("kind"), "id", stamp("lifetime").alias("value")))


@query("""
select id, locator, server, case when state = 'live' and id % 3 = 0 then 'dead' when state = 'live' then 'killing'
   when state = 'starting' then 'dead' else state end as state from f_deployments""")
def transition_deployments(t):
    """Failed starts, removals under way and finished removals, folded into the current table."""
    now_table = t("f_deployments")
    live = now_table.filter(F.col("state") == "live")
    failed = leases.transition_deployments(now_table.filter(F.col("state") == "starting"), now_table, "dead")
    killing = leases.transition_deployments(live, now_table, "killing", 1)
    dead = leases.transition_deployments(live.filter(F.col("id") % 3 == 0), now_table, "dead", 2)
    return leases.current_deployments(leases.as_events(now_table), failed, killing, dead)


NEW_LEASES = """(select tag, locator, seq as deployment, (select max(id) from f_leases)
   + row_number() over (order by md5(tag), tag) as id from f_lease_requests)"""


@query(f"""select id, locator, deployment, {ENDS} as lifetime, tag from {NEW_LEASES}
union all select id, locator, deployment, null, tag from {NEW_LEASES}""")
def new_leases(t):
    """Attached leases (running) and created ones (pending)."""
    asked = t("f_lease_requests").select("tag", "locator", F.col("seq").alias("deployment"))
    both = leases.attach_leases(asked, t("f_leases"), now()).unionByName(
        leases.create_leases(asked, t("f_leases")))
    return both.drop("event_no").withColumn("lifetime", stamp("lifetime"))


@query(f"""
select id, locator, deployment, strftime(case when id % 4 = 0 then {NOW_SQL} + interval '90 minutes'
   else lifetime end, '%Y-%m-%d %H:%M:%S') as lifetime, tag from f_leases""")
def current_leases(t):
    """Every fourth lease gets a new end time; the fold shows the newest."""
    table = t("f_leases")
    ids = table.filter(F.col("id") % 4 == 0).select("id", F.lit(5400).alias("ttl_seconds"))
    return leases.current_leases(leases.as_events(table), leases.set_lease_time(ids, table, now())).withColumn(
        "lifetime", stamp("lifetime"))


FIRST = "(select locator, min(seq) as first_seq from f_lease_requests group by locator)"
ROUTED = f"""(
select r.seq, r.locator, r.timeout, r.tag, coalesce(st.deployment, nw.id) as deployment,
       case when st.status <> 'dead' then st.status when r.seq = f.first_seq then 'started' else 'starting' end as outcome
from f_lease_requests r join {STATUS.format(keys="(select distinct locator from f_lease_requests)")} st using (locator)
  join {FIRST} f using (locator)
  left join (select locator, (select max(id) from f_deployments) + row_number() over (order by md5(locator), locator) as id
             from {STATUS.format(keys="(select distinct locator from f_lease_requests)")} where status = 'dead') nw using (locator))"""
ROUTED_LEASES = f"""select seq, locator, timeout, tag, deployment, outcome,
  (select max(id) from f_leases) + row_number() over (order by md5(tag), tag) as lease from {ROUTED}"""


def _routed(t, mode):
    out = leases.route_lease_requests(t("f_lease_requests"), t("f_deployments"), t("f_servers"), t("f_leases"),
                                      now(), mode)
    made = out.leases.select("tag", F.col("id").alias("lease"), stamp("lifetime").alias("lifetime"))
    return out, out.requests.join(made, "tag")


@query(f"select *, {ENDS} as lifetime from ({ROUTED_LEASES})")
def route_lease_requests(t):
    return _routed(t, "lease")[1]


@query(f"select *, case when outcome <> 'starting' then {ENDS} end as lifetime from ({ROUTED_LEASES})")
def attempt_deployments(t):
    return _routed(t, "attempt")[1]


@query(f"""
select 'grant' as kind, locator, timeout as number, tag as detail from {ROUTED} where outcome = 'live'
union all
select 'deploy', locator, deployment, (select host from {BEST}) from {ROUTED} where outcome = 'started'""")
def lease_request_messages(t):
    """What routing sends on: immediate grants and deploy requests."""
    out = _routed(t, "lease")[0]
    return out.grants.select(F.lit("grant").alias("kind"), "locator", F.col("timeout").alias("number"),
                             F.col("tag").alias("detail")).unionByName(
        out.deploy_requests.select(F.lit("deploy").alias("kind"), "locator", F.col("deployId").alias("number"),
                                   F.col("server.host").alias("detail")))


@query("""
select d.locator, 0 as timeout, l.tag from f_leases l join f_deployments d on l.deployment = d.id
where d.state = 'starting'""")
def grant_leases(t):
    finished = t("f_deployments").filter(F.col("state") == "starting").select(
        "locator", F.col("id").alias("deployId"))
    return leases.grant_leases(finished, t("f_leases"))


GRANTS = """(select 'ds' as any_locator, md5(concat('req-', o_custkey)) as tag, o_orderkey as seq,
  cast(o_orderkey % 2 * 3600000 as bigint) as timeout from {orders} where o_orderstatus = 'F')"""


@query(f"""
select r.tag, r.locator, r.seq, g.timeout as grant_timeout, g.seq as grant_seq, g.seq is not null as granted
from f_lease_requests r left join (
  select * from (select *, row_number() over (partition by tag order by seq) as rn
                 from {GRANTS.format(orders='orders')}) where rn = 1) g using (tag)""")
def match_grants(t):
    return leases.match_grants(t("f_lease_requests"), t.sql("select * from " + GRANTS))


EXPIRED = f"""(select live.id, live.locator, live.server
  from (select deployment from f_leases group by deployment having max(lifetime) < {NOW_SQL}) ended
  join (from f_deployments where state = 'live') live on live.id = ended.deployment semi join f_servers on f_servers.id = live.server)"""


@query(f"""
select 'event' as kind, e.id, e.locator, v.state as detail, v.no as number
from {EXPIRED} e join f_metadata using (locator) join f_geometadata using (locator)
  cross join (values ('killing', 1), ('dead', 2)) v(state, no)
union all
select distinct 'drop', null, e.locator, g.native_format, null from {EXPIRED} e join f_metadata using (locator)
  join f_geometadata g using (locator) where g.native_format = 'zipped-shapefile'
union all
select 'failed', e.id, e.locator, 'missing', null from {EXPIRED} e
where e.locator not in (select locator from f_metadata join f_geometadata using (locator))""")
def cull(t):
    out = leases.cull(t("f_metadata"), t.geometadata(), t("f_deployments"), t("f_servers"), t("f_leases"), now())
    nothing = F.lit(None).cast("bigint")
    return (out.deployments.select(F.lit("event").alias("kind"), "id", "locator", F.col("state").alias("detail"),
                                   F.col("event_no").alias("number"))
            .unionByName(out.dropped.select(F.lit("drop").alias("kind"), nothing.alias("id"), "locator",
                                            F.lit("zipped-shapefile").alias("detail"), nothing.alias("number")))
            .unionByName(out.failed.select(F.lit("failed").alias("kind"), "id", "locator",
                                           F.col("outcome").alias("detail"), nothing.alias("number"))))


@query(f"""
select s.id, s.locator, (select id from {BEST}) as server, case when g.locator is null then 'starting' else 'live' end as state,
       case when g.locator is null then 1 else 2 end as event_no,
       case g.native_format when 'geotiff' then 'raster' when 'zipped-shapefile' then 'feature' end as publisher,
       case when g.locator is null then 'missing' else 'found' end as outcome
from {STARTED.format('f_metadata')} s left join f_geometadata g using (locator)""")
def deploy_datasets(t):
    return leases.deploy_datasets(t("f_metadata").select("locator"), t("f_metadata"), t.geometadata(),
                                  t("f_deployments"), t("f_servers"), t("f_leases"), now())


# A job's path through its life has fixed steps, so each applied report is a "first after" lookup.
STEPS = """
with p as (select id, min(seq) as s0 from f_job_events where status = 'pending' group by id),
a as (select e.id, min(e.seq) as s1 from f_job_events e join p on e.id = p.id and e.seq > p.s0
      where e.status in ('assigned','aborted') group by e.id),
a1 as (select a.id, a.s1, e.status from a join f_job_events e on e.id = a.id and e.seq = a.s1),
b as (select e.id, min(e.seq) as s2 from f_job_events e join a1 on e.id = a1.id and e.seq > a1.s1
      and a1.status = 'assigned' where e.status in ('started','aborted') group by e.id),
b1 as (select b.id, b.s2, e.status from b join f_job_events e on e.id = b.id and e.seq = b.s2),
c as (select e.id, min(e.seq) as s3 from f_job_events e join b1 on e.id = b1.id and e.seq > b1.s2
      and b1.status = 'started' where e.status in ('done','failed') group by e.id),
c1 as (select c.id, c.s3, e.status from c join f_job_events e on e.id = c.id and e.seq = c.s3),
moves as (
  select id, s0 as seq, 'pending' as status from p union all select id, s1, status from a1
  union all select id, s2, status from b1 union all select id, s3, status from c1
  union all select e.id, e.seq, e.status from f_job_events e join b1 on e.id = b1.id and b1.status = 'started'
    left join c on c.id = e.id where e.status = 'progress' and e.seq > b1.s2 and (c.s3 is null or e.seq < c.s3))
"""


@query(STEPS + """select id, seq, lag(status) over (partition by id order by seq) as old_status, status from moves""")
def job_transitions(t):
    return jobs.job_transitions(t("f_job_events"))


@query(STEPS + "select id, arg_max(status, seq) as status from moves group by id")
def fold_job_status(t):
    return jobs.fold_job_status(t("f_job_events"))


@query(STEPS + """select k.id, m.status from (select distinct concat('job-', c_custkey) as id from customer) k
left join (select id, arg_max(status, seq) as status from moves group by id) m using (id)""")
def job_status(t):
    return jobs.job_status(t("f_job_events"), t.sql("select concat('job-', c_custkey) as id from {customer}"))


@query("""
select id, min(seq) as seq from f_job_events
where status = 'pending' and id in (select concat('job-', c_custkey) from customer where c_custkey % 2 = 0) group by id""")
def accept_submissions(t):
    sent = t("f_job_events").filter(F.col("status") == "pending").select("id", "seq")
    issued = t.sql("select concat('job-', c_custkey) as id from {customer} where c_custkey % 2 = 0")
    return jobs.accept_submissions(sent, issued)


@query("""
select seq, case concat(prev, '>', status) when 'pending>assigned' then true when 'pending>aborted' then true
  when 'assigned>started' then true when 'assigned>aborted' then true when 'started>progress' then true
  when 'started>done' then true when 'started>failed' then true when 'progress>progress' then true
  when 'progress>done' then true when 'progress>failed' then true else false end as legal
from (select e.seq, e.status, p.status as prev from f_job_events e left join f_job_events p on p.seq = e.seq - 1)""")
def can_advance(t):
    events = t("f_job_events").select("seq", "status")
    before = events.select((F.col("seq") + 1).alias("seq"), F.col("status").alias("prev"))
    return events.join(before, "seq", "left").select(
        "seq", jobs.can_advance(F.col("prev"), F.col("status")).alias("legal"))


SUBMITTED = "select seq, id, concat('service-', seq % 7) as service from {f_job_events} where status = 'pending'"
REGISTRY = "select concat('service-', r_regionkey) as service, concat(r_name, '-requests') as topic from {region}"


@query("""
select e.seq, e.id, concat('service-', e.seq % 7) as service, r.r_name || '-requests' as topic
from f_job_events e left join region r on e.seq % 7 = r.r_regionkey where e.status = 'pending'""")
def route_jobs(t):
    routed, unknown = jobs.route_jobs(t.sql(SUBMITTED), t.sql(REGISTRY))
    return routed.unionByName(unknown.withColumn("topic", F.lit(None).cast("string")))


@query("""
select 'report' as type, concat('{"id":"', id, '","status":"', status, '"}') as status from f_job_events""")
def job_reports(t):
    return jobs.as_reports(t("f_job_events").select("id", "status")).withColumn("status", F.to_json("status"))
