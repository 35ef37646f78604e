"""Queries of streams that keep state, and of stores that are kept up by changes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.operators import flush, history, saved
from heliograph.operators.filters import Condition, Node
from heliograph.plans.queries import query
from heliograph.sources import imports, package
from heliograph.sources.shared import shared_path
from heliograph.sources.tables import table
from heliograph.streaming import live, tasks

DAY = 86_400


@query(f"""with e as (select cast(user_id as varchar) as task, ts as "at", event_id as place, epoch_us(ts) as us, event_id % 50 as completed, 50 as total,
    case event_type when 'signup' then 'start' when 'view' then 'update' when 'click' then 'poll' when 'purchase' then 'complete' else case when value < 10 then 'cancel' else 'complete' end end as kind,
    case when event_type = 'error' and value >= 10 then 'failed' end as error from events),
  l as (select *, sum(case when kind = 'start' then 1 else 0 end) over (partition by task order by "at", place rows unbounded preceding) as life from e),
  g as (select *, case when us - lag(us) over w > {DAY}000000 then 1 else 0 end as gap from l where life > 0 window w as (partition by task, life order by "at", place)),
  i as (select *, max(gap) over (partition by task, life order by "at", place rows unbounded preceding) as late from g),
  k as (select *, case when kind = 'cancel' then 2 when kind = 'complete' and error is null then 1 end as ends from i where late = 0),
  n as (select *, first_value(ends ignore nulls) over (partition by task, life order by "at", place rows between unbounded preceding and 1 preceding) as ended from k),
  t as (select *, kind = 'poll' and coalesce(ended, 0) = 2 as told from n),
  o as (select *, coalesce(max(case when told then 1 else 0 end) over (partition by task, life order by "at", place rows between unbounded preceding and 1 preceding), 0) as gone from t),
  a as (select *, first_value(us) over w as begun, last_value(case when ended is null and kind in ('complete', 'cancel') then 1.0 when ended is null and kind = 'start' then 0.0 when ended is null and kind = 'update' then completed / 50.0 end ignore nulls) over w as progress,
    last_value(case when ended is null and kind = 'start' then 0 when ended is null and kind = 'update' then completed when ended is null and kind = 'complete' then 50 end ignore nulls) over w as done,
    last_value(case when ended is null and kind = 'cancel' then 'cancelled' when ended is null and kind = 'complete' then error end ignore nulls) over w as problem, lead(us) over v as after
    from o where (ended is null or ended = 2) and gone = 0 window w as (partition by task, life order by "at", place rows unbounded preceding), v as (partition by task, life order by "at", place)),
  s as (select task, "at", case when told then 'told' when ended is not null then null when kind in ('start', 'update') then 'active' when kind = 'cancel' then 'cancelled' when kind = 'complete' then case when error is null then 'done' else 'failed' end end as status,
    done, progress, case when ended is null and kind = 'update' and completed > 0 then ((us - begun) // 1000) * (50 - completed) // completed end as eta_ms, problem from a),
  x as (select a.task, make_timestamp(a.us + {DAY}000000) as "at", 'expired' as status, a.done, a.progress, null as eta_ms, a.problem from a left join (select task, life - 1 as life, us as again from k where kind = 'start') b using (task, life)
    where a.after is null and a.ended is null and a.ends is null and (select max(epoch_us(ts)) from events) > a.us + {DAY}000000 and (b.again is null or b.again > a.us + {DAY}000000))
  select task, "at", status, cast(done as bigint) as completed, round(progress, 9) as progress, cast(eta_ms as bigint) as eta_ms, case when status <> 'done' then problem end as error from (select * from s where status is not null union all select * from x)""")
def task_history(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    failed = (F.col("event_type") == "error") & (F.col("value") >= 10)
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "view", "update").when(F.col("event_type") == "click", "poll").when((F.col("event_type") == "purchase") | failed, "complete").otherwise("cancel")
    rows = stream.select(F.col("user_id").alias("task"), F.col("ts").alias("at"), kind.alias("kind"), (F.col("event_id") % 50).alias("completed"), F.lit(50).alias("total"), F.when(failed, "failed").alias("error"), "event_id")
    with live.timed_state(spark):
        out = live.run_once(tasks.streamed(rows, DAY, "event_id"), "append")
    return out.select("task", "at", "status", "completed", F.round("progress", 9).alias("progress"), "eta_ms", "error")


@query("""select p_partkey, p_size, p_retailprice, place from (select *, row_number() over (order by p_retailprice desc, p_partkey) as place from part
  where p_size >= (select max(n_nationkey) from nation) and p_brand <> 'Brand#11') where place <= 60""")
def live_view(spark: SparkSession, folder: str) -> DataFrame:
    part, nation = table(spark, folder, "part"), table(spark, folder, "nation")
    stream = lambda name, schema: spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    control = stream("nation", nation.schema).select(F.col("n_nationkey").alias("at"), F.col("n_nationkey").alias("least"), F.lit("p_retailprice").alias("by"))

    def view(rows: DataFrame, row) -> DataFrame:
        wanted = Node("and", (Condition("p_size", "ge", row["least"]), Condition("p_brand", "ne", "Brand#11")))
        best = rows.where(wanted.column()).orderBy(F.desc(row["by"]), "p_partkey").limit(60).select("p_partkey", "p_size", "p_retailprice")
        return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long"))

    held = live.LiveView(stream("part", part.schema), control, ["at"], view, shared_path(spark, "live-view"))
    held.start(shared_path(spark, "live-view-state")).awaitTermination()
    return held.current(spark)


# ---- stores that are kept up by changes

PEOPLE_SQL = """with people as (select c_custkey, c_name, c_acctbal, c_mktsegment, '/' || r_name || '/' || n_name as folder, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
  now as (select c_custkey, case when c_mktsegment = 'MACHINERY' then '/' || r_name || '/moved' else folder end as folder, case when c_mktsegment = 'BUILDING' then -c_acctbal else c_acctbal end as c_acctbal, c_mktsegment
    from people where not (c_mktsegment = 'HOUSEHOLD' and c_acctbal < 1000))"""

#: Names of saved filters with the folder and the tree of each.
SAVED = {
    "rich": ("/EUROPE/FRANCE", Condition("c_acctbal", "gt", 5000)), "owing": ("/EUROPE/FRANCE", Condition("c_acctbal", "lt", 0)), "builders": ("/ASIA/CHINA", Condition("c_mktsegment", "eq", "BUILDING")),
    "any": ("/ASIA/moved", Node("and")), "some": ("/AFRICA/KENYA", Node("or", (Condition("c_acctbal", "between", 100, 3000), Condition("c_mktsegment", "eq", "AUTOMOBILE")))),
}


def _people(spark: SparkSession, folder: str) -> DataFrame:
    region, nation, customer = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("c_custkey").alias("element"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_name").alias("path"), F.concat(F.lit("/"), "r_name").alias("region"), "c_name", "c_acctbal", "c_mktsegment")


@query(PEOPLE_SQL + """ select '/EUROPE/FRANCE' as folder, 'rich' as filter_id, cast(c_custkey as varchar) as element from now where folder = '/EUROPE/FRANCE' and c_acctbal > 5000
  union all select '/EUROPE/FRANCE', 'owing', cast(c_custkey as varchar) from now where folder = '/EUROPE/FRANCE' and c_acctbal < 0
  union all select '/ASIA/CHINA', 'builders', cast(c_custkey as varchar) from now where folder = '/ASIA/CHINA' and c_mktsegment = 'BUILDING'
  union all select '/ASIA/moved', 'any', cast(c_custkey as varchar) from now where folder = '/ASIA/moved'
  union all select '/AFRICA/KENYA', 'some', cast(c_custkey as varchar) from now where folder = '/AFRICA/KENYA' and (c_acctbal between 100 and 3000 or c_mktsegment = 'AUTOMOBILE')""")
def saved_filter_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """An index built over all customers, then refreshed by those that owe, move and leave."""
    people = _people(spark, folder)
    root = shared_path(spark, "saved-filters")
    saved.build(spark, root, people, SAVED, parts=16)
    gone = (F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_acctbal") < 1000)
    moves, turns = F.col("c_mktsegment") == "MACHINERY", F.col("c_mktsegment") == "BUILDING"
    path = F.when(gone, None).when(moves, F.concat("region", F.lit("/moved/"), "c_name")).otherwise(F.col("path"))
    changes = people.where(gone | moves | turns).withColumns({"path_before": F.col("path"), "path": path, "c_acctbal": F.when(turns, -F.col("c_acctbal")).otherwise(F.col("c_acctbal"))})
    saved.refresh(spark, root, changes, SAVED)
    return saved.listed(spark, root)


@query("""with t as (select '/' as path, true as is_folder, 'root' as what union all select '/' || r_name, true, 'region' from region
    union all select '/' || r_name || '/' || n_name, true, 'nation' from nation join region on n_regionkey = r_regionkey
    union all select '/' || r_name || '/' || n_name || '/' || c_name, false, 'customer' from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
  a as (select '//' || n_name || '/' || c_name || '/' as path, '/' || n_name || '/' || c_name as normal from customer join nation on c_nationkey = n_nationkey
    union all select ' /' || r_name || '//' || n_name || '/' || c_name || case when c_custkey % 3 = 0 then '/more' else '///' end, '/' || r_name || '/' || n_name || '/' || c_name || case when c_custkey % 3 = 0 then '/more' else '' end
      from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    union all select r_name || '/' || n_name, '/' || r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey union all select '', '/')
  select a.path, a.normal, t.what, t.is_folder from a left join t on t.path = a.normal""")
def resolve_paths(spark: SparkSession, folder: str) -> DataFrame:
    people = _people(spark, folder).withColumn("nation", F.element_at(F.split("path", "/"), 3))
    level = lambda columns, what: people.select(F.concat(*columns).alias("path"), F.lit(what == "customer").alias("file"), F.lit(what).alias("what")).distinct()
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    tree = level(("path",), "customer").unionByName(joined.select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"), F.lit(False).alias("file"), F.lit("nation").alias("what")))
    tree = tree.unionByName(regions.select(F.concat(F.lit("/"), "r_name").alias("path"), F.lit(False).alias("file"), F.lit("region").alias("what"))).unionByName(spark.range(1).select(F.lit("/").alias("path"), F.lit(False).alias("file"), F.lit("root").alias("what")))
    asked = people.select(F.concat(F.lit("//"), "nation", F.lit("/"), "c_name", F.lit("/")).alias("path"))
    deeper = F.when(F.col("element") % 3 == 0, "/more").otherwise("///")
    asked = asked.unionByName(people.select(F.concat(F.lit(" "), "region", F.lit("//"), "nation", F.lit("/"), "c_name", deeper).alias("path")))
    asked = asked.unionByName(joined.select(F.concat("r_name", F.lit("/"), "n_name").alias("path"))).unionByName(spark.range(1).select(F.lit("").alias("path")))
    return saved.resolved(tree.withColumn("is_folder", ~F.col("file")).drop("file"), asked).select("path", "normal", "what", "is_folder")


@query("""with base as (select c_custkey, c_name, c_acctbal, false as deleted, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'F') as refs from customer where c_mktsegment <> 'HOUSEHOLD'),
  steps as (select o_custkey, sum(case o_orderstatus when 'O' then 1 when 'F' then -1 else 0 end) as step from orders where o_orderdate >= timestamp '1996-01-01' group by 1),
  merged as (select c.c_custkey, c.c_name, case when c_mktsegment = 'BUILDING' then c.c_acctbal + 100 else c.c_acctbal end as c_acctbal, greatest(0, coalesce(b.refs, 0) + coalesce(s.step, 0)) as ref_count, c_mktsegment = 'MACHINERY' as deleted
    from customer c left join base b using (c_custkey) left join steps s on s.o_custkey = c.c_custkey)
  select c_custkey, c_name, round(c_acctbal, 2) as c_acctbal, cast(ref_count as bigint) as ref_count, deleted from merged where not deleted or ref_count > 0""")
def dirty_flush(spark: SparkSession, folder: str) -> DataFrame:
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    refs = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("ref_count"))
    segment = F.col("c_mktsegment")
    base = customer.where(segment != "HOUSEHOLD").join(refs, "c_custkey", "left").select("c_custkey", "c_name", "c_acctbal", F.coalesce("ref_count", F.lit(0)).alias("ref_count"), F.lit(False).alias("deleted"))
    kind = F.when(segment == "HOUSEHOLD", "insert").when(segment == "BUILDING", "update").when(segment == "MACHINERY", "delete")
    changes = customer.withColumn("kind", kind).where("kind is not null").withColumn("number", F.lit(2))
    changes = changes.withColumn("c_acctbal", F.when(F.col("kind") == "update", F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal"))).withColumn("c_name", F.when(F.col("kind") != "update", F.col("c_name")))
    stale = changes.where("kind = 'update'").withColumn("c_acctbal", F.lit(-1.0)).withColumn("number", F.lit(1))
    steps = orders.where("o_orderdate >= timestamp '1996-01-01'").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", -1).otherwise(0).alias("step"))
    out = flush.flushed(base, changes.unionByName(stale), steps, "c_custkey", ["number"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("""select 'images' as section, cast(p_partkey as varchar) as id, p_name || '|' || cast(p_size as varchar) as detail from part
  union all select 'thumbnails', cast(p_partkey as varchar), 'thumb/' || cast(p_partkey as varchar) || '.jpg' from part where p_size > 25
  union all select 'edits', cast(event_id as varchar), cast(event_id % (select count(*) from part) + 1 as varchar) || '|' || props from events
  union all select 'presets', p_brand, p_type from part group by 2, 3
  union all select 'tree', cast(n_nationkey as varchar), '/' || r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey
  union all select 'header', 'catalogue', cast((select count(*) from part) as varchar) || '|' || cast((select count(distinct event_id % (select count(*) from part)) from events) + 4 as varchar)""")
def project_package(spark: SparkSession, folder: str) -> DataFrame:
    """A package saved twice and opened again, its sections as one table."""
    part, events = table(spark, folder, "part"), table(spark, folder, "events")
    images = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("displayName"), "p_size", F.when(F.col("p_size") > 25, F.concat(F.lit("thumb/"), "p_partkey", F.lit(".jpg"))).alias("thumbnailPath"))
    n = part.count()
    edits = events.select(F.col("event_id").cast("string").alias("id"), (F.col("event_id") % n + 1).cast("string").alias("imageId"), F.col("props").alias("paramDeltaJson"), "value", "ts")
    presets = part.select(F.col("p_brand").alias("name"), F.col("p_type").alias("category")).distinct()
    tree = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"))
    root = shared_path(spark, "project")
    package.save(spark, root, "old", images.limit(0), {}, now=1)
    package.save(spark, root, "catalogue", images, {"tree": tree, "edits": edits, "presets": presets}, now=2)
    header, found = package.opened(spark, root)
    text = {
        "images": (F.col("id"), F.concat_ws("|", "displayName", "p_size")), "thumbnails": (F.col("imageId"), F.col("path")), "edits": (F.col("id"), F.concat_ws("|", "imageId", "paramDeltaJson")),
        "presets": (F.col("name"), F.col("category")), "tree": (F.col("id").cast("string"), F.col("path")),
    }
    out = spark.createDataFrame([("header", header["name"], f"{header['imageCount']}|{header['entryCount']}")], "section string, id string, detail string")
    for name, (key, detail) in text.items():
        out = out.unionByName(found[name].select(F.lit(name).alias("section"), key.alias("id"), detail.alias("detail")))
    return out


# ---- logs of actions

KIND_SQL = "case when event_type = 'error' then 'undo' when event_type = 'signup' and value < 15 then 'redo' when event_type = 'purchase' and value < 5 then 'mark' else 'edit' end"


@query(f"""with recursive l as (select user_id, {KIND_SQL} as kind, event_type, json_extract_string(props, '$.k') as k, row_number() over (partition by user_id order by ts, event_id) as place, count(*) filter ({KIND_SQL} in ('edit', 'mark')) over (partition by user_id) as total from events),
  walk(user_id, place, n, c) as (select user_id, 0::bigint, 0::bigint, 0::bigint from (select distinct user_id from events) union all
    select w.user_id, l.place, w.n + case when l.kind in ('edit', 'mark') then 1 else 0 end, case l.kind when 'edit' then 0 when 'undo' then least(w.c + 1, l.total) when 'redo' then greatest(w.c - 1, 0) else w.c end from walk w join l on l.user_id = w.user_id and l.place = w.place + 1),
  last as (select user_id, arg_max(n, place) as n, arg_max(c, place) as c from walk group by 1),
  real as (select *, row_number() over (partition by user_id order by place) as nth from l where kind in ('edit', 'mark'))
  select r.user_id, event_type as field, arg_max(k, place) as value from real r join last on last.user_id = r.user_id where nth <= n - c and kind = 'edit' group by 1, 2""")
def undo_by_log(spark: SparkSession, folder: str) -> DataFrame:
    """The fields after a log in which errors undo and cheap sign-ups redo."""
    value, kind = F.col("value"), F.col("event_type")
    action = F.when(kind == "error", "undo").when((kind == "signup") & (value < 15), "redo").when((kind == "purchase") & (value < 5), "mark").otherwise("edit")
    log = table(spark, folder, "events").select("user_id", "ts", "event_id", action.alias("kind"), F.create_map("event_type", F.get_json_object("props", "$.k")).alias("delta"))
    return history.replayed(log, "user_id", ["ts", "event_id"], "kind", "delta")


FIELDS_SQL = "[" + ", ".join(f"{{'field': '{name}', 'base': '{value}'}}" for name, value in history.BATCH_DEFAULTS.items()) + "]"


@query(f"""with a as (select user_id, arg_max(event_id, (ts, event_id)) as event_id from events where event_type = 'view' group by 1), t as (select c_custkey as user_id, c_nationkey from customer),
  st as (select user_id, json_extract_string(arg_max(props, (ts, event_id)), '$.k') as k from events where event_type = 'click' group by 1),
  f as (select unnest({FIELDS_SQL}) as f),
  d as (select a.user_id, a.event_id, 'Copy from ' || (a.user_id - 1) as label, f.f.field as field, case when f.f.field = 'exposure' and st.k is not null then cast(cast(st.k as double) as varchar) else f.f.base end as value
      from t join a on a.user_id = t.user_id join a s on s.user_id = a.user_id - 1 left join st on st.user_id = s.user_id, f where c_nationkey < 8
    union all select a.user_id, a.event_id, 'Warm', f.f.field, case f.f.field when 'temperature' then '12.5' when 'lutIntensity' then '0.5' else f.f.base end from t join a on a.user_id = t.user_id, f where c_nationkey between 8 and 15
    union all select a.user_id, a.event_id, 'Reset', f.f.field, f.f.base from t join a on a.user_id = t.user_id, f where c_nationkey > 15)
  select * from d""")
def batch_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Copies from the neighbour, a preset and resets, as rows of the log."""
    events, customer = table(spark, folder, "events"), table(spark, folder, "customer")
    latest = F.struct("ts", "event_id")
    active = events.where("event_type = 'view'").groupBy("user_id").agg(F.max_by("event_id", latest).alias("event_id"))
    clicked = events.where("event_type = 'click'").groupBy("user_id").agg(F.max_by("props", latest).alias("props"))
    states = active.join(clicked, "user_id").select("event_id", F.create_map(F.lit("exposure"), F.get_json_object("props", "$.k"), F.lit("other"), F.lit("1")).alias("state"))
    targets = customer.select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    copies = targets.where("c_nationkey < 8").select("user_id", (F.col("user_id") - 1).alias("source"))
    rows = history.batch_copied(targets, active, states, "user_id", "event_id", "state", copies, "source")
    rows = rows.unionByName(history.batch_preset(targets.where("c_nationkey between 8 and 15"), active, "user_id", "event_id", {"temperature": 12.5, "lutIntensity": 0.5}, "Warm"))
    rows = rows.unionByName(history.batch_reset(targets.where("c_nationkey > 15"), active, "user_id", "event_id"))
    return rows.select("user_id", "event_id", "label", F.explode("delta").alias("field", "value"))


# ---- imports


@query("""with f as (select cast(user_id as varchar) as task, event_id, ts, 'f' || event_id || case event_id % 7 when 0 then '.txt' when 1 then '.NEF' else '.jpg' end as name from events),
  c as (select cast(user_id as varchar) as task, min(ts) as stop from events where event_type = 'error' and value > 60 group by 1),
  n as (select f.*, row_number() over (partition by f.task order by ts, event_id) as done, count(*) over (partition by f.task) as total, max(ts) over (partition by f.task) as fin, c.stop from f left join c on c.task = f.task)
  select task, max(total) as total, count(*) filter ((stop is null or ts <= stop) and event_id % 7 <> 0) as added, count(*) filter ((stop is null or ts <= stop) and event_id % 7 = 0) as refused,
    max(case when stop is null or ts <= stop then done else 0 end) as through, case when any_value(stop) is null or max(fin) <= any_value(stop) then 'done' else 'cancelled' end as status from n group by 1""")
def import_progress(spark: SparkSession, folder: str) -> DataFrame:
    """A task for each user, whose files are the events; costly errors cancel."""
    events = table(spark, folder, "events")
    name = F.concat(F.lit("f"), "event_id", F.when(F.col("event_id") % 7 == 0, ".txt").when(F.col("event_id") % 7 == 1, ".NEF").otherwise(".jpg"))
    files = events.select(F.col("user_id").cast("string").alias("task"), F.col("event_id").alias("number"), F.col("ts").alias("at"), name.alias("name"))
    cancels = events.where("event_type = 'error' and value > 60").select(F.col("user_id").cast("string").alias("task"), F.col("ts").alias("at"))
    good, bad, log = imports.imported(files, cancels, "/import")
    seen = tasks.changes(log, 365 * DAY, "place")
    ends = seen.groupBy("task").agg(F.max("total").alias("total"), F.max(F.when(F.col("status") == "active", F.col("completed"))).alias("through"), F.max(F.when(F.col("status").isin("done", "cancelled"), F.col("status"))).alias("status"))
    count = lambda df, n: df.groupBy("task").agg(F.count("*").alias(n))
    return ends.join(count(good, "added"), "task", "left").join(count(bad, "refused"), "task", "left").fillna(0, ["added", "refused", "through"])
