"""Queries over the driver's tables, each with the same statement in DuckDB's SQL.

The tables stand in for a catalogue: parts and orders are catalogue rows,
region/nation/customer a folder tree, events an edit log, line items pixels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.functions import paths, scoring, text, vectors
from heliograph.functions.hashing import merkle_roots
from heliograph.operators import catalog, history, imaging, scopes, search, tree
from heliograph.operators.filters import Condition, Node, date_filter, exif_filter, scoped
from heliograph.session import configure
from heliograph.sources.shared import as_view
from heliograph.sources.tables import table
from heliograph.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(configure(spark), folder)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


# ---- filters and pages


@query("""select p_partkey, p_size between 10 and 20 as in_range, contains(lower(p_name), 'bolt') as has_text, not contains(lower(p_name), 'ring') as lacks,
  starts_with(lower(p_name), 'blue') as starts, ends_with(lower(p_name), 'gear') as ends, p_size > 25 as above, p_size <= 25 as upto, p_brand <> 'Brand#11' as other,
  p_retailprice >= 1000 as dear, regexp_matches(p_type, '^(SM|LAR)[A-Z]+') as typed, p_type = 'PROMO' as promo, p_retailprice < 950 as cheap from part""")
def filter_ops(spark: SparkSession, folder: str) -> DataFrame:
    tests = {
        "in_range": Condition("p_size", "between", 10, 20), "has_text": Condition("p_name", "contains", "BOLT"), "lacks": Condition("p_name", "not_contains", "ring"),
        "starts": Condition("p_name", "starts", "blue"), "ends": Condition("p_name", "ends", "Gear"), "above": Condition("p_size", "gt", 25), "upto": Condition("p_size", "le", 25),
        "other": Condition("p_brand", "ne", "Brand#11"), "dear": Condition("p_retailprice", "ge", 1000), "typed": Condition("p_type", "regex", "^(SM|LAR)[A-Z]+"), "promo": Condition("p_type", "eq", "PROMO"), "cheap": Condition("p_retailprice", "lt", 950),
    }
    return table(spark, folder, "part").select("p_partkey", *(c.column().alias(n) for n, c in tests.items()))


@query("""select p_partkey, p_name, p_size from part where (p_size > 30 or p_brand = 'Brand#12') and not (p_retailprice < 950 or contains(lower(p_name), '9'))""")
def filter_tree(spark: SparkSession, folder: str) -> DataFrame:
    wanted = Node("and", (
        Node("or", (Condition("p_size", "gt", 30), Condition("p_brand", "eq", "Brand#12"))),
        Node("not", (Condition("p_retailprice", "lt", 950), Condition("p_name", "contains", "9"))),
    ))
    return table(spark, folder, "part").where(wanted.column()).select("p_partkey", "p_name", "p_size")


@query("select c_custkey from customer where c_nationkey = 7 and c_acctbal >= 0 and c_mktsegment <> 'BUILDING'")
def filter_scope(spark: SparkSession, folder: str) -> DataFrame:
    wanted = Node("and", (Condition("c_acctbal", "ge", 0), Condition("c_mktsegment", "ne", "BUILDING")))
    return scoped(table(spark, folder, "customer"), wanted, "c_nationkey", 7).select("c_custkey")


PAGE_SQL = """select o_orderkey, o_totalprice, o_orderstatus from orders where o_totalprice >= 50000 and o_orderstatus in ('O', 'F') and contains(lower(o_orderpriority), 'urgent')
  order by o_totalprice desc nulls last, o_orderkey limit 50 offset 100"""


@query(PAGE_SQL)
def optional_predicates_page(spark: SparkSession, folder: str) -> DataFrame:
    wanted = Node("and", (Condition("o_totalprice", "ge", 50000), Node("or", (Condition("o_orderstatus", "eq", "O"), Condition("o_orderstatus", "eq", "F"))), Condition("o_orderpriority", "contains", "urgent")))
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return catalog.page(rows, wanted.column(), "o_totalprice", False, "o_orderkey", 50, 100).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("""select p_partkey from part where p_brand = 'Brand#13' and p_size >= 10 and p_retailprice >= 900""")
def exif_filter_rows(spark: SparkSession, folder: str) -> DataFrame:
    fields = {"camera": "p_brand", "aperture": "p_size", "focal_length": "p_retailprice"}
    return table(spark, folder, "part").where(exif_filter("Brand#13", aperture=10, focal_length=900).column(fields)).select("p_partkey")


@query("select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1996-06-30'")
def date_filter_rows(spark: SparkSession, folder: str) -> DataFrame:
    wanted = date_filter("o_orderdate", "1995-01-01", "1996-06-30")
    return table(spark, folder, "orders").where(wanted.column()).select("o_orderkey", "o_orderdate")


@query("""select count(*) as total, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_orderstatus = 'F') as done,
  count(*) filter (o_totalprice > 200000) as dear from orders""")
def catalog_stats(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.stats(table(spark, folder, "orders"), open=F.col("o_orderstatus") == "O", done=F.col("o_orderstatus") == "F", dear=F.col("o_totalprice") > 200000)


@query("select distinct p_brand from part where p_brand is not null")
def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.distinct_values(table(spark, folder, "part"), "p_brand", in_order=True)


@query("select event_type, count(*) as n, count(distinct user_id) as users from events group by event_type")
def count_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("select c_custkey, c_acctbal from customer where c_acctbal is not null order by c_acctbal desc, c_custkey limit 100")
def top_rated(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.top(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 100)


@query("select c_custkey, c_acctbal from customer where c_acctbal is not null order by c_acctbal, c_custkey limit 100")
def bottom_rated(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.top(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 100, ascending=True)


@query("""select c_custkey, row_number() over (order by coalesce(o.total, -1) desc, c_custkey) as place from customer c
  left join (select o_custkey, round(sum(o_totalprice), 2) as total from orders where o_orderstatus = 'P' group by 1) o on o.o_custkey = c.c_custkey""")
def sort_null_defaults(spark: SparkSession, folder: str) -> DataFrame:
    totals = table(spark, folder, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = table(spark, folder, "customer").select("c_custkey").join(totals, "c_custkey", "left")
    return catalog.numbered(catalog.ordered(rows, "total", False, "c_custkey", null_as=-1.0), "place").select("c_custkey", "place")


# ---- tree

TREE_SQL = """with t as (
  select '/' as path, true as is_folder
  union all select '/' || r_name, true from region
  union all select '/' || r_name || '/' || n_name, true from nation join region on n_regionkey = r_regionkey
  union all select '/' || r_name || '/' || n_name || '/' || c_name, false from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def _tree(spark: SparkSession, folder: str) -> DataFrame:
    region, nation, customer = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", paths.joined(paths.joined(F.lit("/"), F.col("r_name")), F.col("n_name")).alias("path"))
    files = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(paths.joined(F.col("path"), F.col("c_name")).alias("path"), F.lit(False).alias("is_folder"))
    folders = region.select(paths.joined(F.lit("/"), F.col("r_name")).alias("path")).union(nations.select("path")).union(spark.range(1).select(F.lit("/")))
    return folders.select("path", F.lit(True).alias("is_folder")).unionByName(files)


@query(TREE_SQL + "select path, is_folder from t where path like '/ASIA/%' and len(string_split(path, '/')) = 3")
def folder_tree_listing(spark: SparkSession, folder: str) -> DataFrame:
    return tree.children(_tree(spark, folder), "/ASIA")


@query(TREE_SQL + """, f as (select path from t where not is_folder)
  select t.path, count(*) as files from t join f on f.path like (case when t.path = '/' then '/' else t.path || '/' end) || '%' where is_folder group by t.path""")
def subtree_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tree.subtree_counts(_tree(spark, folder))


@query(TREE_SQL + """, c as (select coalesce(nullif(regexp_replace(path, '/[^/]*$', ''), ''), '/') as parent, is_folder from t where path <> '/')
  select parent, count(*) filter (is_folder) as folders, count(*) filter (not is_folder) as files from c group by parent""")
def listing_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tree.listing_counts(_tree(spark, folder))


@query(TREE_SQL + """select path, cast(len(list_filter(string_split(path, '/'), lambda x: x <> '')) as integer) as depth,
  repeat('  ', len(list_filter(string_split(path, '/'), lambda x: x <> ''))) || case when path = '/' then '/' else list_last(string_split(path, '/')) end as line from t""")
def tree_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return tree.flattened(_tree(spark, folder)).select("path", "depth", "line")


@query(TREE_SQL + "select case when path = '/ASIA' or path like '/ASIA/%' then '/EUROPE/ASIA' || substr(path, 6) else path end as path, is_folder from t")
def subtree_move(spark: SparkSession, folder: str) -> DataFrame:
    return tree.moved(_tree(spark, folder), "/ASIA", "/EUROPE/ASIA")


@query(TREE_SQL + "select path, is_folder from t where not (path = '/AFRICA' or starts_with(path, '/AFRICA/'))")
def subtree_delete(spark: SparkSession, folder: str) -> DataFrame:
    return tree.without_subtree(_tree(spark, folder), "/AFRICA")


@query("""with recursive e(id, parent_id) as (select 1000 + n_nationkey, n_regionkey from nation union all select r_regionkey, -1 from region union all select -1, null),
  below(id, depth) as (select id, 0 from e where id = -1 union all select e.id, b.depth + 1 from e join below b on e.parent_id = b.id) select id, depth from below""")
def tree_reachable(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    edges = nation.select((F.col("n_nationkey") + 1000).alias("id"), F.col("n_regionkey").alias("parent_id")).union(region.select("r_regionkey", F.lit(-1))).union(spark.range(1).select(F.lit(-1), F.lit(None).cast("int")))
    return tree.reachable(spark, as_view(edges), -1)


# ---- changes


@query("""select user_id, event_id, round(value, 4) as value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "value")
    before = catalog.latest(events.where("ts < timestamp_ntz'2024-01-15'"), ["user_id"], ["ts", "event_id"])
    after = catalog.upserted(before, events.where("ts >= timestamp_ntz'2024-01-15'"), ["user_id"], ["ts", "event_id"])
    return after.select("user_id", "event_id", F.round("value", 4).alias("value"))


@query("""select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'old' else 'new' end as origin from customer""")
def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    old = keys.where("c_mktsegment in ('BUILDING', 'MACHINERY')").select("c_custkey", F.lit("old").alias("origin"))
    new = keys.select("c_custkey", F.lit("new").alias("origin"))  # all customers, those that are there among them
    return catalog.inserted_if_absent(old, new, ["c_custkey"])


@query("select l_orderkey, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by l_orderkey")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    left = catalog.cascade_deleted(gone, "o_orderkey", (table(spark, folder, "lineitem").select("l_orderkey"), "l_orderkey"))[0]
    return left.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""select p_partkey, case when p_size > 40 then 'PICK' else p_type end as p_type, greatest(0, case when p_size > 10 then p_size - 15 else p_size end) as p_size from part""")
def column_updates(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog.updated(table(spark, folder, "part").select("p_partkey", "p_type", "p_size"), F.col("p_size") > 40, p_type="PICK")
    return catalog.counted(rows, F.col("p_size") > 10, "p_size", -15)


@query("""select c.c_custkey, c.c_name, o.score from customer c join (select o_custkey, round(max(o_totalprice), 2) as score from orders group by 1 order by score desc, o_custkey limit 100) o
  on c.c_custkey = o.o_custkey""")
def id_lookup_join(spark: SparkSession, folder: str) -> DataFrame:
    scores = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("score"))
    best = catalog.top(scores, "score", "c_custkey", 100)
    return catalog.joined_in_order(best, table(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey", "score")


@query("select user_id, max(ts) as last_used from events where user_id is not null group by user_id order by last_used desc, user_id limit 8")
def recent_queries(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.recent(table(spark, folder, "events"), "user_id", "ts")


# ---- search

QUERY_SQL = "(select list_transform(embedding, lambda x: x::double) as q from embeddings where vec_id = 0)"


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    row = table(spark, folder, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


@query(f"""select vec_id, round(score, 5) as score from (select vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::double), q) as score from embeddings, {QUERY_SQL})
  order by score desc, vec_id limit 50""")
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    best = search.nearest(table(spark, folder, "embeddings"), _query_vector(spark, folder), 50, "vec_id", "embedding")
    return best.select("vec_id", F.round("score", 5).alias("score"))


@query("""select vec_id, list_transform(list_transform(embedding, lambda x: x::double), lambda x: round(x / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))), 4))[1] as first,
  round(sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))), 4) as norm from embeddings""")
def l2_normalise(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", F.round(vectors.l2_normalised(F.col("embedding"))[0], 4).alias("first"), F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


@query(f"""with s as (select vec_id as id, list_cosine_similarity(list_transform(embedding, lambda x: x::double), q) as score from embeddings, {QUERY_SQL} order by score desc, id limit 100),
  f as (select doc_id as id, 0.5 + case when n_chars > 1000 then 0.3 else 0 end as score from documents where lang = 'en')
  select coalesce(s.id, f.id) as id, round(case when s.id is not null and f.id is not null then 0.7 * s.score + 0.5 * f.score when s.id is not null then 0.7 * s.score else 0.4 * f.score end, 5) as score
  from s full join f on s.id = f.id""")
def hybrid_merge(spark: SparkSession, folder: str) -> DataFrame:
    meaning = search.nearest(table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id"), _query_vector(spark, folder), 100, "id", "embedding")
    rows = table(spark, folder, "documents").where("lang = 'en'")
    found = rows.select(F.col("doc_id").alias("id"), (F.lit(0.5) + F.when(F.col("n_chars") > 1000, 0.3).otherwise(0.0)).alias("score"))
    return search.merged(meaning, found, "id").select("id", F.round("score", 5).alias("score"))


@query("select doc_id from documents where contains(text, 'tion%') or contains(text, 'License')")
def text_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.where(F.col("text").contains("tion%") | F.col("text").contains("License")).select("doc_id")


@query("select p_partkey from part where contains(lower(p_name), 'blue b')")
def name_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.text_matches(table(spark, folder, "part"), "BLUE B", "p_name").select("p_partkey")


@query(r"""with q as (select conv_id, turn, 'iso' || (conv_id + 100) || ' 50mm f/2.8 9stars ' || (turn % 7) || '-5 3stars camera:X100 ' || text as q from conversations where role = 'user'),
  w as (select conv_id, turn, q, list_filter(string_split_regex(q, '\s+'), lambda x: x <> '') as words from q),
  k as (select *, list_filter(words, lambda x: not (regexp_full_match(lower(x), 'iso=?:?[0-9]{1,9}|f/?[0-9]+([.][0-9]+)?|[0-9]+mm|[1-5]stars?|[1-5]-[1-5]') or starts_with(lower(x), 'camera:') or starts_with(lower(x), 'lens:'))) as rest,
    list_filter(words, lambda x: regexp_full_match(lower(x), '[1-5]stars?|[1-5]-[1-5]'))[-1] as rated from w)
  select conv_id, turn, case when regexp_matches(lower(q), 'date|time|year|month') then 'DATE' else 'EXIF' end as kind, nullif(array_to_string(rest, ' '), '') as semantic,
    cast(regexp_extract(lower(list_filter(words, lambda x: regexp_full_match(lower(x), 'iso=?:?[0-9]{1,9}'))[-1]), '[0-9]+') as integer) as iso,
    cast(regexp_extract(list_filter(words, lambda x: regexp_full_match(lower(x), 'f/?[0-9]+([.][0-9]+)?'))[-1], '[0-9.]+') as double) as aperture,
    cast(regexp_extract(list_filter(words, lambda x: regexp_full_match(lower(x), '[0-9]+mm'))[-1], '[0-9]+') as double) as focal_length,
    cast(left(rated, 1) as integer) as rating_min, cast(case when contains(rated, '-') then right(rated, 1) else left(rated, 1) end as integer) as rating_max,
    substr(lower(list_filter(words, lambda x: starts_with(lower(x), 'camera:'))[-1]), 8) as camera,
    substr(lower(list_filter(words, lambda x: starts_with(lower(x), 'lens:'))[-1]), 6) as lens from k""")
def classify_query(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("iso"), F.col("conv_id") + 100, F.lit(" 50mm f/2.8 9stars "), (F.col("turn") % 7).cast("string"), F.lit("-5 3stars camera:X100 "), F.col("text")).alias("q"))
    return asked.select("conv_id", "turn", search.classified("q").alias("c"), search.query_kind(F.col("q")).alias("kind")).select("conv_id", "turn", "kind", "c.*")


@query("""select p_partkey, round(least(1.0, 0.5 + case when p_size = 10 then 0.3 else 0 end + case when p_retailprice > 1000 then 0.3 else 0 end + case when lower(p_brand) = 'brand#12' then 0.4 else 0 end), 4) as score
  from part""")
def filter_score(spark: SparkSession, folder: str) -> DataFrame:
    no = F.lit(False)
    score = scoring.filter_match(F.col("p_size") == 10, F.col("p_retailprice") > 1000, no, F.lower("p_brand") == "brand#12", no)
    return table(spark, folder, "part").select("p_partkey", F.round(score, 4).alias("score"))


# ---- ratings and text

RATING_SQL = """with r as (select event_id, (greatest(0.3::float, least(0.9::float, 1::float - (cast(floor(value * 100) as integer)::float / 6400::float))) * 0.5::float + 0.5::float * 0.7::float)::float as overall from events)"""


@query(RATING_SQL + """select event_id, round(overall::double, 5) as overall, cast(greatest(1, least(5, cast(trunc(overall * 5::float) as integer))) as integer) as stars,
  case when overall > 0.75::float then 'PICK' else 'NONE' end as flag from r""")
def heuristic_rating(spark: SparkSession, folder: str) -> DataFrame:
    iso = F.floor(F.col("value") * 100).cast("int")
    rows = table(spark, folder, "events").select("event_id", scoring.heuristic_overall(iso).alias("o"))
    return rows.select("event_id", F.round(F.col("o").cast("double"), 5).alias("overall"), scoring.stars(F.col("o")).alias("stars"), scoring.heuristic_flag(F.col("o")).alias("flag"))


@query(RATING_SQL + """, s as (select event_id, greatest(0::float, least(1::float, overall - 0.15::float * ((0.8::float - 0.5::float) * 2::float)))::float as o from r)
  select event_id, round(o::double, 5) as overall, case when o > 0.75::float - 0.1::float * ((0.8::float - 0.5::float) * 2::float) then 'PICK' when o < 0.3::float then 'REJECT' else 'NONE' end as flag from s""")
def strictness(spark: SparkSession, folder: str) -> DataFrame:
    iso = F.floor(F.col("value") * 100).cast("int")
    rows = table(spark, folder, "events").select("event_id", scoring.strict_overall(scoring.heuristic_overall(iso), 0.8).alias("o"))
    return rows.select("event_id", F.round(F.col("o").cast("double"), 5).alias("overall"), scoring.strict_flag(F.col("o"), 0.8).alias("flag"))


@query("""select conv_id, turn, array_to_string(list_slice(list_distinct_first, 1, 12), ',') as tags from (
  select conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) as list_distinct_first from (
    select conv_id, turn, list_filter(list_transform(string_split_regex(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), '[^\\w'']+'), lambda x: trim(lower(x), '''')),
      lambda x: length(x) > 2 and x not in ('a','an','the','of','and','with','in','on','at','is','are','to','for')) as w from conversations))""")
def tags_from_text(spark: SparkSession, folder: str) -> DataFrame:
    words = F.regexp_replace("text", "[^A-Za-z]+", " ")
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(text.tags_from_text(words), ",").alias("tags"))


@query("select event_id, cast(json_extract(props, '$.k') as integer) as k, greatest(0.0, least(1.0, cast(json_extract(props, '$.k') as double) / 10)) as unit from events")
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    k = F.from_json(text.loose_object(F.concat(F.lit("reply: "), F.col("props"), F.lit(" end"))), "k int")["k"]
    return table(spark, folder, "events").select("event_id", k.alias("k"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), k.cast("double") / 10)).alias("unit"))


@query("""select o_orderkey, case when n < 1024 then printf('%d B', n) when n < 1048576 then printf('%.1f KB', round(n / 1024, 1)) when n < 1073741824 then printf('%.1f MB', round(n / 1048576, 1)) else printf('%.2f GB', round(n / 1073741824, 2)) end as size,
  strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') as taken, left(sha256(o_orderkey::varchar), 24) as path_id
  from (select *, cast(case o_orderkey % 4 when 0 then floor(floor(o_totalprice) / 500) when 1 then floor(o_totalprice) when 2 then floor(o_totalprice) * 1000 + 1 else floor(o_totalprice) * 100000 + 1 end as bigint) as n from orders)""")
def formats(spark: SparkSession, folder: str) -> DataFrame:
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    whole, kind = F.floor("o_totalprice"), F.col("o_orderkey") % 4
    n = F.when(kind == 0, F.floor(whole / 500)).when(kind == 1, whole).when(kind == 2, whole * 1000 + 1).otherwise(whole * 100000 + 1)
    return table(spark, folder, "orders").select(
        "o_orderkey", text.bytes_text(n).alias("size"), text.capture_date(ms).alias("taken"), text.path_id(F.col("o_orderkey").cast("string")).alias("path_id")
    )


# ---- edit history

DELTA_SQL = "(select user_id, ts, event_id, event_type as field, json_extract_string(props, '$.k') as value from events)"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").select("user_id", "ts", "event_id", F.create_map("event_type", k).alias("delta"), "event_type")


@query(f"select user_id, field, arg_max(value, (ts, event_id)) as value from {DELTA_SQL} group by user_id, field")
def delta_fold(spark: SparkSession, folder: str) -> DataFrame:
    return history.folded(_log(spark, folder), "user_id", ["ts", "event_id"], "delta")


@query(f"""select user_id, field, arg_max(value, (ts, event_id)) as value from (select *, row_number() over (partition by user_id order by ts, event_id) as nth from {DELTA_SQL})
  where nth <= user_id % 10 + 3 group by user_id, field""")
def undo_prefix(spark: SparkSession, folder: str) -> DataFrame:
    kept = history.applied(_log(spark, folder), "user_id", ["ts", "event_id"], F.col("user_id") % 10 + 3)
    return history.folded(kept, "user_id", ["ts", "event_id"], "delta")


@query("""select user_id, coalesce(arg_min(event_id, (ts, event_id)) filter (event_type = 'purchase'), arg_max(event_id, (ts, event_id))) as event_id from events group by user_id""")
def active_version(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("active", F.col("event_type") == "purchase")
    return history.active_versions(rows, "user_id", "event_id", "ts", "active")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'X' end as status, case when o_orderkey % 5 = 0 then 'none' end as priority from orders where o_orderkey % 3 = 0 or o_orderkey % 5 = 0""")
def sparse_diff(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    old = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    new = F.create_map(F.lit("status"), F.when(key % 3 == 0, "X").otherwise(F.col("o_orderstatus")), F.lit("priority"), F.when(key % 5 == 0, "none").otherwise(F.col("o_orderpriority")))
    rows = table(spark, folder, "orders").select("o_orderkey", history.sparse_diff(old, new).alias("d")).where(F.size("d") > 0)
    return rows.select("o_orderkey", F.try_element_at("d", F.lit("status")).alias("status"), F.try_element_at("d", F.lit("priority")).alias("priority"))


@query("""select c_custkey as user_id, event_id, 'exposure' as field, '1' as value from customer join
  (select user_id, arg_max(event_id, (ts, event_id)) as event_id from events where event_type = 'view' group by 1) a on a.user_id = c_custkey""")
def batch_transfer(spark: SparkSession, folder: str) -> DataFrame:
    active = table(spark, folder, "events").where("event_type = 'view'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    targets = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    rows = history.batch_applied(targets, active, "user_id", "event_id", F.create_map(F.lit("exposure"), F.lit("1")), "Batch")
    return rows.select("user_id", "event_id", F.explode("delta").alias("field", "value"))


# the hash of a text's bytes, then level by level
MERKLE_SQL = """with recursive leaves as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as place, count(*) over (partition by user_id) as n, list_transform(string_split(props, ''), lambda c: cast(ord(c) as uhugeint)) as bytes from events),
  lanes as (select user_id, place, n, list_reduce(bytes, lambda a, b: (xor(a, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint, 14695981039346656037::uhugeint) as lo,
    list_reduce(bytes, lambda a, b: list_reduce([18397679294719823053::uhugeint, 14181476777654086739::uhugeint, 0::uhugeint], lambda m, p: case when p = 0 then xor(m, m // 8589934592) else (xor(m, m // 8589934592) * p) % 18446744073709551616::uhugeint end, xor(a, b)), 11400714819323198485::uhugeint) as hi from leaves),
  tree(user_id, place, n, hi, lo) as (select user_id, place, n, hi, lo from lanes union all
    select user_id, place // 2, (any_value(n) + 1) // 2, case when count(*) = 1 then min(hi) else xor(arg_min(hi, place), (arg_max(lo, place) + 9650029242287828579::uhugeint) % 18446744073709551616::uhugeint) end,
      case when count(*) = 1 then min(lo) else xor(arg_min(lo, place), (arg_max(hi, place) + 11400714819323198485::uhugeint) % 18446744073709551616::uhugeint) end from tree where n > 1 group by user_id, place // 2)
  select user_id, lower(lpad(to_hex(cast(hi as ubigint)), 16, '0') || lpad(to_hex(cast(lo as ubigint)), 16, '0')) as root from tree where n = 1"""


@query(MERKLE_SQL)
def merkle_hash(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_roots(table(spark, folder, "events"), "user_id", ["ts", "event_id"], F.col("props"))


# ---- images: the line items of an order are a row of pixels, 64 orders an image

PIXEL_SQL = """with px as (select l_orderkey // 64 as image_id, cast(l_orderkey % 64 as integer) as y, l_linenumber - 1 as x,
  min(l_quantity / 50) as r, min(l_extendedprice / 100000) as g, min(l_discount * 10) as b from lineitem group by 1, 2, 3)"""


def _pixels(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    key = F.col("l_orderkey")
    return items.groupBy(F.floor(key / 64).alias("image_id"), (key % 64).cast("int").alias("y"), (F.col("l_linenumber") - 1).alias("x")).agg(
        F.min(F.col("l_quantity") / 50).alias("r"), F.min(F.col("l_extendedprice") / 100000).alias("g"), F.min(F.col("l_discount") * 10).alias("b")
    )


def _rounded(df: DataFrame, places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in imaging.RGB})


@query(PIXEL_SQL + """select image_id, channel, cast(floor(greatest(0.0, least(1.0, v)) * 63 + 0.5) as integer) as bin, count(*) as n from (
  select image_id, unnest([0, 1, 2]) as channel, unnest([r, g, b]) as v from px where x % 2 = 0 and y % 2 = 0) group by 1, 2, 3""")
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return scopes.histogram(_pixels(spark, folder), 64, 2)


@query(PIXEL_SQL + """, h as (select image_id, channel, cast(floor(greatest(0.0, least(1.0, v)) * 63 + 0.5) as integer) as bin, count(*) as n from (
  select image_id, unnest([0, 1, 2]) as channel, unnest([r, g, b]) as v from px) group by 1, 2, 3),
  c as (select image_id, channel, sum(case when bin < 1 then n else 0 end) / sum(n) as low, sum(case when bin >= 63 then n else 0 end) / sum(n) as high from h group by 1, 2)
  select image_id, round(max(low), 5) as shadow_share, round(max(high), 5) as highlight_share, max(low) >= 0.02 as shadow_warning, max(high) >= 0.02 as highlight_warning from c group by 1""")
def clip_warning(spark: SparkSession, folder: str) -> DataFrame:
    out = scopes.clip_warning(scopes.histogram(_pixels(spark, folder), 64, 1), 64)
    return out.withColumn("shadow_share", F.round("shadow_share", 5)).withColumn("highlight_share", F.round("highlight_share", 5))


@query(PIXEL_SQL + """, w as (select image_id, max(x) + 1 as w from px group by 1), c as (select image_id, channel, cast(floor(x * 4 / w) as integer) as col, cast(floor((1.0 - greatest(0.0, least(1.0, v))) * 15) as integer) as row, count(*) as n
  from (select px.image_id, x, w, unnest([0, 1, 2]) as channel, unnest([r, g, b]) as v from px join w on w.image_id = px.image_id) group by 1, 2, 3, 4)
  select image_id, channel, col, row, n, round(n / max(n) over (partition by image_id), 5) as v from c""")
def waveform(spark: SparkSession, folder: str) -> DataFrame:
    return scopes.waveform(_pixels(spark, folder), 4, 16).withColumn("v", F.round("v", 5))


LUMA = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"


@query(PIXEL_SQL + f""", a as (select image_id, y, x, 0.18 + ((r + 0.5 / 17.52) - 0.18) * 1.2 as r, 0.18 + ((g + 0.5 / 17.52) - 0.18) * 1.2 as g, 0.18 + ((b + 0.5 / 17.52) - 0.18) * 1.2 as b from px),
  w as (select image_id, y, x, r / 0.9 as r, g / 0.9 as g, b / 0.9 as b from a), k as (select image_id, y, x, r - 0.1 * (1 - r) as r, g - 0.1 * (1 - g) as g, b - 0.1 * (1 - b) as b from w),
  t as (select image_id, y, x, r - 0.05 as r, g + 0.1 as g, b - 0.05 as b from k), s as (select image_id, y, x, {LUMA} as l, r, g, b from t)
  select image_id, y, x, round(l + (r - l) * 1.5, 8) as r, round(l + (g - l) * 1.5, 8) as g, round(l + (b - l) * 1.5, 8) as b from s""")
def image_point_ops(spark: SparkSession, folder: str) -> DataFrame:
    steps = {"exposure": {"value": 0.5}, "contrast": {"value": 0.2}, "white": {"value": 0.9}, "black": {"value": 0.1}, "tint": {"value": 10.0}, "saturation": {"value": 1.5}}
    return _rounded(imaging.develop(_pixels(spark, folder), steps))


@query(PIXEL_SQL + f""", s as (select image_id, y, x, r, g, b, case when {LUMA} < 0.5 then 0.2 * pow(cos(pi() / 2 * {LUMA} / 0.5), 2) else 0 end as d from px),
  s2 as (select image_id, y, x, r + d as r, g + d as g, b + d as b from s), h as (select *, case when {LUMA} > 0.5 then -0.1 * pow(({LUMA} - 0.5) / 0.5, 2) else 0 end as d from s2)
  select image_id, y, x, round(r + d, 8) as r, round(g + d, 8) as g, round(b + d, 8) as b from h""")
def shadows_highlights(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.develop(_pixels(spark, folder), {"shadows": {"value": 0.2}, "highlights": {"value": -0.1}}))


@query("""select l_orderkey, l_linenumber, round(case when v <= 0 then 0 when v < 0.5 then (3 * t * t - 2 * t * t * t) * 0.7 + (t * t * t - 2 * t * t + t) * 0.7 + (t * t * t - t * t) * 0.5
  when v < 1 then (2 * u * u * u - 3 * u * u + 1) * 0.7 + (u * u * u - 2 * u * u + u) * 0.5 + (3 * u * u - 2 * u * u * u) + (u * u * u - u * u) * 0.3 else 1 end, 5) as v
  from (select l_orderkey, l_linenumber, l_discount * 10 as v, l_discount * 10 / 0.5 as t, (l_discount * 10 - 0.5) / 0.5 as u from lineitem)""")
def tone_curve(spark: SparkSession, folder: str) -> DataFrame:
    v = imaging.curve_value(F.col("l_discount") * 10, [(0.0, 0.0), (0.5, 0.7), (1.0, 1.0)])
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(v, 5).alias("v"))


@query(PIXEL_SQL + """, a as (select *, sum(r) over w as sr, sum(g) over w as sg, sum(b) over w as sb, count(*) over w as n from px window w as (partition by image_id, y order by x range between 1 preceding and 1 following)),
  m as (select *, sum(sr) over w as tr, sum(sg) over w as tg, sum(sb) over w as tb, sum(n) over w as t from a window w as (partition by image_id, x order by y range between 1 preceding and 1 following))
  select image_id, y, x, round(case when t = 9 and abs(9 * r - tr) >= 0.05 then r + 0.5 * (9 * r - tr) else r end, 8) as r, round(case when t = 9 and abs(9 * g - tg) >= 0.05 then g + 0.5 * (9 * g - tg) else g end, 8) as g,
  round(case when t = 9 and abs(9 * b - tb) >= 0.05 then b + 0.5 * (9 * b - tb) else b end, 8) as b from m""")
def image_neighbour_ops(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.sharpen(_pixels(spark, folder), 0.5, 0.05))


@query(PIXEL_SQL + f""", l as (select *, {LUMA} as l from px), h as (select *, sum(l) over w as s, count(*) over w as n from l window w as (partition by image_id, y order by x range between 1 preceding and 1 following)),
  m as (select *, sum(s) over w / sum(n) over w as mean from h window w as (partition by image_id, x order by y range between 1 preceding and 1 following))
  select image_id, y, x, round(r * case when l > 1e-5 then 1 + 0.4 * (l - mean) / l else 1 end, 8) as r, round(g * case when l > 1e-5 then 1 + 0.4 * (l - mean) / l else 1 end, 8) as g, round(b * case when l > 1e-5 then 1 + 0.4 * (l - mean) / l else 1 end, 8) as b from m""")
def image_clarity(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.clarity(_pixels(spark, folder), 0.4, 1))


@query(PIXEL_SQL + """, c as (select image_id, y - 8 as y, x - 1 as x, r, g, b from px where y between 8 and 39 and x between 1 and 4), s as (select image_id, max(x) + 1 as w, max(y) + 1 as h from c group by 1)
  select c.image_id, ty as y, tx as x, round(sum(r) / max((least(w - 1, ceil((tx + 1) * w / 2.0)) - floor(tx * w / 2.0) + 1) * (least(h - 1, ceil((ty + 1) * h / 8.0)) - floor(ty * h / 8.0) + 1)), 8) as r,
    round(sum(g) / max((least(w - 1, ceil((tx + 1) * w / 2.0)) - floor(tx * w / 2.0) + 1) * (least(h - 1, ceil((ty + 1) * h / 8.0)) - floor(ty * h / 8.0) + 1)), 8) as g,
    round(sum(b) / max((least(w - 1, ceil((tx + 1) * w / 2.0)) - floor(tx * w / 2.0) + 1) * (least(h - 1, ceil((ty + 1) * h / 8.0)) - floor(ty * h / 8.0) + 1)), 8) as b
  from c join s on s.image_id = c.image_id, (select cast(unnest(range(8)) as integer) as ty), (select cast(unnest(range(2)) as integer) as tx)
  where x between floor(tx * w / 2.0) and least(w - 1, ceil((tx + 1) * w / 2.0)) and y between floor(ty * h / 8.0) and least(h - 1, ceil((ty + 1) * h / 8.0)) group by 1, 2, 3""")
def resize_crop(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.resize(imaging.crop(_pixels(spark, folder), 1, 8, 4, 32), 2, 8, "area"))


@query(PIXEL_SQL + """, s as (select image_id, max(x) + 1 as w, max(y) + 1 as h from px group by 1) select px.image_id, x as y, h - 1 - y as x, round(r, 8) as r, round(g, 8) as g, round(b, 8) as b from px join s on s.image_id = px.image_id""")
def image_rotate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.rotate(_pixels(spark, folder), 90))


@query(PIXEL_SQL + f""", s as (select image_id, avg({LUMA}) as mean, stddev_pop({LUMA}) as dev from px group by 1) select image_id, round(mean, 5) as mean, round(dev, 5) as deviation,
  cast(greatest(1, least(5, 3 + case when abs(mean - 0.18) < 0.06 then 1 when abs(mean - 0.18) > 0.3 then -1 else 0 end + case when dev > 0.2 then 1 when dev < 0.03 then -1 else 0 end)) as integer) as rating from s""")
def luma_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = scopes.luma_stats(_pixels(spark, folder))
    rating, _ = scoring.rubric(F.col("mean"), F.col("deviation"), F.lit(0.1))
    return stats.select("image_id", F.round("mean", 5).alias("mean"), F.round("deviation", 5).alias("deviation"), rating.alias("rating"))


# ---- streams


@query("""with g as (select user_id, ts, event_id, value, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
  s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as burst from g)
  select user_id, min(ts) as begin, max(ts) as at, round(arg_max(value, ts), 4) as value, count(*) as n from s group by user_id, burst""")
def debounce_latest(spark: SparkSession, folder: str) -> DataFrame:
    out = live.debounced(table(spark, folder, "events"), "user_id", "ts", "value", "6 hours")
    return out.select("user_id", "begin", "at", F.round("value", 4).alias("value"), "n")


@query("""with s as (select user_id, min(ts) as first, arg_max(ts, ts) as last, cast(arg_max(event_id, ts) % 50 as integer) as completed from events group by 1)
  select user_id, completed, case when completed > 0 and 50 - completed > 0 then round(epoch_us(last) / 1e6 - epoch_us(first) / 1e6, 0) end as elapsed from s""")
def task_progress(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("completed", (F.col("event_id") % 50).cast("int")).withColumn("total", F.lit(50))
    out = live.progress(rows, "user_id", "ts", "completed", "total")
    return out.select("user_id", "completed", F.round(F.col("eta") * F.col("completed") / (50 - F.col("completed")), 0).alias("elapsed"))


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts from events group by user_id")
def stream_latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    latest = live.latest_by_key(stream, "user_id", "ts", "event_id")
    return live.run_once(latest).select("user_id", "event_id", "ts")
