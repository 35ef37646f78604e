"""Queries of the album: an images table with the catalogue's columns made of the driver's tables, filters, sorts, joins, versions and text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.functions import colour, paths, text
from heliograph.operators import catalog, history, search, tree
from heliograph.operators.filters import CatalogFilter, Condition, Node, dispatch, from_json, interpreted, to_json
from heliograph.plans.queries import TREE_SQL, _tree, query
from heliograph.sources.shared import as_view
from heliograph.sources import tables
from heliograph.sources.tables import image_type, is_raw, is_supported, table

EXTENSIONS = ("jpg", "NEF", "dng", "png", "txt")
IMAGES_SQL = """with images as (select cast(p_partkey as varchar) as id, '/album/' || p_brand || '/' || replace(p_name, '#', '') || '.' || ['jpg', 'NEF', 'dng', 'png', 'txt'][p_partkey % 5 + 1] as sleevePath,
  replace(p_name, '#', '') || '.' || ['jpg', 'NEF', 'dng', 'png', 'txt'][p_partkey % 5 + 1] as displayName, ['jpg', 'NEF', 'dng', 'png', 'txt'][p_partkey % 5 + 1] as fileExtension,
  cast(p_size * 100000 + p_partkey as bigint) as fileSizeBytes, cast(946684800000 + p_partkey * 86400000 as bigint) as dateCapturedEpoch, cast(1700000000000 - p_partkey as bigint) as dateAddedEpoch,
  cast(p_size % 6 as integer) as rating, ['NONE', 'PICK', 'REJECT'][p_size % 3 + 1] as flag, ['NONE', 'RED', 'GREEN', 'BLUE'][p_partkey % 4 + 1] as colorLabel, p_size % 11 = 0 as isHidden,
  case when p_size % 4 > 0 then lower(p_type) || ' seen' end as aiCaption, case when p_size % 3 > 0 then p_brand || chr(1) || lower(p_type) end as aiTags, case when p_size % 5 > 0 then p_size / 50.0 end as aiScore,
  p_brand as cameraModel, case when p_size % 2 = 0 then p_type end as lensModel, case when p_size % 7 > 0 then p_size * 1.5 end as focalLength, case when p_size % 6 > 0 then cast(p_size * 100 as integer) end as iso,
  case when p_size % 8 > 0 then p_size / 4.0 end as aperture from part)"""


def _images(spark: SparkSession, folder: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    one_of = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (n + 1).cast("int"))
    extension = one_of(EXTENSIONS, key % 5)
    name = F.concat(F.regexp_replace("p_name", "#", ""), F.lit("."), extension)
    return table(spark, folder, "part").select(
        key.cast("string").alias("id"), F.concat(F.lit("/album/"), "p_brand", F.lit("/"), name).alias("sleevePath"), name.alias("displayName"), extension.alias("fileExtension"),
        (size * 100000 + key).cast("long").alias("fileSizeBytes"), (F.lit(946684800000) + key * F.lit(86400000)).cast("long").alias("dateCapturedEpoch"), (F.lit(1700000000000) - key).cast("long").alias("dateAddedEpoch"),
        (size % 6).cast("int").alias("rating"), one_of(("NONE", "PICK", "REJECT"), size % 3).alias("flag"), one_of(("NONE", "RED", "GREEN", "BLUE"), key % 4).alias("colorLabel"), (size % 11 == 0).alias("isHidden"),
        F.when(size % 4 > 0, F.concat(F.lower("p_type"), F.lit(" seen"))).alias("aiCaption"), F.when(size % 3 > 0, F.concat("p_brand", F.lit(text.TAG_MARK), F.lower("p_type"))).alias("aiTags"),
        F.when(size % 5 > 0, size / 50.0).alias("aiScore"), F.col("p_brand").alias("cameraModel"), F.when(size % 2 == 0, F.col("p_type")).alias("lensModel"), F.when(size % 7 > 0, size * 1.5).alias("focalLength"),
        F.when(size % 6 > 0, (size * 100).cast("int")).alias("iso"), F.when(size % 8 > 0, size / 4.0).alias("aperture"),
    )


# ---- filters and pages


@query(IMAGES_SQL + """select id, displayName, rating from images where not coalesce(isHidden, false) and rating >= 1 and rating <= 4 and (contains(lower(displayName), 'bolt') or contains(lower(aiCaption), 'bolt'))
  and flag in ('PICK', 'REJECT') and lower(fileExtension) in ('nef', 'jpg') and len(list_intersect(string_split(coalesce(aiTags, ''), chr(1)), ['Brand#12', 'economy', 'small', 'large'])) > 0
  and dateCapturedEpoch between 946684800000 and 1200000000000 order by rating desc, id limit 60 offset 1""")
def catalog_filter_page(spark: SparkSession, folder: str) -> DataFrame:
    wanted = CatalogFilter(
        text=" BOLT ", rating_min=1, rating_max=4, flags=["PICK", "REJECT"], extensions=["NEF", "jpg"], any_tag=["Brand#12", "economy", "small", "large"], date_from=946684800000, date_to=1200000000000
    )
    return catalog.page(_images(spark, folder), wanted.column(), "rating", False, "id", 60, 1).select("id", "displayName", "rating")


@query(IMAGES_SQL + """select id from images where regexp_replace(sleevePath, '/[^/]*$', '') = '/album/Brand#12' and colorLabel in ('RED', 'BLUE', 'GREEN') and iso >= 100 and iso <= 4500 and aperture >= 0.5
  and aperture <= 12.0 and focalLength >= 2 and focalLength <= 74 and lower(cameraModel) = 'brand#12'""")
def catalog_filter_exif(spark: SparkSession, folder: str) -> DataFrame:
    wanted = CatalogFilter(
        folder="/album//Brand#12/", labels=["RED", "BLUE", "GREEN"], iso=(100, 4500), aperture=(0.5, 12.0), focal_length=(2.0, 74.0), camera="BRAND#12", include_hidden=True
    )
    return _images(spark, folder).where(wanted.column()).select("id")


SORTS_SQL = " union all ".join(
    f"(select '{name}' as field, id, row_number() over (order by {column} {way}, id) as place from images qualify place <= 25)"
    for name, column, way in (
        ("date_captured", "dateCapturedEpoch", "desc"), ("date_added", "dateAddedEpoch", "desc"), ("name", "lower(displayName)", "asc"), ("rating", "rating", "desc"), ("file_size", "fileSizeBytes", "desc"),
        ("ai_score", "coalesce(aiScore, -1)", "asc"), ("focal_length", "coalesce(focalLength, 0)", "asc"), ("iso", "coalesce(iso, 0)", "asc"), ("aperture", "coalesce(aperture, 0)", "asc"),
    )
)


@query(IMAGES_SQL + SORTS_SQL)
def sort_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of each of the nine orders, those of dates, rating and size descending."""
    images, pages = _images(spark, folder), []
    for name in catalog.SORT_FIELDS:
        first = catalog.first_page(images, name, name not in ("date_captured", "date_added", "rating", "file_size"), "id", 25, "place")
        pages.append(first.select(F.lit(name).alias("field"), "id", "place"))
    return reduce(DataFrame.unionByName, pages)


@query(IMAGES_SQL + """select id, sleevePath, displayName, fileExtension, list_filter(string_split(coalesce(aiTags, ''), chr(1)), lambda t: t <> '') as tags, round(aiScore, 4) as aiScore, isHidden, iso from images""")
def entity_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as the album shows them: tags as a list."""
    return _images(spark, folder).select("id", "sleevePath", "displayName", "fileExtension", text.tags_split(F.col("aiTags")).alias("tags"), F.round("aiScore", 4).alias("aiScore"), "isHidden", "iso")


@query(IMAGES_SQL + "select id, displayName, flag from images where id = '77'")
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.lookup(_images(spark, folder), "id", "77").select("id", "displayName", "flag")


@query(IMAGES_SQL + """select flag, count(*) as n, sum(fileSizeBytes) as bytes, max(dateAddedEpoch) as newest, count(*) filter (contains(lower(aiCaption), 'economy')) as matches from images
  where flag in ('PICK', 'REJECT') group by flag""")
def status_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = _images(spark, folder).where(F.col("flag").isin("PICK", "REJECT"))
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.sum("fileSizeBytes").alias("bytes"), F.max("dateAddedEpoch").alias("newest"), F.count_if(F.lower("aiCaption").contains("economy")).alias("matches"))


@query(IMAGES_SQL + "select id from images where not coalesce(flag = 'REJECT' and rating < 3, false)")
def delete_rows(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.deleted(_images(spark, folder), (F.col("flag") == "REJECT") & (F.col("rating") < 3)).select("id")


@query(IMAGES_SQL + """select id, case lower(regexp_extract(displayName, '[.]([^.]+)$', 1)) when 'nef' then 'RAW' when 'dng' then 'RAW' when 'jpg' then 'JPEG' when 'png' then 'PNG' else 'UNKNOWN' end as type,
  lower(fileExtension) in ('nef', 'dng') as raw, lower(fileExtension) <> 'txt' as supported from images""")
def file_types(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("displayName")
    return _images(spark, folder).select("id", F.coalesce(image_type(name), F.lit("UNKNOWN")).alias("type"), is_raw(name).alias("raw"), is_supported(name).alias("supported"))


@query(IMAGES_SQL + "select id from images where (rating >= 4 or cameraModel = 'Brand#12') and not (flag = 'REJECT' or contains(lower(displayName), 'blue'))")
def filter_json(spark: SparkSession, folder: str) -> DataFrame:
    """A filter tree through its JSON form, by the catalogue's names of fields."""
    tree_ = Node("and", (Node("or", (Condition("rating", "ge", 4), Condition("camera", "eq", "Brand#12"))), Node("not", (Condition("flag", "eq", "REJECT"), Condition("name", "contains", "blue")))))
    from heliograph.operators.filters import FIELDS

    return _images(spark, folder).where(from_json(to_json(tree_)).column(FIELDS)).select("id")


@query(IMAGES_SQL + "select id from images where isHidden or (contains(displayName, 'bolt') and rating > 2)")
def filter_interpreted(spark: SparkSession, folder: str) -> DataFrame:
    """The interpreter: conditions on fields that are not at hand hold, as all do for folders (hidden rows here)."""
    tree_ = Node("and", (Condition("displayName", "contains", "bolt"), Condition("rating", "gt", 2), Condition("lens", "eq", "none")))
    return _images(spark, folder).where(interpreted(tree_, {"displayName", "rating"}, F.col("isHidden"))).select("id")


@query(IMAGES_SQL + "select id from images where cameraModel = 'Brand#13' and rating >= 3")
def filter_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    request = '{"folder": "Brand#13", "filter": {"field": "rating", "op": "ge", "value": 3}}'
    return dispatch(_images(spark, folder), request, "displayName", "cameraModel").select("id")


# ---- joins and tree


@query(TREE_SQL + """, c as (select coalesce(nullif(regexp_replace(path, '/[^/]*$', ''), ''), '/') as parent, list_last(string_split(path, '/')) as name, is_folder from t where path <> '/')
  select parent, string_agg(name, '|' order by is_folder desc, name) as names from c group by parent""")
def children_by_parent(spark: SparkSession, folder: str) -> DataFrame:
    return tree.children_by_parent(_tree(spark, folder)).select("parent", F.array_join(F.transform("children", lambda c: c["name"]), "|").alias("names"))


@query("select n.n_nationkey as id, r.r_name as parent, n.n_name as name from nation n join region r on n.n_regionkey = r.r_regionkey where r.r_name = 'ASIA'")
def child_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Children by the id of their parent, not by path."""
    region, nation = table(spark, folder, "region").where("r_name = 'ASIA'"), table(spark, folder, "nation")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("parent"), F.col("n_name").alias("name"))


@query("""select o_orderkey as element, c.c_custkey as image, c.c_name as name from orders left join customer c on c.c_custkey = o_custkey and c.c_acctbal > 0""")
def file_image_links(spark: SparkSession, folder: str) -> DataFrame:
    """Elements with the image they link to; links to nothing stay, without one."""
    images = table(spark, folder, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return orders.join(images, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("element"), F.col("c_custkey").alias("image"), F.col("c_name").alias("name"))


@query("select path, is_folder from (" + TREE_SQL.replace("with t as (", "select * from (") + ") union all select '/ASIA/new', true")
def tree_create(spark: SparkSession, folder: str) -> DataFrame:
    """A folder made below one that is there; one below nothing and one that is there already change nothing."""
    rows = _tree(spark, folder)
    for path in ("/ASIA/new", "/nowhere/new", "/ASIA"):
        rows = tree.created(rows, path, True)
    return rows


@query("select path, is_folder from (" + TREE_SQL.replace("with t as (", "select * from (") + ") union all select '/EUROPE_copy', true")
def tree_duplicate(spark: SparkSession, folder: str) -> DataFrame:
    return tree.duplicated(_tree(spark, folder), "/EUROPE")


@query("""select c_custkey as id, count(o_orderkey) as ref_count, c_mktsegment = 'BUILDING' and count(o_orderkey) = 0 as garbage from customer left join orders on o_custkey = c_custkey group by 1, c_mktsegment""")
def reference_counts(spark: SparkSession, folder: str) -> DataFrame:
    elements = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "DELETED").otherwise("SYNCED").alias("flag"))
    links = table(spark, folder, "orders").select(F.col("o_custkey").alias("element_id"))
    gone = tree.garbage(elements, links).select("id", F.lit(True).alias("garbage"))
    counted = elements.join(tree.reference_counts(links).withColumnRenamed("element_id", "id"), "id", "left").join(gone, "id", "left")
    return counted.select("id", F.coalesce("ref_count", F.lit(0)).alias("ref_count"), F.coalesce("garbage", F.lit(False)).alias("garbage"))


@query(IMAGES_SQL + r"""select id, '/' || array_to_string(list_filter(string_split('//album///' || cameraModel || '/', '/'), lambda p: p <> ''), '/') as path, case when starts_with(sleevePath, '/album/Brand#12/') then substr(sleevePath, 17) end as relative,
  list_last(string_split(sleevePath, '/')) as name, starts_with(sleevePath, '/album/') as below from images""")
def path_algebra(spark: SparkSession, folder: str) -> DataFrame:
    own = F.col("sleevePath")
    return _images(spark, folder).select(
        "id", paths.normalised(F.concat(F.lit(" //album///"), "cameraModel", F.lit("/ "))).alias("path"), paths.relative(F.lit("/album/Brand#12"), own).alias("relative"), paths.name(own).alias("name"),
        paths.is_below(F.lit("/album"), own).alias("below"),
    )


# ---- versions and history


@query("""select user_id, event_id, event_id = coalesce(c, a) as active from (select *, max(case when event_type = 'purchase' then event_id end) over (partition by user_id) as c,
  max(event_id) filter (event_type <> 'purchase') over (partition by user_id) as a from events) where c is not null union all
  select user_id, event_id, event_type = 'view' from events where user_id not in (select user_id from events where event_type = 'purchase')""")
def activate_version(spark: SparkSession, folder: str) -> DataFrame:
    """One version made the active one of each user who has a purchase; others stay."""
    rows = table(spark, folder, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("active"), "event_type")
    chosen = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return history.activated(rows, "user_id", "event_id", "active", chosen).select("user_id", "event_id", "active")


@query("""with l as (select *, row_number() over (partition by user_id order by ts, event_id) as nth from events where user_id is not null), k as (select user_id, event_id from l where nth <= 5 or user_id % 2 = 1)
  select user_id, event_id from k union all select distinct user_id, cast(-1 as bigint) from l where user_id % 2 = 0""")
def append_after_undo(spark: SparkSession, folder: str) -> DataFrame:
    """New rows for even users cut off what their cursor (5) has undone; odd users have a cursor too, but get no row."""
    log = table(spark, folder, "events").where("user_id is not null").select("user_id", "ts", F.col("event_id").cast("long").alias("event_id"))
    users = log.select("user_id").distinct()
    new = users.where("user_id % 2 = 0").select("user_id", F.lit(None).cast(log.schema["ts"].dataType).alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    return history.appended(log, new, "user_id", ["ts", "event_id"], users.withColumn("cursor", F.lit(5))).select("user_id", "event_id")


@query("""with d as (select user_id, event_type as field, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) as value from events where event_type <> 'view' group by 1, 2),
  b as (select distinct user_id, unnest(['view', 'click']) as field, '-1' as value from events)
  select user_id, field, value from d union all select user_id, field, value from b where not exists (select 1 from d where d.user_id = b.user_id and d.field = b.field)""")
def fold_over_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Deltas over a snapshot: its fields hold where no delta sets them."""
    events = table(spark, folder, "events")
    log = events.where("event_type <> 'view'").select("user_id", "ts", "event_id", F.create_map("event_type", F.get_json_object("props", "$.k")).alias("delta"))
    base = events.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit("view"), F.lit("click"))).alias("field"), F.lit("-1").alias("value"))
    return history.folded(log, "user_id", ["ts", "event_id"], "delta", base)


@query("""select user_id, event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0) as exposure, 1.0 as contrast, cast(0 as double) as tint from events""")
def numeric_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The compatible fold: known fields as numbers, defaults where one is missing or no number."""
    state = F.create_map(F.lit("exposure"), F.get_json_object("props", "$.k"), F.lit("contrast"), F.lit("no number"))
    fields = history.numeric_fields(state, {"exposure": 0.0, "contrast": 1.0, "tint": 0.0})
    return table(spark, folder, "events").select("user_id", "event_id", *(c.alias(name) for name, c in fields.items()))


@query("""with recursive v as (select event_id as id, lag(event_id) over (partition by user_id order by event_id) as parent_id from events), up(id, parent_id, step) as (
  select id, parent_id, 0 from v where id = (select max(event_id) from events) union all select v.id, v.parent_id, step + 1 from v join up on v.id = up.parent_id) select id, step from up""")
def version_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_id")
    parent = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("parent_id")
    return history.ancestors(spark, as_view(events.select(F.col("event_id").alias("id"), parent)), events.agg(F.max("event_id")).first()[0])


@query("select event_id + 1000000 as event_id, case when user_id >= 10 then user_id + 1000000 else user_id end as parent from events")
def clone_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A log under new ids; parents outside the clone keep theirs."""
    log = table(spark, folder, "events").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("parent"))
    # the log's events and their parents are cloned; parents below 10, put at negative ids, are others' and not among them
    old = log.select(F.col("event_id").alias("old_id")).union(log.select(F.col("parent").alias("old_id"))).distinct()
    ids = old.withColumn("new_id", F.col("old_id") + 1000000)
    rows = history.cloned(log.withColumn("parent", F.when(F.col("parent") >= 10, F.col("parent")).otherwise(-F.col("parent") - 1)), ids, "event_id", "parent")
    return rows.withColumn("parent", F.when(F.col("parent") < 0, -F.col("parent") - 1).otherwise(F.col("parent")))


@query("""select c_custkey, array_to_string(list_sort(case when list_contains(s, c_mktsegment) then list_filter(s, lambda x: x <> c_mktsegment) else list_append(s, c_mktsegment) end), ',') as selection
  from (select c_custkey, c_mktsegment, ['BUILDING', 'MACHINERY'] as s from customer)""")
def toggle_selection(spark: SparkSession, folder: str) -> DataFrame:
    chosen = F.array(F.lit("BUILDING"), F.lit("MACHINERY"))
    return table(spark, folder, "customer").select("c_custkey", F.array_join(F.array_sort(catalog.toggled(chosen, F.col("c_mktsegment"))), ",").alias("selection"))


@query("""select c_custkey, 'new' as a, '2' as b, case when c_mktsegment = 'BUILDING' then '3' end as c from customer""")
def map_merge(spark: SparkSession, folder: str) -> DataFrame:
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    delta = F.when(F.col("c_mktsegment") == "BUILDING", F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("3"))).otherwise(F.create_map(F.lit("a"), F.lit("new")))
    got = table(spark, folder, "customer").select("c_custkey", history.merged(old, delta).alias("m"))
    return got.select("c_custkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"))


# ---- text and search


@query("""select doc_id, turnkind as kind from (select doc_id, case when coalesce(lower(text), '') = '' then 'UNKNOWN' when regexp_matches(lower(text), 'date|time|year|month') then 'DATE'
  when regexp_matches(lower(text), 'camera|lens|iso|aperture|focal|shutter') then 'EXIF' when regexp_matches(lower(text), 'rating|star|rated') then 'RATING'
  when regexp_matches(lower(text), 'tag:|semantic:|label:') then 'SEMANTIC' else 'TEXT' end as turnkind from documents)""")
def query_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", search.query_kind(F.col("text")).alias("kind"))


@query(IMAGES_SQL + """select id, list_slice(list_filter(string_split_regex(lower(regexp_replace(displayName, '[.][^.]*$', '')), '[_ -]+'), lambda w: length(w) > 2), 1, 6) as tags,
  case when iso is not null and iso % 400 > 0 then round(cast(iso as double) / (iso % 400), 1) end as aperture,
  case when iso is null then null when iso < 1000 then '1/' || cast(round(1000.0 / iso) as integer) else printf('%.1fs', iso / 1000.0) end as shutter, concat_ws(' · ', cameraModel, lensModel, cast(iso as varchar)) as summary,
  'x-' || displayName || '-2024' as export from images""")
def text_formats(spark: SparkSession, folder: str) -> DataFrame:
    iso = F.col("iso")
    return _images(spark, folder).select(
        "id", text.tags_from_name(F.col("displayName")).alias("tags"), text.aperture(iso.cast("double"), iso % 400).alias("aperture"), text.shutter(iso / 1000.0).alias("shutter"),
        text.summary_line(F.col("cameraModel"), F.col("lensModel"), iso.cast("string")).alias("summary"), text.export_name(F.lit("x-{name}-{date}"), F.col("displayName"), F.lit("2024")).alias("export"),
    )


LINEAR = "case when {c} <= 0.04045 then {c} / 12.92 else pow(({c} + 0.055) / 1.055, 2.4) end"


@query(f"""with v as (select event_id, (value % 1.0 + 1.0) % 1.0 as r, (value * 3 % 1.0 + 1.0) % 1.0 as g, (value * 7 % 1.0 + 1.0) % 1.0 as b from events),
  l as (select event_id, {LINEAR.format(c='r')} as r, {LINEAR.format(c='g')} as g, {LINEAR.format(c='b')} as b from v)
  select event_id, round(case when r <= 0.0031308 then 12.92 * r else 1.055 * pow(r, 1 / 2.4) - 0.055 end, 6) as r, round(r, 6) as linear from l""")
def srgb_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value")
    r = F.pmod(value, F.lit(1.0))
    linear = colour.to_linear(r)
    return table(spark, folder, "events").select("event_id", F.round(colour.to_srgb(linear), 6).alias("r"), F.round(linear, 6).alias("linear"))


@query("""with v as (select user_id, event_id, 'n' || event_type as name, event_type = 'view' as active from events), r as (select distinct user_id from events where user_id % 2 = 0),
  n as (select v.user_id, count(*) as n from v join r on v.user_id = r.user_id group by 1)
  select user_id, event_id, name, case when user_id % 2 = 0 then false else active end as active from v union all
  select user_id, cast(-1 as bigint), case when user_id % 4 = 0 then 'Version ' || n else 'mine' end, true from n""")
def create_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A new active version for every even user, named by its number where no name is given."""
    events = table(spark, folder, "events").where("user_id is not null")
    versions = events.select("user_id", F.col("event_id").cast("long").alias("event_id"), F.concat(F.lit("n"), "event_type").alias("name"), (F.col("event_type") == "view").alias("active"))
    asked = events.where("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("event_id"), F.when(F.col("user_id") % 4 == 0, " ").otherwise("mine").alias("name"))
    return history.created_versions(versions, asked, "user_id", "event_id", "name", "active").select("user_id", "event_id", "name", "active")


@query("select event_id, case when event_id = 5 then 'renamed' else event_type end as name from events")
def rename_version(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", F.col("event_type").alias("name"))
    return history.renamed_version(rows, "event_id", 5, "name", "renamed")


@query("""select o_orderkey, '{"operators":[{"type":1,"params":"a' || o_orderkey || '"}' || case when o_orderkey % 2 = 0 then ',{"type":2,"params":"new"}' else ',{"type":2,"params":"old"}' end
  || case when o_orderkey % 2 = 0 then ',{"type":7,"params":"c"}' else '' end || ']}' as params from orders""")
def merge_params(spark: SparkSession, folder: str) -> DataFrame:
    """A stage's parameters out of JSON, with changes put over them, as JSON."""
    key = F.col("o_orderkey")
    own = F.concat(F.lit('{"stage": 3, "operators": [{"type": 2, "params": "old"}, {"type": 1, "params": "a'), key, F.lit('"}]}'))
    changes = F.when(key % 2 == 0, '{"operators": [{"type": 7, "params": "c"}, {"type": 2, "params": "new"}]}').when(key % 3 == 0, "no json").otherwise('{"operators": []}')
    return table(spark, folder, "orders").select("o_orderkey", history.merged_stage(own, changes).alias("params"))


ITEM_COLUMNS = [part.split()[0] for part in tables.IMAGES.split(",")]
MISSING = [c for c in ITEM_COLUMNS if c not in ("id", "sleevePath", "displayName", "fileExtension", "fileSizeBytes", "dateCapturedEpoch", "dateAddedEpoch", "rating", "flag", "colorLabel", "isHidden", "aiCaption", "aiTags", "aiScore", "cameraModel", "lensModel", "focalLength", "iso", "aperture")]


@query(IMAGES_SQL + " select id, sleevePath, displayName, fileExtension, fileSizeBytes, dateCapturedEpoch, dateAddedEpoch, rating, flag, colorLabel, isHidden, aiCaption, case when aiTags is not null then list_filter(string_split(aiTags, chr(1)), lambda t: t <> '') else [] end as aiTags,"
  " round(cast(cast(aiScore as real) as double), 6) as aiScore, cameraModel, lensModel, round(cast(cast(focalLength as real) as double), 6) as focalLength, iso, round(cast(cast(aperture as real) as double), 6) as aperture, aiTags as stored, " + ", ".join(f"null as {c}" for c in MISSING) + " from images")  # fmt: skip
def entity_columns(spark: SparkSession, folder: str) -> DataFrame:
    """All 28 columns of stored rows as items, and the tags as they are stored again."""
    items = catalog.to_items(_images(spark, folder))
    stored = catalog.to_entities(items).select("id", F.col("aiTags").alias("stored"))
    rounded = items.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("aiScore", "focalLength", "aperture")})
    return rounded.join(stored, "id").withColumn("aiTags", F.coalesce("aiTags", F.array().cast("array<string>")))


@query(IMAGES_SQL + """ select id, row_number() over (order by dateCapturedEpoch desc, id) as place from images where starts_with(sleevePath, '/album/Brand#13/')""")
def folder_by_date(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.numbered(catalog.folder_images(_images(spark, folder), "/album/Brand#13").select("id"), "place")


@query("select event_id, cast(json_extract(props, '$.k') as integer) as k from events where event_id = 123")
def stored_payload(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.payload(table(spark, folder, "events"), "event_id", 123, "props", "k int").select("event_id", "payload.k")
