"""Catalogue queries: pages, counts, distinct values, and changes as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import paths
from heliograph.functions.text import tags_joined, tags_split
from heliograph.sources.shared import written
from heliograph.sources.tables import IMAGES


def ordered(df: DataFrame, by: str | Column, ascending: bool, key: str, null_as: object = None, fold_case: bool = False) -> DataFrame:
    """Rows in order of ``by``, nulls as ``null_as`` (else as the least), and of ``key``, so that the order is total."""
    return df.orderBy(*_order(by, ascending, key, null_as, fold_case))


def _order(by: str | Column, ascending: bool, key: str, null_as: object = None, fold_case: bool = False) -> list[Column]:
    column = F.col(by) if isinstance(by, str) else by
    if fold_case:
        column = F.lower(column)
    if null_as is not None:
        column = F.coalesce(column, F.lit(null_as))
    return [column.asc_nulls_first() if ascending else column.desc_nulls_last(), F.col(key).asc()]


#: The orders that an album offers: a column, what stands for null, and whether case is folded.
SORT_FIELDS: dict[str, tuple[str, object, bool]] = {
    "date_captured": ("dateCapturedEpoch", None, False), "date_added": ("dateAddedEpoch", None, False), "name": ("displayName", None, True), "rating": ("rating", None, False),
    "file_size": ("fileSizeBytes", None, False), "ai_score": ("aiScore", -1.0, False), "focal_length": ("focalLength", 0.0, False), "iso": ("iso", 0, False), "aperture": ("aperture", 0.0, False),
}


def sorted_by(df: DataFrame, field: str, ascending: bool, key: str) -> DataFrame:
    """Rows in one of the orders of :data:`SORT_FIELDS`."""
    if field not in SORT_FIELDS:
        raise ValueError(f"unknown order {field}")
    column, null_as, fold_case = SORT_FIELDS[field]
    return ordered(df, column, ascending, key, null_as, fold_case)


def first_page(df: DataFrame, field: str, ascending: bool, key: str, limit: int, place: str) -> DataFrame:
    """The first ``limit`` rows in one of the orders of :data:`SORT_FIELDS` with their places from 1, which are worked out over these rows alone."""
    column, null_as, fold_case = SORT_FIELDS[field]
    order = _order(column, ascending, key, null_as, fold_case)
    return df.orderBy(*order).limit(limit).withColumn(place, F.row_number().over(Window.orderBy(*order)).cast("long"))


def folder_images(images: DataFrame, folder: str, path_col: str = "sleevePath", captured: str = "dateCapturedEpoch", added: str = "dateAddedEpoch", key: str = "id") -> DataFrame:
    """The images directly in a folder, the last captured first; without a capture date the date added counts."""
    own = images.where(paths.parent(F.col(path_col)) == F.lit(folder))
    return own.orderBy(F.coalesce(captured, added).desc_nulls_last(), F.col(key))


def to_items(entities: DataFrame) -> DataFrame:
    """Stored rows as the album works with them: all columns of the schema, tags as a list.  Columns that are missing are null."""
    names = [part.split()[0] for part in IMAGES.split(",")]
    there = set(entities.columns)
    kinds = dict(part.split()[:2] for part in IMAGES.split(","))
    column = lambda n: F.col(n).cast(kinds[n]) if n in there else F.lit(None).cast(kinds[n])
    return entities.select(*(tags_split(column(n)).alias(n) if n == "aiTags" else column(n).alias(n) for n in names))


def to_entities(items: DataFrame) -> DataFrame:
    """Items as stored rows: the list of tags as one text, null if it is empty."""
    text = F.when(F.size("aiTags") > 0, tags_joined(F.col("aiTags")))
    return items.withColumn("aiTags", text)


def payload(rows: DataFrame, key: str, value: object, column: str, schema: str) -> DataFrame:
    """The JSON payload that is stored under a key, parsed by a schema; a payload that is no such JSON gives null."""
    return rows.where(F.col(key) == F.lit(value)).select(F.col(key), F.from_json(F.col(column), schema).alias("payload"))


def page(df: DataFrame, predicate: Column, by: str | Column, ascending: bool, key: str, limit: int, offset: int = 0) -> DataFrame:
    """One page of the rows for which ``predicate`` holds; filtered first, then ordered, then cut."""
    return ordered(df.where(predicate), by, ascending, key).offset(offset).limit(limit)


def numbered(in_order: DataFrame, name: str) -> DataFrame:
    """Rows of an ordered table with their places from 1, without one task that sees all: places within partitions and the rows before each partition.

    The order is written once, since its ranges could fall otherwise a second time.
    """
    placed = written(in_order.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    before, offsets = 0, []
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        offsets.append((row["part"], before))
        before += row["count"]
    table = in_order.sparkSession.createDataFrame(offsets, "__part long, __before long")
    joined = placed.join(F.broadcast(table), part == F.col("__part"))
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__before")


def top(df: DataFrame, by: str, key: str, n: int, ascending: bool = False) -> DataFrame:
    """The ``n`` rows with the greatest (or least) ``by``; null is no value; ties go by key."""
    column = F.col(by)
    return df.where(column.isNotNull()).orderBy(column.asc() if ascending else column.desc(), F.col(key)).limit(n)


def stats(df: DataFrame, **counts: Column) -> DataFrame:
    """All rows as ``total`` and, for each name, those for which its predicate holds, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(name) for name, c in counts.items()))


def distinct_values(df: DataFrame, column: str, in_order: bool = False) -> DataFrame:
    """The distinct values of a column but null."""
    found = df.where(F.col(column).isNotNull()).select(column).distinct()
    return found.orderBy(column) if in_order else found


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def joined_in_order(ids: DataFrame, rows: DataFrame, key: str, score: str) -> DataFrame:
    """The rows of scored ids by descending score; ids without a row are left out."""
    return ids.join(rows, key, "inner").orderBy(F.desc(score), F.col(key))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row with the greatest ``order``; a window with a rank filter, which Spark limits before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__nth", F.row_number().over(window)).where("__nth = 1").drop("__nth")


def upserted(existing: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``existing`` with ``changes`` put in by key: the last change of a key wins over the row there."""
    last = latest(changes, keys, order).select(*existing.columns)
    return existing.join(last, keys, "left_anti").select(*existing.columns).unionByName(last)


def inserted_if_absent(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and those of ``rows`` whose key is not there; of several the first by all columns."""
    new = rows.join(existing.select(*keys), keys, "left_anti")
    first = Window.partitionBy(*keys).orderBy(*rows.columns)
    new = new.withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    return existing.unionByName(new.select(*existing.columns))


def inserted(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and ``rows``; a key that is there already, or twice in ``rows``, is an error when the result is computed."""
    seen = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    there = existing.select(*keys).distinct().withColumn("__there", F.lit(True))
    checked = rows.join(seen, keys).join(there, keys, "left")
    twice = (F.col("__n") > 1) | F.col("__there").isNotNull()
    stopped = F.when(twice, F.raise_error(F.concat(F.lit("duplicate key "), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)))).cast("boolean")).otherwise(True)
    return existing.unionByName(checked.where(stopped).select(*existing.columns))


def seeded(existing: DataFrame, built_in: DataFrame) -> DataFrame:
    """``existing``, or what is built in where nothing is there at all."""
    there = existing.limit(1).select(F.lit(1).alias("__there"))
    new = built_in.withColumn("__there", F.lit(1)).join(there, "__there", "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def updated(df: DataFrame, predicate: Column, **values: object) -> DataFrame:
    """Columns set where the predicate holds."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def counted(df: DataFrame, predicate: Column, column: str, change: int) -> DataFrame:
    """A counter changed where the predicate holds, never below 0."""
    return updated(df, predicate, **{column: F.greatest(F.lit(0), F.col(column) + change).cast(df.schema[column].dataType)})


def deleted(df: DataFrame, predicate: Column) -> DataFrame:
    """The rows for which the predicate does not hold (null: kept)."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def cascade_deleted(gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each child table without the rows that refer to a key of ``gone``."""
    keys = gone.select(F.col(key).alias("__gone")).distinct()
    return [child.join(keys, F.col(column) == F.col("__gone"), "left_anti") for child, column in children]


def toggled(selection: Column, item: Column) -> Column:
    """A set with the item taken out if it is there, else put in."""
    return F.when(F.array_contains(selection, item), F.array_remove(selection, item)).otherwise(F.array_union(selection, F.array(item)))


def recent(df: DataFrame, value: str, time: str, most: int = 8) -> DataFrame:
    """The distinct values used last, the latest first."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.max(time).alias("last_used")).orderBy(F.desc("last_used"), value).limit(most)
