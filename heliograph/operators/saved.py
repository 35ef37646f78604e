"""Saved filters of folders: which of a folder's own elements match is kept as an index table and kept up by change rows.

The index is dealt to parts by a hash of the folder.  A refresh reads the parts of
the folders that changes touch, writes them anew and leaves all others; a
manifest (:mod:`heliograph.sources.versions`) says which files hold a part now.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import paths
from heliograph.operators.filters import Condition, Node
from heliograph.sources.versions import new_folder, publish, published

INDEX = "folder string, filter_id string, element string, part int"

#: A saved filter: its folder and its tree.
Filters = dict[str, tuple[str, Condition | Node]]


def resolved(tree: DataFrame, asked: DataFrame, path_col: str = "path", folder_col: str = "is_folder") -> DataFrame:
    """``asked`` (with a column ``path`` as users write it) and the element that lies there.

    Adds ``normal``, the normalised path, and the tree's other columns, null where
    nothing lies there or where something on the way is no folder.  One join by path:
    an element's own path names all folders above it.
    """
    own = tree.select(paths.normalised(F.col(path_col)).alias("normal"), *(c for c in tree.columns if c != path_col))
    files = tree.where(~F.col(folder_col)).select(paths.normalised(F.col(path_col)).alias("__above")).distinct()
    found = asked.withColumn("normal", paths.normalised(F.col("path"))).join(own, "normal", "left")
    parts = paths.components(F.col("normal"))
    above = F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))))
    ways = found.where(F.size(parts) > 1).select("normal", above.alias("__above")).distinct()
    blocked = ways.join(files, "__above").select("normal").distinct().withColumn("__blocked", F.lit(True))
    hidden = F.col("__blocked").isNotNull()
    kept = [c for c in found.columns if c not in (*asked.columns, "normal")]
    return found.join(blocked, "normal", "left").withColumns({c: F.when(~hidden, F.col(c)) for c in kept}).select(*asked.columns, "normal", *kept)


def part_of(folder: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(folder), F.lit(parts)).cast("int")


def matched(elements: DataFrame, filters: Filters, parts: int, key: str = "element", path_col: str = "path") -> DataFrame:
    """The index rows of some elements: one for each saved filter of an element's folder that it matches.

    All filters are tried in one pass.  Rows without a path match none.
    """
    folders = sorted({folder for folder, _ in filters.values()})
    above = paths.parent(F.col(path_col))
    hits = [F.when((F.col("__folder") == folder) & F.coalesce(tree.column(), F.lit(False)), F.lit(name)) for name, (folder, tree) in sorted(filters.items())]
    rows = elements.where(F.col(path_col).isNotNull() & (F.col(path_col) != "/")).withColumn("__folder", above).where(F.col("__folder").isin(folders))
    rows = rows.select(F.col("__folder").alias("folder"), F.explode(F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")).alias("filter_id"), F.col(key).cast("string").alias("element"))
    return rows.distinct().withColumn("part", part_of(F.col("folder"), parts))


def _put(spark: SparkSession, root: str, rows: DataFrame, version: int, kept: list[dict], parts: int) -> int:
    path = new_folder(root, "index")
    rows.repartition("part").sortWithinPartitions("part", "folder", "filter_id").write.partitionBy("part").parquet(path)
    counts = spark.read.schema(INDEX).parquet(path).groupBy("part").count().collect()  # a row for each part at most
    new = [{"name": str(r["part"]), "path": path, "rows": r["count"]} for r in counts]
    publish(spark, root, version, [*kept, *new, {"name": "parts", "rows": parts}])
    return version


def build(spark: SparkSession, root: str, elements: DataFrame, filters: Filters, parts: int = 64, key: str = "element") -> int:
    """The index of all elements as a new version."""
    version, _ = published(spark, root)
    return _put(spark, root, matched(elements, filters, parts, key), version + 1, [], parts)


def _read(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The index rows of some parts."""
    tables = [spark.read.schema(INDEX).option("basePath", path).parquet(*(f"{path}/part={r['name']}" for r in rows if r["path"] == path)) for path in sorted({r["path"] for r in rows})]
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], INDEX)


def _manifest(spark: SparkSession, root: str) -> tuple[int, int, list[dict]]:
    version, rows = published(spark, root)
    if not rows:
        raise ValueError("no index was built")
    return version, next(r["rows"] for r in rows if r["name"] == "parts"), [r for r in rows if r["name"] != "parts"]


def refresh(spark: SparkSession, root: str, changes: DataFrame, filters: Filters, key: str = "element") -> int:
    """A new version of the index after changes of elements; gives the version.

    ``changes``: a row for each changed element with ``path_before`` (null: it is
    new) and, after the change, ``path`` (null: it is gone) and the columns that
    filters ask for.  Only parts of folders in those paths are read and written.
    """
    version, parts, rows = _manifest(spark, root)
    folders = [folder for folder, _ in filters.values()]
    above = [F.when(F.col(c).isNotNull(), paths.parent(F.col(c))) for c in ("path_before", "path")]
    touched = changes.select(F.explode(F.array(*above)).alias("folder")).where(F.col("folder").isin(folders)).select(part_of(F.col("folder"), parts).alias("part")).distinct()
    numbers = {str(r["part"]) for r in touched.collect()}  # at most ``parts``
    if not numbers:
        return version
    old = _read(spark, [r for r in rows if r["name"] in numbers])
    gone = changes.select(F.col(key).cast("string").alias("element")).distinct()
    new = matched(changes, filters, parts, key)
    left = old.join(gone, "element", "left_anti").select("folder", "filter_id", "element", "part")
    return _put(spark, root, left.unionByName(new), version + 1, [r for r in rows if r["name"] not in numbers], parts)


def has_index(spark: SparkSession, root: str) -> bool:
    return published(spark, root)[0] > 0


def listed(spark: SparkSession, root: str, folder: str | None = None, filter_id: str | None = None) -> DataFrame:
    """``folder``, ``filter_id`` and ``element`` of the whole index, or of one folder (whose part alone is read), or of one filter."""
    _, parts, rows = _manifest(spark, root)
    if folder is not None:
        number = spark.range(1).select(part_of(F.lit(folder), parts)).first()[0]
        rows = [r for r in rows if r["name"] == str(number)]
    found = _read(spark, rows)
    for column, value in (("folder", folder), ("filter_id", filter_id)):
        found = found if value is None else found.where(F.col(column) == value)
    return found.select("folder", "filter_id", "element")
