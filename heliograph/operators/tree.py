"""The folder tree: rows with a path; order and reach come from path prefixes, so nothing iterates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import paths


def children(tree: DataFrame, path: str, folder_col: str = "is_folder", path_col: str = "path") -> DataFrame:
    """What lies directly in a folder: folders first, then by name."""
    own = tree.where(paths.parent(F.col(path_col)) == F.lit(path)).where(F.col(path_col) != "/")
    return own.orderBy(F.desc(folder_col), paths.name(F.col(path_col)))


def children_by_parent(tree: DataFrame, folder_col: str = "is_folder", path_col: str = "path") -> DataFrame:
    """``parent`` and ``children``, structs of ``is_folder`` and ``name``: folders first, then by name.  A listing is as large as its folder."""
    below = tree.where(F.col(path_col) != "/").select(paths.parent(F.col(path_col)).alias("parent"), F.col(folder_col).alias("is_folder"), paths.name(F.col(path_col)).alias("name"))
    grouped = below.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_folder")).alias("is_file"), "name"))).alias("sorted"))
    return grouped.select("parent", F.transform("sorted", lambda c: F.struct((~c["is_file"]).alias("is_folder"), c["name"].alias("name"))).alias("children"))


def listing_counts(tree: DataFrame, folder_col: str = "is_folder", path_col: str = "path") -> DataFrame:
    """Files and folders directly in each folder."""
    below = tree.where(F.col(path_col) != "/").withColumn("parent", paths.parent(F.col(path_col)))
    return below.groupBy("parent").agg(F.count_if(F.col(folder_col)).alias("folders"), F.count_if(~F.col(folder_col)).alias("files"))


def subtree(tree: DataFrame, path: str, path_col: str = "path") -> DataFrame:
    return tree.where(paths.is_descendant(F.lit(path), F.col(path_col)))


def subtree_counts(tree: DataFrame, folder_col: str = "is_folder", path_col: str = "path") -> DataFrame:
    """Files in and below each folder: every file is counted for each folder above it."""
    files = tree.where(~F.col(folder_col)).select(paths.components(F.col(path_col)).alias("parts"))
    above = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda k: F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, k), "/")))).alias("path"))
    return above.groupBy("path").agg(F.count("*").alias("files"))


def without_subtree(tree: DataFrame, path: str, path_col: str = "path") -> DataFrame:
    return tree.where(~paths.is_descendant(F.lit(path), F.col(path_col)))


def flattened(tree: DataFrame, path_col: str = "path") -> DataFrame:
    """Depth-first order of the tree: arrays of names compare like a walk in order of names; adds ``depth`` and an indented ``line``."""
    parts = paths.components(F.col(path_col))
    with_parts = tree.withColumn("__parts", parts).withColumn("depth", F.size(parts))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("depth") == 0, "/").otherwise(paths.name(F.col(path_col))))
    return with_parts.withColumn("line", line).orderBy("__parts").drop("__parts")


def moved(tree: DataFrame, source: str, target: str, path_col: str = "path") -> DataFrame:
    """The tree with a folder and everything below it under another path."""
    return tree.withColumn(path_col, paths.moved(F.col(path_col), source, target))


def created(tree: DataFrame, path: str, is_folder: bool, path_col: str = "path", folder_col: str = "is_folder") -> DataFrame:
    """The tree with one more row, if its parent folder is there and the path is free; else as it is."""
    spark = tree.sparkSession
    above = path.rsplit("/", 1)[0] or "/"
    new = spark.range(1).select(F.lit(path).alias(path_col), F.lit(is_folder).alias(folder_col))
    new = new.join(tree.select(path_col), path_col, "left_anti")
    parents = tree.where((F.col(path_col) == above) & F.col(folder_col)).select(F.col(path_col).alias("__parent")).distinct()
    new = new.join(parents, F.lit(above) == F.col("__parent"), "left_semi")
    return tree.unionByName(new, allowMissingColumns=True)


def duplicated(tree: DataFrame, path: str, path_col: str = "path", suffix: str = "_copy") -> DataFrame:
    """The tree with a copy of one row (a folder's copy is empty), its name with a suffix before the extension."""
    copy = tree.where(F.col(path_col) == path).withColumn(path_col, F.regexp_replace(F.col(path_col), r"(\.[^./]*)?$", "")).withColumn(path_col, F.concat(F.col(path_col), F.lit(suffix + _extension(path))))
    return tree.unionByName(copy)


def _extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1] if "." in name[1:] else ""


def reachable(spark: SparkSession, edges: str, root: object) -> DataFrame:
    """Ids below ``root`` with their depth, by a recursive query over the view ``edges`` (``id``, ``parent_id``)."""
    query = f"""
        WITH RECURSIVE below(id, depth) AS (
          SELECT id, 0 FROM {edges} WHERE id = :root
          UNION ALL
          SELECT e.id, b.depth + 1 FROM {edges} e JOIN below b ON e.parent_id = b.id)
        SELECT id, depth FROM below"""
    return spark.sql(query, args={"root": root})


def reference_counts(links: DataFrame, element_col: str = "element_id") -> DataFrame:
    return links.groupBy(element_col).agg(F.count("*").alias("ref_count"))


def garbage(elements: DataFrame, links: DataFrame, id_col: str = "id", element_col: str = "element_id", flag_col: str = "flag") -> DataFrame:
    """Elements that are deleted and that no folder holds."""
    held = links.select(F.col(element_col).alias("__held")).distinct()
    return elements.where(F.col(flag_col) == "DELETED").join(held, F.col(id_col) == F.col("__held"), "left_anti")
