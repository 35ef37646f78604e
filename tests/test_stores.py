"""Stores kept up by changes: saved filters, packages, flushes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from heliograph.operators import flush, saved
from heliograph.operators.filters import Condition, Node
from heliograph.sources import package, versions

FILTERS = {"big": ("/a", Condition("size", "gt", 5)), "all": ("/b/c", Node("and")), "x": ("/a", Condition("name", "contains", "x"))}
ELEMENTS = "element long, path string, name string, size long"


def plainly(rows):
    tests = {"big": lambda r: r[3] is not None and r[3] > 5, "all": lambda r: True, "x": lambda r: r[2] is not None and "x" in r[2].lower()}
    return {(folder, name, str(r[0])) for name, (folder, _) in FILTERS.items() for r in rows if r[1] and r[1] != "/" and (r[1].rsplit("/", 1)[0] or "/") == folder and tests[name](r)}


def index(spark, root, **which):
    rows = [tuple(r) for r in saved.listed(spark, root, **which).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_refresh_equals_a_fresh_scan(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path)
    new = lambda k: (k, rng.choice(["/a/", "/b/c/", "/b/", "/a/deep/"]) + f"f{k}", rng.choice(["Xy", "no", None]), rng.choice([None, 3, 6, 9]))
    rows = {k: new(k) for k in range(60)} | {60: (60, None, "x", 9), 61: (61, "/", "x", 9)}
    assert not saved.has_index(spark, root)
    saved.build(spark, root, spark.createDataFrame(list(rows.values()), ELEMENTS), FILTERS, parts=4)
    assert saved.has_index(spark, root)
    assert index(spark, root) == plainly(rows.values())
    for _ in range(3):
        after = dict(rows)
        for k in rng.sample(range(70), 15):
            after[k] = new(k)
        for k in rng.sample(sorted(after), 5):
            del after[k]
        changed = [(k, rows.get(k, (None,) * 4)[1], *after.get(k, (k, None, None, None))[1:]) for k in rows.keys() | after.keys() if rows.get(k) != after.get(k)]
        saved.refresh(spark, root, spark.createDataFrame(changed, "element long, path_before string, path string, name string, size long"), FILTERS)
        rows = after
        assert index(spark, root) == plainly(rows.values())
    assert index(spark, root, folder="/a", filter_id="x") == {r for r in plainly(rows.values()) if r[1] == "x"}
    assert index(spark, root, folder="/none") == set()


def test_refresh_reads_and_writes_touched_parts_alone(spark, tmp_path):
    root = str(tmp_path)
    rows = [(k, f"{folder}/f{k}", "x", 9) for k, folder in enumerate(["/a", "/b/c"] * 5)]
    saved.build(spark, root, spark.createDataFrame(rows, ELEMENTS), FILTERS, parts=64)
    before = {r["name"]: r["path"] for r in versions.published(spark, root)[1]}
    change = spark.createDataFrame([(0, "/a/f0", None, None, None)], "element long, path_before string, path string, name string, size long")
    version = saved.refresh(spark, root, change, FILTERS)
    after = {r["name"]: r["path"] for r in versions.published(spark, root)[1]}
    touched = spark.range(1).select(saved.part_of(F.lit("/a"), 64)).first()[0]
    assert {name for name in before if before[name] != after.get(name)} == {str(touched)}
    assert all(f"part={touched}/" in f for f in saved.listed(spark, root, folder="/a").inputFiles())
    nowhere = spark.createDataFrame([(7, "/z/f7", "/z/g7", "x", 9)], change.schema)
    assert saved.refresh(spark, root, nowhere, FILTERS) == version
    assert ("/a", "big", "0") not in index(spark, root) and ("/a", "big", "2") in index(spark, root)


def test_filters_of_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], ELEMENTS)
    assert saved.matched(none, {}, 4).collect() == []
    saved.build(spark, str(tmp_path), none, FILTERS, parts=4)
    assert index(spark, str(tmp_path)) == set()


def test_resolve(spark):
    tree = spark.createDataFrame([("/", True, 0), ("/a", True, 1), ("/a/f", False, 2), ("/a/f/odd", False, 3)], "path string, is_folder boolean, element int")
    asked = spark.createDataFrame([("//a//f/",), ("/a/",), ("/a/f/odd",), ("/nope",), ("",), (None,), ("/a/f",), ("/a/f",)], "path string")
    found = sorted((r["path"] or "", r["normal"], r["element"] if r["element"] is not None else -1) for r in saved.resolved(tree, asked).collect())
    assert found == [("", "/", 0), ("", "/", 0), ("//a//f/", "/a/f", 2), ("/a/", "/a", 1), ("/a/f", "/a/f", 2), ("/a/f", "/a/f", 2), ("/a/f/odd", "/a/f/odd", -1), ("/nope", "/nope", -1)]


@pytest.fixture(scope="module")
def sections(spark):
    images = spark.createDataFrame([("i1", "one", "t/1"), ("i2", None, None)], "id string, displayName string, thumbnailPath string")
    edits = spark.createDataFrame([("e1", "i1", {"exposure": "1"}, float("nan"), bytearray(b"\x00\xff")), ("e2", "i1", None, 0.1, None), ("e3", None, {}, None, None)], "id string, imageId string, delta map<string,string>, weight double, raw binary")
    presets = spark.createDataFrame([], "name string, adjustmentsJson string")
    return images, {"edits": edits, "presets": presets}


def test_package_round_trip(spark, tmp_path, sections):
    images, others = sections
    root = str(tmp_path)
    assert package.save(spark, root, 'a "name"', images, others, now=10) == 1
    header, found = package.opened(spark, root)
    assert header == {"magic": "ALCD", "name": 'a "name"', "createdAt": 10, "modifiedAt": 10, "imageCount": 2, "entryCount": 5}
    for name, df in {"images": images, **others}.items():
        assert found[name].schema == df.schema
        assert sorted(map(repr, found[name].collect())) == sorted(map(repr, df.collect()))
    assert [tuple(r) for r in found["thumbnails"].collect()] == [("i1", "t/1")]
    assert package.damaged(spark, root) == []
    assert dict(package.entries(spark, root)) == {"images": 2, "thumbnails": 1, "edits": 3, "presets": 0, "header": None}
    assert package.save(spark, root, "later", images.limit(0), {}, now=20) == 2
    header, found = package.opened(spark, root)
    assert (header["name"], header["createdAt"], header["modifiedAt"], header["entryCount"]) == ("later", 10, 20, 4)
    assert package.opened(spark, root, 1)[0]["name"] == 'a "name"'
    with pytest.raises(ValueError, match="other names"):
        package.save(spark, root, "x", images, {"images": images}, now=1)


def test_half_written_packages_are_not_seen(spark, tmp_path, sections):
    images, others = sections
    root = str(tmp_path)
    with pytest.raises(ValueError, match="not a project package"):
        package.opened(spark, root)
    package.save(spark, root, "whole", images, others, now=1)
    broken = others["edits"].withColumn("id", F.when(F.col("id") == "e3", F.raise_error("lost").cast("string")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        package.save(spark, root, "half", images, {"edits": broken}, now=2)
    assert package.opened(spark, root)[0]["name"] == "whole"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):  # another writer of the same version
        versions.publish(spark, root, 1, [{"name": "header", "note": "{}"}])
    path = next(r["path"] for r in versions.published(spark, root)[1] if r["name"] == "edits")
    others["edits"].limit(1).write.mode("append").json(path)
    assert package.damaged(spark, root) == ["edits"]


def test_flush(spark):
    elements = spark.createDataFrame([(1, "a", 1, False), (2, "b", 2, False), (3, "c", 1, False), (4, "d", 0, True), (5, "e", 0, None), (6, "f", None, True)], "k long, name string, ref_count long, deleted boolean")
    changes = spark.createDataFrame(
        [(1, "update", 1, "A"), (1, "update", 2, None), (2, "delete", 1, None), (3, "delete", 1, None), (4, "insert", 1, "D"), (7, "insert", 1, "g"), (7, "delete", 2, None), (8, "insert", 1, "h"), (9, "delete", 1, None), (None, "insert", 1, "n"), (1, "odd", 9, "z")],
        "k long, kind string, n int, name string",
    )
    links = spark.createDataFrame([(1, 1), (1, 1), (2, -1), (3, -1), (3, -5), (6, 1), (9, 1), (None, 1), (8, None)], "k long, step long")
    found = sorted(tuple(r) for r in flush.flushed(elements, changes, links, "k", ["n"]).collect())
    assert found == [(1, "a", 3, False), (2, "b", 1, True), (4, "D", 0, False), (5, "e", 0, False), (6, "f", 1, True), (8, "h", 0, False)]
    assert flush.flushed(elements.limit(0), changes.limit(0), links.limit(0), "k", ["n"]).collect() == []
