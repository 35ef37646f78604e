"""Readers of binary files, the tokeniser, inserts, predicates of callers, and streams that arrive in several triggers."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from heliograph.functions import tokens
from heliograph.operators import catalog, imaging
from heliograph.operators.filters import Node, checked_expression
from heliograph.sources import files
from heliograph.streaming import live


def tiff(order: str) -> bytes:
    """A file of two directories with texts, shorts, rationals, in either byte order."""
    mark = b"II*\0" if order == "<" else b"MM\0*"
    texts, at = b"", 8 + 2 + 12 * 4 + 4 + 2 + 12 * 4 + 4
    first, second = [], []

    def add(to: list, tag: int, kind: int, count: int, raw: bytes) -> None:
        nonlocal texts
        if len(raw) > 4:
            to.append(struct.pack(f"{order}HHII", tag, kind, count, at + len(texts)))
            texts += raw
        else:
            to.append(struct.pack(f"{order}HHI", tag, kind, count) + raw.ljust(4, b"\0"))

    add(first, 0x010F, 2, 6, b"Maker\0")
    add(first, 0x0110, 2, 9, b"Model 12\0")
    add(first, 0x0112, 3, 1, struct.pack(f"{order}H", 6))
    add(first, 0x8769, 4, 1, struct.pack(f"{order}I", 8 + 2 + 12 * 4 + 4))
    add(second, 0x829A, 5, 1, struct.pack(f"{order}II", 1, 250))
    add(second, 0x829D, 5, 1, struct.pack(f"{order}II", 28, 10))
    add(second, 0x8827, 3, 1, struct.pack(f"{order}H", 800))
    add(second, 0x9003, 2, 20, b"2024:01:02 03:04:05\0")
    head = mark + struct.pack(f"{order}I", 8)
    return head + b"".join(struct.pack(f"{order}H", len(d)) + b"".join(d) + b"\0" * 4 for d in (first, second)) + texts


def test_exif(spark, tmp_path):
    exif = b"Exif\0\0" + tiff(">")
    whole = {"little.tif": tiff("<"), "big.dng": tiff(">"), "shot.jpg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda", "broken.tif": tiff("<")[:40], "none.txt": b"hello"}  # empty files are no rows of the source
    for name, raw in whole.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.exif(files.binary_files(spark, str(tmp_path))).collect()}
    assert set(got) == set(whole)
    for name in ("little.tif", "big.dng", "shot.jpg"):
        r = got[name]
        assert (r["make"], r["model"], r["orientation"], r["iso"], r["taken"], r["lens"]) == ("Maker", "Model 12", 6, 800, "2024:01:02 03:04:05", None)
        assert r["exposure_time"] == pytest.approx(1 / 250) and r["f_number"] == pytest.approx(2.8)
    assert all(v is None for name in ("broken.tif", "none.txt") for k, v in got[name].asDict().items() if k not in ("path", "error"))
    assert got["broken.tif"]["error"] and not got["none.txt"]["error"] and not got["little.tif"]["error"]  # a file without the format is no fault


def test_lookup_table_file(spark, tmp_path):
    rows = "\n".join(f"{1 - (i & 1)} {i >> 1 & 1} {i >> 2}" for i in range(8))
    (tmp_path / "a.cube").write_text(f'# made by hand\nTITLE "Red turned"\nLUT_3D_SIZE 2\nDOMAIN_MIN 0 0 0\n\n{rows}\n')
    (tmp_path / "b.cube").write_text("LUT_3D_SIZE 3\n0 0 0\n")
    good, bad = sorted(files.cubes(files.binary_files(spark, str(tmp_path), "*.cube")).collect(), key=lambda r: r["path"])
    assert (good["title"], good["size"], len(good["data"]), good["domain_max"]) == ("Red turned", 2, 24, [1.0, 1.0, 1.0]) and bad["size"] is None
    pixels = spark.createDataFrame([(1, 0, 0, 0.25, 0.5, 0.75)], "image_id long, y int, x int, r double, g double, b double")
    turned = imaging.lmt(pixels, good["size"], [good["data"][k : k + 3] for k in range(0, 24, 3)]).first()
    assert (turned["r"], turned["g"], turned["b"]) == (pytest.approx(0.75), pytest.approx(0.5), pytest.approx(0.75))


def test_tensor_header_and_archive(spark, tmp_path):
    header = json.dumps({"__metadata__": {"format": "pt"}, "w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + b"\0" * 24)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("project.json", "{}" * 50)
    (tmp_path / "p.zip").write_bytes(packed.getvalue())
    tensors = files.tensor_headers(files.binary_files(spark, str(tmp_path), "*.safetensors")).first()["tensors"]
    assert [tuple(t) for t in tensors] == [("w", "F32", [2, 3], 0, 24)]
    entries = files.archive_entries(files.binary_files(spark, str(tmp_path), "*.zip")).first()["entries"]
    assert [(e["name"], e["size"]) for e in entries] == [("project.json", 100)]


def test_tokens(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"sun": 10, "set</w>": 11, "a</w>": 12, "photo": 13, "bad": "x", "of": 14}))
    vocabulary = files.vocabulary(spark, str(tmp_path / "v.json"))
    assert vocabulary == {"sun": 10, "set</w>": 11, "a</w>": 12, "photo": 13, "of": 14}
    rows = spark.createDataFrame([("A  Photo of #sunset",), ("",), (None,), ("q",), ("sun " * 200,)], "t string")
    got = [r[0] for r in rows.select(tokens.token_ids(F.col("t"), vocabulary)).collect()]
    assert got[0][:8] == [49406, 12, 13, 14, 10, 11, 49407, 0] and all(len(g) == 77 for g in got)
    assert got[1][:3] == got[2][:3] == [49406, 49407, 0]
    assert got[3][1] == 49408 + ord("q")
    assert got[4].count(10) == 50 and got[4][51] == 49407  # 200 characters count


def test_insert_fails_on_a_known_key(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    assert {r["k"] for r in catalog.inserted(old, new, ["k"]).collect()} == {1, 2}
    for rows in (old, new.union(new)):
        with pytest.raises(Exception, match="duplicate key"):
            catalog.inserted(old, rows, ["k"]).collect()


def test_predicates_of_callers():
    assert checked_expression("lower(name) like '%select%' and rating >= 3") and Node("expr", expr="rating > 2").kind == "expr"
    for bad in ("1 = 1; drop table x", "id in (select id from t)", "reflect('java.lang.Runtime', 'x') = 1", "a = 1 -- b", "uuid() = 'x'", "a = 1 /* */"):
        with pytest.raises(ValueError, match="not allowed"):
            checked_expression(bad)


def test_places_without_one_task(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id").repartition(7)
    got = catalog.numbered(rows.orderBy("v", "id"), "place").collect()
    want = sorted((r["v"], r["id"]) for r in got)
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, 1001))


def _triggers(spark, folder, schema: str, parts: list[list[tuple]], build):
    """What a stream gives after each of several files has come, in append mode."""
    out = f"{folder}/out"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).collect()


def test_debounce_as_a_stream(spark, tmp_path):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    parts = [[("a", at(0), 1), ("a", at(3), 2), ("b", at(1), 7)], [("a", at(6), 3), ("a", at(60), 4)], [("c", at(200), 9)], [("c", at(400), 9)]]
    build = lambda rows: live.debounced(rows, "k", "t", "v", "10 seconds", "10 seconds")
    got = {(r["k"], r["v"], r["n"]) for r in _triggers(spark, tmp_path, "k string, t timestamp, v int", parts, build)}
    assert got == {("a", 3, 3), ("b", 7, 1), ("a", 4, 1), ("c", 9, 1)} and len(got) == 4  # the last burst is still open
    batch = {(r["k"], r["v"], r["n"]) for r in build(spark.createDataFrame([r for p in parts for r in p], "k string, t timestamp, v int")).collect()}
    assert got <= batch


def test_latest_state_over_several_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(u, k * 10 + u, f"v{k}") for u in range(5 - k)], "u int, t int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("u int, t int, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r["u"]: (r["t"], r["v"]) for r in live.run_once(live.latest_by_key(stream, "u", "t", "v")).collect()}
    assert got == {0: (20, "v2"), 1: (21, "v2"), 2: (22, "v2"), 3: (13, "v1"), 4: (4, "v0")}
