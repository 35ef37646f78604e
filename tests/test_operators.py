"""Small cases worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from heliograph.functions import colour, hashing, paths, scoring, text, vectors
from heliograph.operators import catalog, history, imaging, raw, scopes, search, tree
from heliograph.operators.filters import CatalogFilter, Condition, Node, dispatch, from_json, interpreted, to_json
from heliograph.sources import tables
from heliograph.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("path", "want"), [("a//b/", "/a/b"), ("  ", "/"), ("/", "/"), (None, "/"), ("/a/ab", "/a/ab")])
def test_normalised(spark, path, want):
    assert one(spark, paths.normalised(F.lit(path).cast("string"))) == want


@pytest.mark.parametrize(("above", "path", "want"), [("/a", "/ab", False), ("/a", "/a", True), ("/a", "/a/b", True), ("/", "/x", True)])
def test_is_descendant(spark, above, path, want):
    assert one(spark, paths.is_descendant(F.lit(above), F.lit(path))) is want


def test_paths(spark):
    assert one(spark, paths.parent(F.lit("/a"))) == "/"
    assert one(spark, paths.name(F.lit("/a/b.c"))) == "b.c"
    assert one(spark, paths.depth(F.lit("/a/b"))) == 2
    assert one(spark, paths.relative(F.lit("/a"), F.lit("/a/b/c"))) == "b/c"
    assert one(spark, paths.relative(F.lit("/a"), F.lit("/a"))) == ""
    assert one(spark, paths.relative(F.lit("/a"), F.lit("/b"))) is None
    assert one(spark, paths.moved(F.lit("/a/x"), "/a", "/b/a")) == "/b/a/x"
    assert one(spark, paths.moved(F.lit("/ab/x"), "/a", "/b")) == "/ab/x"


@pytest.mark.parametrize(("iso", "stars", "flag"), [(100, 3, "PICK"), (640, 3, "PICK"), (1280, 3, "NONE"), (3200, 3, "NONE"), (6400, 2, "NONE"), (12800, 2, "NONE")])
def test_heuristic_rating(spark, iso, stars, flag):
    overall = scoring.heuristic_overall(F.lit(iso))
    assert one(spark, scoring.stars(overall)) == stars
    assert one(spark, scoring.heuristic_flag(overall)) == flag


@pytest.mark.parametrize(("overall", "strictness", "want", "flag"), [(0.8, 1.0, 0.65, "NONE"), (0.8, 0.0, 0.95, "PICK"), (0.4, 1.0, 0.25, "REJECT")])
def test_strictness(spark, overall, strictness, want, flag):
    out = scoring.strict_overall(F.lit(overall), strictness)
    assert one(spark, out) == pytest.approx(want, abs=1e-6)
    assert one(spark, scoring.strict_flag(out, strictness)) == flag


def test_remaining_time(spark):
    assert one(spark, scoring.remaining_time(F.lit(6.0), F.lit(3), F.lit(10))) == pytest.approx(14)
    assert one(spark, scoring.remaining_time(F.lit(6.0), F.lit(0), F.lit(10))) is None


def test_vectors(spark):
    a, b = (F.array(*(F.lit(float(x)) for x in v)) for v in ([1, 2, 2], [2, 0, 1]))
    zero = F.array(*(F.lit(0.0) for _ in range(3)))
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(0.596285, abs=1e-6)
    assert one(spark, vectors.cosine(a, zero)) == 0
    assert one(spark, vectors.cosine(a, F.array(F.lit(1.0)))) is None
    assert one(spark, vectors.l2_normalised(zero)) == [0, 0, 0]
    assert one(spark, vectors.argmax(b)) == 0
    assert one(spark, vectors.from_text(F.lit("1, x,2.5"))) == [1.0, 2.5]
    assert one(spark, vectors.from_blob(vectors.to_blob(a.cast("array<float>")))) == [1, 2, 2]


@pytest.mark.parametrize(("value", "bin"), [(0, 0), (0.0019, 0), (0.002, 1), (0.499, 127), (0.5, 128), (1.0, 255), (1.2, 255), (-1.0, 0)])
def test_bins(spark, value, bin):
    assert one(spark, scopes.bin_of(F.lit(float(value)), 256)) == bin


def test_tail_bins():
    assert [scopes.tail_bins(b) for b in (16, 64, 256, 1024)] == [1, 1, 4, 4]


@pytest.mark.parametrize(("at", "want"), [(0.25, 0.375), (0.5, 0.7), (0.75, 0.875), (-1, 0), (2, 1)])
def test_curve(spark, at, want):
    assert one(spark, imaging.curve_value(F.lit(float(at)), [(0, 0), (0.5, 0.7), (1, 1)])) == pytest.approx(want)


def test_classify():
    q = search.classify("iso800 sunset")
    assert (q.iso, q.semantic) == (800, "sunset")
    assert search.classify("ISO 800 sunset").semantic == "ISO 800 sunset"
    q = search.classify("f/2.8 50mm 4stars camera:X100")
    assert (q.aperture, q.focal_length, q.rating_min, q.rating_max, q.camera, q.semantic) == (2.8, 50, 4, 4, "x100", None)
    assert search.classify("forest").semantic == "forest"
    assert search.classify(None).semantic is None


def test_logged_queries_are_classified_alike(spark):
    texts = ["iso800 sunset", "ISO 800 x", "f/2.8 F4 50mm 85MM", "4stars 2-3", "2-3 1star", "camera:X100 lens: lens:Z é\u00a0b\u2003c", "", None, "  ", "iso=100 iso:200 isoX 6stars 0-3 f/ .5 mm", "a\x1cb\x85c\n\td"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", search.classified(F.col("t")).alias("q")).collect()
    for r in rows:
        q = search.classify(texts[r["k"]])
        assert r["q"].asDict() == {n: getattr(q, n) for n in r["q"].asDict()}, texts[r["k"]]


def test_merge(spark):
    a = spark.createDataFrame([("A", 0.8), ("B", 0.5)], "id string, score double")
    b = spark.createDataFrame([("B", 0.8), ("C", 1.0)], "id string, score double")
    assert [(r[0], round(r[1], 6)) for r in search.merged(a, b, "id", 10).collect()] == [("B", 0.75), ("A", 0.56), ("C", 0.4)]


def test_tags(spark):
    got = one(spark, text.tags_from_text(F.lit("A photo of the red-brick house's door")))
    assert got == ["photo", "red", "brick", "house's", "door"]
    assert one(spark, text.tags_from_name(F.lit("IMG_old house-2.jpg"))) == ["img", "old", "house"]
    assert one(spark, text.tags_split(text.tags_joined(F.array(F.lit("a"), F.lit("b"))))) == ["a", "b"]


def test_formats(spark):
    assert one(spark, text.shutter(F.lit(0.004))) == "1/250"
    assert one(spark, text.shutter(F.lit(2.0))) == "2.0s"
    assert one(spark, text.aperture(F.lit(28), F.lit(10))) == 2.8
    assert one(spark, text.bytes_text(F.lit(1536))) == "1.5 KB"
    assert one(spark, text.export_name(F.lit("{name}-{date}"), F.lit("a"), F.lit("b"))) == "a-b"
    rating = one(spark, text.parsed_rating(F.lit('ok: {"overall": 1.4, "flag": "maybe"} end')))
    assert (rating["overall"], rating["flag"]) == (1.0, "NONE")
    assert one(spark, text.parsed_rating(F.lit("nothing"))) is None


def test_fold(spark):
    log = spark.createDataFrame([(1, 1, {"exposure": "1"}), (1, 2, {"contrast": "2"}), (1, 3, {"exposure": "3"})], "v int, t int, d map<string,string>")
    assert history.state_maps(history.folded(log, "v", ["t"], "d"), "v").first()["state"] == {"exposure": "3", "contrast": "2"}
    cursors = spark.createDataFrame([(1, 2)], "v int, cursor int")
    undone = history.undone(log, "v", ["t"], cursors)
    assert history.state_maps(history.folded(undone, "v", ["t"], "d"), "v").first()["state"] == {"exposure": "1", "contrast": "2"}
    new = spark.createDataFrame([(1, 9, {"tint": "4"})], log.schema)
    assert {r["t"] for r in history.appended(log, new, "v", ["t"], cursors).collect()} == {1, 2, 9}
    base = spark.createDataFrame([(1, "tint", "7"), (1, "exposure", "0")], "v int, field string, value string")
    assert history.state_maps(history.folded(log, "v", ["t"], "d", base), "v").first()["state"] == {"exposure": "3", "contrast": "2", "tint": "7"}


def test_versions(spark):
    rows = spark.createDataFrame([(1, "a", 1, True, "default"), (1, "b", 2, False, "x"), (2, "c", 1, False, "x"), (2, "d", 2, False, "y")], "k int, v string, t int, active boolean, name string")
    assert {r["k"]: r["v"] for r in history.active_versions(rows, "k", "v", "t", "active").collect()} == {1: "a", 2: "d"}
    chosen = spark.createDataFrame([(1, "b")], "k int, v string")
    assert {r["v"]: r["active"] for r in history.activated(rows, "k", "v", "active", chosen).collect()} == {"a": False, "b": True, "c": False, "d": False}
    assert {r["v"] for r in history.removed_version(rows, "k", "v", "t", "active", "a").collect()} == {"a", "b", "c", "d"}
    assert {r["v"]: r["active"] for r in history.removed_version(rows, "k", "v", "t", "active", "c").collect()} == {"a": True, "b": False, "d": True}


def test_maps(spark):
    old, new = (F.create_map(*(F.lit(x) for x in m)) for m in (("a", "1", "b", "2"), ("a", "1", "b", "3", "c", "4")))
    assert one(spark, history.sparse_diff(old, new)) == {"b": "3", "c": "4"}
    assert one(spark, history.merged(new, old)) == {"a": "1", "b": "2", "c": "4"}


def test_hashes(spark):
    assert one(spark, hashing.hash128(F.lit(""))) == "9e3779b97f4a7c15cbf29ce484222325"
    assert one(spark, hashing.hash128(F.lit("a"))) == "405337e338614e91af63dc4c8601ec8c"
    assert one(spark, hashing.blend(hashing.hash128(F.lit("a")), hashing.hash128(F.lit("b")))) == "751c9e2770d5ee99e59458ca0c960ab8"
    rows = spark.createDataFrame([(1, k, str(k)) for k in range(5)], "g int, n int, s string")
    roots = hashing.merkle_roots(rows, "g", ["n"], F.col("s"))
    assert roots.count() == 1
    h = [one(spark, hashing.hash128(F.lit(str(k)))) for k in range(5)]
    blend = lambda a, b: one(spark, hashing.blend(F.lit(a), F.lit(b)))
    assert roots.first()["root"] == blend(blend(blend(h[0], h[1]), blend(h[2], h[3])), h[4])


def test_filter_language(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("AB", None)], "name string, n int")
    neither = Node("not", (Condition("name", "eq", "a"), Condition("n", "eq", 2)))
    assert [r[0] for r in rows.where(neither.column()).collect()] == []
    assert rows.where(Node("or").column()).count() == 3
    assert rows.where(Condition("n", "between", 1).column()).count() == 0
    assert {r[0] for r in rows.where(Condition("name", "contains", "A").column()).collect()} == {"a", "AB"}
    assert {r[0] for r in rows.where(Condition("name", "contains", "A").column(ignore_case=False)).collect()} == {"AB"}
    assert from_json(to_json(neither)) == neither
    assert rows.where(interpreted(Condition("other", "eq", 1), {"name"}, F.lit(False))).count() == 3
    assert dispatch(rows, "{bad", "name", "n").count() == 0
    assert dispatch(rows, '{"query": "A"}', "name", "n").count() == 1
    with pytest.raises(ValueError, match="unknown comparison"):
        Condition("n", "like", 1).column()


def test_catalog_filter(spark):
    spec = CatalogFilter(folder="/x", rating_min=2, any_tag=["sea"], iso=(100, 400), text="%")
    assert not spec.is_empty()
    assert CatalogFilter(include_hidden=True).is_empty()
    row = {"sleevePath": "/x/a.jpg", "displayName": "100%", "rating": 3, "aiTags": "sun\u0001sea", "iso": 200}
    rows = spark.createDataFrame([row, row | {"displayName": "100"}, row | {"iso": 800}, row | {"sleevePath": "/x/y/a.jpg"}], tables.IMAGES)
    assert [r["displayName"] for r in rows.where(spec.column()).collect()] == ["100%"]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], old.schema)
    assert {r["k"]: r["v"] for r in catalog.upserted(old, new, ["k"], ["t"]).collect()} == {1: "a", 2: "d", 3: "e"}
    assert {(r["k"], r["v"]) for r in catalog.inserted_if_absent(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "e")}
    assert {r["k"] for r in catalog.deleted(old, F.col("v") == "a").collect()} == {2}
    assert {r["k"]: r["t"] for r in catalog.counted(old, F.col("k") == 1, "t", -5).collect()} == {1: 0, 2: 1}
    assert one(spark, catalog.toggled(F.array(F.lit(1), F.lit(2)), F.lit(2))) == [1]
    assert one(spark, catalog.toggled(F.array(F.lit(1)), F.lit(2))) == [1, 2]


def test_tree(spark):
    rows = spark.createDataFrame([("/", True), ("/a", True), ("/a/x.jpg", False), ("/ab", True)], "path string, is_folder boolean")
    assert [r["path"] for r in tree.children(rows, "/").collect()] == ["/a", "/ab"]
    assert [r["path"] for r in tree.flattened(rows).collect()] == ["/", "/a", "/a/x.jpg", "/ab"]
    assert {r["path"] for r in tree.without_subtree(rows, "/a").collect()} == {"/", "/ab"}
    assert tree.created(rows, "/a/y", True).count() == 5
    assert tree.created(rows, "/zz/y", True).count() == 4
    assert tree.created(rows, "/ab", True).count() == 4
    assert "/a/x_copy.jpg" in {r["path"] for r in tree.duplicated(rows, "/a/x.jpg").collect()}


@pytest.fixture(scope="module")
def image(spark):
    rows = [(1, y, x, (x + 1) / 4, (y + 1) / 4, 0.5) for y in range(4) for x in range(3)]
    return spark.createDataFrame(rows, tables.PIXELS).cache()


def pixels(df):
    return {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in df.collect()}


def test_every_image_operator_keeps_the_schema(image):
    params = {
        "exposure": {"value": 1.0}, "contrast": {"value": 0.1}, "white": {"value": 0.9}, "black": {"value": 0.1}, "shadows": {"value": 0.1}, "highlights": {"value": 0.1},
        "color_temp": {"kelvin": 5000.0}, "hs_local_tone": {"shadow": 0.2, "highlight": 0.2, "radius": 1}, "curve": {"points": [(0.0, 0.0), (0.5, 0.6), (1.0, 1.0)]}, "tint": {"value": 5.0},
        "saturation": {"value": 1.2}, "vibrance": {"value": 0.3}, "hls": {"profiles": [(10.0, 10.0, 10.0)]}, "cst": {"matrix": [[1, 0, 0], [0, 1, 0], [0, 0, 1]]},
        "color_wheel": {"lift": (0, 0, 0), "gamma": (1, 1, 1), "gain": (1, 1, 1)}, "clarity": {"value": 0.2, "radius": 1}, "sharpen": {"amount": 0.3}, "lmt": {"size": 2, "values": [[i & 1, i >> 1 & 1, i >> 2] for i in range(8)]},
        "odt": {}, "film_grain": {"strength": 0.1}, "halation": {"low": 0.3, "high": 0.6, "sigma": 1.0, "tint_rgb": (1.0, 0.3, 0.1), "strength": 0.2}, "resize": {"width": 3, "height": 4}, "crop": {"x": 0, "y": 0, "width": 3, "height": 4},
        "crop_rotate": {"degrees": 180}, "lens_calib": {"radial": (0.01,)}, "raw_decode": {},
    }
    assert set(params) == set(imaging.REGISTRY)
    for name, own in params.items():
        got = pixels(imaging.apply(image, name, **own))
        assert len(got) == 12, name
        assert all(math.isfinite(v) for rgb in got.values() for v in rgb), name
    same = pixels(image)
    for name in ("cst", "color_wheel", "lmt", "crop"):
        assert pixels(imaging.apply(image, name, **params[name])) == {k: pytest.approx(v) for k, v in same.items()}, name


def test_geometry(image):
    turned = pixels(imaging.rotate(image, 90))
    assert turned[(0, 3)] == pixels(image)[(0, 0)]
    assert pixels(imaging.crop(image, 1, 1, 2, 2))[(0, 0)] == pixels(image)[(1, 1)]
    assert len(pixels(imaging.resize(image, 6, 8))) == 48
    assert len(pixels(imaging.resize(image, 1, 2, "area"))) == 2


def test_masks(image):
    rows = image.select("y", "x", imaging.mask("disc", cx=1, cy=1, radius=1).alias("d"), imaging.mask("linear", x0=0, y0=0, x1=2, y1=0).alias("l"), imaging.polygon_mask([(-0.5, -0.5), (1.5, -0.5), (1.5, 1.5), (-0.5, 1.5)]).alias("p")).collect()
    assert sum(r["d"] for r in rows) == 5
    assert {r["l"] for r in rows if r["x"] == 1} == {0.5}
    assert sum(r["p"] for r in rows) == 4


def test_demosaic(spark):
    rows = spark.createDataFrame([(1, y, x, 0.5) for y in range(4) for x in range(4)], "image_id long, y int, x int, v double")
    assert set(pixels(raw.demosaic(rows)).values()) == {(0.5, 0.5, 0.5)}


def test_colour(spark):
    lab = colour.to_oklab(F.lit(0.2), F.lit(0.5), F.lit(0.7))
    back = spark.range(1).select(*(c.alias(n) for c, n in zip(colour.from_oklab(*lab), "rgb", strict=True))).first()
    assert list(back) == pytest.approx([0.2, 0.5, 0.7], abs=1e-6)
    assert one(spark, colour.chromaticity(F.lit(0.0), F.lit(0.0), F.lit(0.0))[0]) is None


def test_scopes(image):
    hist = scopes.histogram(image, 16, 1)
    assert hist.agg(F.sum("n")).first()[0] == 36
    assert len(scopes.feature_vector(image).first()["features"]) == 39
    assert scopes.caption(image).first()["caption"].startswith("A ")
    assert scopes.normalised_histogram(hist, 16).agg(F.max("v")).first()[0] <= 1
    assert scopes.column_means(image, 3).count() == 3


def test_stream_upserts(spark, tmp_path):
    for k, value in enumerate(("old", "new")):
        spark.createDataFrame([(1, value, k)], "k int, v string, t int").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v string, t int").parquet(str(tmp_path / "in"))
    live.upsert_batches(stream, str(tmp_path / "out"), ["k"], ["t"], str(tmp_path / "cp")).awaitTermination()
    last = max((p for p in (tmp_path / "out").iterdir()), key=lambda p: int(p.name))
    assert [r["v"] for r in spark.read.parquet(str(last)).collect()] == ["new"]


def test_ingest(spark):
    files = spark.createDataFrame([("a.NEF",), ("b.txt",), (None,), ("c.jpg",)], "name string")
    good, bad = tables.import_batch(files, "/Imports/")
    assert {(r["type"], r["path"]) for r in good.collect()} == {("RAW", "/Imports/a.NEF"), ("JPEG", "/Imports/c.jpg")}
    assert {r["error"] for r in bad.collect()} == {"no name", "unsupported type"}
