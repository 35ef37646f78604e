"""Queries of development, geometry, masks and statistics over the pixels of :mod:`heliograph.plans.queries`, each with the operator's formula in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import colour, vectors
from heliograph.operators import imaging, masks, raw, scopes, tiles
from heliograph.plans.media import BILINEAR, OUT, SIZES
from heliograph.plans.queries import LUMA, PIXEL_SQL, _pixels, _rounded, query

CAMERA = ((0.9, 0.05, 0.05), (0.1, 0.8, 0.1), (0.0, 0.2, 0.8))
BALANCE = (1.8, 0.9, 1.35)
WORKING = [[sum(raw.XYZ_TO_WORKING[r][k] * CAMERA[k][c] for k in range(3)) for c in range(3)] for r in range(3)]


def _near(dy: int, dx: int) -> str:
    return f"coalesce((select v from m where m.image_id = o.image_id and m.y = least(greatest(o.y + {dy}, 0), s.h - 1) and m.x = least(greatest(o.x + {dx}, 0), s.w - 1)), 0)"


@query(PIXEL_SQL + f"""{SIZES}, m0 as (select image_id, y, x, greatest(0, g * 1.3 - 0.02) as v from px),
  m as (select a.image_id, a.y, a.x, case when a.v >= 1 then least(1, coalesce(0.5 * a.v + 0.5 * avg(b.v), a.v)) else a.v end as v from m0 a left join m0 b on b.image_id = a.image_id and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1 and (b.y <> a.y or b.x <> a.x) and b.v < 1 and a.v >= 1 group by a.image_id, a.y, a.x, a.v),
  n as (select o.image_id, o.y, o.x, s.w, s.h, o.v, {_near(0, -1)} + {_near(0, 1)} as sides, {_near(-1, 0)} + {_near(1, 0)} as ends, {_near(-1, -1)} + {_near(-1, 1)} + {_near(1, -1)} + {_near(1, 1)} as corners from m o join s on s.image_id = o.image_id),
  c as (select image_id, y, x, w, h, case when y % 2 = 1 and x % 2 = 0 then v when y % 2 = 0 and x % 2 = 1 then 0.25 * corners else 0.5 * sides end * {BALANCE[0] / BALANCE[1]} as r, case when y % 2 = x % 2 then v else 0.25 * (sides + ends) end as g,
    case when y % 2 = 0 and x % 2 = 1 then v when y % 2 = 1 and x % 2 = 0 then 0.25 * corners else 0.5 * ends end * {BALANCE[2] / BALANCE[1]} as b from n)
  select image_id, y // 2 as y, x // 2 as x, {", ".join(f"round({a!r}e0 * r + {b!r}e0 * g + {c!r}e0 * b, 8) as {name}" for (a, b, c), name in zip(WORKING, "rgb", strict=True))}
  from c where y % 2 = 0 and x % 2 = 0 and y // 2 < greatest(1, h // 2) and x // 2 < greatest(1, w // 2)""")
def raw_develop(spark: SparkSession, folder: str) -> DataFrame:
    mosaic = _pixels(spark, folder).select("image_id", "y", "x", (F.col("g") * 1.3 - 0.02).alias("v"))
    return _rounded(raw.developed(mosaic, pattern="GBRG", multipliers=BALANCE, camera=CAMERA, resolution="half"))


@query(PIXEL_SQL + """, c as (select image_id, y, x, r * 1.2 - 0.05 as r, g, b from px), d as (select image_id, y, x, greatest(0, r) as r, g, b from c)
  select image_id, y, x, round(case when greatest(r, g, b) >= 1 then least(1, 0.5 * r + 0.5 * (r + g + b) / 3) else r end * 0.6624541811 + case when greatest(r, g, b) >= 1 then least(1, 0.5 * g + 0.5 * (r + g + b) / 3) else g end * 0.1340042065 + case when greatest(r, g, b) >= 1 then least(1, 0.5 * b + 0.5 * (r + g + b) / 3) else b end * 0.1561876870, 8) as r,
    round(case when greatest(r, g, b) >= 1 then least(1, 0.5 * r + 0.5 * (r + g + b) / 3) else r end * 0.2722287168 + case when greatest(r, g, b) >= 1 then least(1, 0.5 * g + 0.5 * (r + g + b) / 3) else g end * 0.6740817658 + case when greatest(r, g, b) >= 1 then least(1, 0.5 * b + 0.5 * (r + g + b) / 3) else b end * 0.0536895174, 8) as g,
    round(case when greatest(r, g, b) >= 1 then least(1, 0.5 * r + 0.5 * (r + g + b) / 3) else r end * -0.0055746495 + case when greatest(r, g, b) >= 1 then least(1, 0.5 * g + 0.5 * (r + g + b) / 3) else g end * 0.0040607335 + case when greatest(r, g, b) >= 1 then least(1, 0.5 * b + 0.5 * (r + g + b) / 3) else b end * 1.0103391003, 8) as b from d""")
def raw_linear(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(raw.developed(_pixels(spark, folder).withColumn("r", F.col("r") * 1.2 - 0.05), pattern=None))


#: Taps of targets whose places are worked out per image: the tables ``ax`` and ``ay`` hold target, source and weight of each side.
SEPARABLE = """ select ax.image_id, ay.t as y, ax.t as x, round(sum(r * ax.k * ay.k), 8) as r, round(sum(g * ax.k * ay.k), 8) as g, round(sum(b * ax.k * ay.k), 8) as b
  from ax join ay on ay.image_id = ax.image_id join px on px.image_id = ax.image_id and px.x = ax.s and px.y = ay.s where ax.k <> 0 and ay.k <> 0 group by 1, 2, 3"""


def _side(name: str, size: str, count: str, place: str, first: str, share: str) -> str:
    return f""", {name}0 as (select image_id, {size} as n, unnest(range(cast({count} as integer))) as t, {count} as c, sc from z), {name}1 as (select *, {place} as v from {name}0),
  {name}2 as (select *, greatest(0, least({first}, n - 1)) as f0 from {name}1), {name}3 as (select *, {share} as f from {name}2),
  {name} as (select image_id, cast(t as integer) as t, cast(least(f0 + d, n - 1) as integer) as s, case d when 1 then f else 1 - f end as k from {name}3, (select unnest([0, 1]) as d))"""


THUMB = [_side(n, s, f"greatest(1, floor({s} * sc + 0.5))", "(t + 0.5) / sc - 0.5", "floor(v)", "v - floor(v)") for n, s in (("ax", "w"), ("ay", "h"))]


@query(PIXEL_SQL + f"""{SIZES}, q as (select image_id, w, h, 10.0 / greatest(w, h) as sc from s), z as (select * from q where sc < 1){"".join(THUMB)}
  {SEPARABLE} union all select px.image_id, y, x, round(r, 8), round(g, 8), round(b, 8) from px join q on q.image_id = px.image_id where sc >= 1""")
def thumbnails(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.thumbnail(_pixels(spark, folder), 10))


ENCODED = [_side(n, s, "9", f"(t + 0.5) * ({s} / 9.0) - 0.5".replace(s, "n"), "trunc(v)", "greatest(0, v - f0)") for n, s in (("ax", "w"), ("ay", "h"))]


@query(PIXEL_SQL + f"""{SIZES}, z as (select *, 1 as sc from s){"".join(ENCODED)}, e as ({SEPARABLE.replace("round(", "(").replace(", 8)", ")")}),
  g as (select s.image_id, c, p from s, (select unnest(range(3)) as c), (select unnest(range(81)) as p)),
  l as (select image_id, y * 9 + x as p, unnest([0, 1, 2]) as c, unnest([r, g, b]) as v from e)
  select g.image_id, cast(g.c * 81 + g.p as integer) as place, round(cast(cast((coalesce(l.v, 0) - [{", ".join(f"{v}e0" for v in imaging.MODEL_MEAN)}][g.c + 1]) / [{", ".join(f"{v}e0" for v in imaging.MODEL_DEVIATION)}][g.c + 1] as real) as double), 6) as value from g left join l on l.image_id = g.image_id and l.p = g.p and l.c = g.c""")
def model_tensors(spark: SparkSession, folder: str) -> DataFrame:
    packed = imaging.tensors(imaging.encoder_input(_pixels(spark, folder), 9), 9, 9)
    return packed.select("image_id", F.posexplode(vectors.from_blob(F.col("tensor"))).alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


TURN = 30.4
COS, SIN = math.cos(math.radians(TURN)), math.sin(math.radians(TURN))


@query(PIXEL_SQL.replace("with px", "with px0") + f""", px as (select image_id, y - 4 as y, x - 1 as x, r, g, b from px0 where y >= 4 and x >= 1 and y < 44){SIZES},
  t as (select *, cast(greatest(1, ceil(round(w * {COS!r}e0 + h * {SIN!r}e0, 9))) as integer) as rw, cast(greatest(1, ceil(round(w * {SIN!r}e0 + h * {COS!r}e0, 9))) as integer) as rh from s),
  u as (select *, cast(unnest(range(rw)) as integer) as tx from t), g as (select *, cast(unnest(range(rh)) as integer) as ty from u),
  placed as (select *, greatest(0, least((tx - rw * 0.5) * {COS!r}e0 + (ty - rh * 0.5) * {SIN!r}e0 + w * 0.5, w - 1.001)) as sx, greatest(0, least((ty - rh * 0.5) * {COS!r}e0 - (tx - rw * 0.5) * {SIN!r}e0 + h * 0.5, h - 1.001)) as sy from g)""" + BILINEAR)
def crop_rotate_free(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.apply(_pixels(spark, folder), "crop_rotate", degrees=TURN, x=1, y=4, width=0, height=40))


HSV = "cast(floor(greatest(0, least(1, r)) * 255 + 0.5) as double) as r, cast(floor(greatest(0, least(1, g)) * 255 + 0.5) as double) as g, cast(floor(greatest(0, least(1, b)) * 255 + 0.5) as double) as b"
TURNED = (math.cos(math.radians(25)), math.sin(math.radians(25)))


@query(PIXEL_SQL + f"""{SIZES}, p as (select px.image_id, y, x, w, h, {HSV} from px join s on s.image_id = px.image_id),
  q as (select *, cast(floor(round({LUMA}, 6)) as integer) as lum, greatest(r, g, b) as hi, least(r, g, b) as lo, x + 0.5 - w * 0.4 as dx, y + 0.5 - h * 0.5 as dy,
    ((x + 0.5 - w * 0.1) * (w * 0.8) + (y + 0.5 - h * 0.2) * (h * 0.6)) / ((w * 0.8) * (w * 0.8) + (h * 0.6) * (h * 0.6)) as t from p),
  u as (select *, case when hi = lo then 0 when hi = r then fmod((g - b) / (hi - lo) + 6, 6) when hi = g then (b - r) / (hi - lo) + 2 else (r - g) / (hi - lo) + 4 end * 60 as hue, case when hi = 0 then 0 else (hi - lo) / hi end as sat, case when lum < 63 then 63 - lum else lum - 153 end as off, greatest(w * 0.45, h * 0.3) as reach from q),
  v as (select *, case when abs(hue - 20) > 180 then 360 - abs(hue - 20) else abs(hue - 20) end as apart from u)
  select image_id, y, x, cast(case when abs(dx * {TURNED[0]!r}e0 + dy * {TURNED[1]!r}e0) <= w * 0.45 and abs(dy * {TURNED[0]!r}e0 - dx * {TURNED[1]!r}e0) <= h * 0.3 then greatest(0, least(255, floor(round((1 - sqrt(dx * dx + dy * dy) / reach) * 204, 6)))) else 0 end as integer) as radial,
    cast(255 - greatest(0, floor(round((1 - greatest(0, least(1, t))) * 127, 6))) as integer) as linear,
    cast(case when lum between 63 and 153 then 229 when lum >= 63 - 25 and lum <= 153 + 25 then greatest(0, least(229, floor(round((1 - off / 25.0) * 229, 6)))) else 0 end as integer) as luminance,
    cast(case when sat < 0.2 then 0 when apart <= 40 then greatest(0, floor(round((1 - apart / 40.0) * 255, 6))) when apart <= 40 + 0.25 * 180 then greatest(0, floor(round((1 - (apart - 40) / 45.0) * 255, 6))) else 0 end as integer) as hue from v""")
def mask_coverage(spark: SparkSession, folder: str) -> DataFrame:
    sized = masks.with_sizes(_pixels(spark, folder))
    return sized.select(
        "image_id", "y", "x", masks.radial((0.4, 0.5), (0.45, 0.3), 25, 0.8).alias("radial"), masks.inverted(masks.linear((0.1, 0.2), (0.9, 0.8), 0.5)).alias("linear"),
        masks.luminance_range(0.25, 0.6, 0.1, 0.9).alias("luminance"), masks.hue_range(20, 40, 0.2, 0.25).alias("hue"),
    )


@query(PIXEL_SQL + f"""{SIZES}, k as (select distinct image_id, y as oy, x as ox from px where y % 16 = 15 and x = 2), d as (select k.image_id, (ox + 0.5) as ax, (oy + 0.7) as ay, (ox + 0.5) + w * 0.4 as ex, (oy + 0.7) + h * 0.05 as ey, (0.3 + 0.05 * (oy % 5)) * least(w, h) as reach, floor(0.6 * 255) / 255 as a from k join s on s.image_id = k.image_id),
  m as (select px.image_id, px.y, px.x, d.*, greatest(0, least(1, ((px.x + 0.5 - ax) * (ex - ax) + (px.y + 0.5 - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)))) as t from px left join d on d.image_id = px.image_id and abs(d.ay - px.y) < 20),
  n as (select *, sqrt(pow(x + 0.5 - ax - t * (ex - ax), 2) + pow(y + 0.5 - ay - t * (ey - ay), 2)) as off from m),
  c as (select image_id, y, x, 1 - product(case when off <= reach then 1 - a * greatest(0, least(1, (reach - off) / (reach * 0.5))) else 1 end) as c from n group by 1, 2, 3)
  select image_id, y, x, cast(greatest(0, least(255, floor(round(coalesce(c, 0) * 255, 6)))) as integer) as coverage from c""")
def brush_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Slanted strokes that start at every sixteenth row, over the edges of tiles of eight pixels."""
    pixels = _pixels(spark, folder)
    sizes = tiles.sizes_of(pixels)
    starts = pixels.where("y % 16 = 15 and x = 2").select("image_id", F.col("y").alias("oy"), F.col("x").alias("ox")).join(sizes, "image_id")
    at = lambda dx, dy: F.array((F.col("ox") + 0.5) / F.col("w") + dx, (F.col("oy") + 0.7) / F.col("h") + dy)
    strokes = starts.select("image_id", F.array(at(0.0, 0.0), at(0.4, 0.05)).alias("points"), (F.lit(0.3) + F.col("oy") % 5 * 0.05).alias("radius"), F.lit(0.6).alias("opacity"), F.lit(0.5).alias("feather"))
    return masks.brush(pixels, strokes, sizes, side=8, joined=True)


@query(PIXEL_SQL + f""", s as (select image_id, avg({LUMA}) as mean, max(x) + 1 as w, max(y) + 1 as h from px group by 1), p as (select px.image_id, y, x, mean, {LUMA} as l, case when h > 1 then y / (h - 1.0) else 0 end as ny, case when w > 1 then x / (w - 1.0) else 0 end as nx from px join s on s.image_id = px.image_id),
  q as (select *, sqrt(pow(abs(nx - 0.5) * 2, 2) + pow(abs(ny - 0.5) * 2, 2)) as far, greatest(0, least(1, abs(l - mean) / (mean + 1e-3))) as unlike from p),
  f(kind) as (values ('sky'), ('background'), ('subject')),
  v as (select image_id, y, x, kind, case kind when 'sky' then greatest(0, least(1, (l - mean) / (1 - mean + 1e-3))) * 0.6 + (1 - ny) * 0.4 when 'background' then least(1, far) * 0.6 + (1 - unlike) * 0.4 else greatest(0, 1 - far) * 0.6 + unlike * 0.4 end as a from q, f)
  select image_id, y, x, kind, cast(floor(round(greatest(0, least(1, a)) * 255, 6)) as integer) as coverage from v""")
def fallback_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return masks.guesses(_pixels(spark, folder), ("sky", "background", "subject"))


@query(PIXEL_SQL + f""", l as (select *, {LUMA} as l from px), h as (select *, sum(l) over w as s, count(*) over w as n from l window w as (partition by image_id, y order by x range between 1 preceding and 1 following)),
  m as (select *, sum(s) over w / sum(n) over w as mean from h window w as (partition by image_id, x order by y range between 1 preceding and 1 following)),
  c as (select image_id, y, x, r * k as r, g * k as g, b * k as b from (select *, case when l > 1e-5 then 1 + 0.4 * (l - mean) / l else 1 end as k from m)),
  a as (select *, sum(r) over w as sr, sum(g) over w as sg, sum(b) over w as sb, count(*) over w as n from c window w as (partition by image_id, y order by x range between 1 preceding and 1 following)),
  t as (select *, sum(sr) over w as tr, sum(sg) over w as tg, sum(sb) over w as tb, sum(n) over w as t from a window w as (partition by image_id, x order by y range between 1 preceding and 1 following))
  select image_id, y, x, round(case when t = 9 then r + 0.2 * (9 * r - tr) else r end, 7) as r, round(case when t = 9 then g + 0.2 * (9 * g - tg) else g end, 7) as g, round(case when t = 9 then b + 0.2 * (9 * b - tb) else b end, 7) as b from t""")
def neighbourhood_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Clarity and sharpening in one exchange, on tiles of 16 pixels."""
    chain = [imaging.STEPS["clarity"](value=0.4, radius=1), imaging.STEPS["sharpen"](amount=0.2)]
    return _rounded(tiles.over_tiles(_pixels(spark, folder), chain, side=16), 7)


@query(PIXEL_SQL + f""", k as (select image_id, y, x, greatest(0, least(1, r)) as r, greatest(0, least(1, g)) as g, greatest(0, least(1, b)) as b from px){SIZES.replace("from px", "from k")},
  v as (select k.*, {LUMA} as l from k), p as (select image_id, greatest(1, floor(sqrt(w * h / 20.0))) as st, w, h from s),
  i as (select v.*, st, w, h from v join p on p.image_id = v.image_id where x % st = 0 and y % st = 0),
  f as (select image_id, unnest([0, 1, 2, 3]) as c, unnest([r, g, b, l]) as u from i), t as (select image_id, count(*) as n from i group by 1),
  b as (select f.image_id, c * 8 + least(7, floor(u * 8)) as place, count(*) / any_value(n) as value from f join t on t.image_id = f.image_id group by 1, 2),
  a as (select image_id, avg(r) as r, avg(g) as g, avg(b) as b, avg(l) as l, sqrt(greatest(0, avg(l * l) - avg(l) * avg(l))) as d from i group by 1),
  e as (select i.image_id, 4 * i.l - sum(o.l) as lap, count(o.l) as n from i join v o on o.image_id = i.image_id and abs(o.x - i.x) + abs(o.y - i.y) = 1 where i.x >= greatest(1, st) and i.y >= greatest(1, st) and i.x < w - 1 and i.y < h - 1 group by i.image_id, i.y, i.x, i.l having count(o.l) = 4),
  z as (select image_id, sqrt(greatest(0, avg(lap * lap) - avg(lap) * avg(lap))) as s, avg(case when abs(lap) > 0.05 then 1.0 else 0 end) as q from e group by 1),
  m as (select a.image_id, unnest(range(32, 39)) as place, unnest([r, g, b, l, d, coalesce(s, 0), coalesce(q, 0)]) as value from a left join z on z.image_id = a.image_id)
  select s.image_id, cast(k as integer) as place, round(coalesce(b.value, m.value, 0), 5) as value from s cross join (select unnest(range(39)) as k) left join b on b.image_id = s.image_id and b.place = k left join m on m.image_id = s.image_id and m.place = k""")
def image_features(spark: SparkSession, folder: str) -> DataFrame:
    found = scopes.feature_vector(_pixels(spark, folder), samples=20)
    return found.select("image_id", F.posexplode("features").alias("place", "value")).withColumn("value", F.round("value", 5))


@query(PIXEL_SQL + f"""{SIZES}, p as (select image_id, greatest(1, w // 3) as sx, greatest(1, h // 16) as sy from s),
  f as (select px.image_id, unnest([0, 1, 2]) as channel, unnest([r, g, b]) as v from px join p on p.image_id = px.image_id where x % sx = 0 and y % sy = 0)
  select image_id, channel, cast(floor(greatest(0, least(1, v)) * 255 + 0.5) as integer) as bin, count(*) as n from f group by 1, 2, 3""")
def histogram_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return scopes.byte_histogram(_pixels(spark, folder), across=3, down=16)


@query(PIXEL_SQL + """, f as (select image_id, unnest([0, 1, 2]) as channel, unnest([r, g, b]) as v from px), h as (select image_id, channel, cast(floor(greatest(0, least(1, v)) * 63 + 0.5) as integer) as bin, count(*) as n from f group by 1, 2, 3),
  c as (select image_id, channel, sum(case when bin < 1 then n else 0 end) / sum(n) as low, sum(case when bin >= 63 then n else 0 end) / sum(n) as high from h group by 1, 2), w as (select image_id, max(low) >= 0.02 as dark, max(high) >= 0.02 as light from c group by 1),
  p as (select h.image_id, greatest(1, max(case when bin < 1 and dark or bin >= 63 and light then 0 else n end)) as peak from h join w on w.image_id = h.image_id group by 1)
  select h.image_id, channel, bin, round(least(1, n / peak), 8) as v from h join p on p.image_id = h.image_id""")
def histogram_normalised(spark: SparkSession, folder: str) -> DataFrame:
    found = scopes.normalised_histogram(scopes.histogram(_pixels(spark, folder), 64, 1), 64)
    return found.withColumn("v", F.round("v", 8))


# ---- colours and tables


def _rows(matrix: tuple[tuple[float, ...], ...], *names: str) -> list[str]:
    return [" + ".join(f"{v!r}e0 * {n}".replace("e-05e0", "e-05") for v, n in zip(row, names, strict=True)) for row in matrix]


def _named(parts: list[str], names: str) -> str:
    return ", ".join(f"{part} as {name}" for part, name in zip(parts, names.split(), strict=True))


@query(PIXEL_SQL + f""", l as (select *, {_named(_rows(colour.LMS, "r", "g", "b"), "l m s")} from px), o as (select image_id, y, x, r, g, b, {_named(_rows(colour.OKLAB, "cbrt(l)", "cbrt(m)", "cbrt(s)"), "ol oa ob")} from l),
  n as (select *, {_named([f"case when {c} <= 0.04045 then {c} / 12.92 else pow(({c} + 0.055) / 1.055, 2.4) end" for c in "rgb"], "lr lg lb")} from o), z as (select *, {_named(_rows(colour.XYZ, "lr", "lg", "lb"), "cx cy cz")} from n),
  c as (select *, cx + cy + cz as t from z)
  select image_id, y, x, round(ol, 8) as lightness, round(oa, 8) as a, round(ob, 8) as b, round(sqrt(oa * oa + ob * ob), 8) as chroma,
    case when t > 1e-4 and cx / t between 0 and 1 and cy / t between 0 and 1 then round(cx / t, 8) end as cie_x, case when t > 1e-4 and cx / t between 0 and 1 and cy / t between 0 and 1 then round(cy / t, 8) end as cie_y from c""")
def colour_spaces(spark: SparkSession, folder: str) -> DataFrame:
    r, g, b = (F.col(c) for c in imaging.RGB)
    lightness, a, back = colour.to_oklab(r, g, b)
    cx, cy = colour.chromaticity(r, g, b)
    out = {"lightness": lightness, "a": a, "b": back, "chroma": colour.lch(a, back)[0], "cie_x": cx, "cie_y": cy}
    return _pixels(spark, folder).select("image_id", "y", "x", *(F.round(v, 8).alias(n) for n, v in out.items()))


#: A table of three entries a side, red fastest, that bends and mixes.
LUT = [[round((i % 3) / 2 * 0.8 + 0.05 * (i // 9), 4), round(((i // 3 % 3) / 2) ** 2, 4), round((i // 9) / 2 * 0.9 + 0.02 * (i % 3), 4)] for i in range(27)]


@query(PIXEL_SQL + f""", t(i, c) as (values {", ".join(f"({i}, {v})" for i, v in enumerate(LUT))}), u as (select *, greatest(0, least(1, r)) * 2 as ur, greatest(0, least(1, g)) * 2 as ug, greatest(0, least(1, b)) * 2 as ub from px),
  f as (select *, least(1, cast(floor(ur) as integer)) as lr, least(1, cast(floor(ug) as integer)) as lg, least(1, cast(floor(ub) as integer)) as lb from u),
  w as (select f.*, dr, dg, db, (case dr when 1 then ur - lr else 1 - (ur - lr) end) * (case dg when 1 then ug - lg else 1 - (ug - lg) end) * (case db when 1 then ub - lb else 1 - (ub - lb) end) as k
    from f, (select unnest([0, 1]) as dr), (select unnest([0, 1]) as dg), (select unnest([0, 1]) as db))
  select image_id, y, x, round(any_value(r) * 0.25691e0 + 0.74309e0 * sum(k * c[1]), 7) as r, round(any_value(g) * 0.25691e0 + 0.74309e0 * sum(k * c[2]), 7) as g, round(any_value(b) * 0.25691e0 + 0.74309e0 * sum(k * c[3]), 7) as b
  from w join t on t.i = lr + dr + 3 * (lg + dg) + 9 * (lb + db) group by 1, 2, 3""")
def lookup_table(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.apply(_pixels(spark, folder), "lmt", size=3, values=LUT, blend=0.74309), 7)


def _encoded(v: str) -> str:
    return f"case when {v} <= 0.0031308 then ({v}) * 12.92 else pow({v}, 1 / 2.4e0) * 1.055 - 0.055 end"


BENT = [f"pow(2, log2(greatest({c}, 0) / 0.18 + 1e-6) * 1.2e0) * 0.18e0" for c in "rgb"]


@query(PIXEL_SQL + f""", p as (select *, {_named(BENT, "br bg bb")}, {_named(_rows(imaging.ACES_MATRIX, "r", "g", "b"), "ar ag ab")} from px),
  q as (select image_id, y, x, {_named([f"pow(b{c} / (b{c} + 1), 0.9e0) * 1.5" for c in "rgb"], "ur ug ub")}, {_named([f"greatest(0, greatest(a{c}, 0) / (greatest(a{c}, 0) + 1) * 1.1)" for c in "rgb"], "vr vg vb")} from p)
  select image_id, y, x, {", ".join(f"round({_encoded('u' + c)}, 7) as open_{c}, round({_encoded('v' + c)}, 7) as aces_{c}" for c in "rgb")} from q""")
def display_output(spark: SparkSession, folder: str) -> DataFrame:
    pixels = _pixels(spark, folder)
    bent = imaging.apply(pixels, "odt", variant="open", white=1.5, slope=1.2, gamma=0.9)
    aces = imaging.apply(pixels, "odt", variant="aces", white=1.1)
    key = ["image_id", "y", "x"]
    return bent.select(*key, *(F.round(c, 7).alias(f"open_{c}") for c in imaging.RGB)).join(aces.select(*key, *(F.round(c, 7).alias(f"aces_{c}") for c in imaging.RGB)), key)
