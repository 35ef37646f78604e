"""Queries of image operators and statistics over the pixels of :mod:`heliograph.plans.queries`, each with the operator's formula in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import colour
from heliograph.operators import imaging, scopes
from heliograph.plans.queries import LUMA, PIXEL_SQL, _pixels, _rounded, query

OUT = "image_id, y, x, round(r, 8) as r, round(g, 8) as g, round(b, 8) as b"
SIZES = ", s as (select image_id, max(x) + 1 as w, max(y) + 1 as h from px group by 1)"

PROFILES = [(900.0, 5.0, 10.0), (-400.0, -8.0, 20.0), (0.0, 12.0, -30.0), (300.0, 0.0, 0.0), (-1200.0, 3.0, 15.0), (700.0, -4.0, -10.0), (0.0, 6.0, 25.0), (200.0, -9.0, 5.0)]


@query(PIXEL_SQL + f""", a as (select *, greatest(r, g, b) as mx, least(r, g, b) as mn from px), c as (select *, (mx + mn) * 0.5 as l, mx - mn as d from a),
  e as (select *, case when d < 1e-6 then 0 else d / (1 - abs(2 * l - 1) + 1e-6) end as s,
    case when d < 1e-6 then 0 when mx = r then fmod((g - b) / d, 6) * 60 when mx = g then ((b - r) / d + 2) * 60 else ((r - g) / d + 4) * 60 end as h0 from c),
  f as (select *, case when h0 < 0 then h0 + 360 else h0 end as h from e),
  p as (select unnest([{", ".join(f"{{'c': {45.0 * k}, 'dh': {a}, 'dl': {b}, 'ds': {c}}}" for k, (a, b, c) in enumerate(PROFILES))}]) as p),
  w as (select image_id, y, x, h, l, s, sum(w * p.dh * 0.01) as dh, sum(w * p.dl * 0.01) as dl, sum(w * p.ds * 0.01) as ds from (
    select f.*, p.p as p, greatest(0, 1 - (case when abs(h - p.p.c) > 180 then 360 - abs(h - p.p.c) else abs(h - p.p.c) end) / 45.0) as w from f, p) group by all),
  m as (select image_id, y, x, fmod(h + dh + 360, 360) as h, greatest(0, least(1, l + dl)) as l, greatest(0, least(1, s + ds)) as s from w),
  k as (select *, (1 - abs(2 * l - 1)) * s as c, h / 60 as hp from m), q as (select *, c * (1 - abs(fmod(hp, 2) - 1)) as z, l - c * 0.5 as o from k)
  select image_id, y, x, round(o + case when hp < 1 then c when hp < 2 then z when hp < 4 then 0 when hp < 5 then z else c end, 9) as r,
    round(o + case when hp < 1 then z when hp < 3 then c when hp < 4 then z else 0 end, 9) as g, round(o + case when hp < 2 then 0 when hp < 3 then z when hp < 5 then c else z end, 9) as b from q""")
def image_hls(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.hls(_pixels(spark, folder), PROFILES), 9)


@query(PIXEL_SQL + f""", l as (select *, {LUMA} as l from px), h as (select *, sum(l) over w as s, count(*) over w as n from l window w as (partition by image_id, y order by x range between 2 preceding and 2 following)),
  m as (select image_id, y, x, sum(s) over w / sum(n) over w as mean from h window w as (partition by image_id, x order by y range between 2 preceding and 2 following)),
  t as (select l.*, log2(greatest(l, 1e-5)) as ll, log2(greatest(mean, 1e-5)) as lm from l join m on l.image_id = m.image_id and l.y = m.y and l.x = m.x),
  k as (select *, case when l > 1e-5 then pow(2, least(1, greatest(0, -lm) / 4) * 0.6 - least(1, greatest(0, lm) / 4) * 0.4 + (ll - lm) * 0.3) else 1 end as k from t)
  select image_id, y, x, round(r * k, 8) as r, round(g * k, 8) as g, round(b * k, 8) as b from k""")
def image_local_tone(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.apply(_pixels(spark, folder), "hs_local_tone", shadow=0.6, highlight=0.4, clarity_amount=0.3, radius=2))


BILINEAR = """, p as (select *, cast(floor(sx) as integer) as x0, cast(floor(sy) as integer) as y0 from placed),
  k as (select image_id, ty, tx, least(w - 1, x0 + dx) as x, least(h - 1, y0 + dy) as y, case when dx = 1 then sx - x0 else 1 - (sx - x0) end * case when dy = 1 then sy - y0 else 1 - (sy - y0) end as wt
    from p, (select unnest([0, 1]) as dx), (select unnest([0, 1]) as dy))
  select k.image_id, ty as y, tx as x, round(sum(r * wt), 8) as r, round(sum(g * wt), 8) as g, round(sum(b * wt), 8) as b from k join px on px.image_id = k.image_id and px.x = k.x and px.y = k.y where wt <> 0 group by 1, 2, 3"""


def _target(width: int, height: int) -> str:
    return f"""{SIZES}, placed as (select s.*, tx, ty, greatest(0, least(tx * w / {width}.0, w - 1.001)) as sx, greatest(0, least(ty * h / {height}.0, h - 1.001)) as sy
  from s, (select cast(unnest(range({width})) as integer) as tx), (select cast(unnest(range({height})) as integer) as ty))"""


@query(PIXEL_SQL + _target(5, 24) + BILINEAR)
def resize_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.resize(_pixels(spark, folder), 5, 24))


@query(PIXEL_SQL + _target(9, 20) + """, p as (select *, cast(floor(sx) as integer) as x0, cast(floor(sy) as integer) as y0 from placed),
  k0 as (select *, abs(dx - (sx - x0)) as ax, abs(dy - (sy - y0)) as ay from p, (select unnest([-1, 0, 1, 2]) as dx), (select unnest([-1, 0, 1, 2]) as dy)),
  k as (select image_id, ty, tx, greatest(0, least(w - 1, x0 + dx)) as x, greatest(0, least(h - 1, y0 + dy)) as y,
    case when ax <= 1 then 1.5 * ax * ax * ax - 2.5 * ax * ax + 1 when ax < 2 then -0.5 * ax * ax * ax + 2.5 * ax * ax - 4 * ax + 2 else 0 end *
    case when ay <= 1 then 1.5 * ay * ay * ay - 2.5 * ay * ay + 1 when ay < 2 then -0.5 * ay * ay * ay + 2.5 * ay * ay - 4 * ay + 2 else 0 end as wt from k0)
  select k.image_id, ty as y, tx as x, round(sum(r * wt), 7) as r, round(sum(g * wt), 7) as g, round(sum(b * wt), 7) as b from k join px on px.image_id = k.image_id and px.x = k.x and px.y = k.y where wt <> 0 group by 1, 2, 3""")
def resize_bicubic(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.resize(_pixels(spark, folder), 9, 20, "bicubic"), 7)


@query(PIXEL_SQL + f"""{SIZES}, c as (select px.image_id, px.x as tx, px.y as ty, w, h, 0.5 * w as cx, 0.4 * h as cy, greatest(w, h) as f from (select s.image_id, w, h, cast(unnest(range(w)) as integer) as x from s) xs
    join (select s.image_id, cast(unnest(range(h)) as integer) as y from s) ys using (image_id), lateral (select xs.image_id, xs.x, ys.y) px),
  n as (select *, (tx - cx) / f as dx, (ty - cy) / f as dy from c), q as (select *, dx * dx + dy * dy as r2 from n),
  t as (select *, 1 + 0.05 * r2 + 0.02 * r2 * r2 + 0.01 * r2 * r2 * r2 - 0.03 * r2 * r2 + 0.04 * r2 * r2 * r2 - 0.02 * r2 * r2 * r2 as dist from q),
  placed as (select image_id, w, h, tx, ty, greatest(0, least((dx * dist + 2 * 0.01 * dx * dy + 0.02 * (r2 + 2 * dx * dx)) * f + cx, w - 1.001)) as sx,
    greatest(0, least((dy * dist + 0.01 * (r2 + 2 * dy * dy) + 2 * 0.02 * dx * dy) * f + cy, h - 1.001)) as sy from t)""" + BILINEAR)
def image_lens(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.lens_calib(_pixels(spark, folder), (0.05, 0.02, 0.01, -0.03, 0.04, -0.02), (0.01, 0.02), (0.5, 0.4)))


SEED = 12345


@query(PIXEL_SQL.replace("with px", "with recursive px") + f"""{SIZES}, v(k, n) as (select -1, cast({(SEED ^ 0x9E3779B9) & 0xFFFFFFFF} as ubigint) union all
    select k + 1, cast(xor((((st >> ((st >> 28) + 4)) # st) * 277803737 % 4294967296) >> 22, ((st >> ((st >> 28) + 4)) # st) * 277803737 % 4294967296) as ubigint)
    from (select k, cast((n * 747796405 + 2891336453) % 4294967296 as ubigint) as st from v) where k < (select max(w * h) from s)),
  a as (select px.*, (v.n / 4294967295.0 - 0.5) * 0.2 * (0.15 + 0.85 * (1 - {LUMA})) as d from px join s on s.image_id = px.image_id join v on v.k = px.y * s.w + px.x)
  select image_id, y, x, round(r + d, 8) as r, round(g + d, 8) as g, round(b + d, 8) as b from a""".replace("(st >> ((st >> 28) + 4)) # st", "xor(st >> ((st >> 28) + 4), st)"))
def image_grain(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.film_grain(_pixels(spark, folder), 0.2, SEED))


@query(PIXEL_SQL + f"""{SIZES}, m as (select px.image_id, y, x, w, h, case when {LUMA} <= 0.4 then 0 else greatest(0, least(1, ({LUMA} - 0.4) / 0.3)) end as m from px join s on s.image_id = px.image_id),
  g as (select cast(unnest(range(-3, 4)) as integer) as d), n as (select d, exp(-0.5 * d * d / 1.44) / sum(exp(-0.5 * d * d / 1.44)) over () as k from g),
  a as (select m.image_id, m.y, m.x, m.w, m.h, sum(k * coalesce(o.m, 0)) as m from m cross join n left join m o on o.image_id = m.image_id and o.y = m.y and o.x = greatest(0, least(m.w - 1, m.x + d)) group by 1, 2, 3, 4, 5),
  b as (select a.image_id, a.y, a.x, sum(k * coalesce(o.m, 0)) as m from a cross join n left join a o on o.image_id = a.image_id and o.x = a.x and o.y = greatest(0, least(a.h - 1, a.y + d)) group by 1, 2, 3)
  select px.image_id, px.y, px.x, round(r + 0.5 * m, 8) as r, round(g + 0.15 * m, 8) as g, round(b + 0.05 * m, 8) as b from px join b on b.image_id = px.image_id and b.y = px.y and b.x = px.x""")
def image_halation(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.halation(_pixels(spark, folder), 0.4, 0.7, 1.2, (1.0, 0.3, 0.1), 0.5))


@query(PIXEL_SQL + f""", m as (select image_id, avg(greatest(0, least(1, r))) as r, avg(greatest(0, least(1, g))) as g, avg(greatest(0, least(1, b))) as b from px group by 1), v as (select *, {LUMA} as v, r - b as t from m)
  select image_id, case when v < 0.15 then 'A dark image' when v < 0.35 then 'A dim image' when v < 0.65 then 'A well-exposed image' when v < 0.85 then 'A bright image' else 'An overexposed image' end
    || ' with ' || case when t > 0.08 then 'warm tones' when t < -0.08 then 'cool blue tones' else 'neutral tones' end as caption,
    case when r >= g and r >= b then 'red-dominant' when g >= r and g >= b then 'green-dominant' else 'blue-dominant' end || ',' || case when v < 0.35 then 'low-key' when v > 0.65 then 'high-key' else 'mid-key' end as tags from v""")
def image_caption(spark: SparkSession, folder: str) -> DataFrame:
    return scopes.caption(_pixels(spark, folder)).select("image_id", "caption", F.array_join("tags", ",").alias("tags"))


@query(PIXEL_SQL + f""", v as (select *, {LUMA} as l, case when greatest(r, g, b) > 1e-6 then (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) else 0 end as s from px), k as (select *, 1 + 0.4 * (1 - s) as k from v)
  select image_id, y, x, round(l + (r - l) * k, 8) as r, round(l + (g - l) * k, 8) as g, round(l + (b - l) * k, 8) as b from k""")
def image_vibrance(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.apply(_pixels(spark, folder), "vibrance", value=40.0))


@query(PIXEL_SQL + """, a as (select image_id, y, x, r * 1.1 + (1 - r) * 0.05 as r, g * 0.9 + (1 - g) * -0.1 as g, b as b from px)
  select image_id, y, x, round(case when r > 0 then pow(r, 1 / 1.2) else r end, 8) as r, round(case when g > 0 then pow(g, 1 / 0.8) else g end, 8) as g, round(case when b > 0 then pow(b, 1.0) else b end, 8) as b from a""")
def lift_gamma_gain(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.apply(_pixels(spark, folder), "color_wheel", lift=(0.05, -0.1, 0.0), gamma=(1.2, 0.8, 1.0), gain=(1.1, 0.9, 1.0)))


@query(PIXEL_SQL + "select image_id, y, x, round(0.9 * r + 0.1 * g, 8) as r, round(0.05 * r + 0.9 * g + 0.05 * b, 8) as g, round(0.2 * g + 0.8 * b, 8) as b from px")
def colour_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.apply(_pixels(spark, folder), "cst", matrix=[[0.9, 0.1, 0.0], [0.05, 0.9, 0.05], [0.0, 0.2, 0.8]]))


@query(PIXEL_SQL + f""", l as (select *, {LUMA} as l from px), c as (select *, case when l <= 0 then 0 when l >= 1 then 1 when l < 0.5 then (3 * (l / 0.5) ** 2 - 2 * (l / 0.5) ** 3) * 0.7 + ((l / 0.5) ** 3 - 2 * (l / 0.5) ** 2 + l / 0.5) * 0.7
    + ((l / 0.5) ** 3 - (l / 0.5) ** 2) * 0.5 else (2 * ((l - 0.5) / 0.5) ** 3 - 3 * ((l - 0.5) / 0.5) ** 2 + 1) * 0.7 + (((l - 0.5) / 0.5) ** 3 - 2 * ((l - 0.5) / 0.5) ** 2 + (l - 0.5) / 0.5) * 0.5
    + (3 * ((l - 0.5) / 0.5) ** 2 - 2 * ((l - 0.5) / 0.5) ** 3) + (((l - 0.5) / 0.5) ** 3 - ((l - 0.5) / 0.5) ** 2) * 0.3 end as v from l), k as (select *, case when l > 1e-6 then v / l else 1 end as k from c)
  select image_id, y, x, round(r * k, 7) as r, round(g * k, 7) as g, round(b * k, 7) as b from k""")
def luminance_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(imaging.apply(_pixels(spark, folder), "curve", points=[(0.0, 0.0), (0.5, 0.7), (1.0, 1.0)]), 7)


@query(PIXEL_SQL + f""", h as (select image_id, y, x, {LUMA} as s from px), e as (select image_id, y, x, 0.2126 * (r + 0.1) + 0.7152 * (g + 0.1) + 0.0722 * (b + 0.1) as t from px)
  select h.image_id, h.y, h.x, round(log2(greatest(t, 1e-6) / greatest(s, 1e-6)), 6) as gain from h join e on h.image_id = e.image_id and h.y = e.y and h.x = e.x""")
def image_gain_map(spark: SparkSession, folder: str) -> DataFrame:
    sdr = _pixels(spark, folder)
    hdr = sdr.withColumns({c: F.col(c) + 0.1 for c in imaging.RGB})
    return imaging.gain_map(sdr, hdr).withColumn("gain", F.round("gain", 6))


@query(PIXEL_SQL + f"""select image_id, y, x, round(greatest(0, least(1, (1 - sqrt((x - 2) * (x - 2) + (y - 30) * (y - 30)) / 20.0) / 0.5)), 8) as radial, round(1 - greatest(0, least(1, (x * 6.0 + y * 60.0) / 3636.0)), 8) as linear,
    case when sqrt((x - 2) * (x - 2) + (y - 30) * (y - 30)) / 10.0 <= 1 then 1.0 else 0.0 end as disc,
    round(greatest(0, least(1, ({LUMA} - 0.3) / 0.1 + 1)) * greatest(0, least(1, (0.6 - {LUMA}) / 0.1 + 1)), 8) as luminance, case when x between 1 and 4 and y between 10 and 40 then 1.0 else 0.0 end as polygon from px""")
def image_masks(spark: SparkSession, folder: str) -> DataFrame:
    masks = {
        "radial": imaging.mask("radial", cx=2, cy=30, radius=20, feather=0.5), "linear": imaging.mask("linear", invert=True, x0=0, y0=0, x1=6, y1=60), "disc": imaging.mask("disc", cx=2, cy=30, radius=10),
        "luminance": imaging.mask("luminance", low=0.3, high=0.6, feather=0.1), "polygon": imaging.polygon_mask([(0.5, 9.5), (4.5, 9.5), (4.5, 40.5), (0.5, 40.5)]),
    }
    return _pixels(spark, folder).select("image_id", "y", "x", *(F.round(m, 8).alias(name) for name, m in masks.items()))


@query(PIXEL_SQL + """select image_id, y, x, round(-0.168736 * (r - 0.5) - 0.331264 * (g - 0.5) + 0.5 * (b - 0.5), 8) as cb, round(0.5 * (r - 0.5) - 0.418688 * (g - 0.5) - 0.081312 * (b - 0.5), 8) as cr from px""")
def chroma(spark: SparkSession, folder: str) -> DataFrame:
    cb, cr = colour.chroma(F.col("r"), F.col("g"), F.col("b"))
    return _pixels(spark, folder).select("image_id", "y", "x", F.round(cb, 8).alias("cb"), F.round(cr, 8).alias("cr"))


@query(PIXEL_SQL + f""", l as (select *, {LUMA} as l from px), n as (select a.image_id, a.y, a.x, case when count(b.l) = 4 then sum(b.l) - 4 * a.l end as v from l a left join l b on a.image_id = b.image_id
    and ((abs(a.x - b.x) = 1 and a.y = b.y) or (abs(a.y - b.y) = 1 and a.x = b.x)) group by 1, 2, 3, a.l)
  select image_id, round(stddev_pop(v), 6) as sharpness, round(avg(case when abs(v) > 0.05 then 1.0 when v is not null then 0.0 end), 6) as edge_density from n group by 1""")
def image_sharpness(spark: SparkSession, folder: str) -> DataFrame:
    return scopes.luma_stats(_pixels(spark, folder)).select("image_id", F.round("sharpness", 6).alias("sharpness"), F.round("edge_density", 6).alias("edge_density"))


@query(PIXEL_SQL + f"""{SIZES} select px.image_id, cast(floor(x * 3 / w) as integer) as col, round(avg(r), 10) as r, round(avg(g), 10) as g, round(avg(b), 10) as b from px join s on s.image_id = px.image_id group by 1, 2""")
def column_means(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(scopes.column_means(_pixels(spark, folder), 3), 10)
