"""Queries over polygons, analysis windows, clipped cells and certificates by error budget."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calls, stains
from ..functions.geometry import disc
from ..operators import certificate, membrane, proximity, regions, registration, stochastic, studies, voronoi, windows
from ..sources.adapters import POINTS_SQL, landmarks, marker, points, read
from .pair_queries import FIT
from .pattern_queries import BY, HEIGHT, N_PERM, RMAX, STEP, WIDTH, sides
from .registry import Catalogue

catalogue = Catalogue()
add = catalogue.add

# areas by layers from edges e(g, layer, x0, y0, x1, y1): slabs between corners and crossings, widths at mid height
SLABS_SQL = """up as (select g, layer, case when y0 < y1 then x0 else x1 end xa, least(y0, y1) ya, case when y0 < y1 then x1 else x0 end xb, greatest(y0, y1) yb, (x1 - x0) / (y1 - y0) s from e where y0 <> y1),
 hs as (select g, ya y from up union select g, yb from up union select p.g, ((q.xa - q.s * q.ya) - (p.xa - p.s * p.ya)) / (p.s - q.s) h from up p join up q on p.g = q.g and p.s <> q.s where h > greatest(p.ya, q.ya) and h < least(p.yb, q.yb)),
 sl as (select g, y, lead(y) over (partition by g order by y) top from hs),
 ct as (select sl.g, y, top, layer, xa + s * ((y + top) / 2 - ya) xm from sl join up on up.g = sl.g and ya <= y and yb >= top),
 pr as (select g, y, top, xm, lead(xm) over w nx, bit_xor(1::bigint << layer) over (partition by g, y order by xm, layer rows between unbounded preceding and current row) mask from ct window w as (partition by g, y order by xm, layer)),
 ar as (select g, mask, sum((nx - xm) * (top - y)) area from pr where mask <> 0 and nx is not null group by 1, 2)"""


def _fives(spark, sf_dir, name):
    """Rings of five points of a marker that follow each other, with a hole of 0.3 times their size."""
    k = F.row_number().over(Window.partitionBy("sample_id").orderBy("pt_id")) - 1
    p = marker(points(spark, sf_dir), name).withColumn("ring_id", F.floor(k / 5))
    by = ["sample_id", "ring_id"]
    ring = F.transform(F.sort_array(F.collect_list(F.struct("pt_id", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    r = p.groupBy(*by).agg(ring.alias("ring"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    hole = F.transform("ring", lambda c: F.struct((F.col("cx") + 0.3 * (c["x"] - F.col("cx"))).alias("x"), (F.col("cy") + 0.3 * (c["y"] - F.col("cy"))).alias("y")))
    return windows.ring_edges(r, by), windows.ring_edges(r.withColumn("ring", hole), by)


@add("polygon_overlay", f"""with {POINTS_SQL}, k as (select *, (row_number() over (partition by sample_id, marker order by pt_id) - 1) // 5 ring_id from points where marker in ('click', 'view')),
 c as (select *, avg(x) over v cx, avg(y) over v cy, count(*) over v n from k window v as (partition by sample_id, marker, ring_id)),
 r as (select * from c where n >= 3), p as (select sample_id, ring_id, marker, 0 part, pt_id, x, y from r union all select sample_id, ring_id, marker, 1, pt_id, cx + 0.3::double * (x - cx), cy + 0.3::double * (y - cy) from r where marker = 'click'),
 e as (select sample_id || '|' || ring_id g, case marker when 'click' then 0 else 1 end layer, x x0, y y0, coalesce(lead(x) over w, first_value(x) over w) x1, coalesce(lead(y) over w, first_value(y) over w) y1 from p window w as (partition by sample_id, ring_id, marker, part order by pt_id)),
 {SLABS_SQL}, s as (select g, coalesce(sum(area) filter (mask & 1 <> 0), 0) a, coalesce(sum(area) filter (mask & 2 <> 0), 0) b, coalesce(sum(area) filter (mask = 3), 0) i, sum(area) u from ar group by 1)
 select split_part(g, '|', 1) sample_id, split_part(g, '|', 2)::bigint ring_id, round(a, 3) area_a, round(b, 3) area_b, round(i, 3) intersection, round(u, 3) as "union", round(i / u, 9) iou, round(case when a > 0 then i / a else 0 end, 9) frac_a from s""")  # fmt: skip
def polygon_overlay(spark, sf_dir):
    """Rings of clicks with holes against rings of views, for every five of a day."""
    outer, hole = _fives(spark, sf_dir, "click")
    other, _ = _fives(spark, sf_dir, "view")
    out = windows.overlay(outer.unionByName(hole), other, ["sample_id", "ring_id"])
    return out.select("sample_id", "ring_id", *[F.round(c, 3).alias(c) for c in ("area_a", "area_b", "intersection", "union")], *[F.round(c, 9).alias(c) for c in ("iou", "frac_a")])


def _tissues(spark, sf_dir):
    """Points of each day, the outline of its clicks, that of its views taken over by the fitted similarity, and that of its purchases."""
    pts = points(spark, sf_dir)
    a, b, roi = (windows.outline(marker(pts, m), BY) for m in ("click", "view", "purchase"))
    fit = registration.similarity_fit(landmarks(spark, sf_dir), ["pair_id"]).where("a is not null").withColumnRenamed("pair_id", "sample_id")
    return pts, a, windows.transformed(b, windows.similarity_matrix(fit, BY), BY), roi


@add("analysis_window", f"""with {FIT}, ce as (select sample_id, marker, avg(x) cx, avg(y) cy from points where marker in ('click', 'view', 'purchase') group by 1, 2),
 se as (select p.*, power(x - cx, 2) + power(y - cy, 2) d2, least(floor((atan2(y - cy, x - cx) / 6.283185307179586::double + 0.5) * 32), 31) sector from points p join ce using (sample_id, marker)),
 fa as (select * from se qualify row_number() over (partition by sample_id, marker, sector order by d2 desc, x, y) = 1), fn as (select * from fa qualify count(*) over (partition by sample_id, marker) >= 3),
 mv as (select f.sample_id, marker, sector, case when marker = 'view' then a * x - b * y + tx else x end x, case when marker = 'view' then b * x + a * y + ty else y end y from fn f left join fit on pair_id = f.sample_id where marker <> 'view' or a is not null),
 e as (select sample_id g, case marker when 'click' then 0 when 'view' then 1 else 2 end layer, x x0, y y0, coalesce(lead(x) over w, first_value(x) over w) x1, coalesce(lead(y) over w, first_value(y) over w) y1 from mv window w as (partition by sample_id, marker order by sector)),
 {SLABS_SQL}, t as (select g, max(mask & 1) <> 0 has_a, max(mask & 4) <> 0 has_r, coalesce(sum(area) filter (mask & 1 <> 0), 0) a, coalesce(sum(area) filter (mask & 3 = 3), 0) ab, sum(area) filter (mask & 3 <> 0) o, coalesce(sum(area) filter (mask & 4 <> 0), 0) r, coalesce(sum(area) filter (mask & 5 = 5), 0) ar, coalesce(sum(area) filter (mask = 7), 0) abr from ar group by 1),
 bx as (select sample_id, (max(x) - min(x)) * (max(y) - min(y)) box from points group by 1),
 m as (select sample_id, box, t.*, coalesce(ab > 0, false) both_, coalesce(has_a, false) one, coalesce(has_r, false) roi from bx left join t on g = sample_id), z as (select *, case when both_ then case when roi then abr else ab end when one then case when roi then ar else a end when roi then r else box end size from m)
 select sample_id, case when roi and size <= 0 then null when both_ then case when roi then 'intersection_roi' else 'intersection' end when one then case when roi then 'a_only_roi' else 'a_only' end when roi then 'roi' else 'bbox' end as method,
 round(case when not (roi and size <= 0) then size end, 3) area, round(case when both_ then ab / o end, 9) iou, round(case when both_ then ab / a end, 9) frac_a, case when roi and size <= 0 then 'invalid_roi' end error from z""")  # fmt: skip
def analysis_window(spark, sf_dir):
    pts, a, b, roi = _tissues(spark, sf_dir)
    found, _ = windows.analysis_windows(pts, a, b, roi, BY)
    return found.select("sample_id", "method", F.round("area", 3).alias("area"), F.round("iou", 9).alias("iou"), F.round("frac_a", 9).alias("frac_a"), "error")


@add("window_points", f"""with {POINTS_SQL}, ce as (select sample_id, avg(x) cx, avg(y) cy from points where marker = 'purchase' group by 1),
 se as (select p.*, power(x - cx, 2) + power(y - cy, 2) d2, least(floor((atan2(y - cy, x - cx) / 6.283185307179586::double + 0.5) * 32), 31) sector from points p join ce using (sample_id) where marker = 'purchase'),
 fa as (select * from se qualify row_number() over (partition by sample_id, sector order by d2 desc, x, y) = 1), fn as (select * from fa qualify count(*) over (partition by sample_id) >= 3),
 e as (select sample_id, x x0, y y0, coalesce(lead(x) over w, first_value(x) over w) x1, coalesce(lead(y) over w, first_value(y) over w) y1 from fn window w as (partition by sample_id order by sector)),
 i as (select p.sample_id, p.marker, p.pt_id from points p join e on e.sample_id = p.sample_id and ((y0 > y) <> (y1 > y)) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 where p.marker in ('click', 'view') group by 1, 2, 3 having count(*) % 2 = 1)
 select sample_id, marker, count(*) n from i group by 1, 2""")  # fmt: skip
def window_points(spark, sf_dir):
    """Clicks and views within the outline of a day's purchases."""
    pts = points(spark, sf_dir)
    parts = windows.faces(windows.layered(BY, roi=windows.outline(marker(pts, "purchase"), BY)), BY)
    return windows.inside(pts.where("marker in ('click', 'view')"), parts, BY).groupBy("sample_id", "marker").agg(F.count(F.lit(1)).alias("n"))


@add("window_csr_null")
def window_csr_null(spark, sf_dir):
    """K under views uniform in each day's window."""
    pts, *layers = _tissues(spark, sf_dir)
    found, parts = windows.analysis_windows(pts, *layers, BY)
    parts = parts.checkpoint()
    a, b = (windows.inside(d, parts, BY).checkpoint() for d in sides(spark, sf_dir))
    return windows.csr_null(a, b, found, parts, BY, N_PERM, RMAX, STEP)


@add("window_dense_null")
def window_dense_null(spark, sf_dir):
    """K under views redrawn from a day's points with jitter, within its window."""
    pts, *layers = _tissues(spark, sf_dir)
    found, parts = windows.analysis_windows(pts, *layers, BY)
    parts = parts.checkpoint()
    a, b = (windows.inside(d, parts, BY).checkpoint() for d in sides(spark, sf_dir))
    return windows.support_null(a, b, pts.select("sample_id", "pt_id", "x", "y"), found, parts, BY, N_PERM, RMAX, STEP)


@add("voronoi_cells")
def voronoi_cells(spark, sf_dir):
    """Each click's disc of 25 um, cut by the bisectors of its neighbours."""
    a = marker(points(spark, sf_dir), "click").withColumn("ring", disc(F.col("x"), F.col("y"), 25.0, 24))
    out = voronoi.voronoi_cells(a, BY, 25.0 * 2**0.5)
    return out.select("sample_id", "pt_id", F.round("area", 3).alias("area"), F.size("ring").alias("corners"))


# moves that both engines can write down
MOVES_SQL = "moves as (select i perm_id, (i * 0.6180339887498949::double + 0.37) % 1 u, (i * 0.7548776662466927::double + 0.61) % 1 v from range(1000) t(i))"


@add("mnn_null", f"""with {POINTS_SQL}, a as (select * from points where marker = 'click'), b as (select * from points where marker = 'view'), {MOVES_SQL},
 ba as (select sample_id, min(x) ax0, max(x) ax1, min(y) ay0, max(y) ay1 from a group by 1), bb as (select sample_id, min(x) bx0, max(x) bx1, min(y) by0, max(y) by1 from b group by 1),
 room as (select sample_id, least(ax0, bx0) - bx0 tx, greatest(greatest(ax1, bx1) - least(ax0, bx0) - (bx1 - bx0), 0) sx, least(ay0, by0) - by0 ty, greatest(greatest(ay1, by1) - least(ay0, by0) - (by1 - by0), 0) sy from ba join bb using (sample_id)),
 mv as (select sample_id, perm_id, pt_id, x + tx + u * sx x, y + ty + v * sy y from b join room using (sample_id) cross join moves union all select b.sample_id, -1, pt_id, x, y from b join room using (sample_id)),
 pr as (select a.sample_id, perm_id, a.pt_id p, mv.pt_id q, sqrt((a.x - mv.x) * (a.x - mv.x) + (a.y - mv.y) * (a.y - mv.y)) d from a join mv on a.sample_id = mv.sample_id and sqrt((a.x - mv.x) * (a.x - mv.x) + (a.y - mv.y) * (a.y - mv.y)) <= 20),
 mu as (select sample_id, perm_id from pr qualify row_number() over (partition by sample_id, perm_id, p order by d, q) = 1 and row_number() over (partition by sample_id, perm_id, q order by d, p) = 1),
 ct as (select r.sample_id, i.perm_id, count(m.perm_id) n from room r cross join (select perm_id from moves union all select -1) i left join mu m on m.sample_id = r.sample_id and m.perm_id = i.perm_id group by 1, 2),
 ob as (select sample_id, n observed from ct where perm_id = -1) select sample_id, observed, round(avg(n), 9) null_mean, round(stddev_pop(n), 9) null_std, (1 + count(*) filter (n >= observed)) / (1 + count(*))::double p, count(*) n_perm, round(case when stddev_pop(n) > 0 then (observed - avg(n)) / stddev_pop(n) end, 6) z from ct join ob using (sample_id) where perm_id >= 0 group by 1, 2""")  # fmt: skip
def mnn_null(spark, sf_dir):
    """Mutual nearest clicks and views within 20 um against 1,000 rigid moves of the views."""
    i = F.col("id")
    moves = spark.range(N_PERM).select(i.alias("perm_id"), F.expr("pmod(id * 0.6180339887498949D + 0.37, 1D)").alias("u"), F.expr("pmod(id * 0.7548776662466927D + 0.61, 1D)").alias("v"))
    out = proximity.mutual_null(*sides(spark, sf_dir), moves, BY, 20.0)
    return out.select("sample_id", "observed", F.round("null_mean", 9).alias("null_mean"), F.round("null_std", 9).alias("null_std"), "p", "n_perm", F.round("z", 6).alias("z"))


@add("certify_fitzpatrick_west")
def certify_fitzpatrick_west(spark, sf_dir):
    """The certificate of each day's landmarks at 0.5 um a pixel, with the localisation error measured on them."""
    lm, by = landmarks(spark, sf_dir), ["pair_id"]
    fle = registration.measured_error(lm, registration.residuals(lm, registration.similarity_fit(lm, by), by), by, 0.5)
    return certificate.fitzpatrick_west(lm, fle, by, 0.5, WIDTH, HEIGHT)


@add("roi_constraint", f"""with {POINTS_SQL}, ce as (select sample_id, avg(x) cx, avg(y) cy from points where marker = 'purchase' group by 1),
 se as (select p.*, power(x - cx, 2) + power(y - cy, 2) d2, least(floor((atan2(y - cy, x - cx) / 6.283185307179586::double + 0.5) * 32), 31) sector from points p join ce using (sample_id) where marker = 'purchase'),
 fa as (select * from se qualify row_number() over (partition by sample_id, sector order by d2 desc, x, y) = 1), fn as (select * from fa qualify count(*) over (partition by sample_id) >= 3),
 e as (select sample_id g, 0 layer, x x0, y y0, coalesce(lead(x) over w, first_value(x) over w) x1, coalesce(lead(y) over w, first_value(y) over w) y1 from fn window w as (partition by sample_id order by sector)), {SLABS_SQL},
 t as (select sample_id, coalesce(f.area, 0) / 490000.0::double f from (select distinct sample_id from points) left join (select g, sum(area) area from ar group by 1) f on g = sample_id) select sample_id, case when f < 0.7 then 'NOT_CERTIFIABLE' else 'CERTIFIED' end verdict, round(f, 9) window_frac from t""")  # fmt: skip
def roi_constraint(spark, sf_dir):
    """A certificate of every day held against the outline of its purchases, at a share of 0.7 of the field."""
    pts = points(spark, sf_dir)
    parts = windows.faces(windows.layered(BY, roi=windows.outline(marker(pts, "purchase"), BY)), BY).groupBy(*BY).agg(F.sum("area").alias("area"))
    out = windows.constrained(pts.select(*BY).distinct().withColumn("verdict", F.lit("CERTIFIED")), parts, BY, WIDTH * HEIGHT, 0.7)
    return out.withColumn("window_frac", F.round("window_frac", 9))


def _csr(n_perm):
    return lambda a, b, by: stochastic.csr_null(a, b, by, WIDTH, HEIGHT, n_perm, RMAX, STEP)


@add("swapped_sections")
def swapped_sections(spark, sf_dir):
    """Every day's clicks against the views of the next day, 1,000 permutations."""
    a, b = sides(spark, sf_dir)
    return studies.run_tests(a, studies.swapped(b, "sample_id"), BY, WIDTH * HEIGHT, _csr(N_PERM), RMAX, STEP)


@add("warp_stability")
def warp_stability(spark, sf_dir):
    """The verdict of each day under 50 transforms within the error of its landmarks, 99 permutations each."""
    a, b = sides(spark, sf_dir)
    lm = landmarks(spark, sf_dir)
    error = registration.landmark_noise(registration.residuals(lm, registration.similarity_fit(lm, ["pair_id"]), ["pair_id"]), ["pair_id"]).where("sigma is not null").withColumnRenamed("pair_id", "sample_id")
    return studies.stability(a, b, BY, error, (WIDTH, HEIGHT), 50, _csr(99), RMAX, STEP)


@add("warp_recovery")
def warp_recovery(spark, sf_dir):
    """The verdict of each day with its views turned by two degrees and shifted by 5 um, beside the one without."""
    a, b = sides(spark, sf_dir)
    warped = stochastic.rotated(b, 2.0, 5.0, 0.0, WIDTH / 2, HEIGHT / 2)
    tests = [studies.run_tests(a, d, BY, WIDTH * HEIGHT, _csr(199), RMAX, STEP) for d in (b, warped)]
    return studies.same_verdict(*tests, BY)


@add("support_field_null")
def support_field_null(spark, sf_dir):
    """K under views redrawn from the smoothed field of all points of a day."""
    a, b = sides(spark, sf_dir)
    field = stochastic.intensity_grid(points(spark, sf_dir), BY, WIDTH, HEIGHT, 25.0, 50.0)
    return stochastic.field_null(a, b, field, BY, WIDTH, HEIGHT, 25.0, N_PERM, RMAX, STEP)


@add("stain_unmixing", """with p as (select l_orderkey * 10 + l_linenumber px, l_partkey % 256 r, l_suppkey * 7 % 256 g, l_quantity * 5 b from lineitem),
 o as (select px, -log10((r + 1.0::double) / 250) x, -log10((g + 1.0::double) / 245) y, -log10((b + 1.0::double) / 240) z from p), v as (select [0.65::double, 0.70, 0.29] p, [0.27::double, 0.57, 0.78] q, [0.71::double, 0.42, 0.56] s),
 u as (select list_transform(p, lambda t: t / sqrt(list_sum(list_transform(p, lambda w: w * w)))) p, list_transform(q, lambda t: t / sqrt(list_sum(list_transform(q, lambda w: w * w)))) q, list_transform(s, lambda t: t / sqrt(list_sum(list_transform(s, lambda w: w * w)))) s from v),
 d as (select *, p[1] * (q[2] * s[3] - q[3] * s[2]) - p[2] * (q[1] * s[3] - q[3] * s[1]) + p[3] * (q[1] * s[2] - q[2] * s[1]) det from u)
 select px, round((x * (q[2] * s[3] - q[3] * s[2]) + y * (q[3] * s[1] - q[1] * s[3]) + z * (q[1] * s[2] - q[2] * s[1])) / det, 9) hema, round((x * (p[3] * s[2] - p[2] * s[3]) + y * (p[1] * s[3] - p[3] * s[1]) + z * (p[2] * s[1] - p[1] * s[2])) / det, 9) dab from o, d""")  # fmt: skip
def stain_unmixing(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("px"), (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") * 7 % 256).alias("g"), (F.col("l_quantity") * 5).alias("b"))
    hema, dab, _ = stains.unmixed((F.col("r"), F.col("g"), F.col("b")), ((0.65, 0.70, 0.29), (0.27, 0.57, 0.78), (0.71, 0.42, 0.56)), (250.0, 245.0, 240.0))
    return li.select("px", F.round(hema, 9).alias("hema"), F.round(dab, 9).alias("dab"))


@add("membrane_cutoffs")
def membrane_cutoffs(spark, sf_dir):
    """Suppliers stand in for labelled cells, their line items for ring pixels; a nation is a marker."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_idx"), F.col("s_nationkey").alias("marker"), F.col("s_suppkey").alias("image"), (F.col("s_acctbal") > 4500).cast("int").alias("label"))
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell_idx"), (F.col("l_extendedprice") / 100000).alias("dab"), (F.col("l_tax") * 5).alias("hema"))
    return membrane.fit_membrane(s.join(li, "cell_idx"), ["marker"])


@add("local_region")
def local_region(spark, sf_dir):
    """The region of each day whose landmarks certify by themselves, at 0.5 um a pixel."""
    return regions.local_region(landmarks(spark, sf_dir), ["pair_id"], 0.5, WIDTH, HEIGHT)


@add("certified_tiles")
def certified_tiles(spark, sf_dir):
    return regions.certified_tiles(landmarks(spark, sf_dir), ["pair_id"], 0.5, WIDTH, HEIGHT, sizes=(120.0, 90.0, 60.0))


@add("grid_seed", f"""with {POINTS_SQL}, r as (select * from points where marker = 'click'), d as (select k, [-6, -3, 0, 3, 6][k + 1]::double deg from range(5) t(k)),
 m as (select sample_id, pt_id, k, deg, cos(radians(deg)) * (x - 245) - sin(radians(deg)) * (y - 500) + 245 x, sin(radians(deg)) * (x - 245) + cos(radians(deg)) * (y - 500) + 500 y from points cross join d where marker = 'view'),
 s as (select i, j, i * 10.0::double - 40 dx, j * 10.0::double - 40 dy from range(9) a(i), range(9) b(j)),
 h as (select distinct m.sample_id, k, deg, i, j, dx, dy, m.pt_id from m join r on r.sample_id = m.sample_id and abs(r.x - m.x) <= 48 and abs(r.y - m.y) <= 48 join s on (r.x - m.x - dx) * (r.x - m.x - dx) + (r.y - m.y - dy) * (r.y - m.y - dy) <= 64),
 c as (select sample_id, k, deg, i, j, dx, dy, count(*) hits from h group by all) select sample_id, deg as degrees, dx, dy, hits from c qualify row_number() over (partition by sample_id order by hits desc, k, i, j) = 1""")  # fmt: skip
def grid_seed(spark, sf_dir):
    """The turn and shift that bring most views of a day within 8 um of a click."""
    a, b = sides(spark, sf_dir)
    return regions.grid_seed(a, b, BY, (WIDTH / 2, HEIGHT / 2), 8.0, 40.0, 10.0)


@add("spatial_batch")
def spatial_batch(spark, sf_dir):
    """Clicks against views of every day, in the day's window, behind the state of its registration and its certificate."""
    from . import workflows

    pts, *layers = _tissues(spark, sf_dir)
    found, parts = windows.analysis_windows(pts, *layers, BY)
    lm, by = landmarks(spark, sf_dir), ["pair_id"]
    state = registration.residuals(lm, registration.similarity_fit(lm, by), by).groupBy("pair_id").agg(calls.registration_status(F.lit("features"), F.percentile("err", 0.5) * 0.5, F.lit(1.0)).alias("qc"))
    gates = state.join(registration.certify(lm, by, 0.5, WIDTH, HEIGHT).select("pair_id", "verdict"), by, "full_outer").withColumnRenamed("pair_id", "sample_id")
    pairs = pts.select(*BY).distinct().join(gates, BY, "left").select(*BY, F.lit("click").alias("a"), F.lit("view").alias("b"), "qc", "verdict")
    return workflows.spatial_batch(pts, pairs, found, parts, BY, N_PERM, RMAX, STEP)
