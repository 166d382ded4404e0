"""Point-pattern queries over days of events (click = A, view = B, purchase = C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import envelopes, point_pattern, proximity, stochastic
from ..sources.adapters import POINTS_SQL, marker, points
from .registry import Catalogue

catalogue = Catalogue()
add = catalogue.add

WIDTH, HEIGHT = 490.0, 1000.0
BY = ["sample_id"]
#: Permutations and radii (0 to RMAX by STEP) of the Monte-Carlo queries, as in production.
N_PERM, RMAX, STEP = 1000, 100.0, 2.0


def sides(spark, sf_dir, a="click", b="view"):
    pts = points(spark, sf_dir)
    return marker(pts, a), marker(pts, b)


AB = f"""{POINTS_SQL}, a as (select * from points where marker = 'click'), b as (select * from points where marker = 'view'),
radii as (select i::int r_idx, i * 2.0::double r from range(51) t(i)),
sizes as (select coalesce(x.sample_id, y.sample_id) sample_id, coalesce(n_a, 0) n_a, coalesce(n_b, 0) n_b from
  (select sample_id, count(*) n_a from a group by 1) x full join (select sample_id, count(*) n_b from b group by 1) y on x.sample_id = y.sample_id),
pairs as (select a.sample_id, a.pt_id a_id, b.pt_id b_id, a.x ax, a.y ay, b.x bx, b.y by_,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d from a join b on a.sample_id = b.sample_id
  where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 100)"""
COUNTS = """counts as (select s.sample_id, r.r_idx, r.r, count(p.d) pairs, any_value(n_a) n_a, any_value(n_b) n_b from sizes s cross join radii r
  left join pairs p on p.sample_id = s.sample_id and p.d <= r.r group by 1, 2, 3)"""
K = """curve as (select sample_id, r_idx, r, pairs, case when n_a * n_b = 0 then 0 else 490000.0::double / (n_a * n_b) * pairs end k from counts)"""


@add("pair_counts", f"with {AB}, {COUNTS} select sample_id, r_idx, r, pairs from counts")
def pair_counts(spark, sf_dir):
    return point_pattern.pair_counts(*sides(spark, sf_dir), BY)


@add("cross_k_daily", f"""with {AB}, {COUNTS}, {K} select sample_id, r_idx, r, pairs, k, sqrt(k / pi()) - r lmr,
  case when r > 0 then (case when lead(k) over w is null then (k - lag(k) over w) / 2 else (lead(k) over w - lag(k) over w) / 4 end) / (2 * pi() * r) end g
  from curve window w as (partition by sample_id order by r_idx)""")  # fmt: skip
def cross_k_daily(spark, sf_dir):
    return point_pattern.cross_k(*sides(spark, sf_dir), BY, WIDTH * HEIGHT)


@add("pcf_g", f"""with {AB}, {COUNTS}, {K} select sample_id, r_idx, (case when lead(k) over w is null then (k - lag(k) over w) / 2 else (lead(k) over w - lag(k) over w) / 4 end) / (2 * pi() * r) g
  from curve window w as (partition by sample_id order by r_idx) qualify r > 0""")  # fmt: skip
def pcf_g(spark, sf_dir):
    return point_pattern.cross_k(*sides(spark, sf_dir), BY, WIDTH * HEIGHT).where("r > 0").select("sample_id", "r_idx", "g")


@add("cross_k_torus", f"""with {POINTS_SQL}, a as (select * from points where marker = 'click'), b as (select * from points where marker = 'view'),
  radii as (select i::int r_idx, i * 2.0::double r from range(51) t(i)), n as (select sample_id, count(*) filter (marker = 'click') n_a, count(*) filter (marker = 'view') n_b from points where marker in ('click', 'view') group by 1),
  d as (select a.sample_id, sqrt(power(least(abs(a.x - b.x), 490 - abs(a.x - b.x)), 2) + power(least(abs(a.y - b.y), 1000 - abs(a.y - b.y)), 2)) d from a join b using (sample_id))
  select n.sample_id, r_idx, r, case when any_value(n_a) * any_value(n_b) = 0 then 0 else 490000.0::double / (any_value(n_a) * any_value(n_b)) * count(d.d) end k
  from n cross join radii left join d on d.sample_id = n.sample_id and d.d <= r group by 1, 2, 3""")  # fmt: skip
def cross_k_torus(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return point_pattern.cross_k_torus(a, b, BY, WIDTH, HEIGHT)


@add("cross_k_edge", f"""with {AB} select s.sample_id, r_idx, r, round(case when any_value(n_a) * any_value(n_b) = 0 then 0 else 490000.0::double / (any_value(n_a) * any_value(n_b))
  * coalesce(sum(490000.0::double / (greatest(490 - abs(ax - bx), 1e-9) * greatest(1000 - abs(ay - by_), 1e-9))) filter (d is not null), 0) end, 6) k
  from sizes s cross join radii left join pairs p on p.sample_id = s.sample_id and p.d <= r group by 1, 2, 3""")  # fmt: skip
def cross_k_edge(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return point_pattern.cross_k_translated(a, b, BY, WIDTH, HEIGHT).withColumn("k", F.round("k", 6))


LAM = """lam_{0} as (select p.sample_id, p.pt_id, case when any_value(n) <= 1 then greatest(any_value(n) / 490000.0::double, 0.02::double * any_value(n) / 490000.0::double)
  else greatest(coalesce(sum(exp(-(power(p.x - q.x, 2) + power(p.y - q.y, 2)) / (2 * 75 * 75)) / (2 * pi() * 75 * 75)), 0), 0.02::double * any_value(n) / 490000.0::double) end lam
  from {0} p join (select sample_id, count(*) n from {0} group by 1) using (sample_id)
  left join {0} q on p.sample_id = q.sample_id and p.pt_id <> q.pt_id and sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) <= 300 group by 1, 2)"""


@add("loo_intensity", f"with {AB}, {LAM.format('a')} select sample_id, pt_id, round(lam, 12) lam from lam_a")
def loo_intensity(spark, sf_dir):
    a, _ = sides(spark, sf_dir)
    return point_pattern.loo_intensity(a, BY, 75.0, WIDTH * HEIGHT).withColumn("lam", F.round("lam", 12))


@add("cross_k_inhom", f"""with {AB}, {LAM.format('a')}, {LAM.format('b')}, w as (select p.sample_id, p.d, 1 / (la.lam * lb.lam) w from pairs p join lam_a la on la.sample_id = p.sample_id and la.pt_id = a_id
  join lam_b lb on lb.sample_id = p.sample_id and lb.pt_id = b_id) select s.sample_id, r_idx, r, round(coalesce(sum(w), 0) / 490000.0::double, 4) k from sizes s cross join radii left join w on w.sample_id = s.sample_id and w.d <= r group by 1, 2, 3""")  # fmt: skip
def cross_k_inhom(spark, sf_dir):
    return point_pattern.cross_k_inhomogeneous(*sides(spark, sf_dir), BY, 75.0, WIDTH * HEIGHT).withColumn("k", F.round("k", 4))


# shifts that both engines can write down: a permutation's shift is a multiple of an irrational-like step
SHIFTS_SQL = "shifts as (select i::bigint perm_id, (i * 137.5::double + 61) % 490 dx, (i * 271.25::double + 97) % 1000 dy from range(1000) t(i))"


def _shifts(spark):
    return spark.range(N_PERM).select(F.col("id").alias("perm_id"), F.expr("pmod(id * 137.5D + 61, 490D)").alias("dx"), F.expr("pmod(id * 271.25D + 97, 1000D)").alias("dy"))


NULL_SQL = f"""{AB}, {COUNTS}, {K}, {SHIFTS_SQL}, moved as (select sample_id, perm_id, (x + dx) % 490 x, (y + dy) % 1000 y from b cross join shifts),
 hits as (select a.sample_id, perm_id, sqrt((a.x - m.x) * (a.x - m.x) + (a.y - m.y) * (a.y - m.y)) d from a join moved m on a.sample_id = m.sample_id where sqrt((a.x - m.x) * (a.x - m.x) + (a.y - m.y) * (a.y - m.y)) <= 100),
 bucket as (select sample_id, perm_id, ceil(d / 2)::int r_idx, count(*) c from hits group by 1, 2, 3),
 both_ as (select * from sizes where n_a > 0 and n_b > 0),
 null_k as (select s.sample_id, perm_id, r_idx, r, 490000.0::double / (n_a * n_b) * sum(coalesce(c, 0)) over (partition by s.sample_id, perm_id order by r_idx) k
   from both_ s cross join shifts cross join radii left join bucket using (sample_id, perm_id, r_idx)),
 obs as (select c.sample_id, c.r_idx, c.r, c.k from curve c join both_ using (sample_id))"""


def _null(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    both = a.select("sample_id").distinct().join(b.select("sample_id").distinct(), "sample_id")
    a, b = a.join(both, "sample_id", "left_semi"), b.join(both, "sample_id", "left_semi")
    null = point_pattern.toroidal_null(a, b, _shifts(spark), BY, WIDTH, HEIGHT, RMAX, STEP)
    return null, point_pattern.cross_k(a, b, BY, WIDTH * HEIGHT, RMAX, STEP).select("sample_id", "r_idx", "r", "k")


@add("toroidal_null", f"with {NULL_SQL} select sample_id, perm_id, r_idx, r, k from null_k")
def toroidal_null(spark, sf_dir):
    return _null(spark, sf_dir)[0]


@add("null_envelope", f"""with {NULL_SQL}, j as (select n.sample_id, n.r_idx, n.k, o.k k_obs, sqrt(n.k / pi()) - n.r l from null_k n join obs o using (sample_id, r_idx))
  select sample_id, r_idx, round(avg(k), 6) mean_k, round(quantile_cont(k, 0.025), 6) lo_k, round(quantile_cont(k, 0.975), 6) hi_k, round(quantile_cont(l, 0.025), 6) lo_l, round(quantile_cont(l, 0.975), 6) hi_l,
  (1 + count(*) filter (k >= k_obs)) / (1 + count(*))::double p from j group by 1, 2""")  # fmt: skip
def null_envelope(spark, sf_dir):
    null, obs = _null(spark, sf_dir)
    out = envelopes.envelope(null, obs, BY)
    return out.select("sample_id", "r_idx", *[F.round(c, 6).alias(c) for c in ("mean_k", "lo_k", "hi_k", "lo_l", "hi_l")], "p")


DCLF = """pool as (select sample_id, perm_id + 1 perm_id, r_idx, r, sqrt(k / pi()) - r l from null_k union all select sample_id, 0, r_idx, r, sqrt(k / pi()) - r from obs),
 bands as (select * from (values {0}) t(band, lo, hi)), inb as (select p.*, band, l - avg(l) over (partition by sample_id, band, r_idx) dev from pool p cross join bands where r between lo and hi),
 u as (select sample_id, band, perm_id, sum(dev * dev) two, sum(case when dev > 0 then dev * dev else 0 end) pos, sum(case when dev < 0 then dev * dev else 0 end) neg, arg_max(r, {{'l': l, 'i': -r_idx}}) peak from inb group by 1, 2, 3),
 tie as (select sample_id, band, 1e-9::double * max(two) e from u group by 1, 2),
 ranked as (select u.sample_id, u.band, (1 + count(*) filter (u.two >= o.two - e)) / (1 + count(*))::double p_two, (1 + count(*) filter (u.pos >= o.pos - e)) / (1 + count(*))::double p_assoc,
  (1 + count(*) filter (u.neg >= o.neg - e)) / (1 + count(*))::double p_seg, any_value(o.peak) peak_r from u join u o on o.sample_id = u.sample_id and o.band = u.band and o.perm_id = 0 join tie on tie.sample_id = u.sample_id and tie.band = u.band where u.perm_id > 0 group by 1, 2)
 select sample_id, band, p_two, p_assoc, p_seg, peak_r, p_two < 0.05 significant, case when p_two >= 0.05 then 'none' when p_assoc <= p_seg then 'association' else 'segregation' end direction from ranked"""


@add("dclf_global", f"with {NULL_SQL}, {DCLF.format(chr(40) + chr(39) + 'all' + chr(39) + ', 10.0::double, 50.0::double)')}".replace("{{", "{").replace("}}", "}"))
def dclf_global(spark, sf_dir):
    null, obs = _null(spark, sf_dir)
    return envelopes.global_test(null, obs, BY, {"all": (10.0, 50.0)})


@add("dclf_bands", f"with {NULL_SQL}, {DCLF.format(chr(40) + chr(39) + 'coloc' + chr(39) + ', 10.0::double, 20.0::double), (' + chr(39) + 'coinfil' + chr(39) + ', 20.0::double, 50.0::double)')}".replace("{{", "{").replace("}}", "}"))
def dclf_bands(spark, sf_dir):
    null, obs = _null(spark, sf_dir)
    return envelopes.global_test(null, obs, BY, {"coloc": (10.0, 20.0), "coinfil": (20.0, 50.0)})


NN = """nn as (select a.sample_id, a.pt_id a_id, b.pt_id b_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d from a join b on a.sample_id = b.sample_id),
 fwd as (select * from nn qualify row_number() over (partition by sample_id, a_id order by d, b_id) = 1), bwd as (select * from nn qualify row_number() over (partition by sample_id, b_id order by d, a_id) = 1)"""


@add("nn1", f"with {AB}, {NN} select sample_id, a_id, b_id, d from fwd")
def nn1(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return proximity.nearest(a, b, BY, 25.0)


@add("mutual_nn", f"with {AB}, {NN} select sample_id, a_id, b_id, d from fwd join bwd using (sample_id, a_id, b_id, d) where d <= 30")
def mutual_nn(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return proximity.mutual_nearest(a, b, BY, 30.0)


@add("range_pairs", f"with {AB} select sample_id, a_id, b_id, d from pairs where d <= 15")
def range_pairs(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return proximity.range_join(a, b, 15.0, BY).select("sample_id", "a_id", "b_id", "d")


@add("self_range_pairs", f"with {AB} select a.sample_id, a.pt_id a_id, o.pt_id b_id, sqrt((a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y)) d from a join a o on a.sample_id = o.sample_id and a.pt_id < o.pt_id where sqrt((a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y)) <= 15")
def self_range_pairs(spark, sf_dir):
    a, _ = sides(spark, sf_dir)
    return proximity.self_range_join(a, 15.0, BY).select("sample_id", "a_id", "b_id", "d")


@add("greedy_nn_match", f"""with {AB}, offers as (select * from pairs where d <= 20 qualify row_number() over (partition by sample_id, a_id order by d, b_id) = 1)
  select sample_id, a_id, b_id, d from offers qualify row_number() over (partition by sample_id, b_id order by d, a_id) = 1""")  # fmt: skip
def greedy_nn_match(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return proximity.nearest_match(a, b, BY, 20.0)


@add("greedy_all_match")
def greedy_all_match(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return proximity.greedy_match(a, b, BY, 20.0)


@add("displacement_agreement", f"""with {AB}, x as (select *, x * 0.01::double dx, y * 0.01::double dy from a), t as (select *, x * 0.01::double dx, y * 0.01::double dy from b),
  near as (select p.*, t.dx tx, t.dy ty from x p join t on p.sample_id = t.sample_id where sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) <= 40
  qualify row_number() over (partition by p.sample_id, p.pt_id order by sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)), t.pt_id) = 1)
  select sample_id, pt_id, dx, dy from near where sqrt((dx - tx) * (dx - tx) + (dy - ty) * (dy - ty)) <= 0.2""")  # fmt: skip
def displacement_agreement(spark, sf_dir):
    a, b = (p.withColumn("dx", F.col("x") * 0.01).withColumn("dy", F.col("y") * 0.01) for p in sides(spark, sf_dir))
    return proximity.agreeing(a, b, BY, 40.0, 0.2).select("sample_id", "pt_id", "dx", "dy")


# a square with a square hole
RING = [(50.0, 100.0, 400.0, 100.0), (400.0, 100.0, 420.0, 900.0), (420.0, 900.0, 60.0, 880.0), (60.0, 880.0, 50.0, 100.0), (150.0, 300.0, 300.0, 300.0), (300.0, 300.0, 300.0, 600.0), (300.0, 600.0, 150.0, 600.0), (150.0, 600.0, 150.0, 300.0)]
EDGES_SQL = "edges as (select * from (values " + ", ".join(f"({', '.join(f'{v}::double' for v in e)})" for e in RING) + ") t(x0, y0, x1, y1))"


@add("point_in_polygon", f"""with {POINTS_SQL}, {EDGES_SQL} select sample_id, pt_id from points cross join edges
  where ((y0 > y) <> (y1 > y)) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 group by 1, 2 having count(*) % 2 = 1""")  # fmt: skip
def point_in_polygon(spark, sf_dir):
    pts = points(spark, sf_dir)
    ring = spark.createDataFrame(RING, "x0 double, y0 double, x1 double, y1 double")
    edges = pts.select("sample_id").distinct().crossJoin(F.broadcast(ring))
    return proximity.points_in_rings(pts, edges, BY).select("sample_id", "pt_id")


@add("planar_partition", f"""with {POINTS_SQL}, reg as (select * from (values (0, 0, 200, 0, 500), (1, 100, 300, 300, 800), (2, 150, 450, 100, 600)) t(region, x0, x1, y0, y1)),
  m as (select sample_id, pt_id, bit_or(1::bigint << region) mask from points cross join reg where x between x0 and x1 and y between y0 and y1 group by 1, 2) select sample_id, mask, count(*) n from m group by 1, 2""")  # fmt: skip
def planar_partition(spark, sf_dir):
    from ..operators.matching import tissue_faces

    pts = points(spark, sf_dir)
    reg = spark.createDataFrame([(0, 0, 200, 0, 500), (1, 100, 300, 300, 800), (2, 150, 450, 100, 600)], "region int, x0 int, x1 int, y0 int, y1 int")
    return tissue_faces(pts, pts.select("sample_id").distinct().crossJoin(F.broadcast(reg)), BY)


@add("bbox_area", f"with {POINTS_SQL} select sample_id, (max(x) - min(x)) * (max(y) - min(y)) area, count(*) n from points group by 1")
def bbox_area(spark, sf_dir):
    return point_pattern.bounding_box(points(spark, sf_dir), BY)


@add("toroid_wrap", f"with {POINTS_SQL} select sample_id, pt_id, (x + 123.5::double) % 490 x, (y + 710.25::double) % 1000 y from points")
def toroid_wrap(spark, sf_dir):
    from ..functions.geometry import wrap

    return points(spark, sf_dir).select("sample_id", "pt_id", wrap(F.col("x"), 123.5, 0.0, WIDTH).alias("x"), wrap(F.col("y"), 710.25, 0.0, HEIGHT).alias("y"))


@add("curve_sample", f"""with {AB}, {COUNTS}, {K}, t as (select unnest([15.0, 30.0, 50.0])::double target) select sample_id, target, arg_min(sqrt(k / pi()) - r, {{'d': abs(r - target), 'r': r}}) lmr from curve cross join t group by 1, 2""")
def curve_sample(spark, sf_dir):
    from ..operators.aggregates import curve_at

    return curve_at(point_pattern.cross_k(*sides(spark, sf_dir), BY, WIDTH * HEIGHT), BY, [15.0, 30.0, 50.0], "lmr")


@add("mean_curve", f"with {AB}, {COUNTS}, {K} select r_idx, round(avg(sqrt(k / pi()) - r), 9) lmr, count(*) n from curve group by 1")
def mean_curve(spark, sf_dir):
    return point_pattern.cross_k(*sides(spark, sf_dir), BY, WIDTH * HEIGHT).groupBy("r_idx").agg(F.round(F.avg("lmr"), 9).alias("lmr"), F.count(F.lit(1)).alias("n"))


@add("qualifying_groups", f"with {POINTS_SQL} select sample_id, count(*) filter (marker = 'click') n_click, count(*) filter (marker = 'view') n_view from points group by 1 having n_click >= 60 and n_view >= 60")
def qualifying_groups(spark, sf_dir):
    from ..operators.aggregates import qualifying

    return qualifying(points(spark, sf_dir), BY, "marker", ["click", "view"], 60)


@add("csr_null")
def csr_null(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return stochastic.csr_null(a, b, BY, WIDTH, HEIGHT, N_PERM, RMAX, STEP)


@add("kde_null")
def kde_null(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return stochastic.kde_null(a, b, BY, WIDTH, HEIGHT, N_PERM, RMAX, STEP)


@add("dense_null")
def dense_null(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return stochastic.support_null(a, b, points(spark, sf_dir), BY, WIDTH, HEIGHT, N_PERM, RMAX, STEP)


@add("tile_null")
def tile_null(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return stochastic.tile_null(a, b, BY, WIDTH, HEIGHT, 50.0, N_PERM, RMAX, STEP)


@add("arch_scale")
def arch_scale(spark, sf_dir):
    return stochastic.architecture_scale(points(spark, sf_dir), ["sample_id", "marker"], WIDTH, HEIGHT)


GRID_SQL = """kn as (select i::bigint i, j::bigint j, exp(-((i * i + j * j) * 625.0::double) / 5000.0::double) w from range(-8, 9) a(i), range(-8, 9) b(j)), kt as (select sum(w) s from kn),
 bn as (select marker, sample_id, floor(x / 25)::bigint bx, floor(y / 25)::bigint by_, count(*) c from points group by 1, 2, 3, 4),
 sp as (select marker, sample_id, bx + i gx, by_ + j gy, sum(c * w / s) / 625.0::double v from bn, kn, kt where bx + i between 0 and 19 and by_ + j between 0 and 40 group by 1, 2, 3, 4),
 gr as (select marker, sample_id, gx, gy, greatest(v, 0.02::double * avg(v) over (partition by marker, sample_id)) lam from sp)"""


@add("intensity_grid", f"with {POINTS_SQL}, {GRID_SQL} select sample_id, gx, gy, round(lam, 12) lam from gr where marker = 'click'")
def intensity_grid(spark, sf_dir):
    return stochastic.intensity_grid(marker(points(spark, sf_dir), "click"), BY, WIDTH, HEIGHT, 25.0, 50.0).withColumn("lam", F.round("lam", 12))


@add("intensity_at", f"with {POINTS_SQL}, {GRID_SQL} select p.sample_id, pt_id, round(lam, 12) lam from points p left join (select * from gr where marker = 'click') g on g.sample_id = p.sample_id and gx = floor(x / 25) and gy = floor(y / 25) where p.marker = 'view'")
def intensity_at(spark, sf_dir):
    """The intensity of clicks at every view."""
    a, b = sides(spark, sf_dir)
    grid = stochastic.intensity_grid(a, BY, WIDTH, HEIGHT, 25.0, 50.0)
    return point_pattern.intensity_at(b, grid, BY, 25.0).withColumn("lam", F.round("lam", 12))


@add("verdict_table")
def verdict_table(spark, sf_dir):
    """The association workflow: CSR baseline and support null, two bands, robustness and cohort FDR for each day."""
    from .workflows import association

    a, b = sides(spark, sf_dir)
    return association(a, b, points(spark, sf_dir), BY, WIDTH, HEIGHT, N_PERM, RMAX, STEP)


@add("reweighted_null")
def reweighted_null(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return stochastic.reweighted_null(a, b, BY, WIDTH, HEIGHT, N_PERM, RMAX, STEP)


@add("kde_sweep")
def kde_sweep(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return stochastic.kde_sweep(a, b, BY, WIDTH, HEIGHT, N_PERM, RMAX, STEP)


@add("bandwidth_precheck")
def bandwidth_precheck(spark, sf_dir):
    from .workflows import precheck

    return precheck(points(spark, sf_dir), BY, ["click", "view", "purchase"], WIDTH, HEIGHT)


@add("association_all_pairs")
def association_all_pairs(spark, sf_dir):
    """All pairs of three markers of each day, each under the null that the day's plan names."""
    from .workflows import association_pairs

    return association_pairs(points(spark, sf_dir), BY, ["click", "view", "purchase"], WIDTH, HEIGHT, N_PERM, RMAX, STEP)
