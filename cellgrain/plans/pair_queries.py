"""File pairing, configuration chains, registration and verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls, geometry, names
from ..operators import matching, registration
from ..sources.adapters import FILES_SQL, LANDMARKS_SQL, POINTS_SQL, files, landmarks, points, read
from . import workflows
from .registry import Catalogue

catalogue = Catalogue()
add = catalogue.add

# the marker removed by one pass of an expression that DuckDB's engine has: separators around the tokens that occur here
KEYED = f"""{FILES_SQL}, st as (select *, lower(regexp_replace(name, '\\.[^.]*$', '')) s from files),
 tk as (select *, coalesce(nullif(regexp_extract(s, '(^|[^a-z0-9])(panck|tim-3|cd8|h&e)([^a-z0-9]|$)', 2), '')) stain from st),
 keyed as (select folder, name, stain, regexp_replace(regexp_replace(regexp_replace(replace(s, coalesce(stain, '~'), ''), '[-_\\s.]+', '_', 'g'), '^_+|_+$', '', 'g'), '(^|[^0-9])x([0-9]+)$', '\\1\\2x') norm from tk)"""


@add("normalize_name", f"with {KEYED} select folder, name, norm, stain from keyed")
def normalize_name(spark, sf_dir):
    return matching.keyed_files(files(spark, sf_dir)).select("folder", "name", "norm", "stain")


@add("two_folder_match", f"""with {KEYED}, k as (select * from keyed qualify row_number() over (partition by folder, norm order by name desc) = 1), a as (select * from k where folder = 'a'), b as (select * from k where folder = 'b')
  select coalesce(a.norm, b.norm) norm, a.name name_a, a.stain stain_a, b.name name_b, b.stain stain_b, case when b.name is null then 'only_a' when a.name is null then 'only_b' else 'matched' end status from a full join b on a.norm = b.norm""")  # fmt: skip
def two_folder_match(spark, sf_dir):
    return matching.match_folders(files(spark, sf_dir), "a", "b")


@add("single_folder_match", f"""with {KEYED}, n as (select norm, stain, max(name) as name from keyed where stain is not null group by 1, 2), g as (select norm, list({{'stain': stain, 'name': name}} order by stain, name) m from n group by 1)
  select norm, m[1].name name_a, m[2].name name_b, m[1].stain stain_a, m[2].stain stain_b, case when len(m) >= 2 then 'matched' else 'single' end status from g
  union all select norm, name, null, null, null, 'no_stain' from keyed where stain is null""")  # fmt: skip
def single_folder_match(spark, sf_dir):
    return matching.match_within(files(spark, sf_dir))


@add("stains_present", f"with {KEYED} select folder, array_to_string(list_sort(list(distinct stain) filter (stain is not null)), ',') stains, count(distinct stain)::int n from keyed group by 1")
def stains_present(spark, sf_dir):
    return matching.stains_present(matching.keyed_files(files(spark, sf_dir)), ["folder"])


@add("compared_runs", """with r as (select o_custkey % 40 pair_id, avg(o_totalprice) rtre from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey % 40 pair_id, avg(o_totalprice) base from orders where o_orderkey % 2 = 1 group by 1)
  select pair_id, round(rtre, 6) rtre, round(base, 6) base, round(rtre - base, 6) difference, rtre < base better from r join b using (pair_id)""")  # fmt: skip
def compared_runs(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    run = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy((F.col("o_custkey") % 40).alias("pair_id")).agg(F.avg("o_totalprice").alias("rtre"))
    return matching.compared_runs(run(0), run(1), "pair_id", "rtre").select("pair_id", *[F.round(c, 6).alias(c) for c in ("rtre", "base", "difference")], "better")


BUNDLE = """fl as (select 'case' || (s_suppkey // 4) || '_' || ['hema', 'marka', 'markb', 'mask'][s_suppkey % 4 + 1] || '.tif' as name from supplier where s_suppkey % 11 <> 0)"""


@add("bundle_pivot", f"""with {BUNDLE}, r as (select name, regexp_extract(name, '^(.*)_([a-z]+)\\.tif$', 1) case_id, regexp_extract(name, '_([a-z]+)\\.tif$', 1) role from fl),
  p as (select case_id, max(name) filter (role = 'hema') h, max(name) filter (role = 'marka') a, max(name) filter (role = 'markb') b from r where role <> 'mask' group by 1)
  select *, array_to_string(list_filter([case when h is null then 'h' end, case when a is null then 'a' end, case when b is null then 'b' end], lambda x: x is not null), ',') missing, h is not null and a is not null and b is not null complete from p""")  # fmt: skip
def bundle_pivot(spark, sf_dir):
    k = F.col("s_suppkey")
    role = F.element_at(F.array(*[F.lit(r) for r in ("hema", "marka", "markb", "mask")]), (k % 4 + 1).cast("int"))
    fl = read(spark, sf_dir, "supplier").where("s_suppkey % 11 <> 0").select(F.concat(F.lit("case"), F.floor(k / 4).cast("string"), F.lit("_"), role, F.lit(".tif")).alias("name"))
    return matching.bundles(fl, {"h": "hema", "a": "marka", "b": "markb"})


@add("px_from_filename", """with f as (select p_partkey, lower(p_brand || '_' || ['10x_a.png', 'x20_b.tif', '40x', 'scan 4x.svs', 'x99_x60_c.png', 'none.png'][p_partkey % 6 + 1]) f from part),
  m as (select p_partkey, [regexp_extract(f, '[-_\\s](\\d+)x[-_\\s.]', 1), regexp_extract(f, '[-_\\s]x(\\d+)[-_\\s.]', 1), regexp_extract(f, '^(\\d+)x[-_\\s.]', 1), regexp_extract(f, '[-_\\s](\\d+)x$', 1), regexp_extract(f, '[-_]x(\\d+)[-_]', 1), regexp_extract(f, '(\\d+)x(\\D|$)', 1), regexp_extract(f, 'x(\\d+)(\\D|$)', 1)] c from f)
  select p_partkey, list_filter(list_transform(c, lambda x: case x when '4' then 2.5 when '10' then 1.0 when '20' then 0.5 when '40' then 0.25 when '60' then 0.165 when '100' then 0.1 end::double), lambda v: v is not null)[1] px from m""")  # fmt: skip
def px_from_filename(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    tail = F.element_at(F.array(*[F.lit(t) for t in ("10x_a.png", "x20_b.tif", "40x", "scan 4x.svs", "x99_x60_c.png", "none.png")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return part.select("p_partkey", names.pixel_size_of(F.concat("p_brand", F.lit("_"), tail)).alias("px"))


@add("px_chain", """with c as (select p_partkey, case when p_size % 5 = 0 then 0.4::double end m, case when p_size % 7 = 0 then -1.0::double when p_size % 3 = 0 then 0.33::double end meta, case when p_size % 2 = 0 then 0.6::double end ui from part)
  select p_partkey, coalesce(m, case when meta > 0 then meta end, ui, 0.5::double) px, case when m is not null then 'override' when meta > 0 then 'metadata' when ui is not null then 'ui' else 'default' end source from c""")  # fmt: skip
def px_chain(spark, sf_dir):
    s = F.col("p_size")
    value, source = calls.pixel_size_chain(F.when(s % 5 == 0, 0.4), F.when(s % 7 == 0, -1.0).when(s % 3 == 0, 0.33), F.when(s % 2 == 0, 0.6), F.lit(None).cast("double"))
    return read(spark, sf_dir, "part").select("p_partkey", value.alias("px"), source.alias("source"))


@add("threshold_chain", """with t as (select * from (values (1, 'standard', 0.11::double), (2, 'promo', 0.12), (3, 'tin', 0.13)) t(ord, token, thr)), i as (select distinct p_type image from part), o as (select min(image) image, 0.9::double thr from i),
  h as (select image, arg_min(thr, ord) th from i join t on contains(lower(image), token) group by 1) select i.image, coalesce(o.thr, th, 0.2::double) threshold, case when o.thr is not null then 'override' when th is not null then 'stain' else 'global' end source from i left join o using (image) left join h using (image)""")  # fmt: skip
def threshold_chain(spark, sf_dir):
    images = read(spark, sf_dir, "part").select(F.col("p_type").alias("image")).distinct()
    over = images.agg(F.min("image").alias("image")).withColumn("thr", F.lit(0.9))
    tokens = spark.createDataFrame([(1, "standard", 0.11), (2, "promo", 0.12), (3, "tin", 0.13)], "ord int, token string, thr double")
    return matching.threshold_chain(images, over, F.broadcast(tokens), 0.2)


@add("membrane_routing", """select p_partkey, case when p_size % 9 = 0 then p_size % 2 = 0 when p_size % 4 = 0 then true else contains(lower(p_type), 'brushed') end cytoplasm from part""")
def membrane_routing(spark, sf_dir):
    s = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", calls.cytoplasm_route(F.when(s % 9 == 0, s % 2 == 0), F.when(s % 4 == 0, F.lit(True)), F.col("p_type"), ["brushed"]).alias("cytoplasm"))


@add("calib_lookup", """with saved as (select p_name as name, p_type marker, p_partkey ord, p_retailprice value from part where p_partkey % 3 = 0), rq as (select p_partkey req_id, case when p_partkey % 2 = 0 then p_name end as name, p_type marker from part),
  n as (select r.req_id, max(value) v1 from rq r join saved s on s.name = r.name group by 1), m as (select marker, arg_max(value, ord) v2 from saved group by 1) select r.req_id, coalesce(v1, v2) value from rq r left join n using (req_id) left join m using (marker)""")  # fmt: skip
def calib_lookup(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    saved = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("name"), F.col("p_type").alias("marker"), F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("value"))
    requests = part.select(F.col("p_partkey").alias("req_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("name"), F.col("p_type").alias("marker"))
    return matching.calibration_lookup(requests, saved)


FIT = f"""{LANDMARKS_SQL}, s as (select pair_id, count(*) n, avg(rx) rx, avg(ry) ry, avg(mx) mx, avg(my) my, sum(mx * rx) xx, sum(my * ry) yy, sum(mx * ry) xy, sum(my * rx) yx, sum(mx * mx + my * my) ss from landmarks group by 1),
 ab as (select *, (xx - n * mx * rx + yy - n * my * ry) / nullif(ss - n * (mx * mx + my * my), 0) a, (xy - n * mx * ry - (yx - n * my * rx)) / nullif(ss - n * (mx * mx + my * my), 0) b from s),
 fit as (select pair_id, n, a, b, rx - a * mx + b * my tx, ry - b * mx - a * my ty from ab),
 res as (select l.*, a * mx - b * my + tx - rx ex, b * mx + a * my + ty - ry ey from landmarks l join fit using (pair_id)), er as (select *, sqrt(ex * ex + ey * ey) err from res)"""


@add("similarity_fit", f"with {FIT} select pair_id, n, round(a, 8) a, round(b, 8) b, round(tx, 5) tx, round(ty, 5) ty from fit")
def similarity_fit(spark, sf_dir):
    return registration.similarity_fit(landmarks(spark, sf_dir), ["pair_id"]).select("pair_id", "n", *[F.round(c, d).alias(c) for c, d in (("a", 8), ("b", 8), ("tx", 5), ("ty", 5))])


@add("similarity_defect", f"with {FIT}, m as (select pair_id, a, -b * 1.01::double b, b d, a * 1.02::double e from fit), q as (select *, abs(a * e - b * d) s2 from m) select pair_id, round(sqrt(s2), 8) scale, round(sqrt(power(a * a + d * d - s2, 2) + 2 * power(a * b + d * e, 2) + power(b * b + e * e - s2, 2)) / s2, 8) defect from q")
def similarity_defect(spark, sf_dir):
    f = registration.similarity_fit(landmarks(spark, sf_dir), ["pair_id"])
    m = (F.col("a"), -F.col("b") * 1.01, F.col("b"), F.col("a") * 1.02)
    return f.select("pair_id", F.round(geometry.affine_scale(*m), 8).alias("scale"), F.round(geometry.similarity_defect(*m), 8).alias("defect"))


LOO = f"""{LANDMARKS_SQL}, h as (select l.pair_id, h.lm_id held, l.* exclude (pair_id) from landmarks l join landmarks h on h.pair_id = l.pair_id and h.lm_id <> l.lm_id),
 s as (select pair_id, held, count(*) n, avg(rx) rx, avg(ry) ry, avg(mx) mx, avg(my) my, sum(mx * rx) xx, sum(my * ry) yy, sum(mx * ry) xy, sum(my * rx) yx, sum(mx * mx + my * my) ss from h group by 1, 2),
 ab as (select *, (xx - n * mx * rx + yy - n * my * ry) / nullif(ss - n * (mx * mx + my * my), 0) a, (xy - n * mx * ry - (yx - n * my * rx)) / nullif(ss - n * (mx * mx + my * my), 0) b from s),
 f as (select pair_id, held, a, b, rx - a * mx + b * my tx, ry - b * mx - a * my ty from ab),
 loo as (select l.pair_id, lm_id, sqrt(power(a * mx - b * my + tx - rx, 2) + power(b * mx + a * my + ty - ry, 2)) loo_err from landmarks l join f on f.pair_id = l.pair_id and held = lm_id)"""


@add("loo_tre_ls", f"with {LOO} select pair_id, lm_id, round(loo_err, 5) loo_err from loo")
def loo_tre_ls(spark, sf_dir):
    return registration.leave_one_out(landmarks(spark, sf_dir), ["pair_id"]).withColumn("loo_err", F.round("loo_err", 5))


def _residuals(spark, sf_dir):
    lm = landmarks(spark, sf_dir)
    return registration.residuals(lm, registration.similarity_fit(lm, ["pair_id"]), ["pair_id"])


@add("landmark_noise", f"with {FIT} select pair_id, round(sqrt(sum(err * err) / case when count(*) > 2 then 2.0::double * count(*) - 4 end), 6) sigma from er group by 1")
def landmark_noise(spark, sf_dir):
    return registration.landmark_noise(_residuals(spark, sf_dir), ["pair_id"]).withColumn("sigma", F.round("sigma", 6))


@add("rtre_summary", f"with {FIT} select pair_id, count(*) n, round(median(err / 1113.0::double), 8) median, round(avg(err / 1113.0::double), 8) mean, round(quantile_cont(err / 1113.0::double, 0.9), 8) p90, round(max(err / 1113.0::double), 8) max from er group by 1")
def rtre_summary(spark, sf_dir):
    from ..operators.aggregates import error_summary

    out = error_summary(_residuals(spark, sf_dir).withColumn("rel", F.col("err") / 1113.0), ["pair_id"], "rel")
    return out.select("pair_id", "n", *[F.round(c, 8).alias(c) for c in ("median", "mean", "p90", "max")])


@add("moran_observed", f"""with {FIT}, m as (select pair_id, avg(ex) mx_, avg(ey) my_, count(*) n from er group by 1), c as (select er.*, ex - mx_ ux, ey - my_ uy, n from er join m using (pair_id)),
  x as (select a.pair_id, sum(exp(-(power(a.rx - b.rx, 2) + power(a.ry - b.ry, 2)) / 40000.0::double) * (a.ux * b.ux + a.uy * b.uy)) s, sum(exp(-(power(a.rx - b.rx, 2) + power(a.ry - b.ry, 2)) / 40000.0::double)) w from c a join c b on a.pair_id = b.pair_id and a.lm_id <> b.lm_id group by 1),
  t as (select pair_id, sum(ux * ux + uy * uy) q, any_value(n) n from c group by 1) select pair_id, round(n * s / (w * q), 7) moran_i from x join t using (pair_id)""")  # fmt: skip
def moran_observed(spark, sf_dir):
    return registration.morans_i(_residuals(spark, sf_dir), ["pair_id"], 200.0).withColumn("moran_i", F.round("moran_i", 7))


@add("fle_robust", f"""with {POINTS_SQL}, r as (select sample_id, floor(pt_id / 3) spot, x, y from points), d as (select *, power(x - avg(x) over w, 2) + power(y - avg(y) over w, 2) d2, count(*) over w n from r window w as (partition by sample_id, spot)), s as (select *, d2 * n / (n - 1) s2 from d where n > 1)
  select sample_id, round(median(sqrt(s2)) / sqrt(2 * ln(2.0::double)), 6) sigma_median, round(sqrt(avg(s2) / 2), 6) sigma_ms from s group by 1""")  # fmt: skip
def fle_robust(spark, sf_dir):
    r = points(spark, sf_dir).withColumn("spot", F.floor(F.col("pt_id") / 3))
    return registration.localisation_error(r, ["sample_id"], "spot", "x", "y").select("sample_id", *[F.round(c, 6).alias(c) for c in ("sigma_median", "sigma_ms")])


@add("certify_landmarks")
def certify_landmarks(spark, sf_dir):
    return registration.certify(landmarks(spark, sf_dir), ["pair_id"], 0.5, 490.0, 1000.0)


@add("landmark_hull")
def landmark_hull(spark, sf_dir):
    return registration.hull_area(landmarks(spark, sf_dir).select("pair_id", F.col("rx").alias("x"), F.col("ry").alias("y")), ["pair_id"])


@add("spread_landmarks")
def spread_landmarks(spark, sf_dir):
    return registration.farthest_points(landmarks(spark, sf_dir).select("pair_id", F.col("lm_id").alias("pt_id"), F.col("rx").alias("x"), F.col("ry").alias("y")), ["pair_id"], 12)


@add("local_affine")
def local_affine(spark, sf_dir):
    """Where each point of a day, of whatever marker, lies in the other section, by its six nearest landmarks."""
    q = points(spark, sf_dir).select(F.col("sample_id").alias("pair_id"), "pt_id", "x", "y")
    return registration.local_affine(q, landmarks(spark, sf_dir), ["pair_id"])


@add("prediction_error")
def prediction_error(spark, sf_dir):
    lm = landmarks(spark, sf_dir)
    sigma = registration.landmark_noise(registration.residuals(lm, registration.similarity_fit(lm, ["pair_id"]), ["pair_id"]), ["pair_id"])
    return registration.prediction_error(lm, registration.field_grid(lm, ["pair_id"], 490.0, 1000.0), ["pair_id"], sigma)


@add("error_budget")
def error_budget(spark, sf_dir):
    """Cell error over the field from the localisation error measured on each day's landmarks (0.5 um a pixel)."""
    lm, by = landmarks(spark, sf_dir), ["pair_id"]
    res = registration.residuals(lm, registration.similarity_fit(lm, by), by)
    fle = registration.measured_error(lm, res, by, 0.5)
    predicted = registration.prediction_error(lm, registration.field_grid(lm, by, 490.0, 1000.0), by, fle.select(*by, (F.col("fle_um") * 2**0.5).alias("sigma")))
    deformation = registration.deformation_rms(res, by, fle, 0.5).select(*by, F.col("rms_um").alias("deformation"))
    return registration.error_budget(predicted, deformation, by)


@add("moran_verdict")
def moran_verdict(spark, sf_dir):
    """All landmarks of each day and 999 permutations."""
    return registration.moran_verdict(_residuals(spark, sf_dir), ["pair_id"], 200.0, 999)


@add("irls_similarity")
def irls_similarity(spark, sf_dir):
    return registration.huber_similarity(landmarks(spark, sf_dir), ["pair_id"])


AFF = (0.9, -0.1, 12.0, 0.1, 0.9, -7.0)


@add("affine_apply", f"with {POINTS_SQL} select sample_id, pt_id, (0.9::double * (x * 2) + -0.1::double * (y * 2) + 12.0) / 4.0 x, (0.1::double * (x * 2) + 0.9::double * (y * 2) + -7.0) / 4.0 y from points")
def affine_apply(spark, sf_dir):
    x, y = geometry.affine_apply(F.col("x"), F.col("y"), AFF, 2.0, 4.0)
    return points(spark, sf_dir).select("sample_id", "pt_id", x.alias("x"), y.alias("y"))


@add("shoelace_centroid", f"""with {POINTS_SQL}, v as (select sample_id, floor(pt_id / 5)::bigint ring_id, pt_id, x, y, coalesce(lead(x) over w, first_value(x) over w) x1, coalesce(lead(y) over w, first_value(y) over w) y1 from points window w as (partition by sample_id, floor(pt_id / 5) order by pt_id)),
  g as (select sample_id, ring_id, count(*) n, sum(x * y1 - x1 * y) / 2 area, sum((x + x1) * (x * y1 - x1 * y)) sx, sum((y + y1) * (x * y1 - x1 * y)) sy, avg(x) mx, avg(y) my from v group by 1, 2)
  select sample_id, ring_id, round(area, 5) area, round(case when n < 3 or abs(area) < 1e-9 then mx else sx / (6 * area) end * least(1, greatest(abs(area), 1e-9) / 100), 2) cx, round(case when n < 3 or abs(area) < 1e-9 then my else sy / (6 * area) end * least(1, greatest(abs(area), 1e-9) / 100), 2) cy from g""")  # fmt: skip
def shoelace_centroid(spark, sf_dir):
    rings = points(spark, sf_dir).groupBy("sample_id", F.floor(F.col("pt_id") / 5).alias("ring_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pt_id", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    cx, cy = geometry.shoelace_centroid(F.col("ring"))
    out = rings.withColumn("area", geometry.signed_area(F.col("ring"))).withColumn("cx", cx).withColumn("cy", cy)
    # the quotient of a small area loses digits in both engines: centroids are compared by area / 100 where that is below 1
    shown = lambda c: F.round(F.col(c) * F.least(F.lit(1.0), F.greatest(F.abs("area"), F.lit(1e-9)) / 100), 2).alias(c)
    return out.select("sample_id", "ring_id", F.round("area", 5).alias("area"), shown("cx"), shown("cy"))


REG = """rg as (select o_orderkey k, case when o_orderkey % 10 = 0 then 'identity' when o_orderkey % 23 = 0 then null else 'features' end m, case when o_orderkey % 7 = 0 then null else (o_totalprice % 1300) / 100 end res, case when o_orderkey % 13 = 0 then null else (o_totalprice % 997) / 997 end ov from orders)"""


def _registrations(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 10 == 0, "identity").when(k % 23 == 0, F.lit(None)).otherwise("features").alias("m"), F.when(k % 7 != 0, (p % 1300) / 100).alias("res"), F.when(k % 13 != 0, (p % 997) / 997).alias("ov"))


@add("reg_qc_gate", f"with {REG} select k, case when m is null or m = 'identity' then 'invalid' when res is null then 'invalid' when ov < 0.5 then 'invalid' when res >= 10 then 'invalid' when res >= 5 then 'warning' else 'valid' end status from rg")
def reg_qc_gate(spark, sf_dir):
    return _registrations(spark, sf_dir).select("k", calls.registration_status(F.col("m"), F.col("res"), F.col("ov")).alias("status"))


@add("radius_floor", f"with {REG} select k, round(res * 3, 6) floor_um from rg")
def radius_floor(spark, sf_dir):
    return _registrations(spark, sf_dir).select("k", F.round(calls.radius_floor(F.col("res"), digits=9), 6).alias("floor_um"))


@add("structural_verdict", f"with {REG} select k, case when ov < 0.1 then 'FAILED' when res <= 5 and res * 2 <= 15 then 'CERTIFIED' when res <= 5 then 'LOCALLY_CERTIFIED' else 'NOT_CERTIFIABLE' end verdict from rg")
def structural_verdict(spark, sf_dir):
    return _registrations(spark, sf_dir).select("k", calls.structural_verdict(F.col("res"), F.col("res") * 2, F.col("ov")).alias("verdict"))


@add("stats_valid", f"with {REG} select k, coalesce(res < 5, false) and (coalesce(ov > 0.6, false) or k % 3 = 0) ok from rg")
def stats_valid(spark, sf_dir):
    r = _registrations(spark, sf_dir)
    return r.select("k", calls.statistics_valid(F.coalesce(F.col("res") < 5, F.lit(False)), F.coalesce(F.col("ov") > 0.6, F.lit(False)), F.col("k") % 3 == 0).alias("ok"))


MK = f"""{POINTS_SQL}, n as (select sample_id, marker, count(*) n from points group by 1, 2), mk as (select sample_id, marker, n, case when n < 5 then 'marker_absent' when n < 30 then 'underpowered_sparse_marker' when n % 7 = 0 then 'dense_tissue' when n % 5 = 0 then 'caution' else 'ok' end status,
 sum(n) over (partition by sample_id) n_support, n % 11 <> 0 certified from n)"""
RANK = "case status when 'marker_absent' then 0 when 'underpowered_sparse_marker' then 1 when 'unknown' then 2 when 'dense_tissue' then 3 when 'caution' then 4 else 5 end"


def _markers(spark, sf_dir):
    from pyspark.sql import Window

    n = points(spark, sf_dir).groupBy("sample_id", "marker").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("n")
    status = F.when(c < 5, "marker_absent").when(c < 30, "underpowered_sparse_marker").when(c % 7 == 0, "dense_tissue").when(c % 5 == 0, "caution").otherwise("ok")
    return n.withColumn("status", status).withColumn("n_support", F.sum("n").over(Window.partitionBy("sample_id"))).withColumn("certified", c % 11 != 0).withColumn("has_window", F.lit(True))


@add("power_grade", f"with {MK} select sample_id, marker, case when n >= 30 then 'adequate' when n >= 5 then 'sparse' else 'absent' end grade from mk")
def power_grade(spark, sf_dir):
    return _markers(spark, sf_dir).select("sample_id", "marker", calls.power_grade(F.col("n")).alias("grade"))


@add("worst_status", f"with {MK} select sample_id, arg_min(status, {RANK}) worst from mk group by 1")
def worst_status(spark, sf_dir):
    return workflows.worst_status(_markers(spark, sf_dir), ["sample_id"], "status")


@add("null_plan", f"""with {MK}, g as (select sample_id, arg_min(status, {RANK}) worst, min(n) n_min, max(n_support) sup, bool_and(certified) cert from mk group by 1),
  f as (select *, list_filter([case when not cert then 'landmark_certified' end, case when n_min < case when worst = 'underpowered_sparse_marker' then 5 else 30 end then 'min_positive' end, case when sup < 500 then 'min_support' end], lambda x: x is not null) fl from g)
  select sample_id, worst, case when worst in ('ok', 'caution') then 'reweighted' when worst in ('dense_tissue', 'underpowered_sparse_marker') and len(fl) = 0 then 'dense_morphology' else 'none' end primary_null, coalesce(array_to_string(fl, ','), '') failed from f""")  # fmt: skip
def null_plan(spark, sf_dir):
    return workflows.null_plan(_markers(spark, sf_dir), ["sample_id"])


VR = """v as (select o_orderkey k, o_totalprice % 100 < 5 prim, o_totalprice % 70 < 9 csr, case when o_orderkey % 2 = 0 then 'association' else 'segregation' end dir, o_totalprice % 30 fl from orders)"""


def _verdicts(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(k.alias("k"), (p % 100 < 5).alias("prim"), (p % 70 < 9).alias("csr"), F.when(k % 2 == 0, "association").otherwise("segregation").alias("dir"), (p % 30).alias("fl"))


@add("robustness", f"with {VR} select k, case when prim then 'robust' when csr then 'csr_only' else 'none' end verdict from v")
def robustness(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("k", calls.robustness(F.col("prim"), F.col("csr")).alias("verdict"))


@add("interaction", f"with {VR} select k, case when fl >= 20 then 'not_resolvable' when prim then case dir when 'association' then 'attraction' else 'segregation' end when csr then 'csr_only' else 'none' end coloc, case when prim then case dir when 'association' then 'attraction' else 'segregation' end when csr then 'csr_only' else 'none' end coinfil from v")
def interaction(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.select("k", calls.band_verdict(F.col("fl") < 20, F.col("prim"), F.col("dir"), F.col("csr")).alias("coloc"), calls.band_verdict(F.lit(True), F.col("prim"), F.col("dir"), F.col("csr")).alias("coinfil"))


@add("architecture_verdict", f"with {VR} select k, case when fl * 8 >= 150 then 'ok' when fl * 8 >= 75 then 'caution' else 'dense_tissue' end status from v")
def architecture_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("k", calls.architecture_verdict(F.col("fl") * 8).alias("status"))


@add("size_verdict", """with r as (select o_custkey % 50 g, count(*) n, count(*) filter (o_totalprice % 100 < 6) / count(*)::double rate from orders group by 1) select g, n, rate,
  case when rate + 1.96 * sqrt(rate * (1 - rate) / n) < 0.05 then 'conservative' when rate - 1.96 * sqrt(rate * (1 - rate) / n) > 0.05 then 'anti_conservative' when rate between 0.03 and 0.07 then 'pass' else 'borderline' end verdict from r""")  # fmt: skip
def size_verdict(spark, sf_dir):
    r = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("g")).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("o_totalprice") % 100 < 6) / F.count(F.lit(1))).alias("rate"))
    return r.withColumn("verdict", calls.size_verdict(F.col("rate"), F.col("n")))


@add("verdict_tally", f"""with {VR}, t as (select k % 40 g, case when prim then 'robust' when csr then 'csr_only' else 'none' end verdict, fl / 30 p from v), a as (select g, count(*) n, count(*) filter (p <= 0.05) n_significant, round(avg(p), 9) mean_p, round(median(p), 9) median_p, count(*) filter (verdict = 'robust') n_robust from t group by 1)
  select g, n, n_significant, mean_p, median_p, n_robust, n_significant / n::double rate from a""")  # fmt: skip
def verdict_tally(spark, sf_dir):
    t = _verdicts(spark, sf_dir).select((F.col("k") % 40).alias("g"), calls.robustness(F.col("prim"), F.col("csr")).alias("verdict"), (F.col("fl") / 30).alias("p"))
    out = workflows.tally(t, ["g"], "verdict", "p")
    return out.select("g", "n", "n_significant", F.round("mean_p", 9).alias("mean_p"), F.round("median_p", 9).alias("median_p"), "n_robust", "rate")


@add("equal_count_pairs", "with s as (select l_partkey % 20 case_id, l_suppkey stem, count(*) n from lineitem group by 1, 2) select a.case_id, a.stem a, b.stem b, a.n from s a join s b on a.case_id = b.case_id and a.n = b.n and a.stem <> b.stem")
def equal_count_pairs(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 20).alias("case_id"), F.col("l_suppkey").alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    return matching.equal_count_pairs(s)


LINES = """l as (select event_id, case event_id % 8 when 0 then '##METRICS## ' || props when 1 then 'WARNING: low ' || event_type when 2 then 'saved ' || event_type when 3 then 'Processing ' || event_type
  when 4 then 'ERROR after ' || event_type || ' saved' when 5 then 'Warning ' || event_type when 6 then 'QC of ' || event_type || ' complete' else 'done ' || event_type end line from events)"""


def _lines(spark, sf_dir):
    i, kind = F.col("event_id") % 8, F.col("event_type")
    words = [F.concat(F.lit("##METRICS## "), "props"), F.concat(F.lit("WARNING: low "), kind), F.concat(F.lit("saved "), kind), F.concat(F.lit("Processing "), kind), F.concat(F.lit("ERROR after "), kind, F.lit(" saved")), F.concat(F.lit("Warning "), kind), F.concat(F.lit("QC of "), kind, F.lit(" complete"))]
    line = F.coalesce(*[F.when(i == k, w) for k, w in enumerate(words)], F.concat(F.lit("done "), kind))
    return read(spark, sf_dir, "events").select("event_id", line.alias("line"))


@add("metrics_line", f"""with {LINES} select event_id, case when line like '##METRICS##%' then cast(json_extract_string(substr(line, 13), '$.k') as int) end k,
  case when line like '%ERROR%' or line like '%FAILED%' or line like '%TIMEOUT%' then 'error' when line like '%WARNING%' then 'warn' when regexp_matches(line, 'COMPLETE|FINISHED|saved|exported|complete') then 'ok'
  when regexp_matches(line, 'Running|Processing|Detecting|Rerunning|QC|Generating') then 'info' else 'normal' end as level from l""")  # fmt: skip
def metrics_line(spark, sf_dir):
    return _lines(spark, sf_dir).select("event_id", F.get_json_object(names.metrics_json(F.col("line")), "$.k").cast("int").alias("k"), names.log_level(F.col("line")).alias("level"))


@add("dataset_manifest", """with f as (select page_id % 7 tree, url as name, sha256(html) h from pages) select tree, count(*) n_files, sha256(string_agg(h || '  ' || name, chr(10) order by name, h)) manifest from f group by 1""")
def dataset_manifest(spark, sf_dir):
    f = read(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("tree"), F.col("url").alias("name"), F.col("html").cast("binary").alias("content"))
    return matching.dataset_manifest(f, ["tree"])


@add("scale_image_match")
def scale_image_match(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    folder = (F.col("p_size") % 10).alias("folder")
    key = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "_"))
    images = part.where("p_partkey % 2 = 0").select(folder, F.col("p_name").alias("name"), F.concat(key, F.lit("_"), F.col("p_partkey") % 9).alias("key"))
    scales = part.where("p_partkey % 2 = 1").select(folder, F.col("p_name").alias("name"), key.alias("key"))
    return matching.scale_image_match(images, scales, ["folder"])
