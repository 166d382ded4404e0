"""Cell-level queries: calls, image and batch aggregates, thresholds, agreement, cohort corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls
from ..operators import aggregates, envelopes, stochastic, thresholds
from ..sources.adapters import CELLS_SQL, LABELLED_SQL, POINTS_SQL, cells, labelled, points, read
from . import workflows
from .registry import Catalogue

catalogue = Catalogue()
add = catalogue.add

OK = "({0} is not null and not isnan({0}))"
POS = f"coalesce(case when not isnan(dab) then dab > 0.2 end, false)"


@add("dab_positive", f"with {CELLS_SQL} select cell_id, {POS} positive from cells")
def dab_positive(spark, sf_dir):
    return cells(spark, sf_dir).select("cell_id", calls.dab_positive(F.col("dab"), 0.2).alias("positive"))


@add("ring_positive", f"with {CELLS_SQL} select cell_id, coalesce(ring > 0.2, {POS}) positive from cells")
def ring_positive(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.select("cell_id", calls.ring_positive(F.col("ring"), 0.2, calls.dab_positive(F.col("dab"), 0.2)).alias("positive"))


@add("completeness", f"with {CELLS_SQL} select cell_id, coalesce(ring >= 0.15 and dab > 0.1 and not isnan(dab), false) complete from cells")
def completeness(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.select("cell_id", F.coalesce(calls.complete_membrane(F.col("ring"), 0.15, calls.measured(F.col("dab")), 0.1), F.lit(False)).alias("complete"))


@add("restained_class", f"""with {CELLS_SQL} select cell_id, case when dab is null or isnan(dab) or ring is null then 'UNMEASURED'
  else 'A' || case when dab >= 0.2 then '+' else '-' end || '/B' || case when ring >= 0.2 then '+' else '-' end end category from cells""")  # fmt: skip
def restained_class(spark, sf_dir):
    return cells(spark, sf_dir).select("cell_id", calls.two_marker_category(F.col("dab"), F.col("ring"), 0.2, 0.2).alias("category"))


@add("class_predicates", "with c as (select p_partkey, ['Positive', 'weakly POSITIVE', 'Negative', null, p_type][p_size % 5 + 1] c from part) select p_partkey, coalesce(c = 'Positive', false) exact, coalesce(contains(lower(c), 'positive'), false) substring from c")
def class_predicates(spark, sf_dir):
    c = F.element_at(F.array(F.lit("Positive"), F.lit("weakly POSITIVE"), F.lit("Negative"), F.lit(None), F.col("p_type")), (F.col("p_size") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(calls.is_positive_class(c), F.lit(False)).alias("exact"), calls.mentions_positive(c).alias("substring"))


IMG = f"""{CELLS_SQL}, img as (select image, count(*) total, count(*) filter ({POS}) positive from cells group by 1),
 im as (select image, total, positive, total - positive negative, 100.0::double * positive / total pct from img)"""


def images(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("pos", calls.dab_positive(F.col("dab"), 0.2))
    return aggregates.image_counts(c, ["image"], "pos")


@add("image_summary", f"with {IMG} select * from im")
def image_summary(spark, sf_dir):
    return images(spark, sf_dir)


@add("confidence", f"with {IMG} select image, case when total < 50 or pct < 0.1 or pct > 95 then 'LOW' else 'HIGH' end confidence from im")
def confidence(spark, sf_dir):
    return images(spark, sf_dir).select("image", calls.confidence(F.col("total"), F.col("pct")).alias("confidence"))


@add("density_warn", f"""with {IMG}, d as (select image, total / (4000.0::double * 3000 * 0.5 * 0.5 / 1e6) density from im) select image, density, not (density between 100 and 20000) warn from d""")
def density_warn(spark, sf_dir):
    i = images(spark, sf_dir).withColumn("density", calls.cells_per_mm2(F.col("total"), F.lit(4000.0), F.lit(3000.0), F.lit(0.5)))
    return i.select("image", "density", calls.density_warning(F.col("density"), F.lit("metadata")).alias("warn"))


@add("batch_totals", f"""with {IMG} select count(*) n_images, sum(total)::bigint total, sum(positive)::bigint positive, avg(pct) mean_pct, min(pct) min_pct, max(pct) max_pct,
  floor(sum(total) / count(*))::bigint mean_cells, 100.0::double * sum(positive) / sum(total) pooled_pct from im""")  # fmt: skip
def batch_totals(spark, sf_dir):
    return aggregates.batch_totals(images(spark, sf_dir))


@add("quant_pipeline", f"with {IMG} select *, case when total < 50 or pct < 0.1 or pct > 95 then 'LOW' else 'HIGH' end confidence from im")
def quant_pipeline(spark, sf_dir):
    return workflows.quantify(cells(spark, sf_dir), ["image"], "dab", 0.2)


@add("membrane_quality", f"""with {CELLS_SQL} select image, count(*) filter (ring > 0.2) / count(*)::double rate, median(ring) median_ring,
  count(*) filter (ring > 0.2) / count(*)::double > 0.5 or 0.2 - median(ring) < 0.03 warn from cells where ring is not null group by 1""")  # fmt: skip
def membrane_quality(spark, sf_dir):
    return aggregates.membrane_quality(cells(spark, sf_dir), ["image"], "ring", 0.2)


CONT = f"""{LABELLED_SQL}, c as (select sample_id, count(*) filter (a and b) n11, count(*) filter (a and not b) n10, count(*) filter (not a and b) n01, count(*) filter (not a and not b) n00 from labelled group by 1)"""
CONT_COLS = """n11 + n10 + n01 + n00 n, 100.0::double * n11 / nullif(n11 + n10 + n01 + n00, 0) pct_both, (n11 + n10)::double * (n11 + n01) / nullif(n11 + n10 + n01 + n00, 0) expected,
 n11 / nullif((n11 + n10)::double * (n11 + n01) / nullif(n11 + n10 + n01 + n00, 0), 0) enrichment,
 (n11::double * n00 - n10::double * n01) / nullif(sqrt((n11 + n10)::double * (n01 + n00) * (n11 + n01) * (n10 + n00)), 0) phi"""


@add("contingency", f"with {CONT} select sample_id, n11, n10, n01, n00, {CONT_COLS} from c")
def contingency(spark, sf_dir):
    return aggregates.contingency(labelled(spark, sf_dir), ["sample_id"], "a", "b")


@add("cohort_contingency", f"with {CONT}, s as (select sum(n11)::bigint n11, sum(n10)::bigint n10, sum(n01)::bigint n01, sum(n00)::bigint n00 from c) select n11, n10, n01, n00, {CONT_COLS} from s")
def cohort_contingency(spark, sf_dir):
    c = aggregates.contingency(labelled(spark, sf_dir), ["sample_id"], "a", "b")
    return aggregates.derive_contingency(c.agg(*[F.sum(k).alias(k) for k in ("n11", "n10", "n01", "n00")]))


LF = "coalesce((select sum(ln(i)) from range(2, {0} + 1) t(i)), 0)"
FISHER = f"""{CONT}, lf as (select i n, sum(case when i > 0 then ln(i) else 0 end) over (order by i) f from range(0, 200001) t(i)),
 ks as (select sample_id, n11, n10, n01, n00, unnest(range(greatest(0, n11 - n00), least(n11 + n10, n11 + n01) + 1)) k from c),
 lp as (select ks.*, -(f1.f + f2.f + f3.f + f4.f) lp from ks join lf f1 on f1.n = k join lf f2 on f2.n = n11 + n10 - k join lf f3 on f3.n = n11 + n01 - k join lf f4 on f4.n = n00 - n11 + k),
 w as (select *, max(lp) over (partition by sample_id) top, max(case when k = n11 then lp end) over (partition by sample_id) obs from lp),
 fisher as (select sample_id, least(sum(case when lp <= obs + 1e-7 then exp(lp - top) else 0 end) / sum(exp(lp - top)), 1.0) p_fisher from w group by 1)"""


@add("fisher_exact", f"with {FISHER} select sample_id, n11, n10, n01, n00, round(p_fisher, 8) p_fisher, n11::double * n00 / nullif(n10::double * n01, 0) odds_ratio from c join fisher using (sample_id)")
def fisher_exact(spark, sf_dir):
    c = aggregates.contingency(labelled(spark, sf_dir), ["sample_id"], "a", "b")
    return aggregates.fisher_exact(c).select("sample_id", "n11", "n10", "n01", "n00", F.round("p_fisher", 8).alias("p_fisher"), "odds_ratio")


BH = """fine as (select * from t where p is not null and not isnan(p)), r as (select *, row_number() over (partition by fam order by p, ord) rk, count(*) over (partition by fam) n from fine),
 q as (select *, least(min(p * n / rk) over (partition by fam order by rk desc rows unbounded preceding), 1.0) q from r),
 al as (select fam, ord, p, q from q union all select fam, ord, p, null from t where p is null or isnan(p))"""
PV = "t as (select sample_id fam, doc_id ord, case when n % 11 = 0 then null else (n % 1000) / 1000.0::double end p from (select sample_id, doc_id, score::bigint n from labelled))"


def _pvalues(spark, sf_dir):
    n = F.col("score").cast("long")
    return labelled(spark, sf_dir).select(F.col("sample_id").alias("fam"), F.col("doc_id").alias("ord"), F.when(n % 11 != 0, (n % 1000) / 1000.0).alias("p"))


@add("bh_fdr", f"with {LABELLED_SQL}, {PV}, {BH} select * from al")
def bh_fdr(spark, sf_dir):
    return envelopes.adjust(_pvalues(spark, sf_dir), ["fam"])


@add("bonferroni", f"with {LABELLED_SQL}, {PV}, fine as (select *, least(p * count(*) over (partition by fam), 1.0) q from t where p is not null) select * from fine union all select *, null from t where p is null")
def bonferroni(spark, sf_dir):
    return envelopes.adjust(_pvalues(spark, sf_dir), ["fam"], method="bonferroni")


@add("cohort_fdr", f"""with {LABELLED_SQL}, {PV}, {BH} select fam, count(q) n_tested, count(*) - count(q) n_dropped, count(*) filter (q is not null and p <= 0.05) n_raw, count(*) filter (q <= 0.05) n_adjusted,
  min(case when q is not null then p end) min_p, min(q) min_q from al group by 1""")  # fmt: skip
def cohort_fdr(spark, sf_dir):
    return envelopes.cohort_summary(envelopes.adjust(_pvalues(spark, sf_dir), ["fam"]), ["fam"])


@add("restained_workflow", f"""with {FISHER}, t as (select 1 fam, sample_id ord, p_fisher p from fisher where sample_id <> 'es'), {BH}
  select sample_id, n11, n10, n01, n00, sample_id <> 'es' certified, round(q, 8) q from c left join al on ord = sample_id""")  # fmt: skip
def restained_workflow(spark, sf_dir):
    cells_ = labelled(spark, sf_dir)
    certified = cells_.select("sample_id").distinct().where("sample_id <> 'es'")
    return workflows.coexpression(cells_, ["sample_id"], "a", "b", certified).select("sample_id", "n11", "n10", "n01", "n00", "certified", F.round("q", 8).alias("q"))


CONF = """tp / nullif(tp + fp, 0)::double "precision", tp / nullif(tp + fn, 0)::double recall, tn / nullif(tn + fp, 0)::double specificity, 2 * tp / nullif(2 * tp + fp + fn, 0)::double f1, (tp + tn) / nullif(n, 0)::double accuracy,
 ((tp + tn) / n::double - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n::double * n)) / nullif(1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n::double * n), 0) kappa"""


@add("confusion", f"""with {CELLS_SQL}, p as (select image, {POS} p, truth = 1 t from cells), c as (select image, count(*) filter (p and t) tp, count(*) filter (p and not t) fp, count(*) filter (not p and t) fn, count(*) filter (not p and not t) tn, count(*) n from p group by 1)
  select image, tp, fp, fn, tn, {CONF} from c""")  # fmt: skip
def confusion(spark, sf_dir):
    c = cells(spark, sf_dir).select("image", calls.dab_positive(F.col("dab"), 0.2).alias("p"), (F.col("truth") == 1).alias("t"))
    return aggregates.confusion(c, ["image"], "p", "t")


@add("pooled_confusion", f"""with {CELLS_SQL}, p as (select {POS} p, truth = 1 t from cells), c as (select count(*) filter (p and t) tp, count(*) filter (p and not t) fp, count(*) filter (not p and t) fn, count(*) filter (not p and not t) tn, count(*) n from p)
  select tp, fp, fn, tn, {CONF} from c""")  # fmt: skip
def pooled_confusion(spark, sf_dir):
    c = confusion(spark, sf_dir)
    return aggregates.derive_confusion(c.agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn", "tn")]))


@add("bland_altman", f"""with {CELLS_SQL}, d as (select image, dab - ring d from cells where {OK.format('dab')}), s as (select image, count(d) n, avg(d) bias, stddev_samp(d) sd from d group by 1)
  select image, n, round(bias, 10) bias, round(sd, 10) sd, round(bias - 1.96 * sd, 10) lower, round(bias + 1.96 * sd, 10) upper from s""")  # fmt: skip
def bland_altman(spark, sf_dir):
    out = aggregates.bland_altman(cells(spark, sf_dir).withColumn("dab", calls.measured(F.col("dab"))), ["image"], "dab", "ring")
    return out.select("image", "n", *[F.round(c, 10).alias(c) for c in ("bias", "sd", "lower", "upper")])


@add("error_summary", f"with {CELLS_SQL} select image, count(ring) n, median(ring) median, round(avg(ring), 10) mean, quantile_cont(ring, 0.9) p90, max(ring) max from cells group by 1")
def error_summary(spark, sf_dir):
    return aggregates.error_summary(cells(spark, sf_dir), ["image"], "ring").withColumn("mean", F.round("mean", 10))


@add("region_worst", f"with {POINTS_SQL}, g as (select sample_id, floor(x / 100) gx, floor(y / 250) gy, median(x) m from (select sample_id, x, y from points) group by 1, 2, 3) select sample_id, max(m) worst, count(*) n_regions from g group by 1")
def region_worst(spark, sf_dir):
    return aggregates.worst_region(points(spark, sf_dir), ["sample_id"], "x", "y", "x", 100.0, 250.0)


PAR = f"""{CELLS_SQL}, v as (select image, ring x, ring * 0.9::double + 0.01 + (cell_id % 7) * 0.001::double y from cells where ring is not null),
 fit as (select image, count(*) n, corr(x, y) corr, regr_slope(y, x) slope, regr_intercept(y, x) intercept from v group by 1),
 mae as (select image, avg(abs(y - (slope * x + intercept))) mae from v join fit using (image) group by 1)"""


def _parity(spark, sf_dir):
    return cells(spark, sf_dir).where("ring is not null").select("image", "cell_id", F.col("ring").alias("x"), (F.col("ring") * 0.9 + 0.01 + (F.col("cell_id") % 7) * 0.001).alias("y"))


@add("parity_fit", f"with {PAR} select image, n, round(corr, 8) corr, round(slope, 8) slope, round(intercept, 8) intercept, round(mae, 8) mae, n >= 50 and corr >= 0.9 and slope > 0 and mae <= 0.015 passed from fit join mae using (image)")
def parity_fit(spark, sf_dir):
    out = aggregates.channel_parity(_parity(spark, sf_dir), ["image"], "x", "y")
    return out.select("image", "n", *[F.round(c, 8).alias(c) for c in ("corr", "slope", "intercept", "mae")], "passed")


@add("calibrated_values", f"with {PAR} select image, cell_id, round(greatest(0, x * slope + intercept), 8) calibrated from (select image, cell_id, ring x from cells where ring is not null) join fit using (image)")
def calibrated_values(spark, sf_dir):
    p = _parity(spark, sf_dir)
    fit = aggregates.channel_parity(p, ["image"], "x", "y")
    return aggregates.calibrated(p, fit, ["image"], "x").select("image", "cell_id", F.round("calibrated", 8).alias("calibrated"))


@add("ring_fraction", f"with {CELLS_SQL} select image, cell_id % 500 ring_id, avg((ring > 0.15 and ring > dab)::int::double) share, count(*) n_pixels from cells where {OK.format('dab')} and ring is not null group by 1, 2")
def ring_fraction(spark, sf_dir):
    px = cells(spark, sf_dir).where(calls.measured(F.col("dab")).isNotNull() & F.col("ring").isNotNull()).withColumn("ring_id", F.col("cell_id") % 500)
    return aggregates.above_share(px, ["image", "ring_id"], "ring", "dab", 0.15)


@add("median_of_medians", f"with {CELLS_SQL}, m as (select image, cell_id % 20 grp, median(ring) m from cells group by 1, 2) select image, median(m) median_of_medians, round(avg(m), 10) mean_of_medians, count(*) n_groups from m group by 1")
def median_of_medians(spark, sf_dir):
    out = aggregates.median_of_medians(cells(spark, sf_dir).withColumn("grp", F.col("cell_id") % 20), ["image"], ["grp"], "ring")
    return out.withColumn("mean_of_medians", F.round("mean_of_medians", 10))


SC = """ats as (select sample_id, score s, count(*) filter (truth = 1) pos, count(*) filter (truth = 0) neg from sc group by 1, 2),
 cu as (select *, coalesce(sum(pos) over w, 0) tpa, coalesce(sum(neg) over w, 0) fpa, sum(pos) over (partition by sample_id) pa, sum(neg) over (partition by sample_id) na from ats
 window w as (partition by sample_id order by s desc rows between unbounded preceding and 1 preceding))"""
SCORED = f"{LABELLED_SQL}, sc as (select sample_id, doc_id, score, a::int truth from labelled)"


def _scored(spark, sf_dir):
    return labelled(spark, sf_dir).select("sample_id", "doc_id", "score", F.col("a").cast("int").alias("truth"))


@add("auc_rank", f"with {SCORED}, {SC} select sample_id, sum(neg * tpa + pos * neg * 0.5::double) / nullif(any_value(pa) * any_value(na), 0)::double auc from cu group by 1")
def auc_rank(spark, sf_dir):
    return thresholds.rank_auc(_scored(spark, sf_dir), ["sample_id"], "score", "truth")


@add("best_f1", f"with {SCORED}, {SC}, f as (select *, coalesce(2.0::double * tpa / nullif(tpa + fpa + pa, 0), 0) f1 from cu) select sample_id, s cut, f1 from f qualify row_number() over (partition by sample_id order by f1 desc, s) = 1")
def best_f1(spark, sf_dir):
    return thresholds.best_f1(_scored(spark, sf_dir), ["sample_id"], "score", "truth")


ROC = "ro as (select *, (tpa + pos) / nullif(pa, 0)::double sens, (fpa + neg) / nullif(na, 0)::double fpr from cu)"


@add("roc_youden", f"with {SCORED}, {SC}, {ROC} select sample_id, s cut, sens sensitivity, 1 - fpr specificity from ro where sens is not null and fpr is not null qualify row_number() over (partition by sample_id order by sens - fpr desc, s desc) = 1")
def roc_youden(spark, sf_dir):
    return thresholds.youden(_scored(spark, sf_dir), ["sample_id"], "score", "truth")


@add("roc_target", f"with {SCORED}, {SC}, {ROC} select sample_id, max(s) cut, arg_max(sens, s) sensitivity from ro where sens >= 0.9 group by 1")
def roc_target(spark, sf_dir):
    return thresholds.at_sensitivity(_scored(spark, sf_dir), ["sample_id"], "score", "truth", 0.9)


OTSU = """e as (select image, min(v) lo, quantile_cont(v, 0.995) p, max(v) mx, count(*) n from x group by 1), e2 as (select *, case when p > lo then p else mx end hi from e),
 h as (select image, any_value(lo) lo, any_value(hi) hi, least(floor((least(v, hi) - lo) / ((hi - lo) / 256)), 255) bin, count(*) h from x join e2 using (image) where hi > lo and n >= 2 group by image, 4),
 c as (select *, (lo + (hi - lo) / 256 * bin + lo + (hi - lo) / 256 * (bin + 1)) * 0.5::double centre from h),
 cu as (select *, sum(h) over w wb, sum(h * centre) over w sb, sum(h) over (partition by image) tot, sum(h * centre) over (partition by image) grand from c window w as (partition by image order by bin)),
 b as (select *, coalesce(wb * (tot - wb) * power(sb / wb - (grand - sb) / nullif(tot - wb, 0), 2), -1) betw from cu)"""


@add("otsu_capped", f"with {POINTS_SQL}, x as (select marker image, x v from points where x is not null), {OTSU}, m as (select image, centre from b qualify row_number() over (partition by image order by round(betw, 3) desc, bin) = 1) select e2.image, round(coalesce(centre, lo), 9) threshold from e2 left join m using (image)")
def otsu_capped(spark, sf_dir):
    return thresholds.otsu_capped(points(spark, sf_dir).select(F.col("marker").alias("image"), F.col("x").alias("v")), ["image"], "v").withColumn("threshold", F.round("threshold", 9))


@add("otsu_round", f"""with {POINTS_SQL}, x as (select marker image, x v from points where x >= 0), t as (select image, max(v) hi from x group by 1 having max(v) > 0),
  h as (select image, any_value(hi) hi, floor(v / hi * 255 + 0.5)::int bin, count(*) h from x join t using (image) group by image, 3),
  cu as (select *, sum(h) over w wb, sum(h * bin) over w sb, sum(h) over (partition by image) tot, sum(h * bin) over (partition by image) grand from h window w as (partition by image order by bin)),
  b as (select *, coalesce(wb * (tot - wb) * power(sb / wb::double - (grand - sb) / nullif(tot - wb, 0)::double, 2), -1) betw from cu)
  select image, round(bin / 255.0::double * hi, 9) threshold from b qualify row_number() over (partition by image order by betw desc, bin) = 1""")  # fmt: skip
def otsu_round(spark, sf_dir):
    return thresholds.otsu_rounded(points(spark, sf_dir).select(F.col("marker").alias("image"), F.col("x").alias("v")), ["image"], "v").withColumn("threshold", F.round("threshold", 9))


@add("high_range_threshold", f"with {POINTS_SQL} select marker, round_even(0.9 * (quantile_cont(x, 0.999) - quantile_cont(x, 0.001)), 0) + quantile_cont(x, 0.001) threshold from points where x <> 0 group by 1")
def high_range_threshold(spark, sf_dir):
    return thresholds.high_range_threshold(points(spark, sf_dir), ["marker"], "x")


@add("spearman", f"with {SCORED}, l as (select *, length(text) tl from sc join (select doc_id, text from documents) using (doc_id)), r as (select sample_id, row_number() over (partition by sample_id order by score, doc_id) rx, row_number() over (partition by sample_id order by tl % 97, doc_id) ry from l) select sample_id, round(corr(rx, ry), 10) rho from r group by 1")
def spearman(spark, sf_dir):
    s = _scored(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", (F.length("text") % 97).alias("tl")), "doc_id")
    return aggregates.spearman(s, ["sample_id"], "score", "tl", "doc_id").withColumn("rho", F.round("rho", 10))


@add("top_groups", f"with {POINTS_SQL} select sample_id, count(*) n from points group by 1 order by n desc, sample_id limit 5")
def top_groups(spark, sf_dir):
    return aggregates.top_groups(points(spark, sf_dir), ["sample_id"], 5)


@add("strided_sample", "with t as (select p_partkey, row_number() over (order by p_partkey) - 1 k, count(*) over () n from part) select p_partkey from t where list_contains(list_transform(range(40), lambda i: round_even(i * (n - 1) / 39.0::double, 0)::bigint), k)")
def strided_sample(spark, sf_dir):
    return aggregates.strided(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 40)


@add("latest_report", "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc, role desc) = 1")
def latest_report(spark, sf_dir):
    return aggregates.latest(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@add("ncc", "select e.label, round(sum(u.v * u.w) / nullif(sqrt(sum(u.v * u.v)) * sqrt(sum(u.w * u.w)), 0), 8) ncc from (select label, unnest(list_zip(embedding, list_reverse(embedding))) p from embeddings) e, lateral (select p[1]::double v, p[2]::double w) u group by 1")
def ncc(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.explode(F.arrays_zip(F.col("embedding").alias("v"), F.reverse("embedding").alias("w"))).alias("p")).select("label", F.col("p.v").cast("double").alias("v"), F.col("p.w").cast("double").alias("w"))
    return aggregates.normalized_dot(e, ["label"], "v", "w").withColumn("ncc", F.round("ncc", 8))


@add("mask_overlap", f"with {CELLS_SQL}, m as (select image, coalesce(dab > 0.2 and not isnan(dab), false) a, coalesce(ring > 0.2, false) b from cells), c as (select image, count(*) filter (a and b) n_both, count(*) filter (a) n_a, count(*) filter (b) n_b from m group by 1) select *, 2.0::double * n_both / nullif(n_a + n_b, 0) dice, n_both / nullif(n_a + n_b - n_both, 0)::double iou from c")
def mask_overlap(spark, sf_dir):
    m = cells(spark, sf_dir).select("image", calls.dab_positive(F.col("dab"), 0.2).alias("a"), F.coalesce(F.col("ring") > 0.2, F.lit(False)).alias("b"))
    return aggregates.overlap(m, ["image"], "a", "b")


@add("first_crossing", f"with {POINTS_SQL}, pr as (select sample_id, hour, count(*) c from (select sample_id, floor(y / 41.67) as hour from points) group by 1, 2), z as (select sample_id, hour::double lag, exp(-hour / 5.0::double) * (1 + 0.001::double * c) v from pr), w as (select *, lag(v) over (partition by sample_id order by lag) v0, lag(lag) over (partition by sample_id order by lag) l0 from z), p as (select * from w where v <= 0.36787944117144233::double) select sample_id, round(arg_min(case when v0 is null then lag else l0 + (v0 - 0.36787944117144233::double) / (v0 - v) * (lag - l0) end, lag), 9) crossing from p group by 1")
def first_crossing(spark, sf_dir):
    p = points(spark, sf_dir).groupBy("sample_id", F.floor(F.col("y") / 41.67).alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    p = p.select("sample_id", F.col("hour").cast("double").alias("lag"), (F.exp(-F.col("hour") / 5.0) * (1 + 0.001 * F.col("c"))).alias("v"))
    return aggregates.first_crossing(p, ["sample_id"], "lag", "v", 0.36787944117144233).withColumn("crossing", F.round("crossing", 9))


@add("label_maximum", f"with {CELLS_SQL} select image, cell_id % 50 lbl, max(ring) mx, coalesce(max(ring) > 0.35, false) positive from cells group by 1, 2")
def label_maximum(spark, sf_dir):
    return aggregates.label_maximum(cells(spark, sf_dir).withColumn("lbl", F.col("cell_id") % 50), ["image", "lbl"], "ring", 0.35)


@add("stain_drift", f"""with {CELLS_SQL}, g as (select unnest([0.8, 1.0, 1.2])::double gain, unnest([0.0, 0.0, 0.1])::double off) select gain, off, image, count(*) filter (ring * gain + off > 0.2) positive, count(ring) n from cells cross join g group by 1, 2, 3""")
def stain_drift(spark, sf_dir):
    grid = spark.createDataFrame([(0.8, 0.0), (1.0, 0.0), (1.2, 0.1)], "gain double, off double")
    return aggregates.stain_drift(cells(spark, sf_dir), ["image"], "ring", 0.2, grid)


@add("gmm_nuclear")
def gmm_nuclear(spark, sf_dir):
    return stochastic.nuclear_thresholds(cells(spark, sf_dir), ["image"], "dab")


@add("calibrate_loo")
def calibrate_loo(spark, sf_dir):
    return stochastic.calibrate_loo(labelled(spark, sf_dir), ["sample_id"], "score", "a")
