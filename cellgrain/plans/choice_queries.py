"""Queries of choices, gates, rankings and scores over tables that stand in for candidates, regions and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import choices, proximity, stochastic
from ..sources.adapters import CELLS_SQL, POINTS_SQL, cells, marker, points, read
from .pattern_queries import GRID_SQL
from .registry import Catalogue

catalogue = Catalogue()
add = catalogue.add

WIDTH, HEIGHT = 490.0, 1000.0
BY = ["sample_id"]


@add("primary_null", """select o_orderkey k, case when o_orderkey % 2 = 0 then 'reweighted' when o_orderkey % 3 = 0 then 'dense_morphology' when o_orderkey % 5 = 0 then 'inhomogeneous' when o_orderkey % 7 = 0 then 'homogeneous' end chosen from orders""")
def primary_null(spark, sf_dir):
    k = F.col("o_orderkey")
    at_hand = F.array_compact(F.array(*[F.when(k % d == 0, F.lit(n)) for d, n in ((7, "homogeneous"), (3, "dense_morphology"), (2, "reweighted"), (5, "inhomogeneous"), (11, "toroidal"))]))
    return read(spark, sf_dir, "orders").select(k.alias("k"), choices.primary_null(at_hand).alias("chosen"))


@add("setting_overrides", "select p_partkey, case when p_size % 4 = 0 then p_size % 8 = 0 else false end cytoplasm, case when p_size % 3 = 0 then p_size / 100.0::double else 0.15::double end membrane_cut from part")
def setting_overrides(spark, sf_dir):
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", choices.override_or(F.when(size % 4 == 0, size % 8 == 0), False).alias("cytoplasm"), choices.override_or(F.when(size % 3 == 0, size / 100.0), 0.15).alias("membrane_cut"))


@add("threshold_source", """select p_partkey, case when p_size % 5 = 0 then 'membrane_completeness' when p_size % 3 = 0 then 'nuclear_' || lower(p_brand) when p_size % 2 = 0 then 'adaptive_otsu' else 'fixed' end source from part""")
def threshold_source(spark, sf_dir):
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", choices.threshold_source(size % 5 == 0, F.when(size % 3 == 0, F.lower("p_brand")), size % 2 == 0).alias("source"))


CERT = "certs as (select o_custkey c, case count(*) % 4 when 0 then 'CERTIFIED' when 1 then 'DEFORMED' when 2 then 'RADIUS_LIMITED' else 'NOT_CERTIFIABLE' end verdict from orders group by 1)"


def _certs(spark, sf_dir):
    n = F.count(F.lit(1)) % 4
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.when(n == 0, "CERTIFIED").when(n == 1, "DEFORMED").when(n == 2, "RADIUS_LIMITED").otherwise("NOT_CERTIFIABLE").alias("verdict"))


@add("certification_gate", f"with {CERT} select c_custkey c, verdict, case when verdict is null or verdict not in ('CERTIFIED', 'LOCALLY_CERTIFIED', 'RADIUS_LIMITED') then 'uncertified' end error from customer left join certs on c = c_custkey")
def certification_gate(spark, sf_dir):
    return choices.gated(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")), _certs(spark, sf_dir), ["c"]).select("c", "verdict", "error")


@add("region_fan_out", """with rois as (select o_custkey c, o_orderkey roi_id, case o_orderkey % 3 when 0 then 'LOCALLY_CERTIFIED' when 1 then 'CERTIFIED' else 'DEFORMED' end roi_verdict from orders)
  select c_custkey c, roi_id, roi_verdict from customer left join (select * from rois where roi_verdict <> 'DEFORMED') r on r.c = c_custkey""")  # fmt: skip
def region_fan_out(spark, sf_dir):
    k = F.col("o_orderkey")
    rois = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), k.alias("roi_id"), F.when(k % 3 == 0, "LOCALLY_CERTIFIED").when(k % 3 == 1, "CERTIFIED").otherwise("DEFORMED").alias("verdict"))
    return choices.regions_of(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")), rois, ["c"]).select("c", "roi_id", "roi_verdict")


@add("preflight", """with need as (select p_size workflow, p_brand item from part), have as (select distinct p_brand item from part where p_partkey % 4 = 0),
  j as (select workflow, need.item, have.item is null gone from need left join have using (item)) select workflow, count(*) n, count(*) filter (gone) n_missing, coalesce(string_agg(distinct item, ',' order by item) filter (gone), '') missing, count(*) filter (gone) = 0 ready from j group by 1""")  # fmt: skip
def preflight(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return choices.preflight(part.select(F.col("p_size").alias("workflow"), F.col("p_brand").alias("item")), part.where("p_partkey % 4 = 0").select(F.col("p_brand").alias("item")), ["workflow"])


CAND = """cand as (select o_custkey c, o_orderkey cand_id, case when o_orderkey % 9 = 0 then 'CERTIFIED' else 'DEFORMED' end status, case when o_custkey % 5 > 0 and o_orderkey % 4 > 0 then floor(o_totalprice / 10000)::double end tre,
  (o_orderkey % 6)::double coverage, (o_orderkey % 100)::double spread, o_orderkey % 8 n from orders)"""


def _candidates(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tre = F.when((c % 5 > 0) & (k % 4 > 0), F.floor(F.col("o_totalprice") / 10000).cast("double"))
    return read(spark, sf_dir, "orders").select(c.alias("c"), k.alias("cand_id"), F.when(k % 9 == 0, "CERTIFIED").otherwise("DEFORMED").alias("status"), tre.alias("tre"), (k % 6).cast("double").alias("coverage"), (k % 100).cast("double").alias("spread"), (k % 8).alias("n"))


@add("candidate_ranking", f"""with {CAND}, f as (select *, bool_or(status = 'CERTIFIED') over (partition by c) sure from cand), g as (select *, sure or bool_or(tre is not null) over (partition by c) fit from f where not sure or status = 'CERTIFIED')
  select c, cand_id, row_number() over (partition by c order by case when fit then coalesce(tre, 1e9) else 0 end, case when fit then -coverage else 0 end, -spread, cand_id) place from g""")  # fmt: skip
def candidate_ranking(spark, sf_dir):
    return choices.ranked_candidates(_candidates(spark, sf_dir), ["c"])


@add("best_region", f"with {CAND} select c, cand_id roi_id, tre, n, coverage from cand where tre is not null qualify row_number() over (partition by c order by tre, -n, -coverage, cand_id) = 1")
def best_region(spark, sf_dir):
    return choices.best_region(_candidates(spark, sf_dir).withColumnRenamed("cand_id", "roi_id"), ["c"])


@add("accepted_regions", f"""with {CAND}, t as (select *, row_number() over (partition by c % 20 order by cand_id) attempt from cand)
  select c % 20 g, cand_id, row_number() over (partition by c % 20 order by cand_id) place from t where attempt <= 60 and tre < 15 qualify place <= 9""")  # fmt: skip
def accepted_regions(spark, sf_dir):
    tried = _candidates(spark, sf_dir).select((F.col("c") % 20).alias("g"), "cand_id", F.coalesce(F.col("tre") < 15, F.lit(False)).alias("ok"))
    return choices.accepted_regions(tried, ["g"], "cand_id").select("g", "cand_id", "place")


@add("newest_file", "select o_custkey folder, o_orderdate as mtime, o_orderkey as file from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def newest_file(spark, sf_dir):
    files = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderdate").alias("mtime"), F.col("o_orderkey").alias("file"))
    return choices.newest(files, ["folder"], "mtime", "file")


@add("distinct_subsets", """with s as (select l_orderkey g, list_sort(list_distinct([l_partkey % 7, l_suppkey % 7, l_linenumber])) m from lineitem) select distinct g, array_to_string(m, ',') members from s""")
def distinct_subsets(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.array(F.col("l_partkey") % 7, F.col("l_suppkey") % 7, F.col("l_linenumber").cast("long")).alias("members"))
    return choices.distinct_subsets(s, ["g"], "members").select("g", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@add("subsets_of_six", """with i as (select distinct o_custkey c, o_orderkey i from orders), s as (select i.* from i join (select c from i group by 1 having count(*) between 6 and 12) using (c))
  select a.c, concat_ws(',', a.i, b.i, d.i, e.i, f.i, g.i) members from s a join s b on b.c = a.c and b.i > a.i join s d on d.c = a.c and d.i > b.i join s e on e.c = a.c and e.i > d.i join s f on f.c = a.c and f.i > e.i join s g on g.c = a.c and g.i > f.i""")  # fmt: skip
def subsets_of_six(spark, sf_dir):
    items = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("i"))
    return choices.subsets_of_six(items, ["c"], "i").select("c", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@add("ship_verdict", """with r as (select p_partkey, ['pass', 'borderline', 'conservative', 'anti_conservative'][p_size % 4 + 1] a, ['pass', 'pass', 'borderline'][p_partkey % 3 + 1] b, (p_size % 10) / 10.0::double s, (p_partkey % 10) / 10.0::double m from part)
  select p_partkey, case when a = 'pass' and b = 'pass' and s >= 0.8 and m >= 0.8 then 'SHIP_CANDIDATE' when a = 'anti_conservative' then 'REJECT_ANTI_CONSERVATIVE' when not (s >= 0.8 and m >= 0.8) then 'REJECT_WEAK_POWER' else 'BORDERLINE_NEEDS_MORE_SIM' end verdict,
  (a in ('pass', 'borderline'))::int + (b in ('pass', 'borderline'))::int + (s >= 0.8)::int + (m >= 0.8)::int score from r""")  # fmt: skip
def ship_verdict(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    of = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (k + 1).cast("int"))
    r = read(spark, sf_dir, "part").select("p_partkey", of(["pass", "borderline", "conservative", "anti_conservative"], size % 4).alias("a"), of(["pass", "pass", "borderline"], key % 3).alias("b"), ((size % 10) / 10.0).alias("s"), ((key % 10) / 10.0).alias("m"))
    verdict, score = choices.ship_score(["a", "b"], ["s", "m"])
    return r.select("p_partkey", verdict.alias("verdict"), score.alias("score"))


@add("roc_area", f"""with {CELLS_SQL}, c as (select *, sum(truth) over (partition by image order by dab desc, cell_id * 2 + truth rows between unbounded preceding and current row) up from cells where dab is not null and not isnan(dab))
  select image, sum(truth) n_pos, sum(1 - truth) n_neg, sum(case when truth = 0 then up end)::double / nullif(sum(truth) * sum(1 - truth), 0) auc from c group by 1""")  # fmt: skip
def roc_area(spark, sf_dir):
    return choices.roc_area(cells(spark, sf_dir).where("not isnan(dab)").withColumn("place", F.col("cell_id") * 2 + F.col("truth")), ["image"], "dab", "truth", "place")


@add("scale_and_mpp", """select p_partkey, case when p_size % 3 > 0 then p_size::double end scale, case when p_size % 2 = 0 then 0.2::double + p_size / 100.0::double end mpp from part""")
def scale_and_mpp(spark, sf_dir):
    size = F.col("p_size")
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("user-A_"), F.when(size % 3 > 0, F.concat(F.lit("scale-"), size.cast("string"), F.lit("pc"))).otherwise("full")).alias("folder"), F.concat(F.lit("Slide |"), F.when(size % 2 == 0, F.concat(F.lit("MPP = "), F.round(0.2 + size / 100.0, 2).cast("string"))).otherwise("AppMag = 20"), F.lit("|x")).alias("text"))
    return part.select("p_partkey", names.scale_percent(F.col("folder")).alias("scale"), names.microns_per_pixel(F.col("text")).alias("mpp"))


@add("progress", """with l as (select event_id, strftime(ts, '%Y-%m-%d') run, event_id % 5 = 0 finished from events), s as (select *, count(*) filter (finished) over (partition by run order by event_id) done, count(*) over (partition by run) total from l)
  select event_id, run, floor(done * 85 / total)::int pct from s""")  # fmt: skip
def progress(spark, sf_dir):
    lines = read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("run"), F.when(F.col("event_id") % 5 == 0, "PIPELINE FINISHED SUCCESSFULLY").otherwise("Processing").alias("line"))
    from pyspark.sql import Window

    lines = lines.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("run")))
    return names.progress(lines, ["run"], "event_id", "line", "total").select("event_id", "run", "pct")


@add("end_to_end_confusion", f"""with {POINTS_SQL}, t as (select sample_id, pt_id, pt_id % 3 = 0 pos, x, y from points where marker = 'click'), f as (select sample_id, pt_id, pt_id % 4 = 0 pos, x, y from points where marker = 'view'),
  d as (select t.sample_id, t.pt_id a, f.pt_id b, sqrt((t.x - f.x) * (t.x - f.x) + (t.y - f.y) * (t.y - f.y)) d from t join f on t.sample_id = f.sample_id where sqrt((t.x - f.x) * (t.x - f.x) + (t.y - f.y) * (t.y - f.y)) <= 15),
  o as (select * from d qualify row_number() over (partition by sample_id, a order by d, b) = 1), m as (select * from o qualify row_number() over (partition by sample_id, b order by d, a) = 1),
  r as (select coalesce(t.sample_id, f.sample_id) sample_id, t.pos y, f.pos p from t left join m on m.sample_id = t.sample_id and m.a = t.pt_id full join f on f.sample_id = t.sample_id and f.pt_id = m.b)
  select sample_id, count(*) filter (y and p) tp, count(*) filter (coalesce(not y, true) and coalesce(p, false)) fp, count(*) filter (y and coalesce(not p, true)) fn, count(*) filter (not y and coalesce(not p, true)) tn,
  count(*) filter (y and p) matched_tp, count(*) filter (not y and p) matched_fp, count(*) filter (y and not p) matched_fn, count(*) filter (not y and not p) matched_tn from r group by 1""")  # fmt: skip
def end_to_end_confusion(spark, sf_dir):
    pts = points(spark, sf_dir)
    t, f = marker(pts, "click").withColumn("positive", F.col("pt_id") % 3 == 0), marker(pts, "view").withColumn("positive", F.col("pt_id") % 4 == 0)
    return choices.end_to_end(t, f, proximity.nearest_match(t, f, BY, 15.0), BY)


PIX = "pix as (select distinct case when l_linenumber % 2 = 0 then 't' else 'f' end side, l_suppkey % 9 g, l_partkey % 40 x, l_orderkey % 40 y from lineitem)"


@add("tolerant_f1", f"""with {PIX}, t as (select * from pix where side = 't'), f as (select * from pix where side = 'f'),
  p as (select f.g, avg(exists (select 1 from t where t.g = f.g and abs(t.x - f.x) + abs(t.y - f.y) <= 2)::int) precision_ from f group by 1), r as (select t.g, avg(exists (select 1 from f where t.g = f.g and abs(t.x - f.x) + abs(t.y - f.y) <= 2)::int) recall_ from t group by 1)
  select g, round(precision_, 9) "precision", round(recall_, 9) recall, round(2 * precision_ * recall_ / nullif(precision_ + recall_, 0), 9) f1 from p join r using (g)""")  # fmt: skip
def tolerant_f1(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2 == 0).alias("t"), (F.col("l_suppkey") % 9).alias("g"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_orderkey") % 40).alias("y")).distinct()
    out = choices.tolerant_f1(li.where("t").drop("t"), li.where("not t").drop("t"), ["g"])
    return out.select("g", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@add("method_scores", """with i as (select l_returnflag mode, l_partkey % 11 = 0 abst, (l_suppkey % 5)::bigint tp, (l_suppkey % 3)::bigint fp, (l_partkey % 4)::bigint fn, (l_partkey % 6)::bigint tn from lineitem)
  select mode, count(*) n_images, count(*) filter (abst) n_abstained, sum(case when abst then 0 else tp end) tp, sum(case when abst then 0 else fp end) fp, sum(case when abst then 0 else fn end) fn, sum(case when abst then 0 else tn end) tn,
  sum(case when abst then tp else 0 end) abstained_tp, sum(case when abst then fp else 0 end) abstained_fp, sum(case when abst then fn else 0 end) abstained_fn, sum(case when abst then tn else 0 end) abstained_tn,
  2.0::double * sum(case when abst then 0 else tp end) / nullif(sum(case when abst then 0 else 2 * tp + fp + fn end), 0) f1 from i group by 1""")  # fmt: skip
def method_scores(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    i = li.select(F.col("l_returnflag").alias("mode"), (F.col("l_partkey") % 11 == 0).alias("abstained"), (F.col("l_suppkey") % 5).alias("tp"), (F.col("l_suppkey") % 3).alias("fp"), (F.col("l_partkey") % 4).alias("fn"), (F.col("l_partkey") % 6).alias("tn"))
    return choices.by_method(i, ["mode"])


@add("mask_contrast", f"with {CELLS_SQL} select image, avg(ring) filter (truth = 1) inside, avg(ring) filter (truth = 0) outside, avg(ring) filter (truth = 1) - avg(ring) filter (truth = 0) difference from cells group by 1".replace("avg(ring) filter (truth = 1) inside", "round(avg(ring) filter (truth = 1), 9) inside").replace("avg(ring) filter (truth = 0) outside", "round(avg(ring) filter (truth = 0), 9) outside").replace("avg(ring) filter (truth = 1) - avg(ring) filter (truth = 0) difference", "round(avg(ring) filter (truth = 1) - avg(ring) filter (truth = 0), 9) difference"))
def mask_contrast(spark, sf_dir):
    out = choices.contrast(cells(spark, sf_dir).withColumn("m", F.col("truth") == 1), ["image"], "ring", "m")
    return out.select("image", *[F.round(c, 9).alias(c) for c in ("inside", "outside", "difference")])


@add("region_statistics", f"with {CELLS_SQL} select image, round(avg(dab), 9) mean, round(quantile_cont(dab, 0.9), 9) p90, count(*) n from cells where dab is not null and not isnan(dab) group by 1")
def region_statistics(spark, sf_dir):
    out = choices.region_statistics(cells(spark, sf_dir), ["image"], "dab")
    return out.select("image", F.round("mean", 9).alias("mean"), F.round("p90", 9).alias("p90"), "n")


RUNS = "runs as (select o_orderpriority null_model, o_custkey % 3 scenario, (o_orderkey % 97) / 96.0::double p, case when o_orderkey % 4 = 0 then 'association' when o_orderkey % 4 = 1 then 'segregation' else 'none' end direction from orders)"


@add("study_summary", f"""with {RUNS}, s as (select null_model, scenario, count(*) n, avg((p < 0.05)::int::double) rate, avg(p) mean_p, median(p) median_p, avg((direction = 'association')::int::double) association_power from runs group by 1, 2)
  select null_model, scenario, n, round(rate, 9) rate, round(mean_p, 9) mean_p, round(median_p, 9) median_p, round(association_power, 9) association_power,
  case when rate + 1.96 * sqrt(rate * (1 - rate) / n) < 0.05 then 'conservative' when rate - 1.96 * sqrt(rate * (1 - rate) / n) > 0.05 then 'anti_conservative' when rate between 0.03 and 0.07 then 'pass' else 'borderline' end verdict from s""")  # fmt: skip
def study_summary(spark, sf_dir):
    k = F.col("o_orderkey")
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("null_model"), (F.col("o_custkey") % 3).alias("scenario"), ((k % 97) / 96.0).alias("p"), F.when(k % 4 == 0, "association").when(k % 4 == 1, "segregation").otherwise("none").alias("direction"))
    out = choices.study_summary(runs, ["null_model", "scenario"])
    return out.select("null_model", "scenario", "n", *[F.round(c, 9).alias(c) for c in ("rate", "mean_p", "median_p", "association_power")], "verdict")


@add("verdict_stability", """with r as (select o_custkey c, row_number() over (partition by o_custkey order by o_orderkey) - 1 perm_id, o_orderkey % 3 > 0 significant, case when o_orderkey % 5 > 0 then 'association' else 'segregation' end direction from orders),
  b as (select * from r where perm_id = 0), j as (select r.c, (r.significant = b.significant and r.direction = b.direction)::int::double ok from r join b on r.c = b.c where r.perm_id > 0) select c, count(*) n, round(avg(ok), 9) agree_frac, avg(ok) >= 0.9 stable from j group by 1""")  # fmt: skip
def verdict_stability(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    r = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("perm_id"), (k % 3 > 0).alias("significant"), F.when(k % 5 > 0, "association").otherwise("segregation").alias("direction"))
    return choices.stable(r, ["c"]).select("c", "n", F.round("agree_frac", 9).alias("agree_frac"), "stable")


@add("field_correlation", f"""with {POINTS_SQL}, {GRID_SQL}, j as (select coalesce(p.sample_id, q.sample_id) sample_id, coalesce(p.lam, 0) a, coalesce(q.lam, 0) b from (select * from gr where marker = 'click') p full join (select * from gr where marker = 'view') q on p.sample_id = q.sample_id and p.gx = q.gx and p.gy = q.gy)
  select sample_id, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 9) correlation from j group by 1""")  # fmt: skip
def field_correlation(spark, sf_dir):
    pts = points(spark, sf_dir)
    grids = [stochastic.intensity_grid(marker(pts, m), BY, WIDTH, HEIGHT, 25.0, 50.0) for m in ("click", "view")]
    return choices.field_correlation(*grids, BY).withColumn("correlation", F.round("correlation", 9))


@add("median_nn", f"""with {POINTS_SQL}, d as (select a.sample_id, a.pt_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) d from points a join points b on a.sample_id = b.sample_id where a.marker = 'click' and b.marker = 'view' group by 1, 2)
  select sample_id, round(median(d), 9) median_nn from d group by 1""")  # fmt: skip
def median_nn(spark, sf_dir):
    pts = points(spark, sf_dir)
    return proximity.nearest(marker(pts, "click"), marker(pts, "view"), BY, 20.0).groupBy("sample_id").agg(F.round(F.percentile("d", 0.5), 9).alias("median_nn"))
