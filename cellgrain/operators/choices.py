"""Choices, rankings, gates and scores: which row of several counts, and what a run may go on with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calls

#: Nulls by precedence: the first one at hand is a pair's primary null.
NULL_ORDER = ["reweighted", "dense_morphology", "inhomogeneous", "homogeneous"]


def primary_null(nulls: Column) -> Column:
    """The primary null among the names in an array; null without any known one."""
    known = F.filter(F.array(*[F.lit(n) for n in NULL_ORDER]), lambda n: F.array_contains(nulls, n))
    return F.try_element_at(known, F.lit(1))


def override_or(override: Column, default) -> Column:
    """A setting given for one image over the one that holds for all (cytoplasm mode: off; membrane cut: the global one)."""
    return F.coalesce(override, default if isinstance(default, Column) else F.lit(default))


def threshold_source(is_membrane: Column, nuclear_method: Column, adaptive: Column) -> Column:
    """How the threshold that classified an image was chosen."""
    return F.when(is_membrane, "membrane_completeness").when(nuclear_method.isNotNull(), F.concat(F.lit("nuclear_"), nuclear_method)).when(adaptive, "adaptive_otsu").otherwise("fixed")


def gated(pairs: DataFrame, certificates: DataFrame, by: list[str], required: bool = True) -> DataFrame:
    """Pairs with their certificate's verdict and, where one is required and the pair is not analysable, an error; no pair is dropped."""
    out = pairs.join(certificates.select(*by, "verdict"), by, "left")
    blocked = F.lit(required) & ~F.coalesce(calls.analysable(F.col("verdict")), F.lit(False))
    return out.withColumn("error", F.when(blocked, "uncertified"))


def regions_of(pairs: DataFrame, certified: DataFrame, by: list[str]) -> DataFrame:
    """Pairs once for each of their certified regions (by.., roi_id, verdict); pairs without any stay once with a null region."""
    rois = certified.where(calls.analysable(F.col("verdict"))).select(*by, "roi_id", F.col("verdict").alias("roi_verdict"))
    return pairs.join(rois, by, "left")


def preflight(required: DataFrame, available: DataFrame, by: list[str]) -> DataFrame:
    """Each workflow's requirements with whether they are met: by.., n, n_missing, missing, ready."""
    at_hand = available.select("item").distinct().withColumn("_has", F.lit(True))
    j = required.join(at_hand, "item", "left")
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_has").isNull()).alias("n_missing"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_has").isNull(), F.col("item")))), ",").alias("missing")).withColumn("ready", F.col("n_missing") == 0)


def ranked_candidates(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Candidates (by.., cand_id, status, tre, coverage, spread) in order: by.., cand_id, place.

    If any of a group is CERTIFIED, only those stay.  Smallest error first, unknown errors last, then wider coverage and
    spread; in a group without any error, spread alone.
    """
    w = Window.partitionBy(*by)
    c = candidates.withColumn("_any", F.max(F.col("status") == "CERTIFIED").over(w)).where(~F.col("_any") | (F.col("status") == "CERTIFIED"))
    c = c.withColumn("_fit", F.max(F.col("tre").isNotNull()).over(w) | F.col("_any"))
    order = [F.when(F.col("_fit"), F.coalesce("tre", F.lit(1e9))).asc_nulls_first(), F.when(F.col("_fit"), F.coalesce("coverage", F.lit(0.0))).desc_nulls_last(), F.coalesce("spread", F.lit(0.0)).desc(), F.col("cand_id")]
    return c.withColumn("place", F.row_number().over(w.orderBy(*order))).select(*by, "cand_id", "place")


def best_region(tried: DataFrame, by: list[str]) -> DataFrame:
    """Of tried regions (roi_id, tre, n, coverage) the one of least error, then most landmarks, then widest coverage."""
    key = F.struct("tre", (-F.col("n")).alias("n"), (-F.col("coverage")).alias("c"), "roi_id")
    return tried.where("tre is not null").groupBy(*by).agg(F.min_by(F.struct("roi_id", "tre", "n", "coverage"), key).alias("b")).select(*by, "b.*")


def accepted_regions(tried: DataFrame, by: list[str], order: str, most: int = 9, attempts: int = 60) -> DataFrame:
    """The first `most` accepted regions (ok) within the first `attempts` tried, in order."""
    w = Window.partitionBy(*by).orderBy(order)
    seen = tried.withColumn("attempt", F.row_number().over(w)).where(F.col("attempt") <= attempts)
    return seen.where("ok").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def newest(files: DataFrame, by: list[str], time: str, name: str) -> DataFrame:
    """The file last changed in each folder (ties: last name)."""
    return files.groupBy(*by).agg(F.max_by(name, F.struct(time, name)).alias(name), F.max(time).alias(time))


def distinct_subsets(subsets: DataFrame, by: list[str], members: str) -> DataFrame:
    """Candidate subsets without those that hold the same members in another order."""
    return subsets.withColumn(members, F.array_sort(F.array_distinct(members))).dropDuplicates([*by, members])


def subsets_of_six(items: DataFrame, by: list[str], item: str, most: int = 12) -> DataFrame:
    """All choices of six members of groups of at most `most`: by.., members. Choices grow one member at a time, in order."""
    small = items.select(*by, F.col(item).alias("_i")).distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") <= most).drop("_n")
    chosen = small.select(*by, F.array("_i").alias("members"))
    for _ in range(5):
        chosen = chosen.join(small, by).where(F.col("_i") > F.element_at("members", -1)).select(*by, F.concat("members", F.array("_i")).alias("members"))
    return chosen


def ship_score(row_verdicts: list[str], powers: list[str], least: float = 0.8) -> tuple[Column, Column]:
    """(verdict, score) of a candidate null from the size verdicts of its regimes and its powers.

    Shipped if every size passes and every power suffices; the score counts sizes that pass or nearly do and sufficient powers.
    """
    sizes = [F.col(c) for c in row_verdicts]
    passed = reduce(lambda a, b: a & b, [s == "pass" for s in sizes])
    loose = reduce(lambda a, b: a | b, [s == "anti_conservative" for s in sizes])
    strong = reduce(lambda a, b: a & b, [F.col(p) >= least for p in powers])
    verdict = F.when(passed & strong, "SHIP_CANDIDATE").when(loose, "REJECT_ANTI_CONSERVATIVE").when(~strong, "REJECT_WEAK_POWER").otherwise("BORDERLINE_NEEDS_MORE_SIM")
    score = sum((s.isin("pass", "borderline").cast("int") for s in sizes), F.lit(0)) + sum(((F.col(p) >= least).cast("int") for p in powers), F.lit(0))
    return verdict, score


def roc_area(scores: DataFrame, by: list[str], score: str, truth: str, order: str) -> DataFrame:
    """Area under the ROC curve by trapezoids over the rows in falling order of score: by.., n_pos, n_neg, auc.

    Equal scores are taken one by one, in order of `order`; a rank-based area would average them.  As each row moves the
    curve either up or to the right, the area is the share of positives already seen, averaged over the negatives.
    """
    y = F.col(truth).cast("long")
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), order).rowsBetween(Window.unboundedPreceding, 0)
    steps = scores.where(F.col(score).isNotNull()).select(*by, y.alias("_y"), F.sum(y).over(w).alias("_up"))
    sums = steps.groupBy(*by).agg(F.sum("_y").alias("n_pos"), F.sum(1 - F.col("_y")).alias("n_neg"), F.sum(F.when(F.col("_y") == 0, F.col("_up")).otherwise(0)).alias("_area"))
    return sums.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_area"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def end_to_end(truth: DataFrame, found: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """Confusion of detection and call together, and of the calls of matched cells alone.

    truth and found (by.., pt_id, positive), matches (by.., a_id, b_id).  A positive cell that nobody found is missed, a
    negative one is right; a positive detection without a cell is false, a negative one doesn't count.
    """
    m = matches.select(*by, F.col("a_id").alias("_t"), F.col("b_id").alias("_f"))
    t = truth.select(*by, F.col("pt_id").alias("_t"), F.col("positive").alias("y"))
    f = found.select(*by, F.col("pt_id").alias("_f"), F.col("positive").alias("p"))
    rows = t.join(m, [*by, "_t"], "left").join(f, [*by, "_f"], "full_outer")
    y, p = F.col("y"), F.col("p")
    both = y.isNotNull() & p.isNotNull()
    count = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy(*by).agg(count(both & y & p, "tp"), count((y.isNull() | ~y) & F.coalesce(p, F.lit(False)), "fp"), count(y & (p.isNull() | ~p), "fn"), count(~y & (p.isNull() | ~p), "tn"), count(both & y & p, "matched_tp"), count(both & ~y & p, "matched_fp"), count(both & y & ~p, "matched_fn"), count(both & ~y & ~p, "matched_tn"))


def tolerant_f1(truth: DataFrame, found: DataFrame, by: list[str], steps: int = 2) -> DataFrame:
    """F1 of pixels (by.., x, y) that count as hit when the other mask has one at most `steps` steps away (along rows and columns).

    A pixel is listed at the places within reach and joined by place; no distances are computed.
    """
    reach = [(i, j) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1) if abs(i) + abs(j) <= steps]
    grown = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in reach]))

    def hits(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        wide = other.withColumn("_o", grown).select(*by, (F.col("x") + F.col("_o.i")).alias("x"), (F.col("y") + F.col("_o.j")).alias("y")).distinct().withColumn("_hit", F.lit(True))
        return own.join(wide, [*by, "x", "y"], "left").groupBy(*by).agg(F.avg(F.coalesce(F.col("_hit"), F.lit(False)).cast("double")).alias(name))

    both = hits(found, truth, "precision").join(hits(truth, found, "recall"), by, "full_outer").na.fill(0.0, ["precision", "recall"])
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def by_method(images: DataFrame, by: list[str]) -> DataFrame:
    """Confusion sums of each method, images that abstained apart: by.., then n, tp, fp, fn, tn of either set and f1 of the main one."""
    one = lambda c, kept: F.sum(F.when(F.col("abstained") != F.lit(kept), F.col(c)).otherwise(0))
    sums = [one(c, True).alias(c) for c in ("tp", "fp", "fn", "tn")] + [one(c, False).alias(f"abstained_{c}") for c in ("tp", "fp", "fn", "tn")]
    out = images.groupBy(*by).agg(F.count(F.lit(1)).alias("n_images"), F.count_if("abstained").alias("n_abstained"), *sums)
    return out.withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def contrast(pixels: DataFrame, by: list[str], value: str, mask: str) -> DataFrame:
    """Foreground and background means of a mask and their difference."""
    m = F.col(mask)
    return pixels.groupBy(*by).agg(F.avg(F.when(m, F.col(value))).alias("inside"), F.avg(F.when(~m, F.col(value))).alias("outside")).withColumn("difference", F.col("inside") - F.col("outside"))


def field_correlation(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Correlation of two intensity grids (by.., gx, gy, lam) cell by cell; a cell that one lacks counts 0; null for a flat one."""
    cells = a.select(*by, "gx", "gy", F.col("lam").alias("a")).join(b.select(*by, "gx", "gy", F.col("lam").alias("b")), [*by, "gx", "gy"], "full_outer").na.fill(0.0, ["a", "b"])
    s = cells.groupBy(*by).agg(F.covar_pop("a", "b").alias("_c"), F.stddev_pop("a").alias("_a"), F.stddev_pop("b").alias("_b"))
    return s.select(*by, F.try_divide(F.col("_c"), F.col("_a") * F.col("_b")).alias("correlation"))


def study_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Size and power of simulated tests by any keys: keys.., n, rate, its verdict as a size, mean and median p, share that found association."""
    rate = F.avg((F.col("p") < 0.05).cast("double"))
    out = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rate.alias("rate"), F.avg("p").alias("mean_p"), F.percentile("p", 0.5).alias("median_p"), F.avg((F.col("direction") == "association").cast("double")).alias("association_power"))
    return out.withColumn("verdict", calls.size_verdict(F.col("rate"), F.col("n")))


def region_statistics(pixels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, 90th percentile and number of the measured pixels of each geometry."""
    v = calls.measured(F.col(value))
    return pixels.groupBy(*by).agg(F.avg(v).alias("mean"), F.percentile(v, 0.9).alias("p90"), F.count(v).alias("n"))


def stable(runs: DataFrame, by: list[str], least: float = 0.9) -> DataFrame:
    """Whether verdicts under moved transforms (perm_id > 0) agree with the unmoved one (perm_id 0): by.., n, agree_frac, stable."""
    w = Window.partitionBy(*by)
    base = lambda c: F.max(F.when(F.col("perm_id") == 0, F.col(c))).over(w)
    r = runs.withColumn("_s", base("significant")).withColumn("_d", base("direction")).where("perm_id > 0")
    agree = ((F.col("significant") == F.col("_s")) & (F.col("direction") == F.col("_d"))).cast("double")
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(agree).alias("agree_frac")).withColumn("stable", F.col("agree_frac") >= least)
