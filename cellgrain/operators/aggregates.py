"""Image and cohort aggregates, contingency and agreement measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def image_counts(cells: DataFrame, by: list[str], positive: str) -> DataFrame:
    """total, positive, negative and percentage positive for each image."""
    out = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(positive).alias("positive"))
    return out.withColumn("negative", F.col("total") - F.col("positive")).withColumn("pct", F.coalesce(F.try_divide(100.0 * F.col("positive"), F.col("total")), F.lit(0.0)))


def batch_totals(images: DataFrame) -> DataFrame:
    """Totals, unweighted mean percentage, whole mean cells, highest percentage, and the pooled percentage beside them."""
    return images.agg(
        F.count(F.lit(1)).alias("n_images"),
        F.sum("total").alias("total"),
        F.sum("positive").alias("positive"),
        F.avg("pct").alias("mean_pct"),
        F.min("pct").alias("min_pct"),
        F.max("pct").alias("max_pct"),
        F.floor(F.sum("total") / F.count(F.lit(1))).alias("mean_cells"),
        F.try_divide(100.0 * F.sum("positive"), F.sum("total")).alias("pooled_pct"),
    )


def contingency(cells: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """2 x 2 table of two calls with percentages, expectation, enrichment and phi; unmeasured cells (null) are left out."""
    both = cells.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counts = both.groupBy(*by).agg(F.count_if(F.col(a) & F.col(b)).alias("n11"), F.count_if(F.col(a) & ~F.col(b)).alias("n10"), F.count_if(~F.col(a) & F.col(b)).alias("n01"), F.count_if(~F.col(a) & ~F.col(b)).alias("n00"))
    return derive_contingency(counts)


def derive_contingency(counts: DataFrame) -> DataFrame:
    n11, n10, n01, n00 = (F.col(c) for c in ("n11", "n10", "n01", "n00"))
    n = n11 + n10 + n01 + n00
    a1, b1 = n11 + n10, n11 + n01
    expected = F.try_divide(a1.cast("double") * b1, n)
    phi = F.try_divide(n11.cast("double") * n00 - n10.cast("double") * n01, F.sqrt(a1.cast("double") * (n01 + n00) * b1 * (n10 + n00)))
    return counts.withColumn("n", n).withColumn("pct_both", F.try_divide(100.0 * n11, n)).withColumn("expected", expected).withColumn("enrichment", F.try_divide(n11, expected)).withColumn("phi", phi)


def fisher_exact(tables: DataFrame) -> DataFrame:
    """Add the odds ratio and the two-sided exact p of tables n11, n10, n01, n00: all tables no likelier than the observed one.

    A table expands to its possible first cells, one row each; their log
    probabilities follow from the ratio of neighbours by a running sum.
    """
    n11, n10, n01, n00 = (F.col(c) for c in ("n11", "n10", "n01", "n00"))
    keyed = tables.withColumn("_id", F.xxhash64("n11", "n10", "n01", "n00"))
    low, k = F.greatest(F.lit(0), n11 - n00), F.col("k")
    cells = keyed.select("_id", "n11", "n10", "n01", "n00").distinct().withColumn("k", F.explode(F.sequence(low, F.least(n11 + n10, n11 + n01))))
    log = lambda c: F.log(c.cast("double"))
    ratio = F.when(k > low, log(n11 + n10 - k + 1) + log(n11 + n01 - k + 1) - log(k) - log(n00 - n11 + k)).otherwise(0.0)
    w = Window.partitionBy("_id")
    cells = cells.withColumn("lp", F.sum(ratio).over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    cells = cells.withColumn("top", F.max("lp").over(w)).withColumn("obs", F.max(F.when(k == n11, F.col("lp"))).over(w))
    p = F.sum(F.when(F.col("lp") <= F.col("obs") + 1e-7, F.exp(F.col("lp") - F.col("top"))).otherwise(0.0)) / F.sum(F.exp(F.col("lp") - F.col("top")))
    ps = cells.groupBy("_id").agg(F.least(p, F.lit(1.0)).alias("p_fisher"))
    odds = F.try_divide(n11.cast("double") * n00, n10.cast("double") * n01)
    return keyed.join(ps, "_id").drop("_id").withColumn("odds_ratio", odds)


def confusion(calls: DataFrame, by: list[str], predicted: str, truth: str) -> DataFrame:
    """Counts with precision, recall, specificity, F1, accuracy and kappa."""
    p, t = F.col(predicted), F.col(truth)
    c = calls.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    return derive_confusion(c)


def derive_confusion(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    agree = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return (
        c.withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn)).withColumn("specificity", F.try_divide(tn, tn + fp))
        .withColumn("f1", F.try_divide(2 * tp, 2 * tp + fp + fn)).withColumn("accuracy", agree).withColumn("kappa", F.try_divide(agree - chance, 1 - chance))
    )


def bland_altman(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    d = F.col(x) - F.col(y)
    out = pairs.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"))
    return out.withColumn("lower", F.col("bias") - 1.96 * F.col("sd")).withColumn("upper", F.col("bias") + 1.96 * F.col("sd"))


def error_summary(rows: DataFrame, by: list[str], v: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.percentile(v, 0.5).alias("median"), F.avg(v).alias("mean"), F.percentile(v, 0.9).alias("p90"), F.max(v).alias("max"))


def worst_region(rows: DataFrame, by: list[str], x: str, y: str, v: str, width: float, height: float | None = None) -> DataFrame:
    """Largest of the medians of grid cells (square unless a height is given)."""
    regions = rows.groupBy(*by, F.floor(F.col(x) / width).alias("gx"), F.floor(F.col(y) / (height or width)).alias("gy")).agg(F.percentile(v, 0.5).alias("m"))
    return regions.groupBy(*by).agg(F.max("m").alias("worst"), F.count(F.lit(1)).alias("n_regions"))


def membrane_quality(cells: DataFrame, by: list[str], v: str, threshold: float, most: float = 0.5, least_gap: float = 0.03) -> DataFrame:
    """by.., rate above the threshold, median_ring, and a warning where most cells are above it or the median comes near it; null values are left out."""
    out = cells.where(F.col(v).isNotNull()).groupBy(*by).agg((F.count_if(F.col(v) > threshold) / F.count(F.lit(1))).alias("rate"), F.percentile(v, 0.5).alias("median_ring"))
    return out.withColumn("warn", (F.col("rate") > most) | (threshold - F.col("median_ring") < least_gap))


def label_maximum(pixels: DataFrame, by: list[str], v: str, threshold: float) -> DataFrame:
    """The greatest value of each label and whether it passes the threshold; a label without values doesn't."""
    return pixels.groupBy(*by).agg(F.max(v).alias("mx")).withColumn("positive", F.coalesce(F.col("mx") > threshold, F.lit(False)))


def stain_drift(cells: DataFrame, by: list[str], v: str, threshold: float, drifts: DataFrame) -> DataFrame:
    """Positive cells under each gain and offset of drifts(gain, off), a short list that is broadcast."""
    c = cells.crossJoin(F.broadcast(drifts))
    return c.groupBy("gain", "off", *by).agg(F.count_if(F.col(v) * F.col("gain") + F.col("off") > threshold).alias("positive"), F.count(v).alias("n"))


def channel_parity(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y on x with correlation, mean absolute error of the line and the gate's outcome."""
    fit = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("corr"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    err = F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept")))
    mae = pairs.join(fit, by).groupBy(*by).agg(F.avg(err).alias("mae"))
    ok = (F.col("n") >= 50) & (F.col("corr") >= 0.90) & (F.col("slope") > 0) & (F.col("mae") <= 0.015)
    return fit.join(mae, by).withColumn("passed", F.coalesce(ok, F.lit(False)))


def calibrated(values: DataFrame, fit: DataFrame, by: list[str], v: str) -> DataFrame:
    """Values through their image's line, clipped at 0."""
    return values.join(fit.select(*by, "slope", "intercept"), by).withColumn("calibrated", F.greatest(F.lit(0.0), F.col(v) * F.col("slope") + F.col("intercept"))).drop("slope", "intercept")


def above_share(pixels: DataFrame, by: list[str], dab: str, other: str, threshold: float) -> DataFrame:
    """Share of a ring's pixels above the threshold and above the other stain."""
    return pixels.groupBy(*by).agg(F.avg(((F.col(dab) > threshold) & (F.col(dab) > F.col(other))).cast("double")).alias("share"), F.count(F.lit(1)).alias("n_pixels"))


def median_of_medians(rows: DataFrame, outer: list[str], inner: list[str], v: str) -> DataFrame:
    m = rows.groupBy(*outer, *inner).agg(F.percentile(v, 0.5).alias("m"))
    return m.groupBy(*outer).agg(F.percentile("m", 0.5).alias("median_of_medians"), F.avg("m").alias("mean_of_medians"), F.count(F.lit(1)).alias("n_groups"))


def curve_at(curve: DataFrame, by: list[str], targets: list[float], value: str) -> DataFrame:
    """The curve's value at the radius nearest to each target, the smaller radius of equals."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in targets]))
    return curve.withColumn("target", t).groupBy(*by, "target").agg(F.min_by(value, F.struct(F.abs(F.col("r") - F.col("target")), F.col("r"))).alias(value))


def qualifying(cells: DataFrame, by: list[str], marker: str, wanted: list[str], least: int) -> DataFrame:
    """Groups with at least `least` cells of each wanted marker."""
    counts = [F.count_if(F.col(marker) == w).alias(f"n_{w}") for w in wanted]
    out = cells.groupBy(*by).agg(*counts)
    for w in wanted:
        out = out.where(F.col(f"n_{w}") >= least)
    return out


def spearman(rows: DataFrame, by: list[str], x: str, y: str, tie: str) -> DataFrame:
    """Correlation of plain ranks (ties in order of `tie`, not averaged)."""
    r = rows.withColumn("_rx", F.row_number().over(Window.partitionBy(*by).orderBy(x, tie))).withColumn("_ry", F.row_number().over(Window.partitionBy(*by).orderBy(y, tie)))
    return r.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"))


def first_crossing(profile: DataFrame, by: list[str], lag: str, v: str, level: float) -> DataFrame:
    """Lag at which a profile first falls to `level`, by linear interpolation; null if it never does."""
    w = Window.partitionBy(*by).orderBy(lag)
    p = profile.withColumn("_v0", F.lag(v).over(w)).withColumn("_l0", F.lag(lag).over(w)).where(F.col(v) <= level)
    at = F.when(F.col("_v0").isNull(), F.col(lag)).otherwise(F.col("_l0") + (F.col("_v0") - level) / (F.col("_v0") - F.col(v)) * (F.col(lag) - F.col("_l0")))
    return p.groupBy(*by).agg(F.min_by(at, lag).alias("crossing"))


def top_groups(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n largest groups (a report), ties in name order."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *by).limit(n)


def strided(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at even strides of the sorted list; the row numbers come from per-range counts, so no single task sorts all rows."""
    total = rows.count()
    if total <= n:
        return rows
    picks = sorted({round(i * (total - 1) / (n - 1)) for i in range(n)}) if n > 1 else [0]
    part = rows.sort(order).withColumn("_part", F.spark_partition_id())
    sized = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sized.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = part.join(F.broadcast(before), "_part").withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + F.col("_before"))
    return numbered.where(F.col("_k").isin(picks)).drop("_part", "_before", "_k")


def latest(rows: DataFrame, by: list[str], *order) -> DataFrame:
    """One row for each key, the last by `order`."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(o).desc() for o in order]))).where("_k = 1").drop("_k")


def normalized_dot(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Cosine of two columns over a group's rows."""
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col(x) * F.col(y)), F.sqrt(F.sum(F.col(x) * F.col(x))) * F.sqrt(F.sum(F.col(y) * F.col(y)))).alias("ncc"))


def overlap(mask: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Dice and intersection over union of two Boolean rasters."""
    i, na, nb = F.count_if(F.col(a) & F.col(b)), F.count_if(a), F.count_if(b)
    return mask.groupBy(*by).agg(i.alias("n_both"), na.alias("n_a"), nb.alias("n_b")).withColumn("dice", F.try_divide(2.0 * F.col("n_both"), F.col("n_a") + F.col("n_b"))).withColumn("iou", F.try_divide(F.col("n_both").cast("double"), F.col("n_a") + F.col("n_b") - F.col("n_both")))
