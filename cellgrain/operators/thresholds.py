"""Thresholds and score curves: histogram thresholds, rank AUC, operating points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calls import measured


def otsu_capped(values: DataFrame, by: list[str], v: str, bins: int = 256) -> DataFrame:
    """Between-class-variance threshold over [min, p99.5]: by.., threshold (the bin's centre, first maximum)."""
    x = values.select(*by, measured(F.col(v)).alias("v")).where("v is not null")
    ends = x.groupBy(*by).agg(F.min("v").alias("lo"), F.percentile("v", 0.995).alias("p"), F.max("v").alias("mx"), F.count(F.lit(1)).alias("n")).withColumn("hi", F.when(F.col("p") > F.col("lo"), F.col("p")).otherwise(F.col("mx")))
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.least(F.floor((F.least("v", "hi") - F.col("lo")) / width), F.lit(bins - 1))
    hist = x.join(ends, by).where("hi > lo and n >= 2").groupBy(*by, "lo", "hi", k.alias("bin")).agg(F.count(F.lit(1)).alias("h"))
    hist = hist.withColumn("centre", (F.col("lo") + width * F.col("bin") + F.col("lo") + width * (F.col("bin") + 1)) * 0.5)
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    cum = hist.withColumn("wb", F.sum("h").over(up)).withColumn("sb", F.sum(F.col("h") * F.col("centre")).over(up)).withColumn("tot", F.sum("h").over(whole)).withColumn("grand", F.sum(F.col("h") * F.col("centre")).over(whole))
    wf = F.col("tot") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - F.try_divide(F.col("grand") - F.col("sb"), wf)
    between = F.coalesce(F.col("wb") * wf * gap * gap, F.lit(-1.0))
    best = cum.withColumn("between", between).groupBy(*by).agg(F.max_by("centre", F.struct("between", -F.col("bin"))).alias("best"))
    return ends.join(best, by, "left").select(*by, F.coalesce("best", "lo").alias("threshold"))


def otsu_rounded(values: DataFrame, by: list[str], v: str, bins: int = 256) -> DataFrame:
    """The other histogram rule: bins by rounding over [0, max]; returns the bin's value."""
    x = values.select(*by, measured(F.col(v)).alias("v")).where("v >= 0")
    top = x.groupBy(*by).agg(F.max("v").alias("hi")).where("hi > 0")
    hist = x.join(top, by).groupBy(*by, "hi", F.floor(F.col("v") / F.col("hi") * (bins - 1) + 0.5).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("h"))
    up, whole = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    cum = hist.withColumn("wb", F.sum("h").over(up)).withColumn("sb", F.sum(F.col("h") * F.col("bin")).over(up)).withColumn("tot", F.sum("h").over(whole)).withColumn("grand", F.sum(F.col("h") * F.col("bin")).over(whole))
    wf = F.col("tot") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - F.try_divide(F.col("grand") - F.col("sb"), wf)
    return cum.withColumn("between", F.coalesce(F.col("wb") * wf * gap * gap, F.lit(-1.0))).groupBy(*by).agg(F.max_by(F.col("bin") / (bins - 1) * F.col("hi"), F.struct("between", -F.col("bin"))).alias("threshold"))


def score_counts(scored: DataFrame, by: list[str], score: str, truth: str) -> DataFrame:
    """One row for each distinct score: positives and negatives at it and above it, and the group's totals."""
    at = scored.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    above, whole = Window.partitionBy(*by).orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return at.withColumn("tp_above", zero(F.sum("pos").over(above))).withColumn("fp_above", zero(F.sum("neg").over(above))).withColumn("p_all", F.sum("pos").over(whole)).withColumn("n_all", F.sum("neg").over(whole))


def rank_auc(scored: DataFrame, by: list[str], score: str, truth: str) -> DataFrame:
    """Mann-Whitney AUC with ties counted half; null where a class is missing."""
    c = score_counts(scored, by, score, truth)
    wins = F.sum(F.col("neg") * F.col("tp_above") + F.col("pos") * F.col("neg") * F.lit(0.5))
    return c.groupBy(*by).agg(F.try_divide(wins, F.first("p_all") * F.first("n_all")).alias("auc"))


def best_f1(scored: DataFrame, by: list[str], score: str, truth: str) -> DataFrame:
    """Cut with the best F1 for "score > cut" over all distinct scores, the lowest of equals."""
    c = score_counts(scored, by, score, truth)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp_above"), F.col("tp_above") + F.col("fp_above") + F.col("p_all")), F.lit(0.0))
    return c.withColumn("f1", f1).groupBy(*by).agg(F.min_by(F.struct("s", "f1"), F.struct(-F.col("f1"), F.col("s"))).alias("m")).select(*by, F.col("m.s").alias("cut"), F.col("m.f1").alias("f1"))


def youden(scored: DataFrame, by: list[str], score: str, truth: str) -> DataFrame:
    """Cut with the best sensitivity + specificity - 1 for "score >= cut", the highest of equals."""
    c = score_counts(scored, by, score, truth).withColumn("sens", F.try_divide(F.col("tp_above") + F.col("pos"), F.col("p_all"))).withColumn("fpr", F.try_divide(F.col("fp_above") + F.col("neg"), F.col("n_all")))
    best = c.where("sens is not null and fpr is not null").groupBy(*by).agg(F.max_by(F.struct("s", "sens", "fpr"), F.struct(F.col("sens") - F.col("fpr"), F.col("s"))).alias("m"))
    return best.select(*by, F.col("m.s").alias("cut"), F.col("m.sens").alias("sensitivity"), (1 - F.col("m.fpr")).alias("specificity"))


def at_sensitivity(scored: DataFrame, by: list[str], score: str, truth: str, target: float) -> DataFrame:
    """The highest cut for "score >= cut" that reaches the target sensitivity."""
    c = score_counts(scored, by, score, truth).withColumn("sens", F.try_divide(F.col("tp_above") + F.col("pos"), F.col("p_all"))).where(F.col("sens") >= target)
    return c.groupBy(*by).agg(F.max("s").alias("cut"), F.max_by("sens", "s").alias("sensitivity"))


def high_range_threshold(values: DataFrame, by: list[str], v: str) -> DataFrame:
    """round(0.9 (p99.9 - p0.1)) + p0.1 over values other than 0."""
    x = values.where((F.col(v) != 0) & ~F.isnan(v))
    return x.groupBy(*by).agg(F.percentile(v, 0.999).alias("hi"), F.percentile(v, 0.001).alias("lo")).select(*by, (F.bround(0.9 * (F.col("hi") - F.col("lo"))) + F.col("lo")).alias("threshold"))
