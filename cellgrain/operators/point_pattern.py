"""Cross-type point-pattern statistics per sample: pair counts, K, L - r, g, weighted and wrapped variants."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks
from .proximity import looked_up
from .scratch import scratch_folder


def radii(spark: SparkSession, rmax: float = 100.0, step: float = 2.0) -> DataFrame:
    """radii(r_idx, r) from 0 to rmax."""
    return spark.range(int(rmax // step) + 1).select(F.col("id").cast("int").alias("r_idx"), (F.col("id") * step).alias("r"))


def first_radius(d, step: float):
    """Index of the smallest radius >= d, right at the boundaries whatever the division rounds to."""
    k = F.ceil(d / step)
    return F.when((k - 1) * step >= d, k - 1).when(k * step < d, k + 1).otherwise(k).cast("int")


def radius_profile(buckets: DataFrame, groups: DataFrame, by: list[str], rmax: float, step: float) -> DataFrame:
    """Running sum of buckets(by.., r_idx, _v) in the column total, for every group and radius, 0 where there is nothing."""
    grid = groups.select(*by).distinct().crossJoin(F.broadcast(radii(buckets.sparkSession, rmax, step)))
    running = Window.partitionBy(*by).orderBy("r_idx").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(buckets, [*by, "r_idx"], "left").withColumn("total", F.sum(F.coalesce("_v", F.lit(0.0))).over(running)).drop("_v")


def group_sizes(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by.., n_a, n_b) of all groups of either side."""
    return a.groupBy(*by).agg(F.count(F.lit(1)).alias("n_a")).join(b.groupBy(*by).agg(F.count(F.lit(1)).alias("n_b")), by, "full_outer").select(*by, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def pair_counts(a: DataFrame, b: DataFrame, by: list[str], rmax: float = 100.0, step: float = 2.0) -> DataFrame:
    """(by.., r_idx, r, pairs): pairs at most r apart."""
    buckets = blocks.profile(blocks.weighted(a, by), blocks.weighted(b, by), by, rmax, step)
    return radius_profile(buckets, group_sizes(a, b, by), by, rmax, step).select(*by, "r_idx", "r", F.col("total").cast("long").alias("pairs"))


def pair_correlation(curve: DataFrame, by: list[str], step: float, k: str = "k") -> DataFrame:
    """Add g(r) = K'(r) / (2 pi r) by central differences, one-sided at the ends, null at r = 0."""
    w = Window.partitionBy(*by).orderBy("r_idx")
    before, after = F.lag(k).over(w), F.lead(k).over(w)
    slope = F.when(before.isNull(), (after - F.col(k)) / step).when(after.isNull(), (F.col(k) - before) / step).otherwise((after - before) / (2 * step))
    return curve.withColumn("g", F.when(F.col("r") > 0, slope / (2 * math.pi * F.col("r"))))


def cross_k(a: DataFrame, b: DataFrame, by: list[str], area: float, rmax: float = 100.0, step: float = 2.0) -> DataFrame:
    """(by.., r_idx, r, pairs, k, lmr, g); K is 0 where a side is empty."""
    counts = pair_counts(a, b, by, rmax, step).join(group_sizes(a, b, by), by)
    k = F.coalesce(F.try_divide(F.lit(area), F.col("n_a") * F.col("n_b")) * F.col("pairs"), F.lit(0.0))
    curve = counts.withColumn("k", k).withColumn("lmr", F.sqrt(F.col("k") / math.pi) - F.col("r"))
    return pair_correlation(curve, by, step).select(*by, "r_idx", "r", "pairs", "k", "lmr", "g")


def loo_intensity(pts: DataFrame, by: list[str], bandwidth: float, area: float) -> DataFrame:
    """Leave-one-out Gaussian kernel intensity at each point, pairs within four bandwidths, floored: by.., pt_id, lam.

    Points of one place have one intensity; kernels are summed in blocks, so a pair is never a row.
    """
    # the kernel at a point's own place is 1: what is left are the other points, those of the same place included
    sums = blocks.kernel_at(blocks.weighted(pts, by), by, bandwidth).select(*by, "x", "y", ((F.col("_s") - 1) / (2 * math.pi * bandwidth * bandwidth)).alias("_s"))
    n = pts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    least = 0.02 * F.col("_n") / area
    lam = F.when(F.col("_n") <= 1, F.greatest(F.col("_n") / area, least)).otherwise(F.greatest(F.coalesce("_s", F.lit(0.0)), least))
    return pts.select(*by, "pt_id", "x", "y").join(n, by).join(sums, [*by, "x", "y"], "left").select(*by, "pt_id", lam.alias("lam"))


def cross_k_inhomogeneous(a: DataFrame, b: DataFrame, by: list[str], bandwidth: float, area: float, rmax: float = 100.0, step: float = 2.0) -> DataFrame:
    """(by.., r_idx, r, k): each pair weighted by 1 / (lambda_a lambda_b)."""
    sides = [d.join(loo_intensity(d, by, bandwidth, area), [*by, "pt_id"]) for d in (a, b)]
    buckets = blocks.profile(*[blocks.weighted(d, by, 1 / F.col("lam")) for d in sides], by, rmax, step)
    curve = radius_profile(buckets, group_sizes(a, b, by), by, rmax, step)
    return curve.select(*by, "r_idx", "r", (F.col("total") / area).alias("k"))


def cross_k_translated(a: DataFrame, b: DataFrame, by: list[str], width: float, height: float, rmax: float = 100.0, step: float = 2.0) -> DataFrame:
    """(by.., r_idx, r, k) with translation edge correction on a rectangle."""
    area = width * height
    sizes = group_sizes(a, b, by)
    factor = lambda dx, dy: area / (np.maximum(width - abs(dx), 1e-9) * np.maximum(height - abs(dy), 1e-9))
    buckets = blocks.profile(blocks.weighted(a, by), blocks.weighted(b, by), by, rmax, step, factor=factor)
    curve = radius_profile(buckets, sizes, by, rmax, step).join(sizes, by)
    return curve.select(*by, "r_idx", "r", F.coalesce(F.try_divide(F.lit(area), F.col("n_a") * F.col("n_b")) * F.col("total"), F.lit(0.0)).alias("k"))


def cross_k_torus(a: DataFrame, b: DataFrame, by: list[str], width: float, height: float, rmax: float = 100.0, step: float = 2.0) -> DataFrame:
    """(by.., r_idx, r, k) under wrapped distances: every two points meet once, in bins that go round the edges."""
    sizes = group_sizes(a, b, by)
    buckets = blocks.profile(blocks.weighted(a, by), blocks.weighted(b, by), by, rmax, step, torus=(width, height))
    curve = radius_profile(buckets, sizes, by, rmax, step).join(sizes, by)
    return curve.select(*by, "r_idx", "r", F.coalesce(F.try_divide(F.lit(width * height), F.col("n_a") * F.col("n_b")) * F.col("total"), F.lit(0.0)).alias("k"))


def permuted_k(a: DataFrame, b: DataFrame, moved: DataFrame, perms: DataFrame, by: list[str], area: float, rmax: float, step: float, dealt: bool = False, place=None) -> DataFrame:
    """(by.., perm_id, r_idx, r, k) of a against `moved`, the points of b redrawn for each of perms(perm_id).

    A task takes a group's redrawn points of some permutations and all different positions of a: pairs are counted in
    blocks and are never rows. Points are dealt out by group and block of permutations, under numbers instead of the
    groups' own keys, so one large group spreads over as many tasks as there are blocks.  `dealt`: moved comes by group and
    run of permutations, so pairs are counted where points are drawn.  `place`: moved has no x and y, but the columns from
    which this gives them (see `blocks.permuted_profile`).
    """
    weight = F.col("w") if "w" in moved.columns else F.lit(1.0).alias("w")
    where = ("x", "y") if place is None else place.value.columns
    curve = permuted_total(blocks.weighted(a, by), moved.select(*by, "perm_id", *where, weight), group_sizes(a, b, by), perms, by, rmax, step, dealt, place)
    return curve.select(*by, "perm_id", "r_idx", "r", F.coalesce(F.try_divide(F.lit(area), F.col("n_a") * F.col("n_b")) * F.col("total"), F.lit(0.0)).alias("k"))


def permuted_total(a: DataFrame, moved: DataFrame, sizes: DataFrame, perms: DataFrame, by: list[str], rmax: float, step: float, dealt: bool = False, place=None) -> DataFrame:
    """(by.., perm_id, r_idx, r, total, n_a, n_b): running weight of the pairs of a (by.., x, y, w) and moved (by.., perm_id, x, y, w)."""
    scratch_folder(a.sparkSession)
    sizes = sizes.withColumn("_g", F.monotonically_increasing_id()).checkpoint()
    if place is None:
        moved = moved.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    a, moved = (looked_up(d, sizes.select(*by, "_g"), by) for d in (a, moved))
    n_perm = 1 + (perms.agg(F.max("perm_id")).first()[0] or 0)
    buckets = blocks.permuted_profile(a.select("_g", "x", "y", "w"), moved.drop(*by), "_g", sizes, n_perm, rmax, step, dealt, place)
    return radius_profile(buckets, sizes.crossJoin(F.broadcast(perms)), ["_g", "perm_id"], rmax, step).join(sizes, "_g")


def toroidal_null(a: DataFrame, b: DataFrame, shifts: DataFrame, by: list[str], width: float, height: float, rmax: float, step: float) -> DataFrame:
    """(by.., perm_id, r_idx, r, k) for rigid wrapped shifts of b given by shifts(perm_id, dx, dy); shifts are broadcast, bounded by the number of permutations."""
    s = F.broadcast(shifts)
    # a rigid shift takes points of one position to one position
    places = blocks.weighted(b, by)
    moved = places.repartition(int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")), *places.columns)
    moved = moved.crossJoin(s).withColumn("x", F.pmod(F.col("x") + F.col("dx"), F.lit(width))).withColumn("y", F.pmod(F.col("y") + F.col("dy"), F.lit(height))).drop("dx", "dy")
    return permuted_k(a, b, moved, shifts.select("perm_id"), by, width * height, rmax, step)


def bounding_box(pts: DataFrame, by: list[str]) -> DataFrame:
    """Area of the rectangle around each group's points: by.., area, n."""
    return pts.groupBy(*by).agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"), F.count(F.lit(1)).alias("n"))


def intensity_at(pts: DataFrame, grid: DataFrame, by: list[str], cell: float) -> DataFrame:
    """Points with the intensity of the grid cell (by.., gx, gy, lam) in which they lie: by.., pt_id, lam; null where the grid has no such cell."""
    place = lambda c: F.floor(F.col(c) / cell).alias(f"g{c}")
    return pts.select(*by, "pt_id", place("x"), place("y")).join(grid, [*by, "gx", "gy"], "left").select(*by, "pt_id", "lam")
