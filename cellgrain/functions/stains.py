"""Optical density and stain unmixing of pixels as column functions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: least hematoxylin median of a valid candidate, and density from which a pixel counts as tissue
VALID_HEMATOXYLIN, TISSUE = 0.02, 0.1

Vector = tuple[float, float, float]


def unit_vector(v: Vector) -> Vector:
    n = float(np.linalg.norm(v))
    return tuple(float(x) / n for x in v) if n > 0 else tuple(float(x) for x in v)


def optical_density(channel: Column, white: Column | float) -> Column:
    """-log10((intensity + 1) / white point)."""
    return -F.log10((channel + 1.0) / white)


def unmixed(rgb: tuple[Column, Column, Column], stains: tuple[Vector, Vector, Vector], white: Vector) -> tuple[Column, Column, Column]:
    """Densities of three stains at a pixel: its optical density times the inverse of the unit stain vectors (rows).

    Null where a channel is null or below -1 + 1e-9 (no logarithm).
    """
    inverse = np.linalg.inv(np.array([unit_vector(v) for v in stains]))
    od = [F.when(c > -1 + 1e-9, optical_density(c, w)) for c, w in zip(rgb, white, strict=True)]
    return tuple(reduce(Column.__add__, [o * float(inverse[i, k]) for i, o in enumerate(od)]) for k in range(3))


def stain_choice(pixels: DataFrame, by: list[str]) -> DataFrame:
    """The candidate set of stain vectors of each image: by.., candidate, parity, h_median.

    pixels(by.., candidate, hema, dab, reference): unmixed densities under every candidate and the densities they should
    match.  Candidates whose median hematoxylin over tissue is valid go first, by their correlation with the reference;
    only if none is valid do all compete.  Ties go to the first name; a candidate without a correlation ranks last.
    """
    h, d = F.col("hema"), F.col("dab")
    tissue = F.abs(h) + F.abs(d) > TISSUE
    s = pixels.groupBy(*by, "candidate").agg(F.corr("dab", "reference").alias("parity"), F.coalesce(F.percentile(F.when(tissue, h), 0.5), F.percentile(h, 0.5)).alias("h_median"))
    rank = F.struct((F.col("h_median") > VALID_HEMATOXYLIN).cast("int").alias("valid"), F.when(~F.isnan("parity"), F.col("parity")).alias("parity"))
    best = s.groupBy(*by).agg(F.max(rank).alias("best"))
    same = F.coalesce((F.col("h_median") > VALID_HEMATOXYLIN).cast("int"), F.lit(0)) == F.coalesce("best.valid", F.lit(0))
    return s.join(best, by).where(same & F.when(~F.isnan("parity"), F.col("parity")).eqNullSafe(F.col("best.parity"))).groupBy(*by).agg(F.min(F.struct("candidate", "parity", "h_median")).alias("m")).select(*by, "m.*")
