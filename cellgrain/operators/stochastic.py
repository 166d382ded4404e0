"""Monte-Carlo nulls, mixture classification and calibration, with random numbers keyed by ids.

Every draw is a hash of (seed, sample, permutation, point), so results don't
depend on partitioning or on which executor runs a task.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .point_pattern import group_sizes, loo_intensity, permuted_k, permuted_total
from .proximity import looked_up
from .scratch import scratch_folder


def uniform(*key) -> Column:
    """A number in [0, 1) that depends on the key columns only."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / float(1 << 52)


def normal(*key) -> Column:
    """A standard normal by Box and Muller."""
    u, v = F.greatest(uniform(*key, F.lit("u")), F.lit(1e-16)), uniform(*key, F.lit("v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


#: Permutations of a group that one task redraws, in parts of its points.
RUN, PARTS = 50, 4


def permutations(df: DataFrame, n_perm: int, by: list[str]) -> DataFrame:
    """Each row once for each permutation.

    Rows are dealt out first, while they are few: they come from a few scan tasks, which would draw everything else.  They
    go by group and run of permutations, so that a task redraws few curves' points and adds up what it counts of them.
    """
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    runs = df.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_perm - 1) // RUN).cast("long"))))
    dealt = runs.repartition(tasks, *by, "_run", F.pmod(F.xxhash64("pt_id"), F.lit(PARTS)))
    first = F.col("_run") * RUN
    return dealt.sortWithinPartitions(*by, "_run").withColumn("perm_id", F.explode(F.sequence(first, F.least(first + (RUN - 1), F.lit(n_perm - 1).cast("long"))))).drop("_run")


def _curves(a: DataFrame, b: DataFrame, moved: DataFrame, place, by: list[str], area: float, n_perm: int, rmax: float, step: float, dealt: bool = True) -> DataFrame:
    return permuted_k(a, b, moved, a.sparkSession.range(n_perm).select(F.col("id").alias("perm_id")), by, area, rmax, step, dealt, place)


def csr_null(a: DataFrame, b: DataFrame, by: list[str], width: float, height: float, n_perm: int, rmax: float, step: float, seed: int = 0) -> DataFrame:
    """K under b uniform on the rectangle."""
    p = permutations(b, n_perm, by)
    key = [F.lit(seed), *[F.col(c) for c in by], F.col("perm_id"), F.col("pt_id")]
    moved = p.withColumn("x", uniform(*key, F.lit("x")) * width).withColumn("y", uniform(*key, F.lit("y")) * height)
    return _curves(a, b, moved, None, by, width * height, n_perm, rmax, step)


def normal_pair(*key) -> tuple[Column, Column]:
    """Two independent standard normals by Box and Muller, of one pair of uniforms."""
    u, v = F.greatest(uniform(*key, F.lit("u")), F.lit(1e-16)), uniform(*key, F.lit("v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v), F.sqrt(-2 * F.log(u)) * F.sin(2 * math.pi * v)


#: Jittered positions tried for a drawn point before it stays on its support point.
REDRAWS = 128
#: Support points up to which all go to every task, after a count, and drawn points that a task places at once.
SUPPORT, PLACED = 2_000_000, 1 << 14

_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _turned(h: np.ndarray, k: int) -> np.ndarray:
    return (h << np.uint64(k)) | (h >> np.uint64(64 - k))


def hashed_on(h: np.ndarray, v: int | str) -> np.ndarray:
    """Spark's xxhash64(.., v) from that of the columns before it (unsigned), for a 32-bit number v or one ASCII letter."""
    if isinstance(v, str):
        h = (h + _P5 + np.uint64(1)) ^ (np.uint64(ord(v)) * _P5)
        return _mixed(_turned(h, 11) * _P1)
    h = (h + _P5 + np.uint64(4)) ^ (np.uint64(v) * _P1)
    return _mixed(_turned(h, 23) * _P2 + _P3)


def uniform_on(h: np.ndarray, v: str) -> np.ndarray:
    """`uniform(.., v)` from the hash of what comes before v."""
    return (hashed_on(h, v) & np.uint64((1 << 52) - 1)).astype(float) / float(1 << 52)


class Support:
    """Places drawn rows on support points with Gaussian jitter, as the columns of `support_null` do: rows carry the hash of their key and the number of their support's group."""

    columns = ("_h", "_o")

    def __init__(self, table, width: float, height: float, jitter: float):
        group = table.column("_o").to_numpy()
        order = np.argsort(group, kind="stable")
        self.sx, self.sy = (table.column(c).to_numpy()[order] for c in "xy")
        self.n = np.bincount(group, minlength=1)
        self.start = np.cumsum(self.n) - self.n
        self.window, self.jitter = (width, height), jitter

    def __call__(self, points) -> tuple[np.ndarray, np.ndarray]:
        h, o = points.column("_h").to_numpy().view(np.uint64), points.column("_o").to_numpy()
        parts = [self._some(h[k : k + PLACED], o[k : k + PLACED]) for k in range(0, len(h), PLACED)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def _some(self, h: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            at = self.start[o] + np.floor(uniform_on(h, "s") * self.n[o]).astype(np.int64)
            sx, sy = self.sx[at], self.sy[at]
            x, y, out = sx.copy(), sy.copy(), np.arange(len(h))
            for t in range(REDRAWS):
                u, v = (uniform_on(hashed_on(h[out], t), c) for c in "uv")
                size, turn = self.jitter * np.sqrt(-2 * np.log(np.maximum(u, 1e-16))), 2 * math.pi * v
                tx, ty = sx[out] + size * np.cos(turn), sy[out] + size * np.sin(turn)
                held = (tx >= 0) & (tx <= self.window[0]) & (ty >= 0) & (ty <= self.window[1])
                x[out[held]], y[out[held]] = tx[held], ty[held]
                out = out[~held & ~(np.isnan(tx) | np.isnan(ty))]
                if not len(out):
                    break
        return x, y


def support_null(a: DataFrame, b: DataFrame, support: DataFrame, by: list[str], width: float, height: float, n_perm: int, rmax: float, step: float, jitter: float = 2.0, seed: int = 0) -> DataFrame:
    """K under b redrawn from the sample's support points with Gaussian jitter, kept inside the window.

    A position outside the window is drawn again, jitter and all, up to REDRAWS times.  The first position is plain
    columns; only rows that it takes outside reach the list of further ones.  Support that several groups share is given
    once, under those of the columns `by` that it has.  Up to SUPPORT points of it go to every task, which draws, places and
    counts a row at once from the hash of its key; more are joined.
    """
    own = [c for c in by if c in support.columns]
    if support.limit(SUPPORT + 1).count() <= SUPPORT:
        return _curves(a, b, *_placed_in_tasks(b, support, by, own, width, height, n_perm, jitter, seed), by, width * height, n_perm, rmax, step)
    s = support.withColumn("_k", F.row_number().over(Window.partitionBy(*own).orderBy("pt_id")) - 1).select(*own, "_k", F.col("x").alias("sx"), F.col("y").alias("sy"))
    n = support.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    key = [F.lit(seed), *[F.col(c) for c in by], F.col("perm_id"), F.col("pt_id")]
    drawn = permutations(b.join(n, own).select(*by, "pt_id", "_n"), n_perm, by).withColumn("_k", F.floor(uniform(*key, F.lit("s")) * F.col("_n")).cast("int"))
    drawn = looked_up(drawn, s, [*own, "_k"])
    at = lambda t: [F.col(c) + jitter * z for c, z in zip(("sx", "sy"), normal_pair(*key, t), strict=True)]
    held = lambda x, y: x.between(0, width) & y.between(0, height)
    x, y = at(F.lit(0))
    drawn = drawn.withColumns({"x": x, "y": y})
    more = F.filter(F.transform(F.sequence(F.lit(1), F.lit(REDRAWS - 1)), lambda t: F.struct(*[v.alias(c) for v, c in zip(at(t), "xy", strict=True)])), lambda p: held(p["x"], p["y"]))
    again = F.coalesce(F.try_element_at(more, F.lit(1)), F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")))
    drawn = drawn.withColumn("_p", F.when(~held(F.col("x"), F.col("y")), again))
    moved = drawn.select(*by, "perm_id", "pt_id", F.coalesce("_p.x", "x").alias("x"), F.coalesce("_p.y", "y").alias("y"))
    return _curves(a, b, moved, None, by, width * height, n_perm, rmax, step, dealt=False)


def _placed_in_tasks(b: DataFrame, support: DataFrame, by: list[str], own: list[str], width: float, height: float, n_perm: int, jitter: float, seed: int) -> tuple[DataFrame, Broadcast]:
    """Drawn rows (by.., perm_id, _h, _o) without a position, and what gives them theirs."""
    scratch_folder(b.sparkSession)
    known = support.where(F.lit(True) if not own else reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in own])).select(*own).distinct()
    groups = known.withColumn("_o", F.row_number().over(Window.orderBy(*own)) - 1 if own else F.lit(0)).checkpoint()  # one row for each group
    numbered = support.join(F.broadcast(groups), own) if own else support.crossJoin(groups)
    place = b.sparkSession.sparkContext.broadcast(Support(numbered.orderBy("_o", "pt_id").select("_o", "x", "y").toArrow(), width, height, jitter))
    rows = b.join(F.broadcast(groups), own) if own else b.crossJoin(groups)
    key = [F.lit(seed), *[F.col(c) for c in by], F.col("perm_id"), F.col("pt_id")]
    return permutations(rows.select(*by, "pt_id", "_o"), n_perm, by).withColumn("_h", F.xxhash64(*key)), place


def intensity_grid(pts: DataFrame, by: list[str], width: float, height: float, cell: float, sigma: float) -> DataFrame:
    """Smoothed intensity on grid cells (by.., gx, gy, lam): binned counts joined with kernel offsets, floored at 2 % of the mean."""
    reach = int(math.ceil(4 * sigma / cell))
    offsets = [(i, j, math.exp(-((i * i + j * j) * cell * cell) / (2 * sigma * sigma))) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    total = sum(w for _, _, w in offsets)
    kernel = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w / total).alias("w")) for i, j, w in offsets]))
    bins = pts.groupBy(*by, F.floor(F.col("x") / cell).alias("bx"), F.floor(F.col("y") / cell).alias("by_")).agg(F.count(F.lit(1)).alias("c"))
    spread = bins.withColumn("_o", kernel).select(*by, (F.col("bx") + F.col("_o.i")).alias("gx"), (F.col("by_") + F.col("_o.j")).alias("gy"), (F.col("c") * F.col("_o.w")).alias("v"))
    grid = spread.where(F.col("gx").between(0, int(width // cell)) & F.col("gy").between(0, int(height // cell))).groupBy(*by, "gx", "gy").agg((F.sum("v") / (cell * cell)).alias("lam"))
    floor = 0.02 * F.avg("lam").over(Window.partitionBy(*by))
    return grid.withColumn("lam", F.greatest("lam", floor))


def kde_null(a: DataFrame, b: DataFrame, by: list[str], width: float, height: float, n_perm: int, rmax: float, step: float, cell: float = 25.0, sigma: float = 50.0, seed: int = 0) -> DataFrame:
    """K under b redrawn from its own smoothed intensity: a cell by its share, then uniform within the cell."""
    return _curves(a, b, redrawn(b, by, width, height, n_perm, cell, sigma, seed), None, by, width * height, n_perm, rmax, step)


def kde_sweep(a: DataFrame, b: DataFrame, by: list[str], width: float, height: float, n_perm: int, rmax: float, step: float, sigma: float = 50.0, factors: tuple[float, ...] = (0.5, 1.0, 2.0), seed: int = 0) -> DataFrame:
    """The curves of `kde_null` at several bandwidths: by.., factor, perm_id, r_idx, r, k."""
    parts = [kde_null(a, b, by, width, height, n_perm, rmax, step, sigma * f / 2, sigma * f, seed).withColumn("factor", F.lit(f)) for f in factors]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Equal parts of [0, 1) by which a draw finds its cell.
DRAWS = 1024


def redrawn(b: DataFrame, by: list[str], width: float, height: float, n_perm: int, cell: float, sigma: float, seed: int = 0) -> DataFrame:
    """b drawn anew from its smoothed intensity in each permutation: by.., perm_id, pt_id, x, y."""
    return drawn_from_field(permutations(b.select(*by, "pt_id"), n_perm, by), intensity_grid(b, by, width, height, cell, sigma), by, width, height, cell, [F.lit(seed), *[F.col(c) for c in by], F.col("perm_id"), F.col("pt_id")])


def drawn_from_field(rows: DataFrame, field: DataFrame, by: list[str], width: float, height: float, cell: float, key: list[Column]) -> DataFrame:
    """`rows` with x and y drawn from a field of cells (by.., gx, gy, lam): a cell by its share, then uniform within it.  `key` names a draw."""
    run = Window.partitionBy(*by).orderBy("gx", "gy")
    upto = F.sum("lam").over(run.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("lam").over(Window.partitionBy(*by))
    cells = field.select(*by, "gx", "gy", upto.alias("hi"))
    cells = cells.withColumn("lo", F.coalesce(F.lag("hi").over(run), F.lit(0.0))).withColumn("hi", F.when(F.lead("hi").over(run).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    # a cell stands in each of the DRAWS equal parts of [0, 1) that its share overlaps, so a draw meets the few cells of its part
    part = lambda c: F.least(F.floor(F.col(c) * DRAWS), F.lit(DRAWS - 1))
    cells = cells.withColumn("_part", F.explode(F.sequence(part("lo"), part("hi"))))
    drawn = rows.drop("x", "y").withColumn("_u", uniform(*key, F.lit("c"))).withColumn("_part", part("_u"))
    drawn = looked_up(drawn, cells, [*by, "_part"]).where("_u >= lo and _u < hi")
    drawn = drawn.withColumns({"x": F.least((F.col("gx") + uniform(*key, F.lit("x"))) * cell, F.lit(width)), "y": F.least((F.col("gy") + uniform(*key, F.lit("y"))) * cell, F.lit(height))})
    return drawn.drop("_u", "_part", "lo", "hi", "gx", "gy")


def field_null(a: DataFrame, b: DataFrame, field: DataFrame, by: list[str], width: float, height: float, cell: float, n_perm: int, rmax: float, step: float, seed: int = 0) -> DataFrame:
    """K under b redrawn from a field that isn't its own (by.., gx, gy, lam), such as the smoothed field of all cells: by.., perm_id, r_idx, r, k."""
    key = [F.lit(seed), *[F.col(c) for c in by], F.col("perm_id"), F.col("pt_id")]
    moved = drawn_from_field(permutations(b.select(*by, "pt_id"), n_perm, by), field, by, width, height, cell, key)
    return _curves(a, b, moved, None, by, width * height, n_perm, rmax, step)


def reweighted_null(a: DataFrame, b: DataFrame, by: list[str], width: float, height: float, n_perm: int, rmax: float, step: float, bandwidth: float = 75.0, seed: int = 0) -> DataFrame:
    """Inhomogeneous K under b redrawn from its smoothed intensity, whose own intensity is estimated anew in each permutation: by.., perm_id, r_idx, r, k.

    a and its leave-one-out intensity are the same throughout; each pair counts 1 / (lambda_a lambda_b*).
    """
    area = width * height
    moved = redrawn(b, by, width, height, n_perm, max(bandwidth / 3, width / 160), bandwidth, seed)
    moved = with_intensity(moved, [*by, "perm_id"], bandwidth, area).withColumn("w", 1 / F.col("lb"))
    fixed = blocks.weighted(a.join(loo_intensity(a, by, bandwidth, area), [*by, "pt_id"]), by, 1 / F.col("lam"))
    perms = a.sparkSession.range(n_perm).select(F.col("id").alias("perm_id"))
    curve = permuted_total(fixed, moved, group_sizes(a, b, by), perms, by, rmax, step, dealt=True)
    return curve.select(*by, "perm_id", "r_idx", "r", (F.col("total") / area).alias("k"))


def with_intensity(pts: DataFrame, by: list[str], bandwidth: float, area: float) -> DataFrame:
    """Points with their leave-one-out kernel intensity in the column lb, as `point_pattern.loo_intensity` has it.

    The kernel reaches four bandwidths, which is most of a usual window, so nearly every two points of a group count:
    a group (one sample's points in one permutation) is one Arrow group, in blocks of every two points once, instead of
    a joined row for each pair and permutation.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pts.select(*by, "pt_id", "x", "y").schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n = pdf.sort_values("y", kind="stable"), len(pdf)
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        lam, at, reach = np.zeros(n), 0, 4 * bandwidth
        while at < n:  # points by y: those of a block against each other and the later ones in reach
            end = min(n, at + max(1, blocks.PAIRS // max(1, int(np.searchsorted(y, y[at] + reach, side="right")) - at)))
            upto = int(np.searchsorted(y, y[end - 1] + reach, side="right"))
            d2, dy = x[at:end, None] - x[at:upto], y[at:end, None] - y[at:upto]
            d2 *= d2
            dy *= dy
            d2 += dy
            far = d2 > reach * reach
            d2 *= -1 / (2 * bandwidth * bandwidth)
            kernel = np.exp(d2, out=d2)
            kernel[far] = 0
            kernel[np.arange(end - at), np.arange(end - at)] = 0
            lam[at:end] += kernel.sum(axis=1)
            lam[end:upto] += kernel[:, end - at :].sum(axis=0)
            at = end
        lam = lam / (2 * math.pi * bandwidth * bandwidth) if n > 1 else lam + n / area
        return pdf.assign(lb=np.maximum(lam, 0.02 * n / area))

    return pts.select(*by, "pt_id", "x", "y").groupBy(*by).applyInPandas(run, f"{schema}, lb double")


def attracted(a: DataFrame, b: DataFrame, by: list[str], share: float, sigma: float, seed: int = 0) -> DataFrame:
    """b with a share of its points moved beside points of a (Gaussian offsets): planted attraction, for power studies."""
    n = a.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    anchors = a.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("pt_id")) - 1).select(*by, "_k", F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    key = [F.lit(seed), *[F.col(c) for c in by], F.col("pt_id")]
    drawn = b.join(n, by, "left").withColumn("_k", F.floor(uniform(*key, F.lit("anchor")) * F.col("_n")).cast("int")).join(anchors, [*by, "_k"], "left")
    near = (uniform(*key, F.lit("share")) < share) & F.col("_ax").isNotNull()
    moved = {"x": F.col("_ax") + sigma * normal(*key, F.lit("dx")), "y": F.col("_ay") + sigma * normal(*key, F.lit("dy"))}
    return drawn.withColumns({c: F.when(near, v).otherwise(F.col(c)) for c, v in moved.items()}).select(b.columns)


def displaced(pts: DataFrame, by: list[str], error: float, width: float, height: float, seed: int = 0) -> DataFrame:
    """Points moved by Gaussian errors of a registration, without those that leave the window."""
    key = [F.lit(seed), *[F.col(c) for c in by], F.col("pt_id")]
    moved = pts.withColumns({"x": F.col("x") + error * normal(*key, F.lit("ex")), "y": F.col("y") + error * normal(*key, F.lit("ey"))})
    return moved.where(F.col("x").between(0, width) & F.col("y").between(0, height))


def rotated(pts: DataFrame, degrees: float, dx: float, dy: float, cx: float, cy: float) -> DataFrame:
    """Points turned around (cx, cy) and shifted: a known warp to recover."""
    t = math.radians(degrees)
    x, y = F.col("x") - cx, F.col("y") - cy
    return pts.withColumns({"x": math.cos(t) * x - math.sin(t) * y + cx + dx, "y": math.sin(t) * x + math.cos(t) * y + cy + dy})


def tile_null(a: DataFrame, b: DataFrame, by: list[str], width: float, height: float, tile: float, n_perm: int, rmax: float, step: float, seed: int = 0) -> DataFrame:
    """K under b redrawn uniformly within each point's own tile, so that tile counts are kept."""
    key = [F.lit(seed), *[F.col(c) for c in by], F.col("perm_id"), F.col("pt_id")]
    draw = lambda c, top: F.least((F.floor(F.col(c) / tile) + uniform(*key, F.lit(c))) * tile, F.lit(top))
    moved = permutations(b, n_perm, by).withColumn("x", draw("x", width)).withColumn("y", draw("y", height))
    return _curves(a, b, moved, None, by, width * height, n_perm, rmax, step)


# ---- two-component mixture of an image's signal -------------------------------------------------


#: Bins of an image's values that the mixture is fitted to; each keeps the count, sum and sum of squares of its values.
MIXTURE_BINS = 4096
# fixed values: least cells for a fit, variance floor, rounds and gain in log likelihood at which rounds end
LEAST_CELLS, VARIANCE_FLOOR, ROUNDS, GAIN = 10, 1e-6, 200, 1e-7


def binned(cells: DataFrame, by: list[str], v: str) -> DataFrame:
    """The finite values of each image in bins of equal width: by.., bin, n, s1, s2."""
    x = F.col(v).cast("double")
    fine = cells.select(*by, x.alias("_v")).where("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    edge = fine.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * MIXTURE_BINS), F.lit(MIXTURE_BINS - 1))).otherwise(F.lit(0))
    return fine.join(edge, by).groupBy(*by, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("s1"), F.sum(F.col("_v") * F.col("_v")).alias("s2"))


class TwoNormals:
    """A mixture of two normal distributions fitted to binned values: state is (log share, mean, variance) of both."""

    def __init__(self, n: np.ndarray, s1: np.ndarray, s2: np.ndarray):
        self.n, self.x = n.astype(float), s1 / n
        self.inner = np.maximum(s2 / n - self.x**2, 0)  # variance within a bin
        self.total = self.n.sum()

    def moments(self, weight: np.ndarray) -> np.ndarray:
        """Rows (log share, mean, variance) of weighted bins; `weight` has a row for each component."""
        size = np.maximum(weight.sum(axis=1), 1e-9)
        mean = weight @ self.x / size
        spread = (weight * ((self.x - mean[:, None]) ** 2 + self.inner)).sum(axis=1) / size
        return np.array([np.log(size / self.total), mean, spread])

    def log_joint(self, state: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        x = self.x if x is None else x
        share, mean, var = (c[:, None] for c in state)
        return share - (np.log(2 * math.pi * var) + (x - mean) ** 2 / var) / 2

    def single(self) -> float:
        """Log likelihood of one normal distribution."""
        state = self.moments(self.n[None, :]) + np.array([[0], [0], [1e-9]])
        return float((self.n * np.maximum(self.log_joint(state)[0], math.log(1e-300))).sum())

    def fit(self) -> tuple[np.ndarray, float] | None:
        """(state, log likelihood), from a start at the median; None where a side has fewer than two cells."""
        upto = np.cumsum(self.n)
        middle = [self.x[np.searchsorted(upto, k, side="right")] for k in ((self.total - 1) // 2, self.total // 2)]
        low = self.x <= sum(middle) / 2
        sides = np.array([self.n * low, self.n * ~low])
        if sides.sum(axis=1).min() < 2:
            return None
        state, held = self.moments(sides) + np.array([[0], [0], [VARIANCE_FLOOR]]), -math.inf
        for _ in range(ROUNDS):
            joint = self.log_joint(state)
            both = np.maximum(np.logaddexp(*joint), math.log(1e-300))
            state = self.moments(self.n * np.exp(joint - both))
            state[2] = np.maximum(state[2], VARIANCE_FLOOR)
            reached = float((self.n * both).sum())
            if abs(reached - held) < GAIN:
                break
            held = reached
        return state[:, np.argsort(state[1])], held

    def cut(self, state: np.ndarray) -> float:
        """Where both components are equally likely between their means, by halving; the middle where the odds don't change sign there."""
        odds = lambda v: float(np.subtract(*self.log_joint(state, np.array([v]))[:, 0]))
        lo, hi = state[1]
        if not (odds(lo) > 0 > odds(hi)):
            return float(lo + hi) / 2
        for _ in range(100):
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if odds(middle) > 0 else (lo, middle)
        return float(lo + hi) / 2


def mixture(n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> dict | None:
    """cut, Ashman's D, and BIC of one and of two components of binned values; None where there are too few."""
    model = TwoNormals(*(np.asarray(v)[np.argsort(np.asarray(s1) / np.asarray(n), kind="stable")] for v in (n, s1, s2)))
    if model.total < LEAST_CELLS or (fitted := model.fit()) is None:
        return None
    state, likelihood = fitted
    apart = math.sqrt(2) * (state[1, 1] - state[1, 0]) / math.sqrt(state[2].sum())
    return {"cut": model.cut(state), "ashman": apart, "bic1": 2 * math.log(model.total) - 2 * model.single(), "bic2": 5 * math.log(model.total) - 2 * likelihood}


def nuclear_thresholds(cells: DataFrame, by: list[str], v: str, fixed: float = 0.2, least: int = 20, ashman_min: float = 1.25) -> DataFrame:
    """by.., n, threshold, method, ashman, abstain for each image with a value.

    Rounds of EM need an image's values again and again, so they go to one group as at most MIXTURE_BINS bins,
    however many cells there are.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        g = mixture(*(pdf[c].to_numpy() for c in ("n", "s1", "s2"))) if n >= least else None
        good = g is not None and g["bic2"] < g["bic1"] and g["ashman"] >= ashman_min
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n": [n], "threshold": [g["cut"] if good else fixed], "method": ["gmm" if good else "fixed"], "ashman": [g["ashman"] if g else 0.0], "abstain": [not good]})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*by).schema)
    return binned(cells, by, v).groupBy(*by).applyInPandas(fit, f"{schema}, n long, threshold double, method string, ashman double, abstain boolean")


def architecture_scale(pts: DataFrame, by: list[str], width: float, height: float, cell: float = 15.0) -> DataFrame:
    """Autocorrelation length of each pattern's density field: first lag at 1/e of its radial autocorrelation; null under 30 points.

    Points are counted by grid cell first, so a group holds the window's cells and not its points.
    """
    nx, ny = max(2, int(width // cell)), max(2, int(height // cell))
    place = lambda c, top, k: F.least(F.floor(F.col(c) / top * k), F.lit(k - 1)).cast("int")
    counts = pts.withColumn("_in", F.col("x").between(0, width) & F.col("y").between(0, height)).groupBy(*by, F.when(F.col("_in"), place("x", width, nx)).alias("gx"), F.when(F.col("_in"), place("y", height, ny)).alias("gy")).agg(F.count(F.lit(1)).alias("c"))

    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        n, out = int(pdf["c"].sum()), None
        if n >= 30:
            inside = pdf.dropna(subset=["gx", "gy"])
            field = np.zeros((nx, ny))
            field[inside["gx"].to_numpy(int), inside["gy"].to_numpy(int)] = inside["c"]
            field -= field.mean()
            size = [2 * k for k in field.shape]
            auto = np.fft.irfft2(abs(np.fft.rfft2(field, size)) ** 2, size)
            r = np.hypot(*np.meshgrid(*[np.minimum(np.arange(k), k - np.arange(k)) for k in size], indexing="ij"))
            k = np.rint(r).astype(int).ravel()
            prof = np.bincount(k, auto.ravel())[:40] / np.maximum(np.bincount(k)[:40], 1)
            prof = prof / prof[0] if prof[0] > 0 else prof
            below = np.flatnonzero(prof <= 1 / math.e)
            if len(below) and below[0] > 0:
                i = below[0]
                out = cell * (i - 1 + (prof[i - 1] - 1 / math.e) / (prof[i - 1] - prof[i]))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n": [n], "scale": [out]}).astype({"scale": "float64"})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pts.select(*by).schema)
    return counts.groupBy(*by).applyInPandas(scale, f"{schema}, n long, scale double").withColumn("scale", F.when(~F.isnan("scale"), F.col("scale")))


def calibrate_loo(cells: DataFrame, by: list[str], score: str, truth: str) -> DataFrame:
    """Leave-one-out F1 of the best-F1 cut: by.., n, loo_f1 (null with fewer than two of a class or four in all).

    Cells of equal score and truth are left out alike, so everything comes from counts by score.  Without a cell of
    score v and truth y, a cut below v loses y hits and one call, a cut from v on loses neither; the cell is called where
    the best cut below v is at least as good as the best from v on, as the lowest of equal cuts is taken.  A cell without
    a score lies above no cut.
    """
    s = F.col(score).cast("double")
    c = cells.select(*by, F.when(~F.isnan(s), s).alias("_s"), F.col(truth).cast("long").alias("_y")).groupBy(*by, "_s").agg(F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_n"))
    up, whole = Window.partitionBy(*by).orderBy("_s"), Window.partitionBy(*by)
    beyond, below = up.rowsBetween(1, Window.unboundedFollowing), up.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_tp", F.coalesce(F.sum("_p").over(beyond), F.lit(0))).withColumn("_all", F.coalesce(F.sum("_n").over(beyond), F.lit(0)))
    c = c.withColumn("_pos", F.sum("_p").over(whole))
    scored = F.col("_s").isNotNull()
    f1 = lambda y, lost: F.when(scored, 2.0 * (F.col("_tp") - y * lost) / F.greatest(F.col("_all") - lost + F.col("_pos") - y, F.lit(1)))
    for y in (0, 1):
        c = c.withColumn("_own", f1(y, 0))
        low, high = F.max(f1(y, 1)).over(below), F.greatest(F.max("_own").over(beyond), F.when(F.col("_n") > 1, F.col("_own")))
        c = c.withColumn(f"_call{y}", F.coalesce(scored & low.isNotNull() & (high.isNull() | (low >= high)), F.lit(False)).cast("long"))
    hits = F.sum(F.col("_call1") * F.col("_p"))
    called = hits + F.sum(F.col("_call0") * (F.col("_n") - F.col("_p")))
    n, pos = F.sum("_n"), F.sum("_p")
    return c.groupBy(*by).agg(n.alias("n"), F.when((n >= 4) & pos.between(2, n - 2), 2 * hits / F.greatest(called + pos, F.lit(1))).alias("loo_f1"))
