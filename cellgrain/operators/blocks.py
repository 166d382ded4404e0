"""Sums over pairs of points, taken in blocks of numpy inside grouped tasks, so that a pair is never a row.

Points of one position are one entry with a weight.  Spark deals both sides out by bins of the plane (crowded ones in
parts) or by group and permutation; a task holds the points of one of these, and a block of at most PAIRS pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are worked on at once, points of a side in one task, and redrawn points in one task.
PAIRS, CROWD, DRAWN = 1 << 15, 50_000, 200_000
#: Different positions that go to every task, after a count, so that redrawn points stay where they are drawn, and curves that a task adds up at once.
FIXED, CURVES = 2_000_000, 20_000


def weighted(pts: DataFrame, by: list[str], weight=None) -> DataFrame:
    """The different positions of each group: by.., x, y, w (how many points lie there, or the sum of `weight`); points without finite coordinates are left out."""
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    return pts.where(finite).groupBy(*by, "x", "y").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("double").alias("w"))


class Cloud:
    """Points of an Arrow table, by y."""

    def __init__(self, table: pa.Table, *more: str):
        columns = [table.column(c).to_numpy() for c in ("x", "y", "w", *more)]
        order = np.argsort(columns[1], kind="stable")
        self.x, self.y, self.w, *self.more = (c[order] for c in columns)
        self.even = len(order) > 0 and bool((self.w == self.w[0]).all())

    def __len__(self):
        return len(self.x)

    def only(self, rows: np.ndarray) -> "Cloud":
        """The points at these places, which are in the cloud's order."""
        some = object.__new__(Cloud)
        some.x, some.y, some.w, some.more, some.even = self.x[rows], self.y[rows], self.w[rows], [c[rows] for c in self.more], self.even
        return some


def blocks(a: Cloud, b: Cloud, reach: float, wrap: bool = False, height: float = math.inf):
    """Runs of b with the slice of a that can be within `reach` of them in y (all of a on a torus): (rows of b, rows of a, dx, dy).

    A run that spans more than `height` ends there if it has a quarter of PAIRS.
    """
    at, slack = 0, reach * (1 + 1e-9)
    while at < len(b):
        lo, hi = (0, len(a)) if wrap else (int(np.searchsorted(a.y, b.y[at] - slack)), int(np.searchsorted(a.y, b.y[at] + slack, side="right")))
        most = max(1, PAIRS // max(1, hi - lo))
        if height < math.inf:
            most = min(most, max(1, most // 4, int(np.searchsorted(b.y, b.y[at] + height)) - at))
        end = min(len(b), at + most)
        if not wrap:
            hi = int(np.searchsorted(a.y, b.y[end - 1] + slack, side="right"))
        for k in range(lo, hi, PAIRS):
            part = slice(k, min(hi, k + PAIRS))
            yield slice(at, end), part, b.x[at:end, None] - a.x[part], b.y[at:end, None] - a.y[part]
        at = end


def columns(a: Cloud, b: Cloud, reach: float):
    """Both sides by columns of b half of `reach` wide, a's points in reach of it in x beside them; clouds of few pairs as they are.

    Runs of b by y meet a strip of a across the whole plane otherwise, most of it out of reach.
    """
    tile, pairs = reach / 2, len(a) * len(b)
    for v in (b.x, b.y) if pairs > PAIRS else ():  # what a tile of a column meets
        span = max(float(v.max() - v.min()), tile)
        pairs *= tile / span * min(1.0, (tile + 2 * reach) / span)
    if pairs < PAIRS / 8 or len(a) * len(b) <= PAIRS:
        yield a, b
        return
    spans = np.floor(b.x / tile)
    order = np.argsort(spans, kind="stable")  # by column, then by y
    cuts = np.flatnonzero(np.diff(spans[order])) + 1
    slack = reach * (1 + 1e-9)
    for rows in np.split(order, cuts):
        x = b.x[rows]
        near = np.flatnonzero((a.x >= x.min() - slack) & (a.x <= x.max() + slack))
        if len(near):
            yield a.only(near), b.only(rows)


def histogram(a: Cloud, b: Cloud, rmax: float, step: float, torus: tuple[float, float] | None = None, factor=None, slots: int = 1) -> np.ndarray:
    """Weight of the pairs by the first radius (0, step, .. up to rmax) that reaches them; rows are the slots of b (its first further column)."""
    top = int(rmax // step) + 1
    out, exact = np.zeros((slots, top + 1)), math.frexp(step)[0] == 0.5
    plain = a.even and b.even and factor is None
    sides = columns(a, b, rmax) if torus is None and rmax > 0 else [(a, b)]
    for a_, b_, (rows, part, dx, dy) in ((p, q, block) for p, q in sides for block in blocks(p, q, rmax, torus is not None, math.inf if q is b else rmax / 2)):
        if torus is not None:
            dx, dy = (np.minimum(v, abs(size - v)) for v, size in ((abs(dx), torus[0]), (abs(dy), torus[1])))
        weight = None if plain else b_.w[rows, None] * a_.w[part]
        if factor is not None:
            weight = weight * factor(dx, dy)
        dx *= dx
        dy *= dy
        dx += dy
        d = np.minimum(np.sqrt(dx, out=dx), top * step, out=dx)
        if exact:  # a power of two: nothing is rounded
            d *= 1 / step
            k = np.ceil(d, out=d)
        else:  # right at the boundaries whatever the division rounds to
            k = np.ceil(d / step)
            k += (k * step < d).astype(float) - ((k - 1) * step >= d)
            np.minimum(k, top, out=k)
        k = k.astype(np.int64)
        if slots > 1:
            k += b_.more[0][rows, None] * (top + 1)
        out += np.bincount(k.ravel(), None if plain else weight.ravel(), slots * (top + 1)).reshape(slots, -1)
    return out[:, :top] * (a.w[0] * b.w[0] if plain and len(a) and len(b) else 1)


def kernel_sums(a: Cloud, b: Cloud, bandwidth: float) -> np.ndarray:
    """Sum of exp(-d^2 / (2 bandwidth^2)) over the weights of a within four bandwidths, for each point of b in its order."""
    out, reach = np.zeros(len(b)), 4 * bandwidth
    for rows, part, dx, dy in blocks(a, b, reach):
        dx *= dx
        dy *= dy
        dx += dy
        far = dx > reach * reach
        dx *= -1 / (2 * bandwidth * bandwidth)
        np.exp(dx, out=dx)
        dx[far] = 0
        out[rows] += dx @ a.w[part]
    return out


class Grid:
    """Points by square cells, for those near other points; cells of a size are sorted once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: np.ndarray):
        self.x, self.y, self.rank, self.by_rank, self.sizes = x, y, rank, np.argsort(rank), {}

    def cells(self, r: float):
        if r not in self.sizes:
            size = r * (1 + 1e-6)
            x0, y0 = self.x.min(), self.y.min()
            ix, iy = (np.floor((v - low) / size).astype(np.int64) for v, low in ((self.x, x0), (self.y, y0)))
            width = int(ix.max()) + 1
            key = iy * width + ix
            order = np.argsort(key, kind="stable")
            self.sizes[r] = size, x0, y0, width, order, key[order]
        return self.sizes[r]

    def first_size(self, cap: float) -> float:
        """Cells in which a point meets few others; `cap` at most."""
        r = cap
        while r > cap / 4096:
            key = self.cells(r)[-1]
            cuts = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1))
            if float((np.diff(cuts).astype(float) ** 2).sum()) <= 4 * len(key):
                break
            del self.sizes[r]
            r /= 2
        return r

    def near(self, x: np.ndarray, y: np.ndarray, r: float):
        """(rows of x and y in order, points) of all that can be within r of each other, in parts of about PAIRS * 32."""
        size, x0, y0, width, order, key = self.cells(r)
        high = key[-1] // width + 2  # far away is as good as two cells away, whatever the number
        ix, iy = (np.clip(np.floor((v - low) / size), -2, top).astype(np.int64) for v, low, top in ((x, x0, width + 1), (y, y0, high)))
        lo, hi = np.maximum(ix - 1, 0), np.minimum(ix + 1, width - 1)
        row = iy[:, None] + np.array([-1, 0, 1])
        at = np.searchsorted(key, row * width + lo[:, None])
        n = np.where((hi >= lo)[:, None], np.searchsorted(key, row * width + hi[:, None], side="right") - at, 0)
        upto = np.cumsum(n.sum(axis=1))
        begin = 0
        while begin < len(x):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS * 32, side="right")))
            counts = n[begin:end].ravel()
            whole = np.cumsum(counts)
            if whole[-1]:
                j = order[np.repeat(at[begin:end].ravel() - whole + counts, counts) + np.arange(whole[-1])]
                yield np.repeat(np.arange(begin, end), n[begin:end].sum(axis=1)), j
            begin = end

    def nearest(self, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, cap: float, shift: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
        """The nearest point for each (x, y), at most `cap` away (ties: smallest rank), -1 where there is none; (px, py) is where the points lie now, `shift` away from where they were sorted.

        Cells grow twofold: whoever has found a point within their size can't have missed a nearer one.
        """
        return self.nearest_and_ties(x, y, px, py, cap, shift)[0]

    def nearest_and_ties(self, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, cap: float, shift: tuple[float, float] = (0.0, 0.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`nearest` with its distance and how many points are as near."""
        out, open_, r = np.full(len(x), -1), np.arange(len(x)), self.first_size(cap)
        far, ties = np.full(len(x), math.inf), np.zeros(len(x), int)
        while True:
            for i, j in self.near(x[open_] - shift[0], y[open_] - shift[1], r):
                dx, dy = x[open_][i] - px[j], y[open_][i] - py[j]
                d = np.sqrt(dx * dx + dy * dy)
                close = np.flatnonzero(d <= r)
                if not len(close):
                    continue
                i, j, d = i[close], j[close], d[close]
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                least = np.repeat(np.minimum.reduceat(d, starts), np.diff(starts, append=len(i)))
                at, level = open_[i[starts]], d == least
                out[at] = self.by_rank[np.minimum.reduceat(np.where(level, self.rank[j], len(self.rank)), starts)]
                far[at], ties[at] = least[starts], np.add.reduceat(level.astype(int), starts)
            open_ = open_[out[open_] < 0]
            if r >= cap or not len(open_):
                return out, far, ties
            r = min(2 * r, cap)


class Mutual:
    """Counts mutual nearest pairs of two clouds (ids in the first further column) at most `cap` apart, after moves of the second; ties go to the smaller id."""

    def __init__(self, a: Cloud, b: Cloud, cap: float):
        self.cap = cap
        self.a, self.b = (Grid(c.x, c.y, np.argsort(np.argsort(c.more[0], kind="stable"))) if len(c) else None for c in (a, b))

    def count(self, x: np.ndarray, y: np.ndarray) -> int:
        """How many there are with the second cloud's points at (x, y), a rigid move from where they were."""
        if self.a is None or self.b is None:
            return 0
        a, b = self.a, self.b
        own = a.nearest(x, y, a.x, a.y, self.cap)
        rows = np.flatnonzero(own >= 0)
        if not len(rows):
            return 0
        chosen = np.unique(own[rows])
        back = np.full(len(a.x), -1)
        back[chosen] = b.nearest(a.x[chosen], a.y[chosen], x, y, self.cap, (x[0] - b.x[0], y[0] - b.y[0]))
        return int((back[own[rows]] == rows).sum())


class Places:
    """Different positions of a side with their ids in order, which are used up from the smallest on."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        order = by_id[np.lexsort((y[by_id], x[by_id]))]
        x, y, self.ids, self.order = x[order], y[order], np.argsort(by_id)[order], order
        first = np.flatnonzero((np.diff(x, prepend=np.nan) != 0) | (np.diff(y, prepend=np.nan) != 0))
        self.x, self.y, self.at, self.end = x[first], y[first], first.copy(), np.append(first[1:], len(x))
        self.to, self.d, self.ties = np.full(len(first), -1), np.full(len(first), math.inf), np.zeros(len(first), int)
        self.asks = np.ones(len(first), bool)

    def left(self) -> np.ndarray:
        return np.flatnonzero(self.at < self.end)

    def ask(self, other: "Places", tol: float) -> None:
        """Every place whose choice was used looks for its nearest one again: by distance, then by the smallest id left."""
        own, left = np.flatnonzero(self.asks & (self.at < self.end)), other.left()
        self.asks[:] = False
        self.to[own] = -1
        if len(own) and len(left):
            grid = Grid(other.x[left], other.y[left], np.argsort(np.argsort(other.ids[other.at[left]])))
            to, self.d[own], self.ties[own] = grid.nearest_and_ties(self.x[own], self.y[own], grid.x, grid.y, tol)
            self.to[own] = np.where(to >= 0, left[to], -1)


def greedy_pairs(a: Places, b: Places, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-to-one matching of all pairs within tol, nearest first (ties: smallest ids): rows of a, rows of b, distances.

    Places that choose each other are matched in rounds: as many of their points as both have left where nothing else is as
    near, else one.
    """
    out = []
    while True:
        a.ask(b, tol)
        b.ask(a, tol)
        i = np.flatnonzero((a.at < a.end) & (a.to >= 0))
        i = i[b.to[a.to[i]] == i]
        if not len(i):
            break
        j = a.to[i]
        k = np.where((a.ties[i] == 1) & (b.ties[j] == 1), np.minimum(a.end[i] - a.at[i], b.end[j] - b.at[j]), 1)
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        out.append((a.order[np.repeat(a.at[i], k) + step], b.order[np.repeat(b.at[j], k) + step], np.repeat(a.d[i], k)))
        a.at[i] += k
        b.at[j] += k
        for side, chosen in ((a, j), (b, i)):  # whoever chose one of these looks again
            used = np.zeros(len((b if side is a else a).at), bool)
            used[chosen] = True
            side.asks = (side.to >= 0) & used[side.to]
    return tuple(np.concatenate(c) if out else np.zeros(0, int) for c in (zip(*out, strict=True) if out else ((), (), ())))


def mutual_pairs(a: Cloud, b: Cloud, cap: float) -> int:
    """How many points of a and b (ids in the first further column) are each other's nearest, at most `cap` apart; ties go to the smaller id."""
    return Mutual(a, b, cap).count(b.x, b.y)


def together(left: DataFrame, right: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """`run(rows of left, rows of right)` for each key; both sides may come from one table, so their columns get names of their own."""
    left, right = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)


def _repeated(table: pa.Table, by: list[str], n: int) -> list:
    return [pa.repeat(table.column(c)[0], n) for c in by]


def binned(a: DataFrame, b: DataFrame, by: list[str], reach: float, torus: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the keys of the tasks in which each pair within reach meets once: a stands in its bin, b is listed in the bins around; a bin of many points is cut into parts."""
    sizes = (2 * reach, 2 * reach) if torus is None else tuple(s / max(1, int(s // reach)) for s in torus)
    count = [None, None] if torus is None else [max(1, int(s // reach)) for s in torus]

    def place(c, size, n):
        if n is None:
            return F.floor(F.col(c) / size)
        return F.least(F.floor(F.pmod(c, F.lit(float(size * n))) / size), F.lit(n - 1)) if n > 2 else F.lit(0).cast("long")

    left, right = (d.withColumns({"_ix": place("x", sizes[0], count[0]), "_iy": place("y", sizes[1], count[1])}) for d in (a, b))
    steps = [(-1, 0, 1) if n is None or n > 2 else (0,) for n in count]
    right = right.withColumn("_n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps[0] for j in steps[1]])))
    moved = [F.col(c) + F.col(f"_n.{k}") if n is None else F.pmod(F.col(c) + F.col(f"_n.{k}"), F.lit(n)) for c, k, n in (("_ix", "i", count[0]), ("_iy", "j", count[1]))]
    right = right.withColumns({"_ix": moved[0], "_iy": moved[1]}).drop("_n")
    keys = [*by, "_ix", "_iy"]
    sides = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb")), keys)
    parts = sides.select(*keys, (1 + F.floor(F.col("_na") / CROWD)).alias("_pa"), (1 + F.floor(F.col("_nb") / CROWD)).alias("_pb"))
    own = lambda n: F.pmod(F.xxhash64("x", "y"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = left.join(parts, keys).withColumn("_a", own("_pa")).withColumn("_b", each("_pb")).drop("_pa", "_pb")
    right = right.join(parts, keys).withColumn("_b", own("_pb")).withColumn("_a", each("_pa")).drop("_pa", "_pb")
    return left, right, [*keys, "_a", "_b"]


def profile(a: DataFrame, b: DataFrame, by: list[str], rmax: float, step: float, torus: tuple[float, float] | None = None, factor=None) -> DataFrame:
    """(by.., r_idx, _v): weight of the pairs of a and b (by.., x, y, w) whose distance first falls within radius r_idx; nothing where there are none."""
    left, right, keys = binned(a, b, by, rmax, torus)

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        v = histogram(Cloud(q), Cloud(p), rmax, step, torus, factor)[0] if p.num_rows and q.num_rows else np.zeros(0)
        at = np.flatnonzero(v)
        if not len(at):
            return empty
        return pa.Table.from_arrays([*_repeated(p, by, len(at)), pa.array(at.astype(np.int32)), pa.array(v[at])], [*by, "r_idx", "_v"])

    schema = f"{_keys(a, by)}, r_idx int, _v double"
    empty = _empty(a, by, [("r_idx", pa.int32()), ("_v", pa.float64())])
    return together(left, right, keys, run, schema).groupBy(*by, "r_idx").agg(F.sum("_v").alias("_v"))


def kernel_at(pts: DataFrame, by: list[str], bandwidth: float) -> DataFrame:
    """(by.., x, y, _s): kernel sum of all points of pts (by.., x, y, w) at each position, its own points included."""
    left, right, keys = binned(pts, pts, by, 4 * bandwidth)

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return empty
        at = Cloud(p)
        return pa.Table.from_arrays([*_repeated(p, by, len(at)), pa.array(at.x), pa.array(at.y), pa.array(kernel_sums(Cloud(q), at, bandwidth))], [*by, "x", "y", "_s"])

    empty = _empty(pts, by, [(c, pa.float64()) for c in ("x", "y", "_s")])
    return together(left, right, keys, run, f"{_keys(pts, by)}, x double, y double, _s double").groupBy(*by, "x", "y").agg(F.sum("_s").alias("_s"))


def _empty(df: DataFrame, by: list[str], more: list) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([*to_arrow_schema(df.select(*by).schema), *more]).empty_table()


def permuted_profile(a: DataFrame, moved: DataFrame, key: str, sizes: DataFrame, n_perm: int, rmax: float, step: float, dealt: bool = False, place=None) -> DataFrame:
    """(key, perm_id, r_idx, _v): pairs of a (key, x, y, w) with the redrawn points `moved` (key, perm_id, x, y, w) of each permutation, by the first radius that reaches them.

    Where `moved` is dealt out by group and run of permutations, up to FIXED positions of a are broadcast and every task
    adds up the pairs of the points that it redraws.  Else both sides are dealt out; sizes(key, n_b) says how many points a group redraws: a task takes a group's points of
    several permutations, or a part of one.  place: a broadcast function that takes a table of `moved` rows, which then have
    other columns instead of x and y, to their positions.
    """
    if dealt and a.limit(FIXED + 1).count() <= FIXED:
        return _where_drawn(a, moved, key, rmax, step, place).groupBy(key, "perm_id", "r_idx").agg(F.sum("_v").alias("_v"))
    if place is not None:
        moved = _placed(moved, key, place)
    most = sizes.agg(F.max("n_b")).first()[0] or 1
    each = max(1, min(50, DRAWN // most))
    last = (n_perm - 1) // each
    parts = sizes.select(key, (1 + F.floor(F.col("n_b") / DRAWN)).alias("_parts")).where("_parts > 1")
    block = F.floor(F.col("perm_id") / each).cast("int")
    moved, a = moved.withColumn("_block", block), a.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    if most < DRAWN:
        moved, a = moved.withColumn("_part", F.lit(0).cast("long")), a.withColumn("_part", F.lit(0).cast("long"))
    else:
        n = F.coalesce("_parts", F.lit(1).cast("long"))
        moved = moved.join(F.broadcast(parts), key, "left").withColumn("_part", F.pmod(F.xxhash64("x", "y"), n)).drop("_parts")
        a = a.join(F.broadcast(parts), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("_parts")
    keys = [key, "_block", "_part"]

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return empty
        first = p.column("_block")[0].as_py() * each
        p = p.append_column("_slot", pa.array(p.column("perm_id").to_numpy() - first))
        v = histogram(Cloud(q), Cloud(p, "_slot"), rmax, step, slots=each)
        slot, at = np.nonzero(v)
        return pa.Table.from_arrays([*_repeated(p, [key], len(at)), pa.array(slot + first), pa.array(at.astype(np.int32)), pa.array(v[slot, at])], [key, "perm_id", "r_idx", "_v"])

    schema = f"{_keys(a, [key])}, perm_id long, r_idx int, _v double"
    empty = _empty(a, [key], [("perm_id", pa.int64()), ("r_idx", pa.int32()), ("_v", pa.float64())])
    return together(moved, a, keys, run, schema).groupBy(key, "perm_id", "r_idx").agg(F.sum("_v").alias("_v"))


def gathered(batches):
    """Batches put together to tables of about DRAWN rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= DRAWN:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _at(points: pa.Table, place) -> pa.Table:
    """Rows with the positions that they are given, those without finite ones left out."""
    x, y = place.value(points)
    points = points.drop_columns(list(place.value.columns)).append_column("x", pa.array(x)).append_column("y", pa.array(y))
    fine = np.isfinite(x) & np.isfinite(y)
    return points if fine.all() else points.filter(pa.array(fine))


def _placed(moved: DataFrame, key: str, place) -> DataFrame:
    def run(batches):
        for points in gathered(batches):
            yield from _at(points, place).select([key, "perm_id", "x", "y", "w"]).to_batches()

    return moved.mapInArrow(run, f"{_keys(moved, [key])}, perm_id long, x double, y double, w double")


def _where_drawn(a: DataFrame, moved: DataFrame, key: str, rmax: float, step: float, place=None) -> DataFrame:
    """(key, perm_id, r_idx, _v) of the points of each task, in parts that add up: positions of a are few and go to every task."""
    fixed = a.sparkSession.sparkContext.broadcast(a.select(key, "x", "y", "w").toArrow())
    names = [key, "perm_id", "r_idx", "_v"]

    def run(batches):
        table, clouds, sums = fixed.value, {}, {}
        keys = table.column(key).to_numpy()
        order = np.argsort(keys, kind="stable")
        known, starts = np.unique(keys[order], return_index=True)
        rows_of = dict(zip(known.tolist(), np.split(order, starts[1:]), strict=True)) if len(order) else {}

        def drained():
            v = np.array(list(sums.values()))
            i, at = np.nonzero(v)
            g, perm = (np.array(c)[i] for c in zip(*sums, strict=True))
            sums.clear()
            for k in range(0, len(i), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(g[part]), pa.array(perm[part]), pa.array(at[part].astype(np.int32)), pa.array(v[i[part], at[part]])], names)

        for points in gathered(batches):
            if place is not None:
                points = _at(points, place)
            own = points.column(key).to_numpy()
            for g in np.unique(own).tolist():
                if g not in rows_of:
                    continue
                if g not in clouds:
                    clouds[g] = Cloud(table.take(pa.array(rows_of[g])))
                some = points.filter(pa.array(own == g))
                perms, slot = np.unique(some.column("perm_id").to_numpy(), return_inverse=True)
                found = histogram(clouds[g], Cloud(some.append_column("_slot", pa.array(slot)), "_slot"), rmax, step, slots=len(perms))
                for perm, v in zip(perms.tolist(), found, strict=True):
                    sums[g, perm] = sums[g, perm] + v if (g, perm) in sums else v
            if len(sums) > CURVES:
                yield from drained()
        if sums:
            yield from drained()

    return moved.select(key, "perm_id", *(("x", "y") if place is None else place.value.columns), "w").mapInArrow(run, f"{_keys(a, [key])}, perm_id long, r_idx int, _v double")
