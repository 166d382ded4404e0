"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors are compared within a label and by cosine, that is by distance on the
unit sphere.  Identical vectors are collapsed first and counted.  A label of more
than one task's share of vectors hangs under pivots (the top level of its cover
tree, picked from a bounded sample, one for each share); the vectors nearest to
one pivot form a cell with a covering radius, and a large cell is dealt into
several nodes with the same centre.  A pair of cells further apart than their
radii plus the threshold is pruned, and so is a vector that no vector of the other
cell can be near: by that cell's radius, or by its distance from the plane between
the two pivots.  What remains of a pair of nodes goes to one task, which builds a
cover tree of each side (levels of halving radii) and walks both together.  A pair
of tree nodes is dropped when its centres are further apart than both radii plus
the threshold, and linked as a whole when even its furthest points are within the
threshold, so a dense cluster costs its size and not its square.

A task returns sums and a spanning forest, at most two rows for each of its
vectors; pairs are never written out.

Defined results: a null label, a null or empty vector, one with a null or
non-finite component and one of zeros link with nothing; vectors of different
lengths don't link; vectors whose cosine is the threshold (ties) link; rows that
repeat an id count as vectors of their own and carry the same component; rows
without an id are left out; an empty table gives no rows; columns beyond vec_id,
embedding and label are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stash

THRESHOLD = 0.93
#: Most vector components of a node that one task takes (8 bytes each): 8,192 vectors of 64.
NODE_VALUES = 1 << 19
#: Most pivots of a label, and sampled vectors to pick them from.
PIVOTS = 32
SAMPLE = 256
#: Labels of several nodes up to which pivots are used (at most PIVOTS vectors for each are broadcast); with more such labels all are dealt into nodes by hash, and every two nodes of a label are compared.
LABELS = 1000
#: Centres that a cover tree's level tries at a time, and entries of a block of cosines.
TRIED = 64
BLOCK = 1 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def reach(threshold: float) -> float:
    """Distance on the unit sphere that belongs to a cosine, with room for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of k vectors, each the farthest from those before it."""
    picked, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(k, len(x)) and far.max() > 1e-12:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return np.array(picked)


def _gap(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cos))


class CoverTree:
    """Nested levels: a node's points lie within its radius of its centre, its children's centres are its radius / 2 apart.

    The points of node k are order[lo[k] : hi[k]]; its children are kids[k].
    """

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.centre, self.radius, self.lo, self.hi, self.kids = [], [], [], [], []
        todo = []

        def node(at, dist):
            here = len(self.centre)
            self.centre.append(int(self.order[at]))
            self.radius.append(float(dist.max()))
            self.lo.append(at)
            self.hi.append(at + len(dist))
            self.kids.append([])
            if len(dist) > 1:
                todo.append(here)
            return here

        node(0, _gap(x @ x[0]))
        while todo:
            k = todo.pop()
            at, points = self.lo[k], self.order[self.lo[k] : self.hi[k]]
            for members, dist in self._cover(x, points, self.radius[k] / 2):
                self.order[at : at + len(members)] = members
                self.kids[k].append(node(at, dist))
                at += len(members)
        self.centre, self.radius, self.lo, self.hi = (np.array(c) for c in (self.centre, self.radius, self.lo, self.hi))
        self.leaf = self.hi - self.lo == 1
        self.kids = [np.array(c, np.int64) for c in self.kids]

    @staticmethod
    def _cover(x, points, half):
        """(members, their distance from the first) of groups of points within `half` of a centre; single points once that is below rounding."""
        points = points.copy()
        if half < 1e-6:
            yield from ((points[k : k + 1], np.zeros(1)) for k in range(len(points)))
            return
        while len(points):
            tried = points[:TRIED]
            near = _gap(x[tried] @ x[tried].T) <= half
            np.fill_diagonal(near, True)
            picked = []
            for k in range(len(tried)):
                if not near[k, picked].any():
                    picked.append(k)
            centres = tried[picked]
            gap = np.concatenate([_gap(x[points[k : k + 8192]] @ x[centres].T) for k in range(0, len(points), 8192)])
            gap[picked, np.arange(len(picked))] = -1  # a centre is its own group's first
            best = gap.argmin(axis=1)
            least = gap[np.arange(len(points)), best]
            inside = least <= half
            for k in range(len(picked)):
                own = np.flatnonzero(inside & (best == k))
                own = own[np.argsort(least[own], kind="stable")]
                yield points[own], np.maximum(least[own], 0)
            points = points[~inside]


def dual(x: np.ndarray, y: np.ndarray, tx: CoverTree, ty: CoverTree, threshold: float, same: bool):
    """Of the pairs of points of two trees those within the threshold: (True, node, node) of nodes linked as a whole, (False, points, points) of single pairs.

    Of one set (`same`) each pair comes once; a node linked as a whole with itself has all its pairs linked.
    """
    far, slack = reach(threshold), 1e-6
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        own = same and a == b
        if own and 2 * tx.radius[a] <= far - slack:
            if not tx.leaf[a]:
                yield True, a, a
            continue
        left, right = (np.array([k]) if t.leaf[k] else t.kids[k] for t, k in ((tx, a), (ty, b)))
        rows = max(1, BLOCK // len(right))
        for at in range(0, len(left), rows):
            part = left[at : at + rows]
            cos = x[tx.centre[part]] @ y[ty.centre[right]].T
            gap, radii = _gap(cos), tx.radius[part][:, None] + ty.radius[right][None, :]
            live = gap <= radii + far + slack
            if own:
                live &= np.arange(at, at + len(part))[:, None] <= np.arange(len(right))[None, :]
            i, j = np.nonzero(live)
            p, q, cos, gap, radii = part[i], right[j], cos[i, j], gap[i, j], radii[i, j]
            if own:
                stack.extend((int(k), int(k)) for k in p[p == q])
                other = p != q
                p, q, cos, gap, radii = p[other], q[other], cos[other], gap[other], radii[other]
            points = tx.leaf[p] & ty.leaf[q]
            if points.any():
                u, v, c = tx.centre[p[points]], ty.centre[q[points]], cos[points]
                for close in np.flatnonzero(np.abs(c - threshold) < 1e-12):
                    c[close] = math.fsum((x[u[close]] * y[v[close]]).tolist())
                yield False, u[c >= threshold], v[c >= threshold]
            whole = ~points & (gap + radii <= far - slack)
            yield from ((True, int(m), int(n)) for m, n in zip(p[whole], q[whole], strict=True))
            open_ = ~points & ~whole
            stack.extend(zip(p[open_].tolist(), q[open_].tolist(), strict=True))


def forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest number reachable from each point, from labels so far and further links (i, j)."""
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        for end in (label[i], label[j], i, j):
            np.minimum.at(after, end, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def linked(x: np.ndarray, m: np.ndarray, n_left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors that stand for m vectors each: (vectors linked with each, smallest number it reaches).

    The first n_left are held against the others, or all against all where there are no others.
    """
    same = n_left == len(x)
    left, right = x[:n_left], x if same else x[n_left:]
    base = 0 if same else n_left
    tx = CoverTree(left)
    ty = tx if same else CoverTree(right)
    weight_x, weight_y = np.r_[0, np.cumsum(m[:n_left][tx.order])], np.r_[0, np.cumsum(m[base : base + len(right)][ty.order])]
    total, more_x, more_y = np.zeros(len(x), np.int64), np.zeros(n_left + 1, np.int64), np.zeros(len(right) + 1, np.int64)
    label, ends, held = np.arange(len(x)), [], 0
    for whole, p, q in dual(left, right, tx, ty, threshold, same):
        if whole:
            a, b = slice(tx.lo[p], tx.hi[p]), slice(ty.lo[q], ty.hi[q])
            more_x[a.start] += weight_y[b.stop] - weight_y[b.start]
            more_x[a.stop] -= weight_y[b.stop] - weight_y[b.start]
            if same and p == q:
                total[tx.order[a]] -= m[tx.order[a]]  # not with itself
                ends.append((np.full(a.stop - a.start, tx.centre[p]), tx.order[a]))
            else:
                more_y[b.start] += weight_x[a.stop] - weight_x[a.start]
                more_y[b.stop] -= weight_x[a.stop] - weight_x[a.start]
                ends += [(tx.order[a], np.full(a.stop - a.start, base + ty.centre[q])), (np.full(b.stop - b.start, tx.centre[p]), base + ty.order[b])]
        else:
            np.add.at(total, p, m[base + q])
            np.add.at(total, base + q, m[p])
            ends.append((p, base + q))
        held += len(ends[-1][0])
        if held > BLOCK:  # keep labels, not links
            label, ends, held = forest(label, *(np.concatenate(e) for e in zip(*ends, strict=True))), [], 0
    if ends:
        label = forest(label, *(np.concatenate(e) for e in zip(*ends, strict=True)))
    total[tx.order] += np.cumsum(more_x)[:-1]
    total[base + ty.order] += np.cumsum(more_y)[:-1]
    return total, label


def _kernel(threshold: float):
    """Links of a pair of nodes; a pair of different nodes of which one sent no vector has none."""
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})

    def run(table: pa.Table) -> pa.Table:
        task = table.column("task")[0].as_py()
        table = table.sort_by("side")
        ids, side, m = (table.column(c).to_numpy() for c in ("rep", "side", "m"))
        n_left = int((side == 0).sum())
        if (task["p"], task["i"]) != (task["q"], task["j"]) and n_left in (0, len(ids)):
            return empty
        x = unit(table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        total, label = linked(x, m, n_left, threshold)
        own, joined = np.flatnonzero(total), np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": np.concatenate([ids[own], ids[joined]]), "b": np.concatenate([ids[own], ids[label[joined]]]), "n": np.concatenate([total[own], np.zeros(len(joined), np.int64)])})

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, values: int = NODE_VALUES) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of `vectors` (vec_id, embedding, label) with an id."""
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # a vector's identity: 96 bits of hash and its length
    rows = rows.select("vec_id", "embedding", "label", usable.alias("usable"), F.xxhash64("label", "embedding").alias("h1"), F.hash("embedding", "label").alias("h2"))
    by_id = rows.groupBy("vec_id", "h1", "h2").agg(F.first("usable").alias("usable"), F.count(F.lit(1)).alias("m"))
    groups = stash(rows.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "distinct")

    sizes = groups.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    picked: dict[tuple[str, int], np.ndarray] = {}
    shares = F.ceil(F.col("n") * F.col("dim") / values).cast("int")
    large = sizes.select("label", "dim", "n", shares.alias("shares")).where("shares > 1")
    if large.count() <= LABELS:
        cut = large.select("label", "dim", (F.lit(float(SAMPLE << 30)) / F.col("n")).alias("cut"), "shares")
        sample = groups.join(F.broadcast(cut), ["label", "dim"]).where(F.pmod("h1", F.lit(1 << 30)) < F.col("cut")).select("label", "dim", "shares", "embedding").orderBy("rep").collect()
        for r in sample:
            picked.setdefault((r["label"], r["dim"], r["shares"]), []).append(r["embedding"])
        picked = {k: unit(np.array(v)) for k, v in picked.items()}
        picked = {k[:2]: v[farthest_first(v, min(PIVOTS, k[2]))] for k, v in picked.items()}
    shared = spark.sparkContext.broadcast(picked)

    def nearest(batches):
        pivots = shared.value
        for batch in batches:
            pivot, gap = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, 2.0)
            labels, dims = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            for label, dim in set(zip(labels.tolist(), dims.tolist(), strict=True)) & pivots.keys():
                at = np.flatnonzero((labels == label) & (dims == dim))
                x = unit(np.array([batch.column(4)[int(k)].as_py() for k in at]))
                d = np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots[label, dim].T)))
                pivot[at], gap[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(5)] + [pa.array(pivot), pa.array(gap)], ["label", "dim", "rep", "m", "embedding", "pivot", "gap"])

    placed = stash(groups.select("label", "dim", "rep", "m", "embedding").mapInArrow(nearest, "label string, dim int, rep long, m long, embedding array<float>, pivot int, gap double"), "placed")
    cells = placed.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    cells = cells.withColumn("parts", shares)

    far = reach(threshold)

    def gap_of(batches):
        """Distance of the centres of two cells; none known counts as 0."""
        pivots = shared.value
        for batch in batches:
            out = [float(np.sqrt(np.maximum(0, 2 - 2 * (pivots[k][p] @ pivots[k][q])))) if (k := (label, dim)) in pivots else 0.0 for label, dim, p, q in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(8)] + [pa.array(out, pa.float64())], ["label", "dim", "p", "q", "p_parts", "q_parts", "rp", "rq", "apart"])

    one = cells.select("label", "dim", F.col("pivot").alias("p"), F.col("parts").alias("p_parts"), F.col("radius").alias("rp"))
    two = cells.select("label", "dim", F.col("pivot").alias("q"), F.col("parts").alias("q_parts"), F.col("radius").alias("rq"))
    pairs = one.join(two, ["label", "dim"]).where("p <= q").select("label", "dim", "p", "q", "p_parts", "q_parts", "rp", "rq")
    pairs = pairs.mapInArrow(gap_of, "label string, dim int, p int, q int, p_parts int, q_parts int, rp double, rq double, apart double").where(F.col("apart") <= F.col("rp") + F.col("rq") + far + 1e-6)
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p_parts") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).where("p < q or i <= j")
    # each node of a pair asks for its vectors; those beyond the other node's reach stay away
    asks = pairs.select("label", "dim", F.col("p").alias("pivot"), F.col("i").alias("part"), F.lit(0).alias("side"), F.col("q").alias("other"), F.col("rq").alias("other_radius"), F.struct("label", "dim", "p", "i", "q", "j").alias("task"))
    asks = asks.unionByName(pairs.where("p < q or i < j").select("label", "dim", F.col("q").alias("pivot"), F.col("j").alias("part"), F.lit(1).alias("side"), F.col("p").alias("other"), F.col("rp").alias("other_radius"), F.struct("label", "dim", "p", "i", "q", "j").alias("task")))
    nodes = placed.join(cells.select("label", "dim", "pivot", "parts"), ["label", "dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    sent = nodes.join(asks, ["label", "dim", "pivot", "part"]).select("label", "dim", "rep", "m", "embedding", "pivot", "side", "other", "other_radius", "task")

    def in_reach(batches):
        pivots = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            rows_at: dict[tuple, list[int]] = {}
            for k, (label, dim, pivot, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 5, 7)), strict=True)):
                if pivot != other and (label, dim) in pivots:
                    rows_at.setdefault((label, dim, other), []).append(k)
            radius, pivot = batch.column(8).to_numpy(), batch.column(5).to_numpy()
            for (label, dim, other), at in rows_at.items():
                x = unit(np.array([batch.column(4)[k].as_py() for k in at]))
                p = pivots[label, dim]
                home, own = x @ p[other], np.einsum("ij,ij->i", x, p[pivot[at]])
                beyond = own - home > far * _gap(p[pivot[at]] @ p[other]) + 1e-6  # of the plane between the pivots
                keep[at] = (_gap(home) <= radius[at] + far + 1e-6) & ~beyond
            yield batch.select([2, 3, 4, 6, 9]).filter(pa.array(keep))

    task = "task struct<label:string,dim:int,p:int,i:int,q:int,j:int>"
    sent = sent.mapInArrow(in_reach, f"rep long, m long, embedding array<float>, side int, {task}")
    found = stash(sent.groupBy("task").applyInArrow(_kernel(threshold), "a long, b long, n long"), "links")

    sums = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    comps = connected_components(found.where("a <> b"))
    reps = groups.select("h1", "h2", "rep", F.col("m").alias("copies")).join(sums, "rep", "left").join(comps.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    out = by_id.join(reps, ["h1", "h2"], "left")
    n_links = F.when(F.col("usable"), F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).otherwise(F.lit(0))
    component = F.when(F.col("usable"), F.coalesce("component_id", "rep")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", "m", n_links.cast("long").alias("n_links"), component.alias("component_id"))
    return out.select(F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("_copy"), "vec_id", "n_links", "component_id").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
