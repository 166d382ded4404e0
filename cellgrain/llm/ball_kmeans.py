"""Centroid clustering of embeddings by ball k-means, in whole numbers.

Components are turned into integers once, so squared distances, sums and centroids
are exact and no result depends on the order of adding.

After the first round, in which each vector meets every centroid, a cluster is a
ball: its centroid and a bound of its radius (the greatest distance at its last
assignment plus the centroid's move).  Only centroids within twice that radius can
be nearer to a member than its own; they are the ball's neighbours, sorted by their
distance.  A member nearer to its centroid than half the distance to the first
neighbour is in the stable core and keeps its cluster with one distance computed.
The others lie in annuli: a member is compared with just those neighbours whose
half distance it reaches, exactly.

Each round is one pass over the vectors (written to the shared folder with their
cluster), and one in which every task sends one row for each cluster and component;
the driver holds centroids only.  No vector is shuffled, so no cluster is too large.

Defined results: vectors with another number of components than `dims`, null ones
and those with a null or non-finite component are left out, as are rows without an
id; a null label changes nothing.  Rows that repeat an id are vectors of their own
(of seeds with equal hashes the smaller vector comes first).  Ties between centroids
go to the smaller number.  With fewer vectors than clusters there are as many
clusters as vectors; an empty table gives no rows.  Columns beyond vec_id and
embedding are not looked at.  A component of 2**26 or more after scaling, whose
distances 64 bits can't hold, is an error.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

CLUSTERS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
#: Bound of scaled components: 4 times a squared distance of 64 components stays below 2**62.
LIMIT = 1 << 26

ROWS = "vec_id long, v array<int>, cluster int, distance long"


def _as_rows(ids, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    v = pa.ListArray.from_arrays(offsets, pa.array(x.ravel().astype(np.int32)))
    return pa.RecordBatch.from_arrays([ids, v, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])


def _matrix(column, dims: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dims)


def _whole_numbers(dims: int, scale: int):
    """Batches of (vec_id, embedding) to rows without a cluster (-1)."""

    def run(batches):
        for batch in batches:
            right = pc.and_(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False), batch.column(0).is_valid())
            batch = batch.filter(right)
            x = _matrix(batch.column(1), dims, np.float64)
            finite = np.isfinite(x).all(axis=1)
            x = np.floor(x[finite] * scale)
            if len(x) and np.abs(x).max() >= LIMIT:
                raise ValueError(f"components must stay below {LIMIT // scale} in magnitude")
            yield _as_rows(batch.column(0).filter(pa.array(finite)), x, np.full(len(x), -1), np.zeros(len(x), np.int64))

    return run


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals) and squared distance, by meeting all."""
    best, at = squared(x, centroids[0]), np.zeros(len(x), np.int64)
    for k in range(1, len(centroids)):
        d = squared(x, centroids[k])
        closer = d < best
        best[closer], at[closer] = d[closer], k
    return at, best


def neighbours(centroids: list[list[int]], radii: list[int | None]) -> list[list[tuple[int, int]]]:
    """For each ball (squared radius bound; None: no members) the neighbours that can be as near to a member as its own centroid: (squared distance, number), nearest first."""
    out: list[list[tuple[int, int]]] = []
    for j, radius in enumerate(radii):
        gaps = [(sum((a - b) ** 2 for a, b in zip(centroids[j], c, strict=True)), i) for i, c in enumerate(centroids) if i != j] if radius is not None else []
        out.append(sorted(g for g in gaps if g[0] <= 4 * radius))
    return out


def reassign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of members of balls, and the number of distances computed."""
    at, best, met = own.copy(), np.empty(len(x), np.int64), len(x)
    for j in np.unique(own):
        members = np.flatnonzero(own == j)
        d = squared(x[members], centroids[j])
        least, to = d.copy(), np.full(len(members), j)
        for gap, i in near[j]:
            annulus = np.flatnonzero(4 * d >= gap)  # the rest is nearer to its own centroid than half way to this one
            if not len(annulus):
                break  # further neighbours reach none either
            met += len(annulus)
            there = squared(x[members[annulus]], centroids[i])
            closer = (there < least[annulus]) | ((there == least[annulus]) & (i < to[annulus]))
            least[annulus[closer]], to[annulus[closer]] = there[closer], i
        at[members], best[members] = to, least
    return at, best, met


def _assigning(centroids: list[list[int]], near: list[list[tuple[int, int]]] | None):
    def run(batches):
        c = np.array(centroids, np.int64)
        for batch in batches:
            x = _matrix(batch.column(1), c.shape[1], np.int64)
            at, best = nearest(x, c) if near is None else reassign(x, batch.column(2).to_numpy().astype(np.int64), c, near)[:2]
            yield _as_rows(batch.column(0), x, at, best)

    return run


def _totals(k: int, dims: int):
    """One row for each cluster and component of a task's vectors: their sum; component `dims`: number, `dims` + 1: distances and the greatest of them."""

    def run(batches):
        sums, most = np.zeros((k, dims + 2), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, own, d = _matrix(batch.column(1), dims, np.int64), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for j in np.unique(own):
                here = own == j
                sums[j] += [*x[here].sum(axis=0), here.sum(), d[here].sum()]
                most[j] = max(most[j], d[here].max())
        j, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[j, at]), pa.array(most[j])], ["cluster", "at", "total", "most"])

    return run


def _gathered(rows: DataFrame, k: int, dims: int) -> tuple[list[list[int]], list[int], list[int], list[int]]:
    """Component sums, numbers, distance sums and greatest squared distances of the clusters (at most k * (dims + 2) rows)."""
    sums, n, inertia, most = [[0] * dims for _ in range(k)], [0] * k, [0] * k, [0] * k
    parts = rows.mapInArrow(_totals(k, dims), "cluster int, at int, total long, most long")
    for r in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.max("most").alias("most")).collect():
        j = r["cluster"]
        most[j] = max(most[j], r["most"])
        if r["at"] < dims:
            sums[j][r["at"]] = r["total"]
        elif r["at"] == dims:
            n[j] = r["total"]
        else:
            inertia[j] = r["total"]
    return sums, n, inertia, most


def cluster_vectors(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = "1") -> tuple[DataFrame, list[dict]]:
    """Vectors with their cluster: (vec_id, v, cluster, distance squared), and for each cluster its centroid, number of vectors and inertia.

    Seeds are the vectors with the smallest sha256 of `<salt>:<vec_id>`.  Each round
    assigns every vector and moves each centroid that has vectors to the floor of
    their mean; then vectors are assigned once more.
    """
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stash(source.mapInArrow(_whole_numbers(dims, scale), ROWS), "whole")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centroids = [list(r["v"]) for r in rows.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()]
    if not centroids:
        return rows, []
    k, near = len(centroids), None
    for step in range(rounds + 1):
        rows = stash(rows.mapInArrow(_assigning(centroids, near), ROWS), f"round{step}")
        sums, n, inertia, most = _gathered(rows, k, dims)
        if step < rounds:
            moved = [[s // n[j] for s in sums[j]] if n[j] else centroids[j] for j in range(k)]
            shift = [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for p, q in zip(moved, centroids, strict=True)]
            near = neighbours(moved, [(isqrt(most[j]) + isqrt(shift[j]) + 2) ** 2 if n[j] else None for j in range(k)])
            centroids = moved
    return rows, [{"cluster": j, "centroid": centroids[j], "n": n[j], "inertia": inertia[j]} for j in range(k)]


def cluster_table(embeddings: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept."""
    rows, found = cluster_vectors(embeddings)
    total = sum(c["inertia"] for c in found)
    facts = [(c["cluster"], c["inertia"], total, hashlib.sha256(",".join(map(str, c["centroid"])).encode()).hexdigest()) for c in found]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
