"""Shared helpers of the training-data operators.

Texts travel as Arrow columns.  Inside a task they are seen as one flat byte
array plus offsets (`flat_utf8`), cut into bounded slices of whole documents
(`doc_slices`), so that numpy works on a few megabytes at a time whatever the
size of the Arrow batch.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import sys
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Links of a graph that one task takes.
LINKS_PER_TASK = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that have an id."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bucket_of(doc_id: str, modulus: int):
    """crc32(doc_id as text) mod `modulus`, as a column."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where none is set, a temporary one in local mode, else an error."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None)
    if shared is None:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = jvm_dir.get() if jvm_dir.isDefined() else None
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-cellgrain-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(shared)
        atexit.register(shutil.rmtree, shared.removeprefix("file://"), ignore_errors=True)
    return shared


#: Scratch folders of this process, by application.
_FOLDERS: dict[str, SparkSession] = {}


def release_scratch() -> None:
    """Delete what `stash` has written in this process; called at its end, and by whoever needs no result any more."""
    while _FOLDERS:
        folder, spark = _FOLDERS.popitem()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception as error:  # the session has ended; say where the files are
            print(f"left in place: {folder} ({type(error).__name__})", file=sys.stderr)


atexit.register(release_scratch)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared scratch folder and read it back.

    This cuts lineage: what was written survives the loss of any executor, and
    rows whose content depends on how tasks were cut (block ids) stay fixed.
    """
    spark = df.sparkSession
    folder = f"{scratch_dir(spark)}/cellgrain-{spark.sparkContext.applicationId}"
    _FOLDERS[folder] = spark
    path = f"{folder}/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished steps: its cleaner acts when the driver collects garbage.

    Spark refers to the last query until another one has run, so a small one runs first.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def released(work):
    """`work` over batches, after which a task's freed memory goes back to the system: Python workers are used again by later stages."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)

    return run


def flat_utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string (or binary) column end to end, and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges [i, j) of documents that hold about `limit` bytes together (one document at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def crc_mod(doc_ids, modulus: int) -> np.ndarray:
    """crc32(doc_id as text) mod `modulus` for integer ids (as bucket_of)."""
    return np.fromiter((zlib.crc32(str(int(d)).encode()) % modulus for d in doc_ids), np.int64, len(doc_ids))


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads the bits of polynomial hashes."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each byte span [start, end), equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), _R), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(int(starts[-1]) + 1, _R_INV)[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def words_of(data: np.ndarray, is_word: np.ndarray, offsets: np.ndarray):
    """Start and end of each maximal run of word bytes that stays within a document, and each word's document."""
    word = is_word[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = inner[inner > 0]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def group_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i; empty ranges give 0."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, dtype=np.float64, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _forest(batches):
    """A spanning forest of each task's links: (u, smallest vertex that u reaches within the task)."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not ends:
        return
    u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:  # smallest label of both ends, then of the labels themselves
        low = np.minimum(label[i], label[j])
        after = label.copy()
        for end in (label[i], label[j], i, j):
            np.minimum.at(after, end, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    far = label != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], ["u", "v"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 80, one_task: int = LINKS_PER_TASK) -> DataFrame:
    """Smallest reachable id for each id that occurs in `links`: rows (id, component_id).

    Each task first replaces its links by a spanning forest.  While more than
    `one_task` links are left, rounds of contraction follow: every vertex points
    to the smallest neighbour (or itself), pointers are followed twice, and links
    are rewritten to where they lead.  Rounds take turns between the order of ids,
    in which stars around a smallest id collapse at once, and a fresh hash order,
    in which a constant share of the vertices of chains goes, so the number of
    rounds is logarithmic.  Neighbours are pre-aggregated map-side (min), never
    gathered; tables shrink from round to round.  At most `one_task` links (16
    bytes each) are finished by one task.  Each step is written to the shared folder.
    """
    pair = "u long, v long"
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = stash(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().mapInArrow(_forest, pair), "edges")
    labels = None
    for k in range(max_rounds):
        n = edges.count()
        if n <= one_task:
            break
        parts = 8 + n // LINKS_PER_TASK
        rank = lambda c: F.struct((F.col(c) if k % 3 == 0 else F.xxhash64(F.col(c), F.lit(k))).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stash(both.groupBy("u").agg(F.min(rank("v")).alias("m")).select(F.col("u").alias("id"), F.least(F.col("m"), rank("u"))["x"].alias("label")).coalesce(parts), "near")
        for _ in range(2):
            hop = near.select(F.col("id").alias("label"), F.col("label").alias("next"))
            near = near.join(hop, "label").select("id", F.col("next").alias("label"))
        near = stash(near.coalesce(parts), "pointers")
        labels = near if labels is None else _followed(labels, near)
        lu, lv = (near.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "uv")
        edges = edges.join(lu, "u").join(lv, "v").where("lu <> lv")
        edges = stash(edges.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct().coalesce(parts).mapInArrow(_forest, pair), "edges")
    else:
        raise RuntimeError("component labels did not settle")
    last = edges.coalesce(1).mapInArrow(_forest, pair)
    last = stash(last.unionByName(last.select(F.col("v").alias("u"), "v")).distinct().select(F.col("u").alias("id"), F.col("v").alias("label")), "last")
    if labels is None:
        return last.withColumnRenamed("label", "component_id")
    labels = _followed(labels, last)
    smallest = labels.groupBy("label").agg(F.min("id").alias("component_id"))
    return labels.join(smallest, "label").select("id", "component_id")


def _followed(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Labels (id, label) after each has followed `step` (id, label) where it has an entry there."""
    step = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
    return stash(labels.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label")), "labels")
