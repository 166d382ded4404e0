"""Sharding by histogram sort: shards of nearly equal bytes, in the order of doc_id, with one exchange.

Candidate boundaries ("probes") divide the key range into cells whose width is a
power of two.  Each round counts the exact bytes and rows of every cell across all
partitions, pre-aggregated in each task, and the driver adds them up to the bytes
below each probe.  A splitter that lies within the tolerance of its target is
settled; the cells that hold the others are divided by finer probes in the next
round.  Counting reads a narrow table of ids and sizes, and from round to round
only the cells still open.  When all splitters are settled, documents are
exchanged once.

A key that holds more bytes than the tolerance (in the extreme a third of all rows
with one id) is divided too: its rows, and only they, are written to the shared
folder with a row number, and probing goes on over these numbers.  So no shard, and
no task, takes a whole group of equal ids.

Each shard is cut into blocks by splitters of the same kind; a block is what one
task sorts and numbers (more bytes than BLOCK_BYTES only beyond CELLS / 2 blocks).  The histogram knows the rows below each splitter, hence
the first slot of each block, so numbering needs no pass over a whole shard.

DataFrame functions only; the driver holds at most `CELLS` counts in a round.

Defined results: a null text has no bytes, so its size is 8; rows without an id are
kept and stand with the smallest possible id; rows with equal ids may lie in neighbouring
shards; repeated rows are rows of their own; a document larger than a shard's share
stands alone or makes its shard larger, by itself only; with fewer documents than
shards some are empty; an empty table gives no rows.  Columns beyond doc_id and
text are carried along; those named shard or slot are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

SHARDS = 24
#: Bytes beyond the text that a document counts for.
EXTRA = 8
#: Most cells that are counted in a round (each is one row on the driver).
CELLS = 1 << 16
#: Bytes by which a splitter may miss its target, as a part of a shard's share.
TOLERANCE = 1 / 2000
#: Bytes that one task sorts.
BLOCK_BYTES = 32 << 20

_LOWEST = -(1 << 63)


def _cells(rows: DataFrame, parents: list[str], at: str, shift: int) -> dict[tuple, tuple[int, int]]:
    """(parents..., cell number): (bytes, rows)."""
    counts = rows.groupBy(*parents, F.shiftright(at, shift).alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return {(*(r[p] for p in parents), r["cell"]): (r["bytes"], r["n"]) for r in counts.collect()}


def _width(low: int, high: int, cells: int) -> int:
    """Smallest shift under which low..high takes at most `cells` cells."""
    shift = 0
    while (high >> shift) - (low >> shift) >= cells:
        shift += 1
    return shift


def _probe(rows: DataFrame, at: str, shift: int, parents: list[str], groups: dict, tolerance: float, room: int):
    """Settle the targets among the values of column `at`, cell by cell.

    `groups` has for each combination of the parent columns, as a tuple, the bytes
    and rows below it and the targets within it.  Gives {target: (parent, edge, rows
    below)}, where the rows with `at` < edge lie below, and {target: (parent, value,
    bytes below, rows below)} for targets inside a value of `at` that has several rows.
    """
    settled, inside, step = {}, {}, None
    while True:
        found: dict[tuple, list] = {}
        for (*parent, cell), counts in _cells(rows, parents, at, shift).items():
            found.setdefault((*parent, *([] if step is None else [cell >> step])), []).append((cell, *counts))
        open_: dict[tuple, tuple[int, int, list]] = {}
        for group, (size_below, rows_below, targets) in groups.items():
            parent, edges = group[: len(parents)], []  # (bytes below, rows below, cell) of each cell and of the end
            for cell, size, n in sorted(found[group]):
                edges.append((size_below, rows_below, cell))
                size_below, rows_below = size_below + size, rows_below + n
            edges.append((size_below, rows_below, edges[-1][2] + 1))
            for target in targets:
                k = min(max(1, bisect_left(edges, (target,))), len(edges) - 1)  # between the edges k - 1 and k
                low, high = edges[k - 1], edges[k]
                best = low if target - low[0] <= high[0] - target else high
                if abs(best[0] - target) <= tolerance or high[1] - low[1] == 1 and shift == 0:
                    settled[target] = (parent, best[2] << shift if best is low else (low[2] + 1) << shift, best[1])
                elif shift == 0:
                    inside[target] = (parent, low[2], low[0], low[1])
                else:
                    open_.setdefault((*parent, low[2]), (low[0], low[1], []))[2].append(target)
        if not open_:
            return settled, inside
        chosen = rows.sparkSession.createDataFrame([(*g,) for g in open_], ", ".join(f"{c} long" for c in [*parents, "cell"]))
        rows = rows.withColumn("cell", F.shiftright(at, shift)).join(F.broadcast(chosen), [*parents, "cell"], "left_semi").drop("cell")
        step = min(shift, max(1, (room // len(open_)).bit_length() - 1))
        shift, groups = shift - step, open_


def _at_or_above(edges: list[tuple[int, int]]) -> Column:
    """Number of edges (key, row number) at or below a row's, by binary search in a constant array."""
    if not edges:
        return F.lit(0)
    keys, numbers = (F.split(F.lit(",".join(str(e[i]) for e in edges)), ",").cast("array<bigint>") for i in (0, 1))
    steps = F.array(*[F.lit(1 << b) for b in range(len(edges).bit_length() - 1, -1, -1)])

    def further(found, step):
        i = found + step - 1
        key, number = F.get(keys, i), F.get(numbers, i)
        return F.when((key < F.col("key")) | ((key == F.col("key")) & (number <= F.col("number"))), found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), further)


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, block_bytes: int = BLOCK_BYTES, cells: int = CELLS) -> DataFrame:
    """All rows and columns of `docs` with `shard` (0 to shards - 1, in the order of doc_id) and `slot` (0, 1, ... within the shard)."""
    docs = docs.drop("shard", "slot")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + EXTRA
    sizes = stash(docs.select(key.alias("key"), size.alias("size")), "sizes")
    low, high, total, n = sizes.agg(F.min("key"), F.max("key"), F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return docs.select("*", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))

    per_shard = max(1, min(cells // (2 * shards), -(-total // (shards * block_bytes))))
    targets = [total * j / (shards * per_shard) for j in range(1, shards * per_shard)]
    error = min(tolerance, 1 / (4 * per_shard)) * total / shards
    settled, inside = _probe(sizes, "key", _width(low, high, cells), [], {(): (0, 0, targets)}, error, cells)
    edges = {target: (edge, _LOWEST, below) for target, (_, edge, below) in settled.items()}

    documents = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key"), F.lit(0).cast("long").alias("number"))
    if inside:  # targets within the rows of one id: number those rows, and probe the numbers
        groups: dict[tuple, tuple[int, int, list]] = {}
        for target, (_, value, size_below, rows_below) in inside.items():
            groups.setdefault((value,), (size_below, rows_below, []))[2].append(target)
        heavy = F.col("key").isin([value for (value,) in groups])
        numbered = stash(documents.where(heavy).withColumn("number", F.monotonically_increasing_id()), "heavy")
        documents = documents.where(~heavy).unionByName(numbered)
        rows = stash(numbered.select("key", "number", (F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long") + EXTRA).alias("size")), "numbers")
        width = _width(0, rows.agg(F.max("number")).first()[0], max(2, cells // len(groups)))
        settled, _ = _probe(rows, "number", width, ["key"], groups, error, cells)
        edges |= {target: (*parent, edge, below) for target, (parent, edge, below) in settled.items()}

    order = list(accumulate((edges[t] for t in targets), max))
    starts = [0, *(e[2] for e in order)]
    firsts = [starts[j] - starts[j - j % per_shard] for j in range(shards * per_shard)]
    block = _at_or_above([(e[0], e[1]) for e in order])
    first = F.element_at(F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>"), F.col("block") + 1)
    ties = ["key", "number", F.octet_length("doc.text"), F.xxhash64("doc.text")]
    documents = documents.withColumn("block", block).repartitionById(shards * per_shard, "block")
    rank = F.row_number().over(Window.partitionBy("block").orderBy(*ties))
    return documents.select("doc.*", F.floor(F.col("block") / per_shard).cast("int").alias("shard"), (first + rank - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the shards as Parquet folders shard=0, shard=1, ...; rows carry their slots."""
    shard_documents(docs, shards).write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + EXTRA
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return shard_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), shards).select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
