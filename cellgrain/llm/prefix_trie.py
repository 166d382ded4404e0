"""A trie of conversation prefixes by prefix-doubling names.

Turns are put in order and named: equal turns get the same dense number, and from
then on no text is moved.  In doubling rounds the names of two neighbouring blocks of
2**k turns become the name of a block of 2**(k+1), by a join with the table of
different pairs; only blocks that start at a multiple of their length are needed,
fewer than two for each turn over all rounds.  A prefix of d turns is the blocks of
d's binary digits, largest first, so its name is that of the prefix without its last
block paired with that block: as many further rounds as d has binary digits.  Rows
with the same length and prefix name are one node.

Sums over subtrees need no walk.  The conversations that own a node (are its
smallest member) own its continuation too, so each owns one chain of nodes, and the
nodes below a node are what its members own from there on: a running sum along the
owner's chain plus the other members' whole chains.

Nothing of a group is gathered: long conversations are numbered by ranges, chains are
summed in pieces of `PIECE` turns, and the ids that end at a node are joined in
pieces of at most `PIECE_IDS` and hashed as a stream.  Joins whose key can be hot (a
turn that a third of the conversations begin with) are plain joins that are written
out, which Spark splits at run time.

Defined results: rows without a conv_id are left out; a null role or text counts as
empty; turns follow their number, null first, and equal numbers the order of role and
then of the text's SHA-256; repeated rows are turns of their own; conversations
without turns are members of the root; an empty table gives no rows, not even a
root.  Very long texts are hashed once, where they are read.  Columns beyond conv_id,
turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Turns of a chain that are summed by one window (a power of two, like PIECE_IDS).
PIECE = 4096
#: Ids joined into one string at most.
PIECE_IDS = 1024
#: A rebuilt conversation begins with fewer turns of another than this.
BORROWED = 9

NO_IDS = hashlib.sha256(b"").hexdigest()


def dense_names(rows: DataFrame, keys: list[str], step: str) -> DataFrame:
    """(keys..., name): numbers 0, 1, ... of the different keys of `rows`, fixed by being written."""
    found = rows.select(*keys).distinct().withColumn("at", F.monotonically_increasing_id())
    found = stash(found.select(*keys, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")), f"names-{step}")
    first, starts = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in found.groupBy("part").count().collect()):  # one row for each partition
        starts.append((part, first))
        first += n
    starts = rows.sparkSession.createDataFrame(starts, "part long, first long")
    return found.join(F.broadcast(starts), "part").select(*keys, (F.col("first") + F.col("at")).alias("name"))


def ordered_turns(conversations: DataFrame, texts: bool = False) -> DataFrame:
    """(conv_id, pos, key, bytes): turns numbered from 1; key stands for role and text (SHA-256), bytes is the text's UTF-8 length; with `texts` role and text themselves, too.

    Rows are sorted in ranges that may cut a conversation; positions are those
    within the range plus the conversation's turns in earlier ranges.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("body"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"), *([text.alias("text")] if texts else [])
    )
    order = ["turn", "role", "body", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = stash(turns.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()), "ranges")
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    counts = ranges.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("conv_id", "part", before.alias("before")).where("before > 0")  # one row for each range at most
    pos = (F.col("within") + F.coalesce("before", F.lit(0))).cast("long")
    return ranges.withColumn("within", within).join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", pos.alias("pos"), "key", "bytes", *(["role", "text"] if texts else []))


def named_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, name, bytes): ordered turns (as written) with dense names."""
    return stash(turns.join(dense_names(turns, ["key"], "turn"), "key").select("conv_id", "pos", "name", "bytes"), "named")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def borrowed(conv_id: Column) -> tuple[Column, Column]:
    """The conversation that lends its first turns to `conv_id`, and how many at most: c - c % 5, crc32 of c in decimal, modulo 9."""
    return conv_id - conv_id % 5, F.crc32(conv_id.cast("string").cast("binary")) % BORROWED


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that begin with the first turns of another: (conv_id, pos, name, bytes), (conv_id, n)."""
    own = lengths(turns)
    lender, most = borrowed(F.col("conv_id"))
    convs = own.select("conv_id", "n", lender.alias("lender"), most.alias("most"))
    lent = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("lender"), F.col("n").alias("there"))
    taken = F.least("most", F.coalesce("there", F.lit(0)))
    convs = stash(convs.join(lent, "lender", "left").select("conv_id", "lender", "most", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("most"), F.lit(0))).alias("n")), "rebuilt")
    first = turns.where((F.col("pos") < BORROWED) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "lender")
    first = first.join(convs.select("conv_id", "lender", "taken"), "lender").where("pos <= taken").select("conv_id", "pos", "name", "bytes")
    rest = turns.join(convs.select("conv_id", "most", "taken"), "conv_id").where("pos > most")
    rest = rest.select("conv_id", (F.col("taken") + F.col("pos") - F.col("most")).alias("pos"), "name", "bytes")
    return stash(first.unionByName(rest), "turns"), convs.select("conv_id", "n")


def prefix_names(turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, name) for each prefix of each conversation: equal depth and name mean equal prefixes."""
    blocks = turns.select("conv_id", (F.col("pos") - 1).alias("j"), "name")
    ends, level = [], 0  # the blocks that end a prefix: those with an even number, at any level
    while True:
        last = blocks.where("j % 2 = 0").select("conv_id", F.shiftleft(F.col("j") + 1, level).alias("depth"), F.shiftleft("j", level).alias("before"), F.bit_count("j").alias("round"), "name")
        ends.append(last)
        if longest >> (level + 1) == 0:
            break
        left, right = (F.max(F.when(F.col("j") % 2 == side, F.col("name"))).alias(side_name) for side, side_name in ((0, "a"), (1, "b")))
        pairs = blocks.groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(left, right).where("b is not null")
        pairs = stash(pairs, f"pairs{level}")
        blocks = stash(pairs.join(dense_names(pairs, ["a", "b"], f"block{level}"), ["a", "b"]).select("conv_id", "j", "name"), f"blocks{level}")
        level += 1
    tails = ends[0]
    for more in ends[1:]:
        tails = tails.unionByName(more)
    names = tails.where("round = 0").select("conv_id", "depth", "name")
    done = [names]
    for k in range(1, longest.bit_length()):
        shorter = names.select("conv_id", F.col("depth").alias("before"), F.col("name").alias("a"))
        pairs = stash(tails.where(F.col("round") == k).withColumnRenamed("name", "b").join(shorter, ["conv_id", "before"]).select("conv_id", "depth", "a", "b"), f"prefixes{k}")
        names = stash(pairs.join(dense_names(pairs, ["a", "b"], f"prefix{k}"), ["a", "b"]).select("conv_id", "depth", "name"), f"prefix{k}")
        done.append(names)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _joined_hashes(batches):
    """SHA-256 of each node's pieces (depth, member, piece, ids), which come in order: a running hash, whatever their number."""
    node, running, done = None, None, []

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["depth", "member", "ends_sha256"])
        done.clear()
        return rows

    for batch in batches:
        for depth, member, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (depth, member) == node:
                running.update(b"," + ids.encode())
            else:
                if node is not None:
                    done.append((*node, running.hexdigest()))
                node, running = (depth, member), hashlib.sha256(ids.encode())
        yield flush()
    if node is not None:
        done.append((*node, running.hexdigest()))
    yield flush()


def ended_hashes(ends: DataFrame) -> DataFrame:
    """(depth, member, ends_sha256) of nodes at which conversations end; `ends` has (depth, member, conv_id)."""
    piece = F.shiftright("conv_id", PIECE_IDS.bit_length() - 1).alias("piece")  # ids are different, so a piece holds PIECE_IDS at most
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    pieces = ends.groupBy("depth", "member", piece).agg(ids)
    return pieces.repartition("depth", "member").sortWithinPartitions("depth", "member", "piece").mapInArrow(_joined_hashes, "depth long, member long, ends_sha256 string")


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations.

    `turns` has (conv_id, pos, name, bytes) and `convs` (conv_id, n) all
    conversations, those without turns included.  Columns of the result: conv_id (the
    node's smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    longest = convs.agg(F.max("n")).first()[0] or 0
    paths = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"))
    paths = stash(paths.unionByName(prefix_names(turns, longest)) if longest else paths, "paths")
    nodes = stash(paths.groupBy("depth", "name").agg(F.min("conv_id").alias("member"), F.count(F.lit(1)).alias("n_convs")), "nodes")

    # each node's parent: the node of its smallest member, one turn before
    above = paths.select(F.col("conv_id").alias("member"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("before"))
    child = stash(nodes.where("depth > 0").select("depth", "member").join(above, ["member", "depth"]), "children")
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("before"), F.col("member").alias("parent_conv_id"))
    parents = stash(child.join(parent, ["depth", "before"]).select("depth", "member", "parent_conv_id"), "parents")
    children = parents.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("member")).agg(F.count(F.lit(1)).alias("n_children"))

    last = turns.select(F.col("conv_id").alias("member"), F.col("pos").alias("depth"), "bytes")
    valued = nodes.join(last, ["member", "depth"], "left").join(children, ["member", "depth"], "left")
    saved = (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))
    valued = stash(valued.select("depth", "name", "member", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), saved.alias("saved")), "valued")

    # sums along each owner's chain, in pieces
    piece = F.shiftright("depth", PIECE.bit_length() - 1)
    later = F.sum("sum").over(Window.partitionBy("member").orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1))
    later = valued.groupBy("member", piece.alias("piece")).agg(F.sum("saved").alias("sum")).select("member", "piece", F.coalesce(later, F.lit(0)).alias("later"))
    onwards = F.sum("saved").over(Window.partitionBy("member", "piece").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0))
    chains = valued.withColumn("piece", piece).select("*", onwards.alias("onwards")).join(later, ["member", "piece"])
    whole = stash(valued.groupBy("member").agg(F.sum("saved").alias("whole"), F.count_if(F.col("n_children") == 0).alias("leaf")), "chains")
    members = paths.join(whole.withColumnRenamed("member", "conv_id"), "conv_id").groupBy("depth", "name").agg(F.sum("whole").alias("all_saved"), F.sum("leaf").alias("n_leaves"))
    summed = chains.join(whole.select("member", "whole"), "member").join(members, ["depth", "name"])
    summed = summed.select("depth", "member", "n_convs", "n_children", "n_leaves", (F.col("all_saved") - F.col("whole") + F.col("onwards") + F.col("later")).alias("saved_tokens"))

    ends = convs.select("conv_id", F.col("n").alias("depth")).join(paths, ["conv_id", "depth"])
    ends = stash(ends.join(nodes.select("depth", "name", "member"), ["depth", "name"]).select("depth", "member", "conv_id"), "ends")
    out = summed.join(parents, ["depth", "member"], "left").join(ended_hashes(ends), ["depth", "member"], "left")
    return out.select(
        F.col("member").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are, with the role and text of each node's last turn (null for the root)."""
    written = stash(ordered_turns(conversations, texts=True), "turns")
    turns = named_turns(written)
    last = written.select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return trie_nodes(turns, lengths(turns)).join(last, ["conv_id", "depth"], "left")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie_nodes(*rebuilt(named_turns(stash(ordered_turns(conversations), "turns"))))
