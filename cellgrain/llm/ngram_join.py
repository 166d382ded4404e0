"""N-gram Jaccard self-join by token-combination prefixes.

A document's set is its distinct 5-word shingles, as 64-bit hashes: shingles with
equal hashes are taken as equal, and sets with equal 64-bit digests as well.

**A first sieve** needs no counts of shingles.  Under an order by hash, a set that
is similar to another by at least t shares at least (s - (1 - t)) n of the first
s n shingles of its n with the first part of that one; a set that has fewer in
common with any others leaves at once.  Shingles that several sets of one slice of texts hold are
settled in that slice, which sends one entry on for all of them, so a line that
every document carries makes one entry for each slice.

**The index** takes what is left under another order, rarest shingle first; a set
that shares fewer than t n of all its shingles with others leaves too.  Two similar
sets share at least b + 1 shingles within their first p + b (p = n - ceil(t n) + 1).

* A shingle that few sets have in their prefix is *rare* and indexes them by itself.
* Two sets that share no rare shingle share b + 1 *frequent* ones; these fall into
  b classes by hash, two of the b + 1 are in one class, and each set is indexed by
  its pairs of frequent shingles within a class.

b is about 1/32 of p, taken from a ladder of set sizes whose rungs are t apart;
every set is indexed at its own rung and the next, so similar sets meet at one at
least.  Index pairs grow linearly with a set's size.

Only the components of the link graph are wanted.  So in each bucket of a single
shingle candidates are first paired with the bucket's hub, the set in which the shingle
stands foremost (one verification for each set, chosen by how many buckets the two
share, then the others whose ends still lie in different components).  Buckets of one component
are done, however large.  In the others an entry leaves if its shingle stands too
far back in its set for an overlap with even the smallest set there; what remains
is split into rare and frequent as above, and every set outside a bucket's largest
component is verified against the sets of other components that positions and
sizes allow.  No link between different components is lost.  Rarest-first order is
what keeps this small: an edited copy's prefix holds the shingles its edits made.

Defined results: null or empty text and text of white space only have no
shingles and are components of their own; texts shorter than five words are one
shingle, the whole sequence; repeated rows are equal sets; rows without an id are
left out; of an empty table nothing is returned; columns beyond doc_id and text
are not looked at.  Rows that share an id but not a text each keep their own set;
`keep_representatives` then keeps the first of their texts in order.  A similarity
of exactly the threshold (a tie) links; shingles of equal frequency are ordered by
hash; a very long text is one set, whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, SLICE_BYTES, connected_components, doc_slices, flat_utf8, free_shuffles, mix64, released, stash, texts_of, token_hashes, words_of

WORDS = 5
#: Similarity threshold as a fraction SHARE / 100.
SHARE = 75
#: Entries of a bucket up to which a shingle counts as rare.
RARE = 32
#: The first part of a set that the sieve looks at, in hundredths.
SIEVE = 45
#: A prefix is extended by one shingle for so many.
EXTENDED = 32
#: Up to so many candidate pairs (16 bytes each) are broadcast.
BROADCAST_PAIRS = 500_000
#: Text bytes for each bucket of the first sieve.
BUCKET_BYTES = 12 << 20
#: Text bytes that are hashed at once; the arrays take about 100 bytes for each.
PART_BYTES = 1 << 19

_P = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text end to end, n+1 bounds)."""
    n_docs = len(offsets) - 1
    starts, ends, doc = words_of(data, ~IS_SPACE, offsets)
    words = token_hashes(LOWER[data], starts, ends)
    counts = np.bincount(doc, minlength=n_docs)
    k = len(words) - width + 1
    if k > 0:
        h = words[:k].copy()
        for j in range(1, width):
            h = h * _P + words[j : k + j]
        whole = doc[:k] == doc[width - 1 :]
        h, owner = mix64(h)[whole], doc[:k][whole]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        first = np.searchsorted(doc, few)
        extra = np.zeros(len(few), np.uint64)
        for j in range(width - 1):
            has = counts[few] > j
            extra[has] = extra[has] * _P + words[first[has] + j]
        h = np.concatenate([h, mix64(extra + counts[few].astype(np.uint64))])
        owner = np.concatenate([owner, few])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(n_docs + 1))


def _signed(data: np.ndarray, offsets: np.ndarray):
    """(hashes, bounds, sizes, set ids) of a slice of texts; a set's id is a digest of its shingles, never 0."""
    h, bounds = shingle_sets(data, offsets)
    n = np.diff(bounds)
    sid = np.zeros(len(n), np.uint64)
    np.add.at(sid, np.repeat(np.arange(len(n)), n), mix64(h ^ np.uint64(0x5851F42D4C957F2D)))
    return h, bounds, n, np.maximum(mix64(sid + n.astype(np.uint64)), np.uint64(1))


def _signed_in_parts(data: np.ndarray, at: np.ndarray):
    """`_signed` of the texts data[at[i]:at[i+1]], hashed PART_BYTES at a time."""
    h, _, n, sid = zip(*(_signed(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in doc_slices(at, PART_BYTES)), strict=True)
    n = np.concatenate(n)
    return np.concatenate(h), np.r_[0, np.cumsum(n)], n, np.concatenate(sid)


def _signatures(batches):
    for batch in batches:
        ids, (data, offsets) = batch.column(0), flat_utf8(batch.column(1))
        for lo, hi in doc_slices(offsets):
            at = offsets[lo : hi + 1]
            _, _, n, sid = _signed(data[at[0] : at[-1]], at - at[0])
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(sid.view(np.int64))], ["doc_id", "n", "sid"])


_PACKED = "bucket int, keys binary, owners binary, sids binary"
#: Texts of a slice, so that 16 bits number them.
SLICE_TEXTS = 60_000


def _prefixes(n_buckets: int):
    """The first sieve's entries (shingle, set), a row for each slice and bucket of shingles, and counts settled in the slice.

    A set that the task has sent already is left out.  Of a shingle that several sets of the slice hold, one entry is
    sent for all, with set 0; the sets' counts of such shingles go out as rows without keys.
    """

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            data, offsets = flat_utf8(batch.column(1))
            for begin, end in doc_slices(offsets, 2 * SLICE_BYTES):
                for lo in range(begin, end, SLICE_TEXTS):
                    at = offsets[lo : min(end, lo + SLICE_TEXTS) + 1]
                    h, bounds, n, sid = _signed_in_parts(data, at)
                    new = np.zeros(len(n), bool)
                    for k, s in enumerate(sid.tolist()):
                        if n[k] and s not in sent:
                            sent.add(s)
                            new[k] = True
                    if len(sent) > 500_000:
                        sent.clear()
                    m = np.where(new, (n * SIEVE + 99) // 100, 0)
                    inside = np.arange(len(h)) - np.repeat(bounds[:-1], n) < np.repeat(m, n)
                    if inside.any():
                        yield _packed(mix64(h[inside]), np.repeat(np.arange(len(n)), m), sid, n_buckets)

    return run


def _packed(key: np.ndarray, owner: np.ndarray, sid: np.ndarray, n_buckets: int):
    """Rows of a slice: keys as the first one and steps of 6 bytes (8 if one is wider), owners as numbers into sids."""
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    settled = np.repeat(size > 1, size)
    own, common = np.unique(owner[settled], return_counts=True)
    holder = np.where(size > 1, -1, owner[first])
    key = key[first]
    bucket = ((key >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    with_none = np.r_[sid, np.uint64(0)]  # number -1
    rows = [[], [], [], []]
    for x, y in zip(cuts, np.r_[cuts[1:], len(key)], strict=True):
        steps = np.diff(key[x:y])
        narrow = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 if (steps >> np.uint64(48)).any() else 6]
        held, number = np.unique(holder[x:y], return_inverse=True)
        for column, value in zip(rows, (int(bucket[x]), key[x : x + 1].tobytes() + narrow.tobytes(), number.astype(np.uint16).tobytes(), with_none[held].tobytes()), strict=True):
            column.append(value)
    if len(own):
        for column, value in zip(rows, (int(sid[own[0]] % np.uint64(n_buckets)), None, common.astype(np.int64).tobytes(), sid[own].tobytes()), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["bucket", "keys", "owners", "sids"])


def _keys_of(raw: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[0] = np.frombuffer(raw[:8], np.uint8)
    steps = np.frombuffer(raw[8:], np.uint8).reshape(n - 1, -1) if n > 1 else wide[1:]
    wide[1:, : steps.shape[1]] = steps
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _shared_counts(batches):
    """(sid, shingles of its prefix that some other set has too, at least) from rows sorted by bucket."""

    def several(held):
        key, sid = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((sid, key))
        key, sid = key[order], sid[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])]
        key, sid = key[new], sid[new]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        own, n = np.unique(sid[np.repeat(size > 1, size) & (sid != 0)], return_counts=True)
        return out(own, n)

    def out(own, n):
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], ["sid", "common"])

    now, held = None, []
    for batch in batches:
        for bucket, keys, owners, sids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            sids = np.frombuffer(sids, np.uint64)
            if keys is None:
                yield out(sids, np.frombuffer(owners, np.int64))
                continue
            if bucket != now and held:
                yield several(held)
                held = []
            now = bucket
            owners = np.frombuffer(owners, np.uint16)
            held.append((_keys_of(keys, len(owners)), sids[owners]))
    if held:
        yield several(held)


def _sets_of(batches):
    """(sid, n, shingle hashes) of the texts whose set is the one asked for."""
    for batch in batches:
        asked, (data, offsets) = batch.column(0).to_numpy(), flat_utf8(batch.column(1))
        for lo, hi in doc_slices(offsets):
            at = offsets[lo : hi + 1]
            h, bounds, n, sid = _signed(data[at[0] : at[-1]], at - at[0])
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            rows = pa.RecordBatch.from_arrays([pa.array(sid.view(np.int64)), pa.array(n, pa.int64()), sets], ["sid", "n", "grams"])
            yield rows.filter(pa.array(sid.view(np.int64) == asked[lo:hi]))


# Column expressions over a set's size n.
_PREFIX = f"(n - (n * {SHARE} + 99) div 100 + 1)"
_RUNG = f"cast(floor(ln(n) / {math.log(100 / SHARE)!r} + 1e-9) as int)"


def _classes(level: str) -> str:
    return f"greatest(1, cast(floor(pow({100 / SHARE!r}, {level}) * {(100 - SHARE) / 100} / {EXTENDED}) as int))"


def _overlap(na: str, nb: str) -> str:
    """Least overlap of sets of these sizes that are similar enough."""
    return f"(({SHARE} * ({na} + {nb}) + {99 + SHARE}) div {100 + SHARE})"


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets (sid, n, grams) are similar enough, by all their shingles.

    Sizes rule pairs out first.  While the pairs are few they are broadcast, so that only the sets they name are
    shuffled, and of a hub one copy.
    """
    size = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"))
    other = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"))
    near = stash(pairs.join(size, "a").join(other, "b").where(f"100 * least(na, nb) >= {SHARE} * greatest(na, nb)").select("a", "b"), "pairs")
    sent = F.broadcast if near.count() <= BROADCAST_PAIRS else lambda df: df
    members = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("y")).join(sent(near), "b")
    hubs = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("grams").alias("x")).join(sent(near.select("a").distinct()), "a", "left_semi")
    return members.join(hubs, "a").where(f"size(array_intersect(x, y)) >= {_overlap('na', 'nb')}").select("a", "b")


def _with_components(rows: DataFrame, column: str, comps: DataFrame, out: str) -> DataFrame:
    """Add the component of the set in `column` (itself where it has no link)."""
    c = comps.select(F.col("id").alias(column), F.col("component_id").alias("_c"))
    return rows.join(c, column, "left").withColumn(out, F.coalesce("_c", column)).drop("_c")


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: the graph between the components there are is contracted, and all ids follow."""
    between = _with_components(_with_components(links, "a", comps, "u"), "b", comps, "v").where("u <> v").select("u", "v").distinct()
    top = connected_components(between, "u", "v")
    lower = comps.join(top.select(F.col("id").alias("component_id"), F.col("component_id").alias("up")), "component_id", "left").select("id", F.coalesce("up", "component_id").alias("component_id"))
    fresh = top.join(comps, "id", "left_anti")
    return stash(lower.unionByName(fresh.select("id", "component_id")), "components")


def indexed(sets: DataFrame) -> DataFrame:
    """Prefixes under rarest-first order: rows (key, sid, n, i, slack), i the shingle's position in its set.

    Sets (sid, n, grams) that share too few shingles with others have none.  slack is b of the next rung.
    """
    grams = sets.select("sid", "n", F.explode("grams").alias("key"))
    held = grams.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    of_set = Window.partitionBy("sid")
    ranked = grams.join(held, "key").select("sid", "n", "key", F.row_number().over(of_set.orderBy("held", "key")).alias("r"), F.count(F.lit(1)).over(of_set).alias("common"))
    # the shingles of no other set come first and need no entry
    placed = ranked.where(f"100 * common >= {SHARE} * n").select("key", "sid", "n", (F.col("n") - F.col("common") + F.col("r") - 1).alias("i"), F.expr(_classes(f"{_RUNG} + 1")).alias("slack"))
    return placed.where(f"i < {_PREFIX} + slack")


def _mixed(entries: DataFrame) -> DataFrame:
    """The entries (key, sid, c, n, i, slack) that can have a partner in another component of their bucket, and the bucket's size."""
    bucket = entries.groupBy("key").agg(F.min("n").alias("least_n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", "least_n")
    able = entries.join(bucket, "key").where(f"i <= n - {_overlap('n', 'least_n')} + slack").drop("least_n")
    left = able.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("key", "m")
    return able.join(left, "key")


def combined(frequent: DataFrame) -> DataFrame:
    """Buckets of pairs of frequent shingles: rows (key, sid, c, n, i, slack), i the later one's position, slack its b."""
    levels = frequent.select("key", "sid", "c", "n", "i", F.explode(F.expr(f"array({_RUNG}, {_RUNG} + 1)")).alias("level"))
    levels = levels.withColumn("slack", F.expr(_classes("level"))).where(f"i < {_PREFIX} + slack")
    grouped = levels.groupBy("sid", "c", "n", "level", "slack", F.pmod(F.xxhash64("key"), F.col("slack")).alias("class")).agg(F.sort_array(F.collect_list(F.struct("key", "i"))).alias("g")).where("size(g) > 1")
    one = grouped.select("*", F.posexplode("g").alias("at", "x")).select("sid", "c", "n", "level", "slack", "x", F.explode(F.expr("slice(g, at + 2, size(g))")).alias("y"))
    return one.select(F.xxhash64("level", "x.key", "y.key").alias("key"), "sid", "c", "n", F.greatest("x.i", "y.i").alias("i"), "slack")


def _met(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components that meet in a bucket at positions and sizes that allow a link.

    Of each bucket, the sets outside its largest component are paired, so a bucket of one large group costs no more
    than its size for each set beyond it.
    """
    largest = entries.groupBy("key", "c").agg(F.count(F.lit(1)).alias("of_c")).groupBy("key").agg(F.max_by("c", F.struct("of_c", "c")).alias("main"))
    outside = entries.join(largest, "key").where("c <> main").select("key", *(F.col(x).alias(f"{x}2") for x in ("sid", "c", "n", "i", "slack")))
    b = "least(slack, slack2)"
    meets = F.expr(f"c <> c2 and i <= n - {_overlap('n', 'n2')} + {b} and i2 <= n2 - {_overlap('n', 'n2')} + {b}")
    return outside.join(entries, (outside["key"] == entries["key"]) & meets).select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b"))


def jaccard_components(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of `docs` (columns doc_id, text) with an id."""
    docs = texts_of(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = 12 + int(total) // BUCKET_BYTES
    sigs = stash(docs.mapInArrow(released(_signatures), "doc_id long, n long, sid long"), "signatures")
    # equal sets: one id, the digest; its smallest document stands for the text
    sets_of_docs = sigs.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))

    packed = docs.mapInArrow(released(_prefixes(n_buckets)), _PACKED)
    shared = packed.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(released(_shared_counts), "sid long, common long").groupBy("sid").agg(F.sum("common").alias("common"))
    some = sets_of_docs.join(shared, "sid").where(f"100 * common >= {SIEVE + SHARE - 100} * n")
    texts = docs.join(some.select("doc_id", "sid"), "doc_id").dropDuplicates(["doc_id", "sid", "text"]).select("sid", "text")
    sets = stash(texts.mapInArrow(released(_sets_of), "sid long, n long, grams array<long>"), "sets")
    free_shuffles(docs.sparkSession)
    index = stash(indexed(sets), "index")
    free_shuffles(docs.sparkSession)

    # the hub is the set with the fewest rarer shingles before this one: of edited copies, the one nearest to the original
    hubs = index.groupBy("key").agg(F.min_by("sid", F.struct("i", "sid")).alias("hub"), F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("key", "hub")
    stars = stash(index.select("key", "sid").join(hubs, "key").where("hub <> sid").groupBy("hub", "sid").agg(F.count(F.lit(1)).alias("shared")), "stars")
    best = stars.groupBy("sid").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    comps = connected_components(verified(best.select(F.col("hub").alias("a"), F.col("sid").alias("b")), sets))
    rest = _with_components(_with_components(stars.select("hub", "sid"), "hub", comps, "ca"), "sid", comps, "cb").where("ca <> cb")
    rest = rest.join(best, ["sid", "hub"], "left_anti").select(F.col("hub").alias("a"), F.col("sid").alias("b"))
    comps = joined_components(comps, verified(rest, sets))

    mixed = stash(_mixed(_with_components(index, "sid", comps, "c")), "mixed")
    single = _met(mixed.where(F.col("m") <= rare).drop("m"))
    pairs = stash(_mixed(combined(mixed.where(F.col("m") > rare))), "combined")
    met = single.unionByName(_met(pairs.drop("m"))).distinct()
    done = stars.select(F.least("hub", "sid").alias("a"), F.greatest("hub", "sid").alias("b"))
    comps = joined_components(comps, verified(met.join(done, ["a", "b"], "left_anti"), sets))

    of_set = stash(_with_components(sets_of_docs.select("sid", "doc_id"), "sid", comps, "c"), "of_set")
    smallest = of_set.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    final = of_set.join(smallest, "c").select("sid", "component_id")
    rows = sigs.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    return rows.join(final, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose id is the smallest of its component; one row for each id, that with the first text in order."""
    found = jaccard_components(docs)
    kept = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id")).where("doc_id = component_id").select("doc_id")
    rows = docs.join(kept, docs["doc_id"].cast("long") == kept["doc_id"], "left_semi")
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct(*rows.columns), F.coalesce("text", F.lit(""))).alias("_row"))
    return first.select("_row.*")
