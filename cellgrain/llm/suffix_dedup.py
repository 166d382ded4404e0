"""Removal of repeated byte passages (suffix-array deduplication by prefix doubling).

Every byte covered by a `LENGTH`-byte string that also starts in a document
with a smaller id is removed.  Sorting (rank, position) pairs of all suffixes
at offsets 1, 2, 4 .. moves every byte of the corpus through a dozen shuffles;
here the ranks that prove most positions unique are taken first:

1. *Ranks of K bytes at sampled positions.*  In each LENGTH-byte string one
   K-byte string is chosen by its content (the smallest hash, leftmost), so two
   equal strings choose alike and one position in about sixteen carries a rank.
   Spark deals (rank, document) pairs out by rank; a rank of one document
   proves all strings that chose it unique.
2. *Growing to the context.*  The strings that chose one position form a run;
   the run's bytes (up to 2 LENGTH - K) are ranked along with it.  Where a whole
   context also stands in an earlier document, all its strings repeat.
3. *Doubling in what is left.*  First occurrences of contexts that differ but
   share a rank are dealt out by rank with their bytes; the strings in them are
   ranked at 16 bytes, by rank pairs 16 apart at 32 and by pairs 18 apart at
   LENGTH, and a string is dropped as soon as its rank is unique.  A rank of
   more than `MOST` contexts isn't compared in one task: each of its strings
   becomes a row with a 128-bit hash, and Spark finds the smallest document of
   each hash.

Shuffled rows are packed: one row holds all entries of a slice of documents for
one bucket of ranks, so a bucket grows with the corpus only through the number
of entries of a rank, never with pairs.  Ranks are 40-bit and contexts another
40-bit hash of their bytes, together 80 bits.

Defined results: null text counts as empty; texts shorter than LENGTH lose
nothing; rows that repeat an id are judged by that id, one by one; rows without
an id are left out; extra columns are ignored; equal strings of one document (ties)
leave each other alone; a very long text is one slice of its own, read whole; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_slices, flat_utf8, mix64, powers, released, stash, texts_of

LENGTH = 50
K = 20
#: Text bytes for each bucket of ranks and each bucket of documents.
BUCKET_BYTES = 12 << 20
#: Text bytes whose ranks go into one packed row for each bucket.
SLICE = 2 << 20
#: Text bytes that numpy works on at once; its arrays take about 80 bytes for each.
PIECE = 1 << 19
#: Contexts of one rank that are compared in one task.
MOST = 60_000
#: Longest run of string starts worked on at once; longer documents are cut there.
LONGEST = 1 << 20

_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_M40 = np.uint64((1 << 40) - 1)
_M48 = np.uint64((1 << 48) - 1)
_WIDE = 2 * LENGTH - K
_CACHE: dict[tuple[int, int], np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    key = (base, 1 << max(16, (n - 1).bit_length()))
    if key not in _CACHE:
        _CACHE.clear() if len(_CACHE) > 1 else None
        _CACHE[key] = powers(key[1], base)
    return _CACHE[key][:n]


class Runs:
    """The runs of string starts that chose one position, for the texts data[offsets[i]:offsets[i+1]].

    doc: text of each run; first, last: its string starts; at: the chosen
    position; rank: 40 bits of the K bytes there; context: 40 bits of the run's
    bytes; key: 48 bits of both.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        empty = np.zeros(0, np.int64)
        self.data, self.doc, self.first, self.last, self.at = data, empty, empty, empty, empty
        self.rank = self.context = self.key = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n, _R), out=sums[1:])
        back = _powers(n, _R_INV)
        grams = (sums[K:] - sums[:-K]) * back[: n - K + 1]
        place = np.arange(len(grams), dtype=np.uint64)
        low = (mix64(grams) & ~np.uint64((1 << 24) - 1)) | place
        width = LENGTH - K + 1
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        chosen = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        valid = np.ones(len(chosen), bool)
        for o in offsets[1:-1]:
            valid[max(0, o - LENGTH + 1) : o] = False
        starts = np.flatnonzero(valid)
        if not len(starts):
            return
        at = chosen[starts]
        cut = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]
        self.first = starts[cut]
        self.last = starts[np.r_[cut[1:], True]]
        self.at = at[cut]
        self.doc = np.searchsorted(offsets, self.first, side="right") - 1
        size = self.last - self.first + LENGTH
        self.rank = mix64(grams[self.at] ^ np.uint64(0x3C79AC492BA7B653)) & _M40
        whole = (sums[self.first + size] - sums[self.first]) * back[self.first]
        shape = ((self.at - self.first).astype(np.uint64) << np.uint64(8)) | size.astype(np.uint64)
        self.context = mix64(whole ^ (shape << np.uint64(40))) & _M40
        self.key = _key(self.rank, self.context)


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(first text, texts, start in data, end) of slices; a text beyond LONGEST is cut into overlapping parts."""
    for lo, hi in doc_slices(offsets, min(PIECE, SLICE)):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if end - begin <= LONGEST + LENGTH:
            yield lo, hi, begin, end
        else:
            for at in range(begin, max(begin + 1, end - LENGTH + 1), LONGEST):
                yield lo, hi, at, min(end, at + LONGEST + LENGTH - 1)


def _runs(data, offsets, lo, hi, begin, end) -> Runs:
    inside = offsets[lo : hi + 1] - begin if hi - lo > 1 or end - begin == offsets[hi] - offsets[lo] else np.array([0, end - begin])
    return Runs(data[begin:end], inside)


_PACKED = "bucket int, a binary, b binary, c binary, d binary"


def _rows(bucket: np.ndarray, columns: list[np.ndarray]):
    """One row for each bucket, its entries' columns as bytes; `bucket` must be sorted."""
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(bucket)]
    blobs = [pa.array([c[x:y].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), *blobs], ["bucket", "a", "b", "c", "d"])


def _bytes5(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _from5(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _key(rank: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix64((rank << np.uint64(24)) ^ context * np.uint64(_R)) & _M48


def _entries(batches):
    """(rank, context, document) of the runs of about SLICE bytes of text together."""
    held, size = [], 0
    for batch in batches:
        ids, (data, offsets) = batch.column(0).to_numpy(), flat_utf8(batch.column(1))
        for lo, hi, begin, end in pieces(data, offsets):
            r = _runs(data, offsets, lo, hi, begin, end)
            if len(r.doc):
                held.append((r.rank, r.context, ids[lo:hi][r.doc].astype(np.int64)))
            size += end - begin
            del r
            if held and size >= SLICE:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _ranks(n_buckets: int):
    """Task side of steps 1 and 2: each (rank, context) with the smallest document of the slice that has it, packed by rank."""

    def run(batches):
        for rank, context, doc in _entries(batches):
            order = np.lexsort((doc, context, rank))
            rank, context, doc = rank[order], context[order], doc[order]
            fresh = np.r_[True, (rank[1:] != rank[:-1]) | (context[1:] != context[:-1])]
            once = fresh | np.r_[True, doc[1:] != doc[:-1]]
            rank, context, doc, fresh = rank[once], context[once], doc[once], fresh[once]
            # a context that stands in several documents of the slice goes on for the smallest one; in the others all its strings repeat
            if not fresh.all():
                later = [doc[~fresh].tobytes(), _key(rank[~fresh], context[~fresh]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([int(rank[~fresh][0] % np.uint64(n_buckets))], pa.int32()), *(pa.array([c], pa.binary()) for c in (None, *later, None))], ["bucket", "a", "b", "c", "d"])
            rank, context, doc = rank[fresh], context[fresh], doc[fresh]
            bucket = ((rank >> np.uint64(8)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            first = np.r_[True, bucket[1:] != bucket[:-1]]
            step = np.r_[rank[:1], np.diff(rank)]
            step[first] = 0  # a row's first rank stands in its head, before the ids of its documents
            wide = step.astype(np.uint64) if (step >> np.uint64(32)).any() else step.astype(np.uint32)
            cuts = np.flatnonzero(first)
            held = [np.unique(doc[x:y], return_inverse=True) for x, y in zip(cuts, np.r_[cuts[1:], len(doc)], strict=True)]
            number = np.concatenate([k for _, k in held]).astype(np.uint32)
            rows = _rows(bucket, [wide, _bytes5(context), number, number[:, None][:, :0]])
            head = [int(x).to_bytes(8, "little") + own.tobytes() for x, (own, _) in zip(rank[cuts], held, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), rows.column(3), pa.array(head, pa.binary())], ["bucket", "a", "b", "c", "d"])

    return run


def _grouped(batches, n_columns: int):
    """Rows of a partition sorted by bucket: (bucket, lists of the columns' blobs)."""
    now, held = None, None
    for batch in batches:
        buckets = batch.column(0).to_pylist()
        columns = [batch.column(k + 1).to_pylist() for k in range(n_columns)]
        for k, b in enumerate(buckets):
            if b != now:
                if held is not None:
                    yield now, held
                now, held = b, [[] for _ in range(n_columns)]
            for c in range(n_columns):
                held[c].append(columns[c][k])
    if held is not None:
        yield now, held


#: Marks of a run: bits of the string starts that repeat, or this value where its strings have to be compared.
DETAIL = np.uint32(0x80000000)
FULL = np.uint32(0x7FFFFFFF)


#: A document's bucket is id mod _PRIME * _FACTOR mod _PRIME mod the number of buckets, so ids on a stride spread.
_PRIME, _FACTOR = (1 << 31) - 1, 48_271


def _by_document(doc: np.ndarray, key: np.ndarray, mask: np.ndarray, n_docs: int):
    bucket = np.mod(doc, _PRIME) * _FACTOR % _PRIME % n_docs
    order = np.lexsort((key, doc, bucket))
    doc, key, mask = doc[order], key[order], mask[order]
    return _rows(bucket[order], [doc, key, mask, np.zeros((len(mask), 0), np.uint8)])


#: The bucket of rows that hold no marks but (in a) the ranks with too many contexts for one task.
_HOT = -1


def _mark_runs(n_docs: int, most: int):
    """Reduce side of steps 1 and 2, for a bucket of ranks: marks by document bucket, and the hot ranks."""

    def run(batches):
        for _, (steps, contexts, docs, heads) in _grouped(batches, 4):
            rank, context, doc = [], [], []
            for s, c, d, h in zip(steps, contexts, docs, heads, strict=True):
                if s is None:  # settled by the slice
                    later = np.frombuffer(c, np.int64)
                    yield _by_document(later, np.frombuffer(d, np.uint64), np.full(len(later), FULL), n_docs)
                    continue
                s = np.frombuffer(s, np.uint32 if len(s) == len(d) else np.uint64).astype(np.uint64)
                s[0] = np.frombuffer(h[:8], np.uint64)[0]
                rank.append(np.cumsum(s, dtype=np.uint64))
                context.append(_from5(c))
                doc.append(np.frombuffer(h[8:], np.int64)[np.frombuffer(d, np.uint32)])
            if not rank:
                continue
            rank, context, doc = np.concatenate(rank), np.concatenate(context), np.concatenate(doc)
            order = np.lexsort((doc, context, rank))
            rank, context, doc = rank[order], context[order], doc[order]
            new_rank = np.r_[True, rank[1:] != rank[:-1]]
            new_context = new_rank | np.r_[True, context[1:] != context[:-1]]
            of_rank, of_context = np.cumsum(new_rank) - 1, np.cumsum(new_context) - 1
            starts = np.flatnonzero(new_rank)
            lo, hi = np.minimum.reduceat(doc, starts)[of_rank], np.maximum.reduceat(doc, starts)[of_rank]
            several = np.add.reduceat(new_context.astype(np.int64), starts)[of_rank] > 1
            earliest = doc[np.flatnonzero(new_context)][of_context]
            full = doc > earliest
            detail = ~full & several & (lo < hi)
            keep = full | detail
            key = _key(rank, context)
            mask = np.where(full, FULL, DETAIL)
            if keep.any():
                yield _by_document(doc[keep], key[keep], mask[keep], n_docs)
            hot = rank[starts][np.add.reduceat(detail.astype(np.int64), starts) > most]
            if len(hot):
                none = np.zeros((len(hot), 0), np.uint8)
                yield _rows(np.full(len(hot), _HOT), [hot, none, none, none])

    return run


def _with_marks(batches, work):
    """Rows (bucket, kind, doc_id, a, b, c) sorted by bucket and kind: `work(ids, data, offsets, marks)` for runs of texts.

    kind 0 rows hold marks (documents, keys, masks), kind 1 rows a text each.
    """
    now, held, marks = None, [], None
    for batch in batches:
        buckets, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.r_[True, (buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1])])
        for x, y in zip(cuts, np.r_[cuts[1:], len(buckets)], strict=True):
            if buckets[x] != now:
                now, held, marks = buckets[x], [], None
            part = batch.slice(x, y - x)
            if kinds[x] == 0:
                for a, b, c in zip(*(part.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                    held.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.uint64), np.frombuffer(c, np.uint32)))
                continue
            if marks is None:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)]
                order = np.lexsort((columns[1], columns[0]))
                marks, held = [c[order] for c in columns], []
            data, offsets = flat_utf8(part.column(3))
            yield from work(part.column(2).to_numpy(), data, offsets, marks)


def _masks(r: Runs, ids: np.ndarray, marks) -> np.ndarray:
    """The mark of each run, 0 without one."""
    docs, keys, masks = marks
    out = np.zeros(len(r.doc), np.uint32)
    if not len(docs) or not len(r.doc):
        return out
    own = np.unique(ids)
    lo = np.searchsorted(docs, own, side="left")
    hi = np.searchsorted(docs, own, side="right")
    take = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)]) if len(own) else np.zeros(0, np.int64)
    if not len(take):
        return out
    local = np.repeat(np.arange(len(own), dtype=np.uint64), hi - lo)
    table = (local << np.uint64(48)) | keys[take]
    order = np.argsort(table, kind="stable")
    table, take = table[order], take[order]
    seek = (np.searchsorted(own, ids[r.doc]).astype(np.uint64) << np.uint64(48)) | r.key
    at = np.searchsorted(table, seek)
    at[at == len(table)] = 0
    hit = table[at] == seek
    # a run can carry its own mark and the outcome of its comparison: all bits count
    out[hit] = masks[take[at[hit]]]
    nxt = np.minimum(at + 1, len(table) - 1)
    twice = hit & (nxt > at) & (table[nxt] == seek)
    out[twice] |= masks[take[nxt[twice]]]
    return out


def _hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's LENGTH bytes."""
    words = [np.ascontiguousarray(text[:, k : k + 8]).view("<u8").ravel() for k in (*range(0, LENGTH - 8, 8), LENGTH - 8)]
    one, two = np.full(len(text), 1, np.uint64), np.full(len(text), _R, np.uint64)
    for w in words:
        one, two = mix64(one * np.uint64(_R) ^ w), mix64((two + w) * np.uint64(0xD6E8FEB86659FD93))
    return one, two


def _details(n_buckets: int, hot: np.ndarray, apart: bool = False):
    """Task side of step 3: the contexts to compare, packed by rank; or, `apart`, the strings in contexts of the hot ranks, a row each."""

    def work(ids, data, offsets, marks):
        for lo, hi, begin, end in pieces(data, offsets):
            r = _runs(data, offsets, lo, hi, begin, end)
            if not len(r.doc):
                continue
            chosen = np.flatnonzero((_masks(r, ids[lo:hi], marks) & DETAIL > 0) & (np.isin(r.rank, hot) == apart))
            if not len(chosen):
                continue
            _, once = np.unique((r.doc[chosen].astype(np.uint64) << np.uint64(48)) | r.key[chosen], return_index=True)
            chosen = chosen[once]
            if apart:
                for k in range(0, len(chosen), 10_000):
                    some = chosen[k : k + 10_000]
                    count = (r.last - r.first + 1)[some]
                    row = np.repeat(some, count)
                    col = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    one, two = _hashes(r.data[(r.first[row] + col)[:, None] + np.arange(LENGTH)[None, :]])
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(ids[lo:hi][r.doc[row]].astype(np.int64)), pa.array(r.key[row].view(np.int64)), pa.array(col.astype(np.int32))], ["one", "two", "doc", "key", "col"])
                continue
            chosen = chosen[np.argsort(r.rank[chosen], kind="stable")]
            take = r.first[chosen][:, None] + np.arange(_WIDE)[None, :]
            size = (r.last - r.first)[chosen] + LENGTH
            text = np.where(np.arange(_WIDE)[None, :] < size[:, None], r.data[np.minimum(take, len(r.data) - 1)], 0).astype(np.uint8)
            bucket = ((r.rank[chosen] >> np.uint64(8)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            shape = ((r.at - r.first)[chosen].astype(np.uint16) << np.uint16(8)) | (r.last - r.first + 1)[chosen].astype(np.uint16)
            who = np.stack([ids[lo:hi][r.doc[chosen]].astype(np.int64), r.key[chosen].view(np.int64)], axis=1)
            yield _rows(bucket, [r.rank[chosen], who, shape, text])

    return lambda batches: _with_marks(batches, work)


def _rerank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of (left, right) pairs: equal for equal pairs."""
    order = np.lexsort((right, left))
    x, y = left[order], right[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(order) else 0
    return out


def _alone(rank: np.ndarray) -> np.ndarray:
    """Whether each rank occurs once."""
    return np.bincount(rank)[rank] == 1 if len(rank) else np.zeros(0, bool)


def doubled(text: np.ndarray, rank: np.ndarray, doc: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For contexts (rows of `text`), bits of the strings that also stand in a context of a smaller document.

    Strings are compared within a rank and at one distance from the chosen
    position.  Ranks double: 16 bytes, pairs 16 apart, pairs 18 apart.
    """
    n = len(text)
    group = _rerank(rank.astype(np.int64), np.zeros(n, np.int64))
    row = np.repeat(np.arange(n), count)
    col = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    where = (group[row] << 6) | (before[row] - col)  # the rank, and where the chosen position stands in the string

    def rank16(r, c):
        words = np.lib.stride_tricks.sliding_window_view(text, 8, axis=1)
        pair = [np.ascontiguousarray(words[r, c + k]).view(">i8").ravel().astype(np.int64) for k in (0, 8)]
        return _rerank(*pair)

    one = _rerank(where, rank16(row, col))
    live = ~_alone(one)
    row, col, where, one = row[live], col[live], where[live], one[live]
    two = _rerank(one, rank16(row, col + 16))
    live = ~_alone(two)
    row, col, two = row[live], col[live], two[live]
    # 32 bytes at the string's start and the 32 bytes 18 further on, ranked as 16 + 16
    late = _rerank(rank16(row, col + 18), rank16(row, col + 34))
    three = _rerank(two, late)
    order = np.lexsort((doc[row], three))
    first = np.r_[True, three[order][1:] != three[order][:-1]] if len(order) else np.zeros(0, bool)
    earliest = doc[row][order][np.flatnonzero(first)][np.cumsum(first) - 1]
    again = np.zeros(len(order), bool)
    again[order] = doc[row][order] > earliest
    out = np.zeros(n, np.uint32)
    np.bitwise_or.at(out, row[again], np.uint32(1) << col[again].astype(np.uint32))
    return out


def _packed_marks(n_docs: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _by_document(batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().astype(np.uint32), n_docs)

    return run


def _compare_apart(strings: DataFrame, n_docs: int) -> DataFrame:
    """Step 3 for strings as rows: those of a hash combine before they are dealt, to the smallest and largest document."""
    again = strings.groupBy("one", "two").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("most > least")
    hits = strings.join(again, ["one", "two"]).where("doc > least")
    return hits.groupBy("doc", "key").agg(F.expr("bit_or(shiftleft(1L, col))").alias("mask")).mapInArrow(_packed_marks(n_docs), _PACKED)


def _compare(n_docs: int, most: int):
    """Reduce side of step 3."""

    def run(batches):
        for _, (ranks, who, shapes, texts) in _grouped(batches, 4):
            rank = np.concatenate([np.frombuffer(x, np.uint64) for x in ranks])
            who = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in who])
            shape = np.concatenate([np.frombuffer(x, np.uint16) for x in shapes])
            text = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, _WIDE) for x in texts])
            order = np.argsort(rank, kind="stable")
            cuts = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
            at = 0
            while at < len(order):  # whole ranks, about `most` contexts at a time
                k = np.searchsorted(cuts, at + most, side="right")
                end = int(cuts[k - 1]) if k < len(cuts) and cuts[k - 1] > at else (int(cuts[k]) if k < len(cuts) else len(order))
                part = order[at:end]
                doc = who[part, 0]
                mask = doubled(text[part], rank[part], doc, (shape[part] >> np.uint16(8)).astype(np.int64), (shape[part] & np.uint16(255)).astype(np.int64))
                some = mask > 0
                if some.any():
                    yield _by_document(doc[some], who[part, 1][some].view(np.uint64), mask[some], n_docs)
                at = end

    return run


def _removed(keep_text: bool):
    def work(ids, data, offsets, marks):
        for (lo, hi), cuts in groupby(pieces(data, offsets), key=lambda piece: piece[:2]):
            base, at = int(offsets[lo]), offsets[lo : hi + 1] - offsets[lo]
            own = data[base : int(offsets[hi])]
            change = np.zeros(len(own) + 1, np.int32)
            for _, _, begin, end in cuts:
                r = _runs(data, offsets, lo, hi, begin, end)
                if not len(r.doc):
                    continue
                mask = _masks(r, ids[lo:hi], marks) & FULL
                some = np.flatnonzero(mask)
                count = (r.last - r.first + 1)[some]
                row = np.repeat(some, count)
                col = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                hit = (mask[row] >> col.astype(np.uint32)) & np.uint32(1) > 0
                starts = r.first[row[hit]] + col[hit] + begin - base
                np.add.at(change, starts, 1)
                np.add.at(change, starts + LENGTH, -1)
            gone = np.cumsum(change[:-1], dtype=np.int32) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = at[:-1][at[:-1] < len(own)]
            opens[inner] = gone[inner]
            count_gone, count_open = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(opens)]
            kept = [own[x:y][~gone[x:y]].tobytes() if count_gone[y] > count_gone[x] else own[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            columns = [pa.array(ids[lo:hi]), pa.array(np.diff(at)), pa.array(np.diff(count_gone[at])), pa.array(np.diff(count_open[at])), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return lambda batches: _with_marks(batches, work)


def _dealt(packed: DataFrame) -> DataFrame:
    return packed.repartition("bucket").sortWithinPartitions("bucket")


def remove_repeats(docs: DataFrame, keep_text: bool = False, bucket_bytes: int = BUCKET_BYTES, most: int = MOST) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]), one for each row of `docs` with an id.

    `kept_text` leaves out the bytes of characters of which only a part was removed.
    """
    docs = texts_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total) // bucket_bytes
    n_buckets, n_docs = max(16, n), max(17, n | 1)

    ranks = docs.mapInArrow(released(_ranks(n_buckets)), _PACKED)
    marked = stash(_dealt(ranks).mapInArrow(released(_mark_runs(n_docs, most)), _PACKED), "marks")
    # bounded: each of these ranks has more than `most` contexts
    hot = np.frombuffer(b"".join(r["a"] for r in marked.where(F.col("bucket") == _HOT).select("a").collect()), np.uint64)
    marks = marked.where(F.col("bucket") != _HOT)
    texts = docs.select((F.pmod("doc_id", F.lit(_PRIME).cast("long")) * _FACTOR % _PRIME % n_docs).cast("int").alias("bucket"), F.lit(1).alias("kind"), "doc_id", F.col("text").cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), F.lit(None).cast("binary").alias("c"))

    def joined(rows: DataFrame) -> DataFrame:
        marked = rows.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), "a", "b", "c")
        return texts.unionByName(marked).repartition("bucket").sortWithinPartitions("bucket", "kind")

    details = joined(marks).mapInArrow(released(_details(n_buckets, hot)), _PACKED)
    found = stash(_dealt(details).mapInArrow(released(_compare(n_docs, most)), _PACKED), "found")
    if len(hot):
        strings = stash(joined(marks).mapInArrow(_details(n_buckets, hot, True), "one long, two long, doc long, key long, col int"), "strings")
        found = found.unionByName(stash(_compare_apart(strings, n_docs), "hot"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return joined(marks.unionByName(found)).mapInArrow(released(_removed(keep_text)), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, with repeated passages cut from `text` and `n_chars` brought up to date.

    Ids have to be unique.  A text of which nothing is left stays as an empty text.
    """
    kept = remove_repeats(docs, keep_text=True).select("doc_id", F.col("kept_text").alias("__kept"))
    rest = docs.drop("text", *(["n_chars"] if "n_chars" in docs.columns else []))
    out = kept.join(rest, "doc_id").withColumnRenamed("__kept", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
