"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are runs of letters and digits in lower case.  Any
shared run of `MATCH` tokens is a seed; a document that shares seeds enough
with an item is tiled against it: the longest runs of tokens that both have and
that no tile covers yet are marked, longest first, until none of `MATCH` tokens
is left.  Runs are found by running Karp-Rabin hashes of falling length.  An
item is contaminated by a document when tiles cover at least `COVERAGE` of the
item's tokens, in whatever order the passages stand.

Seeds are looked up in a table of the items' hashes that is sent to all tasks
while the items hold at most `BROADCAST_TOKENS` tokens (40 MB), so that no text
is shuffled; larger benchmarks are joined by seed.

Defined results: null or empty texts and items match nothing; items of fewer
than `MATCH` tokens are not searched for; repeated rows and items give a row
each; rows without an id are left out of the pairs.  Of tiles of equal length the
one that begins first in the item, then in the text, is marked first.  A very long
text is searched whole; an empty table on either side gives no pairs; columns
beyond ids and texts are not looked at (`clean_documents` carries them along).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_slices, flat_utf8, mix64, released, texts_of, token_hashes, words_of

MATCH = 5
COVERAGE = 0.5
BROADCAST_TOKENS = 5_000_000

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_TOKEN[128:] = True
_P = np.uint64(0x2545F4914F6CDD1D)

_PAIRS = "doc_id long, item_id long, item_tokens int, covered int, coverage double, tiles int, longest int"


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of lower-cased texts end to end, n+1 bounds)."""
    starts, ends, doc = words_of(data, _TOKEN, offsets)
    return token_hashes(data, starts, ends), np.searchsorted(doc, np.arange(len(offsets)))


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of each window of `width` tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _P + tokens[k : k + n]
    return mix64(h)


def _free_windows(marked: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows without a marked token."""
    if len(marked) < width:
        return np.zeros(0, np.int64)
    sums = np.r_[0, np.cumsum(marked)]
    return np.flatnonzero(sums[width:] == sums[:-width])


def tile(item: np.ndarray, text: np.ndarray, least: int = MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), longest first, by running Karp-Rabin greedy string tiling."""
    used_i, used_t = np.zeros(len(item), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    width = max(least, min(len(item), len(text), 32))
    while True:
        matches: list[tuple[int, int, int]] = []
        longest = 0
        at_item = _free_windows(used_i, width)
        at_text = _free_windows(used_t, width)
        if len(at_item) and len(at_text):
            own = window_hashes(item, width)[at_item]
            order = np.argsort(own, kind="stable")
            own, at_item = own[order], at_item[order]
            seek = window_hashes(text, width)[at_text]
            lo, hi = np.searchsorted(own, seek, "left"), np.searchsorted(own, seek, "right")
            for k in np.flatnonzero(hi > lo):
                j = int(at_text[k])
                for i in at_item[lo[k] : hi[k]].tolist():
                    if i and j and not used_i[i - 1] and not used_t[j - 1] and item[i - 1] == text[j - 1]:
                        continue  # inside a longer run
                    n = 0
                    while i + n < len(item) and j + n < len(text) and not used_i[i + n] and not used_t[j + n] and item[i + n] == text[j + n]:
                        n += 1
                    if n >= width:
                        matches.append((n, i, j))
                        longest = max(longest, n)
        if longest > 2 * width:
            width = longest
            continue
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not used_i[i : i + n].any() and not used_t[j : j + n].any():
                used_i[i : i + n] = used_t[j : j + n] = True
                tiles.append((i, j, n))
        if matches:
            continue  # runs that a tile cut short may still be of this length
        if width == least:
            break
        width = max(least, width // 2)
    return sorted(tiles, key=lambda t: (-t[2], t[0], t[1]))


def near_seeds(text: np.ndarray, hits: np.ndarray, least: int) -> np.ndarray:
    """The parts of a text that lie in some seed, with a token that occurs nowhere else between them."""
    inside = np.zeros(len(text) + 1, np.int64)
    np.add.at(inside, hits, 1)
    np.add.at(inside, np.minimum(hits + least, len(text)), -1)
    inside = np.cumsum(inside[:-1]) > 0
    cut = inside.copy()
    cut[1:] |= inside[:-1]  # one token after each part, overwritten below
    out = text.copy()
    out[~inside] = 0
    return out[cut | inside]


class Items:
    """The benchmark's items: their tokens and a sorted table of seeds."""

    def __init__(self, ids: list[int], texts: list[str], least: int = MATCH):
        # lower-cased as documents are: str.lower() differs for a final sigma and the dotted I
        tokens, bounds = tokens_of(*flat_utf8(pc.utf8_lower(pc.fill_null(pa.array(texts, pa.string()), ""))))
        self.least = least
        self.ids = ids
        self.tokens = [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        seeds = [window_hashes(t, least) for t in self.tokens]
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.lexsort((owner, flat))
        self.seeds, self.owner = flat[order], owner[order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.seeds >> np.uint64(42)).astype(np.int64)] = True

    def matches(self, text: np.ndarray, bounds: np.ndarray, coverage: float):
        """(text number, item number, tiles) for texts given end to end that cover an item enough."""
        windows = window_hashes(text, self.least)
        hit = np.flatnonzero(self.sieve[(windows >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.seeds, windows[hit], "left"), np.searchsorted(self.seeds, windows[hit], "right")
        some = hi > lo
        hit, lo, hi = hit[some], lo[some], hi[some]
        doc = np.searchsorted(bounds, hit, side="right") - 1
        whole = hit + self.least <= bounds[doc + 1]
        hit, lo, hi, doc = hit[whole], lo[whole], hi[whole], doc[whole]
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
        for x, y in zip(cuts, np.r_[cuts[1:], len(doc)] if len(doc) else [], strict=True):
            places: dict[int, list[int]] = {}
            found: Counter[int] = Counter()
            seen: set[int] = set()
            for k in range(x, y):
                for e in range(lo[k], hi[k]):
                    places.setdefault(int(self.owner[e]), []).append(int(hit[k]))
                    if e not in seen:
                        seen.add(e)
                        found[int(self.owner[e])] += 1
            begin, end = bounds[doc[x]], bounds[doc[x] + 1]
            for item, n in sorted(found.items()):
                size = len(self.tokens[item])
                if n * self.least < coverage * size:
                    continue
                part = near_seeds(text[begin:end], np.unique(places[item]) - begin, self.least)
                tiles = tile(self.tokens[item], part, self.least)
                if sum(t[2] for t in tiles) >= coverage * size:
                    yield int(doc[x]), item, tiles


def _scan(batches, shared, id_at: int, text_at: int, coverage: float, clean: bool):
    items: Items = shared.value
    for batch in batches:
        texts = pc.utf8_lower(pc.fill_null(batch.column(text_at), ""))
        data, offsets = flat_utf8(texts)
        rows, found = [], []
        for lo, hi in doc_slices(offsets):
            at = offsets[lo : hi + 1]
            text, bounds = tokens_of(data[at[0] : at[-1]], at - at[0])
            for doc, item, tiles in items.matches(text, bounds, coverage):
                rows.append(lo + doc)
                covered, size = sum(t[2] for t in tiles), len(items.tokens[item])
                found.append((items.ids[item], size, covered, covered / size, len(tiles), tiles[0][2]))
        if clean:
            keep = np.ones(batch.num_rows, bool)
            keep[rows] = False
            yield batch.filter(pa.array(keep))
        elif rows:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            columns = [batch.column(id_at).take(pa.array(rows, pa.int64()))] + [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _PAIRS.split(", ")])


def _load_items(items: DataFrame, match: int) -> Items | None:
    """The items, or None if they are too many to send to all tasks."""
    # a token takes two characters with its space, so characters bound tokens
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size > 2 * BROADCAST_TOKENS:
        return None
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").collect()
    return Items([r["item_id"] for r in rows], [r["text"] for r in rows], match)


def contaminated_pairs(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """Rows (doc_id, item_id, item_tokens, covered, coverage, tiles, longest) of all documents that hold enough of an item."""
    docs = texts_of(docs)
    table = _load_items(items, match)
    if table is None:
        return _joined(docs, items, match, coverage)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    return docs.mapInArrow(lambda batches: _scan(batches, shared, 0, 1, coverage, False), _PAIRS)


def clean_documents(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item; no shuffle while the items are few."""
    table = _load_items(items, match)
    if table is None:
        return docs.join(contaminated_pairs(docs, items, match, coverage).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    text_at = docs.columns.index("text")
    return docs.mapInArrow(lambda batches: _scan(batches, shared, 0, text_at, coverage, True), docs.schema)


def _seeds(match: int):
    def run(batches):
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_numpy(), flat_utf8(pc.utf8_lower(pc.fill_null(batch.column(1), "")))
            for lo, hi in doc_slices(offsets):
                at = offsets[lo : hi + 1]
                text, bounds = tokens_of(data[at[0] : at[-1]], at - at[0])
                h = window_hashes(text, match)
                doc = np.searchsorted(bounds, np.arange(len(h)), side="right") - 1
                whole = np.arange(len(h)) + match <= bounds[doc + 1]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][doc[whole]]), pa.array(h[whole].view(np.int64))], ["id", "seed"])

    return run


def _joined(docs: DataFrame, items: DataFrame, match: int, coverage: float) -> DataFrame:
    """The same pairs for a benchmark of any size: candidates by a join on seeds, tiled one by one."""
    items = items.where("item_id is not null").select("item_id", F.col("text").alias("item_text"))
    of_items = items.mapInArrow(released(_seeds(match)), "id long, seed long").select(F.col("id").alias("item_id"), "seed").distinct()
    of_docs = docs.mapInArrow(released(_seeds(match)), "id long, seed long").select(F.col("id").alias("doc_id"), "seed").distinct()
    candidates = of_docs.join(of_items, "seed").select("doc_id", "item_id").distinct()

    def run(batches):
        for batch in batches:
            out = []
            for doc, item_id, text, item_text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                one = Items([item_id], [item_text], match)
                tokens, bounds = tokens_of(*flat_utf8(pc.utf8_lower(pa.array([text or ""], pa.string()))))
                for _, _, tiles in one.matches(tokens, bounds, coverage):
                    covered, size = sum(t[2] for t in tiles), len(one.tokens[0])
                    out.append((doc, item_id, size, covered, covered / size, len(tiles), tiles[0][2]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in _PAIRS.split(", ")])

    pairs = candidates.join(docs, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "item_text")
    return pairs.mapInArrow(released(run), _PAIRS)
