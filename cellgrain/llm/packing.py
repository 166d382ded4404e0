"""Mixture-controlled packing of documents into fixed-length training sequences.

Each source is a queue of tokens (its documents end to end).  Windows of
`window` tokens are filled by deficit round-robin: in each round every queue is
credited its share of the window, hands out the whole tokens it has credit for
and carries the rest of its credit, its deficit, to the next window.  The
credit that a queue has used before window w is therefore
round(share * w), a closed form: any task can tell in which window, and
where in it, a token of a queue lies, and deficits carry over windows and
partitions without a sequential pass.  A queue that runs dry leaves its share
to the others (a new phase of the plan).  Windows follow each other without a
gap and are cut into sequences of `length` tokens, so only the last sequence
is padded.

Steps: tokenise once into a table in the shared folder (ids as 16 bits, with
each document's place in its block's queue), add up tokens by block and queue,
running sums of those give each block's place in its queue, then every
document is cut into pieces where it stands.  Token ids are never shuffled
unless the table of block offsets outgrows the session's broadcast threshold.

Defined results: rows without an id are left out; null text counts as empty and gives the one end id; a null
source is a queue of its own; repeated rows are packed one by one; an empty
table gives no rows; queues of equal deficit are served in their order; a very long
text is cut into as many pieces as it needs; columns beyond doc_id, text and source
are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stash

LENGTH = 2048
#: Sequences in a window: the span within which the mixture is met.
SEQUENCES = 64
#: Queues with a share of their own; more sources than this share queues by a hash of their name.
QUEUES = 4096
#: Up to so many block offsets (about 50 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
END_ID = 1
BLOCK_TEXTS = 4000

_WORD = re.compile(r"[^ \n\t\r]+")
# the splitting pattern is a value of the vocabulary's file, and fixed
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A character beyond white space, ASCII without "<" and ">" (special tokens hold them), and letters that NFC leaves alone and whose lower case is one letter.
_ODD = re.compile("[^ \\n\\t\\r!-;=?-~À-ÖØ-öø-ÿ]")
#: _SPLIT for lower-cased texts without odd characters.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:;=?@\\[-`{-~]+")
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window_id long"


class WordEncoder:
    """Token ids of whole texts, encoding each part of a text once.

    The vocabulary splits at white space and drops it, so the ids of a text are
    those of its words in order.  Where its file normalises and splits as
    expected, words without odd characters are split here, and their different
    parts go straight to the file's merges: the last id of a part is that of a
    token at a word's end.  Other words are encoded whole.
    """

    SEP = "\x00"

    def __init__(self, path: str, keep: int = 600_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        self.words: dict[str, bytes] = {}
        self.sep_ids = self.tokenizer.encode(self.SEP, add_special_tokens=False).ids
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.merges = None
        if self._as_expected(json.loads(self.tokenizer.to_str())):
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.spelt = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(33, 256) if not _ODD.search(chr(k))}
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[k for token, k in vocab.items() if token.endswith("</w>")]] = True

    def _as_expected(self, spec: dict) -> bool:
        steps = (spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers")
        wanted = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}], [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        model = spec["model"]
        plain = model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not (model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"])
        return steps == wanted and plain and not spec["post_processor"] and all(_ODD.search(t) for t in self.special)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, text: str) -> list[str]:
        """The parts of a text, in order; words with odd characters are parts as they stand."""
        if self.merges is None:
            return _WORD.findall(text)
        if not _ODD.search(text):
            return _PARTS.findall(text.lower())
        return [part for w in _WORD.findall(text) for part in ([w] if _ODD.search(w) else _PARTS.findall(w.lower()))]

    def learn(self, parts: set[str]) -> None:
        new = parts - self.words.keys()
        if len(self.words) + len(new) > self.keep:
            self.words.clear()
            new = parts
        odd = new if self.merges is None else {w for w in new if _ODD.search(w)}
        self._learn_odd(odd)
        plain = list(new - odd)
        for k in range(0, len(plain), 2000):
            some = plain[k : k + 2000]
            ids = np.array(self.merges.encode_batch_fast([" ".join(some).translate(self.spelt)], add_special_tokens=False)[0].ids, np.uint16)
            self._keep(some, ids.tobytes(), np.r_[0, np.flatnonzero(self.ends[ids]) + 1], 0)

    def _learn_odd(self, new: set[str]) -> None:
        alone = [w for w in new if self.SEP in w or any(s in w for s in self.special)] if len(self.sep_ids) == 1 else list(new)
        rest = list(new.difference(alone))
        for w, ids in zip(alone, self._encode(alone), strict=True):
            self.words[w] = np.array(ids, np.uint16).tobytes()
        for k in range(0, len(rest), 2000):
            some = rest[k : k + 2000]
            ids = np.array(self._encode([f" {self.SEP} ".join(some)])[0], np.uint16)
            self._keep(some, ids.tobytes(), np.r_[0, np.flatnonzero(ids == self.sep_ids[0]) + 1, len(ids) + 1], 1)

    def _keep(self, parts: list[str], raw: bytes, bounds: np.ndarray, between: int) -> None:
        """The ids of each part: those from its bound up to the next one, less the ids that stand between parts."""
        at = (2 * bounds).tolist()
        self.words.update((w, raw[x : y - 2 * between]) for w, x, y in zip(parts, at[:-1], at[1:], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers."""
        parts = [self.parts(t) for t in texts]
        self.learn(set().union(*parts) if parts else set())
        get = self.words.__getitem__
        return [b"".join(map(get, p)) for p in parts]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Mixture:
    """The service curve of each queue: tokens handed out before window w, for any w.

    `totals` are the queues' tokens; `weights` their target shares (their
    natural shares when None).
    """

    def __init__(self, totals, window: int, weights=None):
        self.totals = np.asarray(totals, np.int64)
        self.window = window
        goal = np.asarray(self.totals if weights is None else weights, np.float64)
        goal = np.where(goal > 0, goal, 1e-9)
        self.starts, self.given, self.rates = [], [], []
        at, given = 0, np.zeros(len(self.totals), np.int64)
        while (given < self.totals).any():
            active = given < self.totals
            rate = np.where(active, goal / goal[active].sum() * window, 0.0)
            left = (self.totals - given)[active]
            rounds = left / rate[active]
            if weights is None:  # natural shares: all queues end together
                n = max(1, -(-int(left.sum()) // window))
                rate = np.where(active, (self.totals - given) / n, 0.0)
            else:
                n = max(1, int(np.ceil(rounds.min())))
            self.starts.append(at)
            self.given.append(given)
            self.rates.append(rate)
            given = np.where(active, np.minimum(self.totals, given + np.floor(rate * n + 0.5).astype(np.int64)), given)
            if weights is None:
                given = self.totals.copy()
            at += n
        self.starts.append(at)
        self.given.append(given)
        self.rates.append(np.zeros(len(self.totals)))
        self._cache: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def before(self, w: int) -> np.ndarray:
        """Tokens of each queue in the windows before w."""
        k = min(int(np.searchsorted(self.starts, w, side="right")) - 1, len(self.starts) - 1)
        if w == self.starts[k]:
            return self.given[k]
        out = self.given[k] + np.floor(self.rates[k] * (w - self.starts[k]) + 0.5).astype(np.int64)
        return np.minimum(out, self.given[k + 1] if k + 1 < len(self.given) else self.totals)

    def at(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens before w, tokens before w + 1, place of each queue's part of w in the whole packing)."""
        if w not in self._cache:
            if len(self._cache) > 512:
                self._cache.clear()
            lo, hi = self.before(w), self.before(w + 1)
            part = hi - lo
            self._cache[w] = lo, hi, int(lo.sum()) + np.cumsum(part) - part
        return self._cache[w]

    def find(self, q: int, t: int) -> int:
        """The window that holds token t of queue q."""
        k = max(i for i in range(len(self.starts)) if self.given[i][q] <= t and self.rates[i][q] > 0)
        w = self.starts[k] + int((t - self.given[k][q]) / self.rates[k][q])
        while self.at(w)[1][q] <= t:
            w += 1
        while self.at(w)[0][q] > t:
            w -= 1
        return w

    def pieces(self, q: int, first: int, n: int, length: int):
        """Cut tokens first .. first + n of queue q: (start, tokens, place in the whole packing, window)."""
        t, end = first, first + n
        while t < end:
            w = self.find(q, t)
            lo, hi, place = self.at(w)
            at = int(place[q]) + t - int(lo[q])
            size = min(int(hi[q]) - t, end - t, length - at % length)
            yield t - first, size, at, w
            t += size


def tokenize(docs: DataFrame, path: str, n_sources: int) -> DataFrame:
    """Rows (doc_id, queue, block, in_block, n, ids): each document's ids with the end id, and its place in its block's queue."""
    queue = F.concat(F.lit("s:"), F.col("source").cast("string")) if n_sources <= QUEUES else F.concat(F.lit("h:"), F.pmod(F.xxhash64("source"), F.lit(QUEUES)).cast("string"))
    end = np.array([END_ID], np.uint16).tobytes()

    def run(batches):
        machine, part, k = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_TEXTS):
                rows = batch.slice(lo, BLOCK_TEXTS)
                queues, texts = rows.column(1).to_pylist(), pc.fill_null(rows.column(2), "")
                ids = []
                for at in range(0, len(texts), 500):
                    ids += [x + end for x in machine.encode(texts.slice(at, 500).to_pylist())]
                used: dict[str, int] = {}
                places = []
                for name, x in zip(queues, ids, strict=True):
                    places.append(used.get(name, 0))
                    used[name] = places[-1] + len(x) // 2
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(queues, pa.string()), pa.array([f"{part:08d}-{k:08d}"] * len(ids)), pa.array(places, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "queue", "block", "in_block", "n", "ids"],
                )
                k += 1

    return docs.select("doc_id", F.coalesce(queue, F.lit("null")).alias("queue"), "text").mapInArrow(released(run), "doc_id long, queue string, block string, in_block long, n long, ids binary")


def pack(docs: DataFrame, path: str, length: int = LENGTH, sequences: int = SEQUENCES, weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces of every document of `docs` (columns doc_id, text, source) in sequences of `length` ids.

    `path` is a tokenizers file that executors can read.  `weights` are target
    token shares by source; by default each source keeps its natural share.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    if docs.isEmpty():
        return spark.createDataFrame([], _PIECE)
    n_sources = docs.select("source").distinct().count()
    table = stash(tokenize(docs, path, n_sources), "tokens")
    by_block = table.groupBy("queue", "block").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_block.select("queue", "block", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    totals = {r["queue"]: r["n"] for r in by_block.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # at most QUEUES + 1 rows
    # a row for each block of BLOCK_TEXTS documents and queue: sent to all tasks while small, else joined by key
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    names = sorted(totals)
    number = {name: k for k, name in enumerate(names)}
    share = None if weights is None else [float(weights.get(name.removeprefix("s:"), 0.0)) for name in names]
    plan = Mixture([totals[name] for name in names], length * sequences, share)

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(9)]
            for doc, queue, before, in_block, n, ids in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                for start, size, at, w in plan.pieces(number[queue], before + in_block, n, length):
                    row = doc, start, size, zlib.crc32(wide[4 * start : 4 * (start + size)]), n, at // length, at % length, queue[2:] if queue != "null" else None, w
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 7 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [f.split()[0] for f in _PIECE.split(", ")])

    return table.join(offsets, ["queue", "block"]).select("doc_id", "queue", "before", "in_block", "n", "ids").mapInArrow(released(run), _PIECE)
