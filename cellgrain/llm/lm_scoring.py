"""Document likelihood under a unigram subword lattice.

A word is a path through the pieces of an existing vocabulary; the model sums
over all segmentations by a forward recursion in log space, so a word's
probability is marginal, not that of one best cut.  The vocabulary's own scores
(ranks, read as a Zipf law) start the piece probabilities; a few rounds of
expectation-maximisation over all distinct training words refit them to the
corpus.  Each distinct word counts once there, as the lattice has to stand for
words not seen yet, which are like rare ones; for the same reason its word
lengths are brought to those of the distinct words: lattice(word) is divided by
the mass that the lattice gives to words of that length (a convolution of piece
lengths) and multiplied by their share.  Words seen in training are edges of the
lattice too: with absolute discount D, count c and N training tokens

    P(word) = max(c - D, 0) / N + (D V / N) P_lattice(word),

and the end of a text is one more token.  P is at most a probability over texts,
so scores of different models compare.

Jobs: texts are cut into blocks, each with its own word list and token numbers
(one pass, kept in the shared folder); word lists are counted by word; the
counted words are scored once each; the scores go back to the blocks that have
the word.  Texts are never shuffled, and a frequent word costs one row for each
block, summed map-side.

Defined results: null text counts as empty and has the end token alone; rows
without an id are left out; without training rows every count is 0, the base
score is 0 a token and the model is the lattice with the vocabulary's scores.
Repeated rows are scored (and learnt from) one by one; words of equal count are
equals, their order changes no score; an empty table gives no rows; a very long
text is scored whole, in slices of words; columns beyond doc_id and text are not
looked at.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, doc_slices, flat_utf8, stash

BLOCK_BYTES = 12 << 20
#: Share of the lattice's mass that keeps the lattice's own word lengths; all of it for words beyond LONG bytes.
PLAIN = 0.01
LONG = 255
ROUNDS = 3
#: Added to a piece's expected count, so that every piece keeps a chance.
SMOOTHING = 1e-2
_LN10 = float(np.log(10.0))
_NEVER = -1e300


class Lattice:
    """Pieces of a vocabulary as a byte trie; a space marks the start of a word."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                pieces.setdefault(piece, sp.get_score(i))
        order = sorted(pieces, key=lambda p: -pieces[p])
        order += [bytes([b]) for b in range(256) if bytes([b]) not in pieces]
        self.pieces = order
        #: The vocabulary's scores are ranks; as log probabilities, a Zipf law.
        zipf = 1 / (np.arange(len(order)) + 10.0)
        self.start = np.log(zipf / zipf.sum() * 0.99)
        self.end_start = float(np.log(0.01))
        child: list[dict[int, int]] = [{}]
        token = [-1]
        for k, piece in enumerate(order):
            node = 0
            for b in piece:
                if b not in child[node]:
                    child[node][b] = len(child)
                    child.append({})
                    token.append(-1)
                node = child[node][b]
            token[node] = k
        self.next = np.zeros((len(child), 256), np.int32)
        for node, kids in enumerate(child):
            for b, to in kids.items():
                self.next[node, b] = to
        self.token = np.array(token, np.int32)

    def edges(self, words: np.ndarray):
        """(start, end, rows, pieces) of all pieces that occur in equally long words (rows of bytes)."""
        n, length = words.shape
        for i in range(length):
            rows = np.arange(n)
            node = np.zeros(n, np.int32)
            for j in range(i, length):
                node = self.next[node, words[rows, j]]
                live = node > 0
                if not live.all():
                    rows, node = rows[live], node[live]
                    if not len(rows):
                        break
                piece = self.token[node]
                has = piece >= 0
                if has.any():
                    yield i, j + 1, rows[has], piece[has]

    def forward(self, words: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each prefix."""
        alpha = np.full((len(words), words.shape[1] + 1), _NEVER)
        alpha[:, 0] = 0
        for i, j, rows, piece in self.edges(words):
            alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + logp[piece])
        return alpha

    def expected(self, words: np.ndarray, logp: np.ndarray, into: np.ndarray) -> None:
        """Add the expected piece counts of the words."""
        edges = list(self.edges(words))
        length = words.shape[1]
        alpha = np.full((len(words), length + 1), _NEVER)
        alpha[:, 0] = 0
        for i, j, rows, piece in edges:
            alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + logp[piece])
        beta = np.full((len(words), length + 1), _NEVER)
        beta[:, length] = 0
        for i, j, rows, piece in reversed(edges):
            beta[rows, i] = np.logaddexp(beta[rows, i], beta[rows, j] + logp[piece])
        whole = alpha[:, length]
        for i, j, rows, piece in edges:
            share = np.exp(alpha[rows, i] + logp[piece] + beta[rows, j] - whole[rows])
            into += np.bincount(piece, share, len(into))


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """The trie of a vocabulary file, one for each Python worker."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def by_length(data: np.ndarray, offsets: np.ndarray, cells: int = 400_000):
    """Words data[offsets[k]:offsets[k+1]] in groups of one length: (numbers, rows of bytes led by the word mark)."""
    size = np.diff(offsets)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.r_[True, size[order][1:] != size[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
        n = int(size[order[lo]])
        step = max(1, cells // (n + 1))
        for at in range(lo, hi, step):
            take = order[at : min(hi, at + step)]
            words = np.empty((len(take), n + 1), np.uint8)
            words[:, 0] = 32
            words[:, 1:] = data[offsets[take][:, None] + np.arange(n)[None, :]]
            yield take, words


def _blocks(batches):
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        data, offsets = flat_utf8(batch.column(2))
        for lo, hi in doc_slices(offsets, BLOCK_BYTES):
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            tokens, counts = [], []
            for k in range(lo, hi):
                words = data[offsets[k] : offsets[k + 1]].tobytes().lower().split()
                tokens.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                counts.append(len(words))
            flat = np.concatenate(tokens)
            learned = np.repeat(train[lo:hi].astype(bool), counts)
            seen = np.bincount(flat[learned], minlength=len(number))
            # frequent words get small numbers, which pack well
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            words = list(number)
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | seq]),
                    one(ids[lo:hi], pa.int64()),
                    one(train[lo:hi].astype(bool).tolist(), pa.bool_()),
                    one(np.array(counts, np.int32), pa.int32()),
                    pa.array([place[flat].tobytes()], pa.binary()),
                    one([words[k].decode("utf-8", "replace") for k in order], pa.string()),
                    one(seen[order], pa.int64()),
                ],
                ["block", "doc_ids", "train", "counts", "tokens", "words", "seen"],
            )
            seq += 1


_BLOCK = "block long, doc_ids array<long>, train array<boolean>, counts array<int>, tokens binary, words array<string>, seen array<long>"


def fit_pieces(vocab: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(log probability of each piece, of the end) after `rounds` of EM over the distinct words of rows (word, c) with c > 0.

    A task returns one number for each piece: the driver sees a table of the
    vocabulary's size, whatever the corpus.
    """
    machine = lattice(path)
    logp, end = machine.start, machine.end_start
    for _ in range(rounds):
        now = logp

        def run(batches, now=now):
            own, total = lattice(path), np.zeros(len(now))
            for batch in batches:
                for _, words in by_length(*flat_utf8(batch.column(0))):
                    own.expected(words, now, total)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["piece", "n"])

        got = vocab.where("c > 0").select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        count = np.full(len(logp), SMOOTHING)
        for row in got:
            count[row["piece"]] += row["n"]
        whole = count.sum() + 1
        logp, end = np.log(count / whole), -float(np.log(whole))
    return logp, end


def length_factor(machine: Lattice, logp: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Log of the factor that gives words of 0 .. LONG bytes the shares in `sizes` (bytes -> distinct words)."""
    first, later = np.zeros(LONG + 2), np.zeros(LONG + 2)
    for piece, p in zip(machine.pieces, np.exp(logp), strict=True):
        if len(piece) < len(first):
            (first if piece.startswith(b" ") else later)[len(piece)] += p
    mass = first.copy()
    for n in range(1, len(mass)):
        mass[n] += later[1:n] @ mass[n - 1 : 0 : -1]
    share = np.array([sizes.get(n, 0) for n in range(LONG + 1)]) + 0.01
    share[0] = 0
    with np.errstate(divide="ignore"):
        factor = np.log((1 - PLAIN) * share / share.sum() / np.maximum(mass[1:], 1e-300) + PLAIN)
    return factor


def score_documents(docs: DataFrame, path: str, train: Column, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of `docs` with an id.

    `path` is a sentencepiece vocabulary that executors can read; `train` marks
    the rows to learn from.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.col("text").cast("string").alias("text"))
    blocks = stash(docs.mapInArrow(_blocks, _BLOCK), "blocks")
    counted = blocks.select("block", F.posexplode(F.arrays_zip("words", "seen")).alias("pos", "w")).select("block", "pos", F.col("w.words").alias("word"), F.col("w.seen").alias("c"))
    vocab = stash(counted.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    ends = blocks.select(F.explode("train").alias("t")).agg(F.count_if("t")).first()[0]
    learned = F.col("c") > 0
    sums = vocab.agg(F.sum("c").alias("n"), F.count_if(learned).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    n_tokens, n_types = int(sums["n"] or 0) + ends, int(sums["v"]) + (ends > 0)
    # the discount that leaving one out suggests
    discount = min(0.95, max(0.1, sums["n1"] / (sums["n1"] + 2 * sums["n2"]))) if sums["n1"] else 0.5
    machine = lattice(path)
    logp, log_end = fit_pieces(vocab, path, rounds if sums["v"] else 0)
    sizes = vocab.where(learned & (F.octet_length("word") <= LONG)).groupBy(F.octet_length("word").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()  # LONG rows at most
    factor = length_factor(machine, logp, {r["size"]: r["n"] for r in sizes}) if sums["v"] else np.zeros(LONG + 1)
    spread = discount * n_types / n_tokens if n_tokens else 1.0

    def model(c, lattice_log):
        """log10 of the token probability."""
        part = lattice_log + np.log(spread)
        seen = np.log(np.maximum(c - discount, 1e-300)) - np.log(max(n_tokens, 1))
        return np.where(c > 0, np.logaddexp(part, seen), part) / _LN10

    def scored(batches):
        own = lattice(path)
        for batch in batches:
            data, offsets = flat_utf8(batch.column(0))
            value = np.empty(batch.num_rows)
            for take, words in by_length(data, offsets):
                n = words.shape[1] - 1
                value[take] = own.forward(words, logp)[:, -1] + (factor[n] if n <= LONG else np.log(PLAIN))
            c = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model(c, value).astype(np.float32))], ["word", "c", "lp"])

    words = vocab.select("word", "c").mapInArrow(scored, "word string, c long, lp float")
    known = counted.select(F.col("block").alias("of_block"), "pos", "word").join(words, "word").select("of_block", "pos", "c", "lp")
    whole = n_tokens + 0.5 * (n_types + 1)
    base_of = lambda c: np.log10((c + 0.5) / whole)
    end_base, end_score = float(base_of(ends)), float(model(np.array([float(ends)]), np.array([log_end]))[0])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        pos = right.column("pos").to_numpy()
        c, lp = np.zeros(len(pos), np.int64), np.zeros(len(pos))
        c[pos], lp[pos] = right.column("c").to_numpy(), right.column("lp").to_numpy()
        base, known_word = base_of(c), (c > 0).astype(np.int64)
        tables = []
        for k in range(left.num_rows):
            counts = left.column("counts")[k].values.to_numpy()
            tokens = np.frombuffer(left.column("tokens")[k].as_py(), np.int32)
            n = len(counts)
            owner = np.repeat(np.arange(n), counts)
            total = lambda v: np.bincount(owner, v[tokens], n)  # noqa: E731, B023
            held = ~np.array(left.column("train")[k].as_py(), bool)
            columns = [left.column("doc_ids")[k].values, pa.array(held), pa.array(counts.astype(np.int64) + 1), pa.array((total(known_word) + (ends > 0)).astype(np.int64)), pa.array(np.full(n, n_tokens, np.int64)), pa.array(total(base) + end_base), pa.array(total(lp) + end_score)]
            tables.append(pa.Table.from_arrays(columns, _OUT))
        return pa.concat_tables(tables) if tables else pa.Table.from_arrays([pa.array([], t) for t in _KINDS], _OUT)

    sides = blocks.select("block", "doc_ids", "train", "counts", "tokens").groupBy("block").cogroup(known.groupBy("of_block"))
    return sides.applyInArrow(summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def score_likelihood(docs: DataFrame, path: str) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 5 is not 1, score every row."""
    return score_documents(docs, path, bucket_of("doc_id", 5) != 1)
