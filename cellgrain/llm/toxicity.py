"""Toxicity: subword-bag embeddings averaged into a linear softmax.

Every character n-gram (n = 3..5 over lower-cased bytes, white space as one
edge byte) has an embedding; a document is the average of its n-grams'
embeddings, and a linear softmax over two classes sits on top.  Embeddings and
softmax are trained together in numpy.  A misspelled word keeps most of its
n-grams, so it shares their vectors.

An average over a whole long text would bury one hostile sentence, so the
average is taken over windows of `WINDOW` bytes (half overlapping) and the
document takes its most toxic window; training uses the same rule, the window
being chosen again in each epoch.

At scoring time softmax(W . mean(E[g])) needs only the one number
(W1 - W0) . E[g] for each n-gram, so tasks get one float for each bucket: 4 MB
for any corpus.

Defined results: null or empty text and text shorter than an n-gram score the
bias alone (the prior of the training sample, below 0.5 unless most labels are
toxic); without two classes among the training labels every document scores
the share of the one class seen (0 without any).  Labels other than 0 and 1
don't count, of several labels of an id the highest does, and rows without an
id are left out.  Repeated rows are scored one by one; of equally toxic windows
the first counts; a very long text is scored whole, window by window; an empty
table gives no rows; columns beyond doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, IS_SPACE, bucket_of, crc_mod, doc_slices, flat_utf8, texts_of

BITS = 20
SIZES = (3, 4, 5)
WINDOW = 512
#: Bound on labelled documents used for fitting, of each class.
SAMPLE = 1500

_FOLD = LOWER.copy()
_FOLD[IS_SPACE] = 32


def gram_buckets(data: np.ndarray):
    """For each n, the bucket of the n-gram that starts at each byte (n - 1 fewer than bytes)."""
    b = _FOLD[data].astype(np.uint32)
    h = b + np.uint32(1)
    for n in range(2, SIZES[-1] + 1):
        if len(b) < n:
            return
        h = h[:-1] * np.uint32(16777619) + b[n - 1 :] + np.uint32(1)
        if n in SIZES:
            x = (h ^ np.uint32(n * 40503)) * np.uint32(2654435761)
            yield n, ((x ^ (x >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - BITS)


def window_bounds(length: int) -> np.ndarray:
    """Start and end of the windows of a text of `length` bytes, half overlapping, the last one whole."""
    if length <= WINDOW:
        return np.array([[0, length]])
    starts = np.arange(0, length - WINDOW // 2, WINDOW // 2)
    starts[-1] = length - WINDOW
    return np.stack([starts, starts + WINDOW], axis=1)


def window_scores(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each text data[offsets[k]:offsets[k+1]], the highest mean of the table over the n-grams of one window."""
    windows = [window_bounds(int(n)) for n in np.diff(offsets)]
    first = np.r_[0, np.cumsum([len(w) for w in windows])][:-1]
    bounds = np.concatenate(windows) + np.repeat(offsets[:-1], [len(w) for w in windows])[:, None]
    total, count = np.zeros(len(bounds)), np.zeros(len(bounds))
    for n, buckets in gram_buckets(data):
        sums = np.zeros(len(buckets) + 1)
        np.cumsum(table[buckets], dtype=np.float64, out=sums[1:])
        lo = np.minimum(bounds[:, 0], len(buckets))
        hi = np.clip(bounds[:, 1] - n + 1, lo, len(buckets))
        total += sums[hi] - sums[lo]
        count += hi - lo
    return np.maximum.reduceat(total / np.maximum(count, 1), first)


def fit(texts: list[bytes], labels: np.ndarray, dim: int = 8, epochs: int = 12, keep: int = 1 << 12, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """(table, bias, prior): score = sigmoid(max window mean of table + bias).

    Buckets seen in fewer than three documents carry nothing to other texts and
    get no vector; of the rest the `keep` whose document frequencies differ most
    between the classes are embedded.
    """
    labels = np.asarray(labels, np.float64)
    table = np.zeros(1 << BITS, np.float32)
    prior = float(labels.mean()) if len(labels) else 0.0
    if len(set(labels.tolist())) < 2:
        return table, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), prior
    df = np.zeros((2, 1 << BITS), np.int32)
    for text, y in zip(texts, labels, strict=True):
        data = np.frombuffer(text, np.uint8)
        grams = [g for _, g in gram_buckets(data)]
        if grams:
            df[int(y), np.unique(np.concatenate(grams))] += 1
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    p = (df[0] + df[1]) / (n0 + n1)
    z = (df[1] / n1 - df[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1))
    z[df.sum(axis=0) < 3] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:keep]
    chosen = np.sort(chosen[np.abs(z[chosen]) > 2])
    slot = np.full(1 << BITS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    rows = []  # each window of each document: slots, count of all n-grams
    doc_of = []
    for k, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        grams = list(gram_buckets(data))
        for lo, hi in window_bounds(len(data)):
            got = [slot[g[lo : max(lo, hi - n + 1)]] for n, g in grams]
            got = np.concatenate(got) if got else np.zeros(0, np.int32)
            rows.append((got[got >= 0], max(1, len(got))))
            doc_of.append(k)
    doc_of = np.array(doc_of)
    first = np.flatnonzero(np.r_[True, doc_of[1:] != doc_of[:-1]])
    ends = np.r_[first[1:], len(doc_of)]
    length = np.array([len(r[0]) for r in rows])
    flat = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int32)
    at = np.r_[0, np.cumsum(length)]
    total = np.array([r[1] for r in rows], np.float64)
    rng = np.random.default_rng(seed)
    sign = np.sign(z[chosen])
    emb = rng.normal(0, 0.05, (len(chosen), dim)) + 0.3 * sign[:, None] * np.ones(dim) / dim
    out = np.ones(dim) * 2.0
    bias = -1.0
    state = [np.zeros_like(emb), np.zeros_like(out), 0.0]
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0) * len(labels)
    scale = float(np.mean(total)) ** 0.5
    for _ in range(epochs):
        per = emb @ out
        sums = np.r_[0, np.cumsum(per[flat])]
        value = (sums[at[1:]] - sums[at[:-1]]) / total * scale
        best = np.array([lo + int(value[lo:hi].argmax()) for lo, hi in zip(first, ends, strict=True)])
        order = rng.permutation(len(best))
        for lo in range(0, len(order), 64):
            docs = order[lo : lo + 64]
            rows_at = best[docs]
            idx = np.concatenate([flat[at[r] : at[r + 1]] for r in rows_at]) if len(rows_at) else flat[:0]
            seg = np.repeat(np.arange(len(docs)), length[rows_at])
            w = (scale / total[rows_at])[seg]
            mean = np.zeros((len(docs), dim))
            np.add.at(mean, seg, emb[idx] * w[:, None])
            p1 = 1 / (1 + np.exp(-np.clip(mean @ out + bias, -30, 30)))
            err = (p1 - labels[docs]) * weight[docs] / len(docs)
            g_out, g_bias = mean.T @ err + 1e-4 * out, err.sum()
            uniq, inv = np.unique(idx, return_inverse=True)
            coef = np.bincount(inv, err[seg] * w, len(uniq))
            g_emb = coef[:, None] * out[None, :] + 1e-5 * emb[uniq]
            state[0][uniq] += g_emb**2
            state[1] += g_out**2
            state[2] += g_bias**2
            emb[uniq] -= 0.08 * g_emb / (np.sqrt(state[0][uniq]) + 1e-8)
            out -= 0.05 * g_out / (np.sqrt(state[1]) + 1e-8)
            bias -= 0.1 * g_bias / (np.sqrt(state[2]) + 1e-8)
    table[chosen] = (emb @ out) * scale
    return table, float(bias), prior


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int = 3, held: int = 1) -> DataFrame:
    """At most about `per_class` labelled rows of each class (text, y), picked by a hash of their id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    marks = marks.where(bucket_of("doc_id", modulus) != held).groupBy("doc_id").agg(F.max("y").alias("y"))
    marks = marks.withColumn("h", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)))
    n = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = F.when(F.col("y") == 1, F.lit(per_class * (1 << 30) // max(1, n.get(1, 1)))).otherwise(F.lit(per_class * (1 << 30) // max(1, n.get(0, 1))))
    picked = marks.where(F.col("h") < cut).select("doc_id", "y")
    # at most about 2 * per_class ids, whatever the input: broadcasting them saves shuffling all texts
    return texts_of(docs).join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")


def score_documents(docs: DataFrame, table: np.ndarray, bias: float, modulus: int = 3, held: int = 1, cut: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of `docs` with an id; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        weights = shared.value
        for batch in batches:
            ids, (data, offsets) = batch.column(0), flat_utf8(batch.column(1))
            best = np.empty(len(offsets) - 1)
            for lo, hi in doc_slices(offsets):
                at = offsets[lo : hi + 1]
                best[lo:hi] = window_scores(data[at[0] : at[-1]], at - at[0], weights)
            score = 1 / (1 + np.exp(-np.clip(best + bias, -40, 40)))
            held_out = crc_mod(ids.to_pylist(), modulus) == held
            yield pa.RecordBatch.from_arrays([ids, pa.array(held_out, pa.bool_()), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts_of(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """Fit on labelled rows whose crc32(doc_id) mod 3 is not 1 (at most `per_class` of each class), score every row."""
    sample = training_sample(docs, labels, "toxic", per_class).orderBy("doc_id").collect()
    table, bias, _ = fit([r["text"].encode("utf-8", "surrogatepass") for r in sample], np.array([r["y"] for r in sample], float))
    return score_documents(docs, table, bias)
