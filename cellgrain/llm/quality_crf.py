"""Document quality from a linear-chain CRF over lines.

Each line gets a feature vector (character classes, word shape, repetition)
joined with those of the lines before and after it.  A two-state linear-chain
CRF labels every line good or bad; training takes each line's label from its
document's (distant supervision) and maximises the conditional likelihood in
numpy.  A document's quality is the mean of its lines' marginals P(good),
weighted by line length, passed through a one-variable logistic calibration
fitted on the same sample.

Defined results: null or empty text is one empty line and is scored as such;
lines are split at LF only; without two classes among the training labels every
document scores the share of the one class seen (0.5 without any).  Rows without
an id are left out; repeated rows are scored one by one; a very long text is
scored whole, line by line; an empty table gives no rows; columns beyond doc_id
and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, crc_mod, doc_slices, flat_utf8, group_sums, powers, texts_of, token_hashes, words_of
from .toxicity import training_sample

#: Bound on labelled documents used for fitting, of each class.
SAMPLE = 2000

_CLASSES = np.zeros((6, 256), bool)
_CLASSES[0, 65:91] = True  # upper case
_CLASSES[1, 97:123] = True  # lower case
_CLASSES[2, 48:58] = True  # digits
_CLASSES[3, [33, 35, 36, 37, 38, 42, 60, 62, 64, 92, 94, 95, 123, 124, 125, 126]] = True  # symbols
_CLASSES[4, [44, 46, 58, 59, 63]] = True  # prose punctuation
_CLASSES[5] = IS_SPACE
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_WORD = ~IS_SPACE
OWN = 15
FEATURES = 3 * OWN + 2


def line_features(data: np.ndarray, offsets: np.ndarray):
    """(features [lines x FEATURES], line lengths in bytes, line bounds of each document)."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a line starts at each document's start and after each LF; an LF that ends a document opens an empty last line
    doc_of = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((np.concatenate([offsets[:-1], breaks + 1]), doc_of))
    doc_of = doc_of[order]
    starts = np.concatenate([offsets[:-1], breaks + 1])[order]
    bounds = np.searchsorted(doc_of, np.arange(n_docs + 1))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[bounds[1:] - 1] = offsets[1:]
    length = (ends - starts).astype(np.float64)
    whole = np.maximum(length, 1)
    cols = []
    for table in (*_CLASSES, _HIGH):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        cols.append((sums[ends] - sums[starts]) / whole)
    ws, we, _ = words_of(data, _WORD, offsets)
    line_of = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    bounds_w = np.r_[line_of[0], line_of[1][-1:]]
    n_words = (line_of[1] - line_of[0]).astype(np.float64)
    hashes = token_hashes(data, ws, we)
    same = np.zeros(len(ws))
    same[1:] = hashes[1:] == hashes[:-1]
    tail = data[we - 1] if len(we) else np.zeros(0, np.uint8)
    per_word = np.maximum(n_words, 1)
    cols.append(length / per_word / 10)
    cols.append(group_sums(same, bounds_w) / per_word)
    cols.append(group_sums(_CLASSES[3][tail].astype(float), bounds_w) / per_word)
    cols.append(group_sums(((we - ws) == 1).astype(float), bounds_w) / per_word)
    cols.append(np.log1p(length) / 5)
    cols.append((n_words == 0).astype(float))
    cols.append((n_words < 4).astype(float))
    key = np.stack([doc_of.astype(np.uint64), token_hashes(data, starts, ends)], axis=1)
    _, first, back = np.unique(key, axis=0, return_index=True, return_inverse=True) if len(key) < 50 else _unique_pairs(key)
    cols.append((np.arange(len(starts)) != first[back.ravel()]).astype(float))
    own = np.stack(cols, axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    before[bounds[:-1]] = 0
    after[:-1] = own[1:]
    after[bounds[1:] - 1] = 0
    opens, closes = np.zeros(len(own)), np.zeros(len(own))
    opens[bounds[:-1]] = 1
    closes[bounds[1:] - 1] = 1
    return np.concatenate([own, before, after, opens[:, None], closes[:, None]], axis=1), length, bounds


def _unique_pairs(key: np.ndarray):
    """np.unique over (document, hash) pairs through one mixed key: same first positions, faster than rows."""
    one = key[:, 1] ^ (key[:, 0] * powers(2, 0x9E3779B97F4A7C15)[1])
    return np.unique(one, return_index=True, return_inverse=True)


def _steps(bounds: np.ndarray):
    """Documents ordered by falling line count, and for each step the number of documents that still have a line."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    alive = len(n) - np.searchsorted(np.sort(n), np.arange(n.max(initial=0)), side="right")
    return order, alive


def marginals(unary: np.ndarray, trans: np.ndarray, bounds: np.ndarray, pairs: bool = False):
    """P(good) of each line, and with `pairs` the expected transition counts and the log partition function.

    `unary` is the score of good over bad; `trans[i, j]` scores state i followed by j.
    All documents run in step; documents that have ended drop out.
    """
    order, alive = _steps(bounds)
    starts = bounds[:-1][order]
    n_lines = np.diff(bounds)[order]
    fwd = np.zeros((len(unary), 2))
    norm = np.zeros(len(unary))
    score = np.stack([np.zeros(len(unary)), unary], axis=1)
    for t, k in enumerate(alive):
        at = starts[:k] + t
        if t == 0:
            cur = score[at]
        else:
            prev = fwd[at - 1]
            cur = score[at] + np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
        z = np.logaddexp(cur[:, 0], cur[:, 1])
        fwd[at] = cur - z[:, None]
        norm[at] = z
    bwd = np.zeros((len(unary), 2))
    expected = np.zeros((2, 2))
    for t in range(len(alive) - 2, -1, -1):
        k = alive[t + 1]
        at = starts[:k] + t
        nxt = bwd[at + 1] + score[at + 1] - norm[at + 1][:, None]
        for i in (0, 1):
            bwd[at, i] = np.logaddexp(trans[i, 0] + nxt[:, 0], trans[i, 1] + nxt[:, 1])
        if pairs:
            for i in (0, 1):
                for j in (0, 1):
                    expected[i, j] += np.exp(fwd[at, i] + trans[i, j] + nxt[:, j]).sum()
    del n_lines
    good = np.exp(fwd[:, 1] + bwd[:, 1])
    bad = np.exp(fwd[:, 0] + bwd[:, 0])
    good = good / np.maximum(good + bad, 1e-300)
    return (good, expected, norm.sum()) if pairs else good


def aggregate(good: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each document's lines."""
    weight = length + 1
    return group_sums(good * weight, bounds) / group_sums(weight, bounds)


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 120, prior: float | None = None) -> dict:
    """CRF weights, transitions, scaling and calibration, by full-batch gradient ascent with Adagrad steps."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return {"const": float(labels.mean()) if len(labels) else 0.5}
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    x, length, bounds = line_features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    mean, std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = (x - mean) / std
    y = np.repeat(labels, np.diff(bounds)).astype(float)
    inside = np.ones(len(y), bool)
    inside[bounds[1:] - 1] = False
    here, there = np.flatnonzero(inside), np.flatnonzero(inside) + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[here].astype(int), y[there].astype(int)), 1)
    w, bias, trans = np.zeros(FEATURES), 0.0, np.zeros((2, 2))
    state = np.full(FEATURES + 5, 1e-8)
    for _ in range(rounds):
        good, expected, _ = marginals(x @ w + bias, trans, bounds, pairs=True)
        err = y - good
        grad = np.concatenate([x.T @ err / len(y) - 1e-3 * w, [err.mean()], ((seen - expected) / len(y) - 1e-2 * trans).ravel()])
        state += grad**2
        step = 0.3 * grad / np.sqrt(state)
        w, bias, trans = w + step[:FEATURES], bias + step[FEATURES], trans + step[FEATURES + 1 :].reshape(2, 2)
    value = _logit(aggregate(marginals(x @ w + bias, trans, bounds), length, bounds))
    share = labels.mean() if prior is None else prior
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a weighted logistic regression
        p = 1 / (1 + np.exp(-(a * value + b)))
        g = np.array([(weight * (labels - p) * value).sum() - 1e-2 * (a - 1), (weight * (labels - p)).sum() - 1e-3 * b])
        r = weight * p * (1 - p)
        h = np.array([[(r * value**2).sum() + 1e-2, (r * value).sum()], [(r * value).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    return {"w": w, "bias": bias, "trans": trans, "mean": mean, "std": std, "a": float(a), "b": float(b)}


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def score_flat(data: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    if "const" in model:
        return np.full(len(offsets) - 1, model["const"])
    x, length, bounds = line_features(data, offsets)
    good = marginals(((x - model["mean"]) / model["std"]) @ model["w"] + model["bias"], model["trans"], bounds)
    return 1 / (1 + np.exp(-(model["a"] * _logit(aggregate(good, length, bounds)) + model["b"])))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, modulus: int = 3, held: int = 1, cut: float = 0.5) -> DataFrame:
    """Fit on labelled rows whose crc32(doc_id) mod 3 is not 1 (at most `per_class` of each class), score every row.

    Rows (doc_id, held_out, score, predicted) for every row of `docs` with an id; scoring has no shuffle.
    """
    sample = training_sample(docs, labels, "quality", per_class, modulus, held).orderBy("doc_id").collect()
    share = labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held)).agg(F.avg("quality").alias("p")).first()["p"]
    model = fit([r["text"].encode("utf-8", "surrogatepass") for r in sample], np.array([r["y"] for r in sample], int), prior=share)

    def run(batches):
        for batch in batches:
            ids, (data, offsets) = batch.column(0), flat_utf8(batch.column(1))
            score = np.empty(len(offsets) - 1)
            for lo, hi in doc_slices(offsets):
                at = offsets[lo : hi + 1]
                score[lo:hi] = score_flat(data[at[0] : at[-1]], at - at[0], model)
            held_out = crc_mod(ids.to_pylist(), modulus) == held
            yield pa.RecordBatch.from_arrays([ids, pa.array(held_out, pa.bool_()), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts_of(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
