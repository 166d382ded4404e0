"""Language identification by rank-order profiles (out-of-place distance).

A profile is the list of the most frequent character n-grams (n = 1..4) of a
text, most frequent first, ties in code order.  A document's profile is held
against each language's: every n-gram of the document costs the difference of
its two ranks, or the whole profile length where the language lacks it.  The
language with the smallest mean cost wins; equal costs go to the
alphabetically first language.

Text is lower-cased; everything that is no letter becomes one space, runs of
spaces collapse, so n-grams see word edges.  A letter is what Unicode calls one,
in the basic plane and beyond it; those beyond count as two units.

Defined results: null text or text without a letter -> ``und`` with score 0;
no usable training row -> ``und`` for every document; rows without an id are left
out; columns beyond those named are ignored; repeated rows are scored one by one;
equal distances (ties) go to the first language by name; an empty table gives no
rows; texts of any length are taken whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, crc_mod, released

PROFILE = 300
#: Characters whose n-grams are counted at one time; longer texts are counted in parts that overlap.
PART = 1 << 18
#: Up to so many distinct languages their sampling rates are broadcast.
MANY_LANGUAGES = 10_000


def _letter_table() -> np.ndarray:
    """Each UTF-16 unit: its lower-case letter, or a space; halves of code points beyond the basic plane stay."""
    table = np.full(1 << 16, 32, np.uint16)
    table[0xD800:0xE000] = np.arange(0xD800, 0xE000)
    for c in range(1 << 16):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []
_BEYOND = re.compile("[\ud800-\udfff\U00010000-\U0010ffff]")


def _letters_beyond(text: str) -> str:
    """Text whose code points beyond the basic plane are lower-case letters or spaces; halves that stand alone are spaces."""
    return _BEYOND.sub(lambda m: m[0].lower() if m[0].isalpha() else " ", text)


def normalized(text: str | None) -> np.ndarray:
    """UTF-16 units of the letters in lower case, one space between words and at both ends; empty without a letter."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    units = np.frombuffer((" " + (text or "") + " ").encode("utf-16-le", "surrogatepass"), np.uint16)
    if ((units & 0xF800) == 0xD800).any():
        units = np.frombuffer((" " + _letters_beyond(text) + " ").encode("utf-16-le"), np.uint16)
    units = _TABLE[0][units]
    keep = units != 32
    keep[1:] |= keep[:-1]
    keep[0] = True
    units = units[keep]
    return units if len(units) > 1 else units[:0]


def gram_counts(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (four 16-bit units, high first, 0 where the n-gram is shorter) and counts, by code.

    The lone space is no n-gram.
    """
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(units), PART):
        u = units[at : at + PART + 3].astype(np.uint64)
        n = min(PART, len(units) - at)
        grams, wide = [], u << np.uint64(48)
        grams.append(wide[:n])
        for k, shift in ((1, 32), (2, 16), (3, 0)):
            wide = wide[: len(u) - k] | (u[k:] << np.uint64(shift))
            grams.append(wide[:n])
        part = np.sort(np.concatenate(grams))
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        codes = np.concatenate([codes, part[first]])
        counts = np.concatenate([counts, np.diff(np.r_[first, len(part)])])
        if at:
            codes, at_code = np.unique(codes, return_inverse=True)
            counts = np.bincount(at_code, counts).astype(np.int64)
    real = codes != np.uint64(32 << 48)
    return codes[real], counts[real]


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent codes, most frequent first, equal counts by code."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:size]]


def _train_counts(batches):
    """Task side of training: n-gram counts by language over the rows of one partition."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes, counts = gram_counts(normalized(text))
            parts = held.setdefault(lang, [])
            parts.append((codes, counts))
            if sum(len(c) for c, _ in parts) > 500_000:
                held[lang] = [_merged(parts)]
    for lang, parts in held.items():
        codes, counts = _merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "code", "n"])


def _merged(parts):
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def fit_profiles(docs: DataFrame, train, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 1500, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language profiles from at most about `per_language` rows of each language.

    `train` is a Boolean column.  The sample is the rows with the smallest
    values of a hash of their id, so it doesn't depend on partitioning.  The
    result is `size` codes for each language: a bounded table for any input.
    """
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 30)).alias("h"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    cut = sizes.select("lang", (F.lit(float(per_language << 30)) / F.col("n")).alias("cut"))
    # one row for each language: sent to all tasks while that stays small, so that texts aren't shuffled before the cut
    cut = F.broadcast(cut) if cut.count() <= MANY_LANGUAGES else cut
    sample = rows.join(cut, "lang").where("h < cut").select("lang", "text")
    counts = sample.mapInArrow(released(_train_counts), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the most frequent codes of each part of a language, then of the language: sorts that can spill, at most 64 * size rows at the end
    order = [F.col("n").desc(), F.col("code") < 0, "code"]  # codes are unsigned
    first = counts.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(64))).withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("k") <= size)
    best = first.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= size)
    profiles = {}
    for row in best.orderBy("lang", "k").select("lang", "code").collect():
        profiles.setdefault(row["lang"], []).append(row["code"])
    return {lang: np.array(codes, np.int64).view(np.uint64) for lang, codes in profiles.items()}


def classify(text: str | None, langs: list[str], union: np.ndarray, ranks: np.ndarray, size: int) -> tuple[str, float]:
    """Language and score of one text against the tables made by `rank_table`."""
    units = normalized(text)
    if not len(units) or not len(langs):
        return "und", 0.0
    own = ranked(*gram_counts(units), size)
    at = np.minimum(np.searchsorted(union, own), len(union) - 1)
    known = union[at] == own
    cost = np.abs(ranks[at] - np.arange(len(own))[:, None])
    cost[ranks[at] < 0] = size
    cost[~known] = size
    mean = cost.mean(axis=0) / size
    best = int(mean.argmin())
    return langs[best], float(min(1.0, max(0.0, 1.0 - mean[best])))


def rank_table(profiles: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    langs = list(profiles)
    union = np.unique(np.concatenate(list(profiles.values()))) if langs else np.zeros(0, np.uint64)
    ranks = np.full((len(union), len(langs)), -1, np.int32)
    for k, codes in enumerate(profiles.values()):
        ranks[np.searchsorted(union, codes), k] = np.arange(len(codes))
    return langs, union, ranks


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", doc_id: str = "doc_id", size: int = PROFILE, modulus: int = 5, held: int = 0) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of `docs` with an id; no shuffle."""
    langs, union, ranks = rank_table(profiles)

    def score(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            got = [classify(t.as_py(), langs, union, ranks, size) for t in texts]
            held_out = crc_mod(ids.to_pylist(), modulus) == held
            yield pa.RecordBatch.from_arrays([ids, pa.array(held_out, pa.bool_()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(score), "doc_id long, held_out boolean, lang_pred string, score double")


def identify_language(docs: DataFrame, per_language: int = 1500) -> DataFrame:
    """Fit on rows whose crc32(doc_id) mod 5 is not 0, then predict every row."""
    profiles = fit_profiles(docs, bucket_of("doc_id", 5) != 0, per_language=per_language)
    return predict(docs, profiles)


def keep_identified(docs: DataFrame, profiles: dict[str, np.ndarray], least: float = 0.1, size: int = PROFILE) -> DataFrame:
    """The rows of `docs`, all columns, with a language and a score of at least `least`; no shuffle.

    Without any profile (no labelled row) nothing can be rejected for being
    unlike one: then only texts without a letter go.
    """
    langs, union, ranks = rank_table(profiles)
    text_at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        for batch in batches:
            keep = []
            for text in batch.column(text_at):
                if langs:
                    lang, score = classify(text.as_py(), langs, union, ranks, size)
                    keep.append(lang != "und" and score >= least)
                else:
                    keep.append(len(normalized(text.as_py())) > 0)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(released(run), schema)
