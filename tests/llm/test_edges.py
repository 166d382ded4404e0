"""Odd inputs: nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cellgrain.llm import decontamination, embedding_dedup, language_id, lm_scoring, ngram_join, packing, quality_crf, suffix_dedup, token_counts, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet consectetur " * 4000 + "x" * 30000

ROWS = [
    (1, None, "en", "s"),
    (2, "", "en", None),
    (3, "   \n\t ", None, "s"),
    (4, LONG, "en", "s"),
    (5, "the quick brown fox jumps over the lazy dog", "en", "s"),
    (6, "the quick brown fox jumps over the lazy dog", "en", "t"),
    (6, "the quick brown fox jumps over the lazy dog", "en", "t"),
    (7, "12345 !!! ???", None, None),
    (8, "日本語 😀 naïve\x00\n\n\nline", "ja", "s"),
    (9, "one", "de", "u"),
    (None, "a row without an id", "en", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for name in ("n", "sid", "key", "bucket", "queue", "score", "block", "label", "y", "h", "kind", "a", "b", "n_chars"):
        df = df.withColumn(name, F.lit(7))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 0, 1), (5, 1, 0), (6, None, 1), (8, 1, 0), (None, 1, 1), (99, 0, 0), (4, 7, 7)], "doc_id long, quality int, toxic int")


IDS = sorted(r[0] for r in ROWS if r[0] is not None)


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_likelihood(docs, none):
    rows = lm_scoring.score_likelihood(docs, PIECES).collect()
    assert ids(rows) == IDS
    empty = next(r for r in rows if r["doc_id"] == 1)
    assert empty["n_tokens"] == 1 and empty["score"] < 0
    assert lm_scoring.score_likelihood(none, PIECES).count() == 0
    untrained = lm_scoring.score_documents(docs, PIECES, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 for r in untrained)


def test_token_counts(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts.count_tokens(docs, PIECES).collect()
    assert ids(rows) == IDS
    text = {r[0]: r[1] or "" for r in ROWS}
    assert all(r["n_tokens"] == len(sp.encode(text[r["doc_id"]])) and r["n_bytes"] == len(text[r["doc_id"]].encode()) for r in rows)
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_classifiers(docs, none, labels):
    for score in (toxicity.score_toxicity, quality_crf.score_quality):
        rows = score(docs, labels).collect()
        assert ids(rows) == IDS and all(0 <= r["score"] <= 1 for r in rows)
        assert score(none, labels).count() == 0
        unlabelled = score(docs, labels.where("false")).collect()
        assert ids(unlabelled) == IDS and len({r["score"] for r in unlabelled}) == 1


def test_language(docs, none):
    rows = {r["doc_id"]: r for r in language_id.identify_language(docs).collect()}
    assert sorted(rows) == sorted(set(IDS))
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (1, 2, 3, 7))
    assert language_id.identify_language(none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.keep_identified(docs, {})
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, 4, 5, 6, 8, 9}


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "The quick, brown FOX jumps over the lazy dog!"), (1, "The quick, brown FOX jumps over the lazy dog!"), (2, None), (3, ""), (4, "too short"), (None, "lorem ipsum dolor sit amet")], "item_id long, text string")
    got = decontamination.contaminated_pairs(docs, items).collect()
    assert sorted(r["doc_id"] for r in got) == [5, 5, 6, 6, 6, 6] and {r["item_id"] for r in got} == {1}
    assert decontamination.contaminated_pairs(none, items).count() == 0
    assert decontamination.contaminated_pairs(docs, items.where("false")).count() == 0
    clean = decontamination.clean_documents(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {None, 1, 2, 3, 4, 7, 8, 9}


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [0.0, 0.0], 0), (5, None, 0), (6, [1.0, None], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0, 0.0], 0), (9, [float("nan"), 1.0], 0), (10, [], 0), (10, [1.0, 0.0], 1), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("n", F.lit(1))
    got = embedding_dedup.link_vectors(df)
    out = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect())
    assert out[:3] == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]
    assert all(r[1] == 0 and r[3] for r in out[3:]) and len(out) == 11
    assert embedding_dedup.link_vectors(df.where("false")).count() == 0


def test_repeats(docs, none):
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert ids(rows) == IDS
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] < 5)  # a text's own repetition stays
    assert suffix_dedup.remove_repeats(none).count() == 0
    kept = suffix_dedup.without_repeats(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert kept.columns == docs.columns and kept.count() == len(set(IDS))


def test_jaccard(docs, none):
    rows = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs).collect()}
    assert rows[1]["n_shingles"] == rows[3]["n_shingles"] == 0 and rows[1]["component_id"] == 1
    assert rows[5]["n_shingles"] == 5 and rows[6]["component_id"] == 5 and rows[9]["n_shingles"] == 1
    assert ngram_join.jaccard_components(docs).count() == len(IDS)
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8, 9]


def test_packing(docs, none):
    rows = packing.pack(docs, WORDS, length=16, sequences=4).collect()
    assert sorted({r["doc_id"] for r in rows}) == sorted(set(IDS))
    assert [r["doc_tokens"] for r in rows if r["doc_id"] == 1] == [1]
    assert packing.pack(none, WORDS).count() == 0
