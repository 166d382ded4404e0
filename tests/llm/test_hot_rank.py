"""A phrase that stands between varying text in most documents is not compared in one task."""

import random

import numpy as np

from cellgrain.llm import suffix_dedup


def test_hot_ranks_are_compared_as_rows(spark, monkeypatch):
    rng, letters = random.Random(41), "abcdefghijklmnop "
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    phrase, tails = "All rights reserved, whoever holds them.", [noise(30) for _ in range(6)]
    rows = [(i, noise(60) + phrase + (rng.choice(tails) if rng.random() < 0.5 else "") + noise(60)) for i in range(300)]
    first = {}
    for i, text in rows:
        for p in range(len(text) - 49):
            first.setdefault(text[p : p + 50], i)
    expected = {}
    for i, text in rows:
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - 49):
            if first[text[p : p + 50]] < i:
                gone[p : p + 50] = True
        expected[i] = int(gone.sum())

    def bounded(n_docs, most):
        compare = suffix_dedup_compare(n_docs, most)

        def run(batches):
            for batch in batches:
                for ranks in batch.column(1).to_pylist():
                    assert np.unique(np.frombuffer(ranks, np.uint64), return_counts=True)[1].max() <= 20
                yield from compare(iter([batch]))

        return run

    suffix_dedup_compare = suffix_dedup._compare
    monkeypatch.setattr(suffix_dedup, "_compare", bounded)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs, most=20).collect()}
    assert got == expected and sum(got.values()) > 0
    monkeypatch.undo()
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()} == expected
