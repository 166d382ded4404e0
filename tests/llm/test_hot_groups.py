"""One large group of copies, one line that all carry, chains of links: results equal brute force."""

import random

import pytest

from cellgrain.llm import common, ngram_join
from tests.llm.test_brute_force import Union, shingles


def test_components_in_rounds(spark):
    """A chain, a star and random links, contracted in rounds down to five links."""
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(400)] + [(5000, 6000 + i) for i in range(200)] + [(rng.randrange(9000, 9600), rng.randrange(9000, 9600)) for _ in range(350)]
    rng.shuffle(edges)
    links = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r[0]: r[1] for r in common.connected_components(links, one_task=5).collect()}
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    assert {i: got.get(i, i) for i in u.up} == {i: u.find(i) for i in u.up}


def hot_group(seed, n):
    """Copies of one text at growing distance, edited copies of these, and others under one line that all carry."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    line = "a line that every document of this table carries".split()
    base = [rng.choice(vocabulary) for _ in range(90)]
    made = []
    for i in range(n):
        if rng.random() < 0.75:
            words = list(rng.choice(made[-30:]) if made and rng.random() < 0.3 else base)
            for _ in range(rng.randint(0, 7)):
                at = rng.randrange(len(words))
                words[at : at + 1] = [] if rng.random() < 0.5 else [rng.choice(vocabulary[:40])]
            made.append(words)
        else:
            words = line + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        yield i, " ".join(words)


@pytest.mark.parametrize("rare", [2, 32])
def test_hot_group(spark, rare):
    rows = list(hot_group(11, 700))
    got = {r[0]: r[2] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rare).collect()}
    sets = {i: shingles(t) for i, t in rows}
    u = Union(sets)
    linked = 0
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                u.join(i, j)
                linked += 1
    assert linked > 700 and len({u.find(i) for i in sets}) > 100
    assert got == {i: u.find(i) for i in sets}


def test_hot_vector(spark):
    """A third of the vectors in one dense cluster, copies, a chain of links and a label of several nodes."""
    import numpy as np

    from cellgrain.llm import embedding_dedup

    rng = np.random.default_rng(5)
    hot = rng.normal(size=8)
    rows = [(int(i), (hot + 0.12 * rng.normal(size=8)).tolist(), "a") for i in range(500)]
    rows += [(1000 + i, hot.tolist(), "a") for i in range(40)]
    angle = 0.37
    rows += [(2000 + i, [float(np.cos(angle * i)), float(np.sin(angle * i)), *[0.0] * 6], "a") for i in range(17)]
    rows += [(3000 + i, rng.normal(size=8).tolist(), "b" if i % 2 else "a") for i in range(600)]
    order = rng.permutation(len(rows))
    frame = spark.createDataFrame([rows[k] for k in order], "vec_id long, embedding array<float>, label string").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_vectors(frame, values=8 * 150).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    u = Union([r[0] for r in rows])
    for i, j in np.argwhere(near):
        u.join(rows[i][0], rows[j][0])
    assert near.sum() > 200_000
    assert got == {r[0]: (int(near[k].sum()) - 1, u.find(r[0])) for k, r in enumerate(rows)}
