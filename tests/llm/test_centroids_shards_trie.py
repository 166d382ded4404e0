"""Operators 11 to 13 against brute force and SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrain.llm import ball_kmeans, histogram_sort, prefix_trie, queries
from conftest import DATA


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op13_prefix_trie"])
def test_sql(spark, name):
    got = queries.queries()[name](spark, DATA)
    duck = duckdb.connect()
    for t in ("embeddings", "conversations"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rows = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(got.columns)
    expected = rows.fetchall()
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(expected) and expected


def lloyd(rows, k, rounds, scale):
    """rows: (id, list of components that are all usable)."""
    x = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows]
    seeds = sorted(x, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(v) for _, v in seeds]
    at = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for step in range(rounds + 1):
        own = [at(v) for _, v in x]
        if step < rounds:
            for j in range(len(cents)):
                members = [v for (_, v), (_, o) in zip(x, own, strict=True) if o == j]
                if members:
                    cents[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    return Counter((i, o[1], o[0]) for (i, _), o in zip(x, own, strict=True)), cents


def test_ball_kmeans_equals_lloyd(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-3, 3) for _ in range(4)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in centres[rng.randrange(5)]]) for i in range(300)]
    rows += [(300 + i, [1.0, 0.0, -1.0, 0.5]) for i in range(150)] + [(450, [0.0] * 4), (450, [2.0] * 4), (450, [2.0] * 4)]
    odd = [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan")] * 4), (503, [float("inf")] * 4), (504, [1.0] * 3), (505, []), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit(9), "distance": F.lit("x"), "v": F.lit(0)}).repartition(3)
    got, found = ball_kmeans.cluster_vectors(df, clusters=7, rounds=4, dims=4, scale=16)
    expected, cents = lloyd(rows, 7, 4, 16)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == expected
    assert [c["centroid"] for c in found] == cents and sum(c["n"] for c in found) == len(rows)


def test_ball_kmeans_compares_few(spark):
    """Well separated clusters keep their cores: about one distance a vector."""
    rng = np.random.default_rng(3)
    cents = np.arange(16)[:, None] * 100 + np.zeros((16, 8), np.int64)
    own = rng.integers(0, 16, 2000)
    x = cents[own] + rng.integers(-3, 4, (2000, 8))
    near = ball_kmeans.neighbours(cents.tolist(), [400] * 16)
    at, best, met = ball_kmeans.reassign(x, own, cents, near)
    assert (at == own).all() and met == 2000 and (best == ball_kmeans.nearest(x, cents)[1]).all()


def test_ball_kmeans_random_reassignment(spark):
    rng = np.random.default_rng(4)
    for _ in range(30):
        cents = rng.integers(-6, 7, (9, 3))
        x = rng.integers(-8, 9, (200, 3))
        own = rng.integers(0, 9, 200)
        radii = [int(ball_kmeans.squared(x[own == j], cents[j]).max()) if (own == j).any() else None for j in range(9)]
        at, best, _ = ball_kmeans.reassign(x, own, cents, ball_kmeans.neighbours(cents.tolist(), radii))
        assert (at == ball_kmeans.nearest(x, cents)[0]).all() and (best == ball_kmeans.nearest(x, cents)[1]).all()


def test_ball_kmeans_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64, None), (2, [0.25] * 64, 3)], "vec_id long, embedding array<float>, label int")
    assert {(r["vec_id"], r["distance"], r["inertia"]) for r in ball_kmeans.cluster_table(df).collect()} == {(1, 0, 0), (2, 0, 0)}
    empty = ball_kmeans.cluster_table(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def shards_hold(rows, texts, shards, slack):
    """Every row once; slots without gaps; shards in the order of ids; bytes within `slack` of equal."""
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    by = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by[r["shard"]].append(r)
    low = float("-inf")
    for s in sorted(by):
        own = sorted(by[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        for r in own:
            now = -(1 << 63) if r["doc_id"] is None else r["doc_id"]
            assert now >= low
            low = now
    share = sum(r["size"] for r in rows) / shards
    assert all(abs(sum(r["size"] for r in by[s]) - share) <= slack for s in range(shards))


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    shards_hold(histogram_sort.shard_table(docs).collect(), texts, 24, max(len((t or "").encode()) for _, t in texts) + 8)


@pytest.mark.parametrize("cells", [4 * 6, 200, 1 << 16])
def test_shards_of_hot_and_odd_keys(spark, cells):
    rng = random.Random(1)
    ids = [7] * 400 + [None] * 30 + [-(1 << 63), (1 << 63) - 1, (1 << 63) - 1] + [rng.randrange(-1 << 40, 1 << 40) for _ in range(500)] + [12] * 300
    rows = [(i, rng.choice([None, "", "é" * rng.randrange(40), "x" * rng.randrange(60)])) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_block": F.lit(1), "shard": F.lit("s"), "key": F.lit(2)}).repartition(4)
    out = histogram_sort.shard_documents(df, 6, block_bytes=2000, cells=cells)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_block", "key", "shard", "slot"]) and {r["_block"] for r in out.collect()} == {1}
    table = out.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).alias("grown_shard"))
    shards_hold(table.collect(), rows, 6, 100)


def test_shards_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a" * 5000), (2, "b"), (2, "b")], "doc_id long, text string")
    rows = histogram_sort.shard_table(df).collect()
    assert len(rows) == 3 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert histogram_sort.shard_table(df.where("false")).count() == 0
    assert "Exchange" not in histogram_sort.shard_documents(df)._jdf.queryExecution().executedPlan().toString().replace("Exchange shufflepartitionidpassthrough", "")


def test_shards_as_files(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("z"), F.col("id").cast("int")).alias("text"))
    histogram_sort.write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={k}" for k in range(5)]


def trie_by_hand(paths):
    """paths: {conv: [(role, text)]} -> {(member, depth): row}."""
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[d, tuple(turns[:d])].append(c)
    out = {}
    for (d, path), own in members.items():
        below = [(e, q, m) for (e, q), m in members.items() if e >= d and q[:d] == path]
        childless = sum(not any(f == e + 1 and r[:e] == q for f, r in members) for e, q, _ in below)
        ends = ",".join(map(str, sorted(c for c in own if len(paths[c]) == d)))
        out[min(own), d] = (min(members[d - 1, path[:-1]]) if d else None, len(own), sum(e == d + 1 for e, _, _ in below), childless, sum((len(m) - 1) * len(q[-1][1].encode()) for e, q, m in below if e), hashlib.sha256(ends.encode()).hexdigest())
    return out


def ordered(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    return {c: [(r[2], r[4]) for r in sorted(v)] for c, v in convs.items()}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def random_turns(seed, convs, most):
    rng = random.Random(seed)
    texts = ["hi", "hello there", "é", "", None, "long " * 40]
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, most)):
            role, text = (rng.choice(["user", "assistant", None]), rng.choice(texts)) if rng.random() < 0.4 else ("user", "same")
            rows += [(c, t if rng.random() < 0.9 else None, role, text)] * rng.choice([1, 1, 1, 2])
    return [*rows, (None, 1, "user", "no id")]


@pytest.mark.parametrize(("seed", "convs", "most"), [(1, range(40), 9), (2, [3, 4, 9, 11, 22, 23, 25], 20), (3, [1003], 3)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, convs, most):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 2)
    rows = random_turns(seed, convs, most)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"name": F.lit(1), "part": F.lit(2), "n": F.lit("x"), "depth": F.lit(3)}).repartition(5)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = prefix_trie.rebuilt_trie(df)
    assert {(r[0], r[1]): tuple(r)[2:] for r in got.select(*columns).collect()} == trie_by_hand(rebuild(ordered(rows)))


def test_trie_of_conversations_as_they_are(spark):
    rows = random_turns(4, range(30), 7)
    df, paths = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(2), ordered(rows)
    got = prefix_trie.prefix_trie(df).cache()
    assert {(r[0], r[1]): tuple(r)[2:] for r in got.drop("role", "text").collect()} == trie_by_hand(paths)
    last = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in got.collect()}
    assert all((paths[c][d - 1] if d else (None, None)) == turn for (c, d), turn in last.items())


def test_trie_of_copies_and_nothing(spark):
    copies = spark.range(3000).select((F.col("id") + 5).alias("conv_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("turn"), F.lit("user").alias("role"), F.lit("again").alias("text"))
    rows = prefix_trie.prefix_trie(copies).orderBy("depth").collect()
    ids = hashlib.sha256(",".join(str(c) for c in range(5, 3005)).encode()).hexdigest()
    assert [(r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in rows] == [(5, 3000, 1, 1, 3 * 2999 * 5), (5, 3000, 1, 1, 3 * 2999 * 5), (5, 3000, 1, 1, 2 * 2999 * 5), (5, 3000, 0, 1, 2999 * 5)]
    assert rows[3]["ends_sha256"] == ids and rows[0]["ends_sha256"] == prefix_trie.NO_IDS
    assert prefix_trie.rebuilt_trie(copies.where("false")).count() == 0


def test_one_very_long_conversation(spark):
    long = spark.range(100).select(F.lit(8).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), (F.col("id") % 3).cast("string").alias("text"))
    nodes = prefix_trie.prefix_trie(long).collect()
    assert sorted(r["depth"] for r in nodes) == list(range(101)) and all(r["n_convs"] == 1 and r["saved_tokens"] == 0 for r in nodes)
