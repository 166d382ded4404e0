"""Operators against brute-force versions on small random inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from cellgrain.llm import common, decontamination, embedding_dedup, language_id, lm_scoring, ngram_join, packing, quality_crf, suffix_dedup, token_counts, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r[0]: r[1] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    assert all(got.get(i, i) == u.find(i) for i in u.up)


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    boiler = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 25))] for _ in range(4)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] for _ in range(10)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            words = list(rng.choice(bases[:3]))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.8:
            words = rng.choice(boiler) + [rng.choice(vocabulary) for _ in range(rng.randint(0, 10))]
        elif kind < 0.95:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] + rng.choice(boiler)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 6))]
        yield i, " ".join(words)


@pytest.mark.parametrize("rare", [3, 32])
def test_jaccard(spark, rare):
    rows = list(near_copies(3, 500))
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), rare).collect()}
    sets = {i: shingles(t) for i, t in rows}
    u = Union(sets)
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                u.join(i, j)
    assert got == {i: (len(s), u.find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("cut", [False, True])
def test_repeats(spark, cut, monkeypatch):
    if cut:
        monkeypatch.setattr(suffix_dedup, "LONGEST", 300)
        monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    rng = random.Random(4 + cut)
    letters = "abcdefgh é\n"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(30, 300))) for _ in range(8)]
    rows = []
    for i in range(250):
        text = ""
        for _ in range(rng.randint(0, 4)):
            base, kind = rng.choice(bases), rng.random()
            at = rng.randrange(len(base))
            text += base[at : at + rng.randint(1, 150)] if kind < 0.5 else base if kind < 0.7 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) if kind < 0.9 else "ab " * rng.randint(1, 40)
        rows.append((i * 7 - 100, text))
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    first = {}
    for i, text in rows:
        raw = text.encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    for i, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert got[i] == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("leaf", [1024, 40])
def test_embeddings(spark, leaf):
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(6, 16))
        for _ in range(160):
            rows.append((len(rows) * 3 + 5, (centres[rng.integers(6)] + rng.normal(size=16) * rng.choice([0, 0.1, 0.25, 0.4])).astype(np.float32).tolist(), label))
    got = {r[0]: (r[1], r[2]) for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), values=16 * leaf).collect()}
    u, links = Union([r[0] for r in rows]), Counter()
    for k, (i, x, a) in enumerate(rows):
        for j, y, b in rows[:k]:
            x_, y_ = np.array(x, float), np.array(y, float)
            if a == b and x_ @ y_ / math.sqrt((x_ @ x_) * (y_ @ y_)) >= 0.93:
                links.update((i, j))
                u.join(i, j)
    assert got == {i: (links[i], u.find(i)) for i, _, _ in rows}


def test_token_counts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    machine = token_counts.Transducer(token_counts.load_pieces(PIECES), limit=2000)
    rng = random.Random(1)
    parts = [" ", "  ", "a", "the", "er", "ing", "\n", "é", "ß", "日", "😀", "<s>", "▁", "\t", "1", "99", "x", "q", ".", ",", "!!", "un", "   "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["ererer" * 300]
    expected = [len(sp.encode(t)) for t in texts]
    assert machine.count_texts(texts) == expected
    assert [machine.count_text(t, chunk=rng.randint(1, 9)) for t in texts] == expected


def test_likelihood(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "The", "of", "ing", "erand", f"x{rng.randrange(60)}"]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    got = {r["doc_id"]: r for r in lm_scoring.score_likelihood(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()}
    counts, ends = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(t.encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    for i, t in rows:
        words = t.encode().lower().split()
        assert got[i]["n_tokens"] == len(words) + 1 and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in words) + 1
        assert math.isclose(got[i]["base_score"], sum(base(counts[w]) for w in words) + base(ends), abs_tol=1e-6)
        assert got[i]["score"] < 0


def test_lattice_sums_all_segmentations():
    machine = lm_scoring.Lattice(PIECES)
    number = {p: k for k, p in enumerate(machine.pieces)}

    def total(text):
        return 1.0 if not text else sum(math.exp(machine.start[number[text[:k]]]) * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in number)

    for word in (b" there", b" x", b" \xc3\xa9t\xff"):
        got = machine.forward(np.frombuffer(word, np.uint8)[None, :], machine.start)[0, -1]
        assert math.isclose(got, math.log(total(word)), rel_tol=1e-9)


def test_language_profile_matches_plain_counts():
    text = "The cat, the CAT!"
    codes, counts = language_id.gram_counts(language_id.normalized(text))
    plain = Counter()
    clean = " the cat the cat "
    for n in (1, 2, 3, 4):
        for k in range(len(clean) - n + 1):
            plain[clean[k : k + n]] += 1
    del plain[" "]
    # n-grams that run past the end are kept at their full length only
    decoded = {"".join(chr(int(c) >> s & 0xFFFF) for s in (48, 32, 16, 0) if int(c) >> s & 0xFFFF): int(m) for c, m in zip(codes, counts, strict=True)}
    assert decoded == plain


def test_language_parts_agree(monkeypatch):
    units = language_id.normalized("some words of a long text " * 40)
    whole = language_id.gram_counts(units)
    monkeypatch.setattr(language_id, "PART", 100)
    parts = language_id.gram_counts(units)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


@pytest.mark.parametrize(("score", "label", "least"), [(toxicity.score_toxicity, "toxic", 0.9), (quality_crf.score_quality, "quality", 0.97)])
def test_classifier_held_out(spark, score, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r[label] for r in rows) >= least * len(rows)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    unary, trans = rng.normal(size=4), rng.normal(size=(2, 2))
    weights = defaultdict(float)
    for state in np.ndindex(2, 2, 2, 2):
        weights[state] = math.exp(sum(unary[k] * s for k, s in enumerate(state)) + sum(trans[a, b] for a, b in zip(state[:-1], state[1:], strict=True)))
    z = sum(weights.values())
    got = quality_crf.marginals(np.r_[unary, unary[:1]], trans, np.array([0, 4, 5]))
    assert np.allclose(got[:4], [sum(w for s, w in weights.items() if s[k]) / z for k in range(4)])
    assert np.isclose(got[4], 1 / (1 + math.exp(-unary[0])))


def test_tiles_cover_reordered_passages():
    item = np.arange(1, 41, dtype=np.uint64)
    text = np.concatenate([item[20:40], [900, 901], item[0:18], [902]]).astype(np.uint64)
    assert decontamination.tile(item, text, 5) == [(20, 0, 20), (0, 22, 18)]
    assert decontamination.tile(item, item[::-1].copy(), 5) == []


def test_leaks_by_join_and_by_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(12)]
    rows = []
    for i in range(80):
        text = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if i % 4 == 0:
            own = rng.choice(items)[1].split()
            own = own[15:] + own[:15] if i % 8 else own[:13]
            text[5:5] = own
        rows.append((i, " ".join(text).upper() + "."))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontamination.contaminated_pairs(docs, bench).collect()))
    assert {r[0] for r in one} == {i for i in range(0, 80, 4) if i % 8}
    monkeypatch.setattr(decontamination, "BROADCAST_TOKENS", 1)
    assert sorted(map(tuple, decontamination.contaminated_pairs(docs, bench).collect())) == one


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.2}])
def test_packing(spark, weights):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "substr('aaaabbc', 1 + cast(doc_id % 7 as int), 1) as source")
    rows = packing.pack(docs, WORDS, length=256, sequences=8, weights=weights).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {r["doc_id"]: tokenizer.encode(r["text"], add_special_tokens=False).ids + [1] for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, parts in by_doc.items():
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1]) and sum(n for _, n in parts) == len(ids[i])
    assert len(by_doc) == len(ids)
    last = max(by_sequence)
    for k, parts in by_sequence.items():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1])
        assert k == last or sum(n for _, n in parts) == 256
    # every window but those after a queue has run dry holds the target proportions to a token
    share, window = defaultdict(Counter), Counter()
    for r in rows:
        share[r["window_id"]][r["source"]] += r["length"]
        window[r["window_id"]] += r["length"]
    total = Counter()
    for r in rows:
        total[r["source"]] += r["length"]
    goal = {s: (total[s] / sum(total.values()) if weights is None else weights[s]) for s in total}
    first = share[0]
    assert all(abs(first[s] - goal[s] * window[0]) <= 2 for s in goal)
