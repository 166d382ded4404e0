"""Every stage of the pipeline against a brute-force version, on a small table with odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from cellgrain.llm import language_id
from tests.llm.test_brute_force import Union, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra array<int>"
WORDS = {"en": "the cat and dog sat on mat with house river tree under over green small".split(), "de": "der hund und die katze saß auf dem baum mit haus fluss unter grün klein".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    items = [(k, prose(rng, "en", 60)) for k in range(3)]
    shared = prose(rng, "de", 30)
    texts = [prose(rng, rng.choice(["en", "de"]), rng.randint(20, 90)) for _ in range(60)]
    texts += [t if rng.random() < 0.5 else t + " " + rng.choice(WORDS["en"]) for t in texts[:15]]
    texts += [prose(rng, "de", 20) + " " + shared + " " + prose(rng, "de", 20) for _ in range(4)]
    texts += [prose(rng, "en", 10) + " " + items[1][1] + " " + prose(rng, "en", 10), None, "", "😀 12 345", "… !!", "short one here"]
    docs = [(3 * k + 1, t, "de" if t and "und" in t else "en", f"src{k % 3}" if k % 7 else None, len(t or ""), [k]) for k, t in enumerate(texts)]
    docs += [docs[2], (docs[5][0], "another text under the same id, the cat and dog sat on mat", "en", "src1", 3, None), (None, texts[3] + " and more", "en", "src0", 1, [1])]
    return docs, items


@pytest.fixture(scope="module")
def stages(spark, rows, tmp_path_factory):
    docs, items = rows
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {"documents": docs}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(folder)).write.parquet(f"{folder}/{name}.parquet")
        frame = spark.read.parquet(f"{folder}/{name}.parquet")
        out[name] = [tuple(r) for r in frame.collect()]
    out["run"] = corpus_pipeline.run(spark, str(folder)).count()
    return out


def key(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


def test_language_stage(spark, rows, stages):
    docs = spark.createDataFrame(rows[0], SCHEMA)
    train = [r for r in rows[0] if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 0]
    profiles = language_id.fit_profiles(docs.join(spark.createDataFrame([(r[0],) for r in train], "doc_id long").distinct(), "doc_id"), docs["doc_id"] == docs["doc_id"])
    table = language_id.rank_table(profiles)
    expected = [r for r in rows[0] if (got := language_id.classify(r[1], *table, 300))[0] != "und" and got[1] >= 0.1]
    assert sorted(stages["language_id"], key=key) == sorted(expected, key=key)
    assert not {"", None, "😀 12 345", "… !!"} & {r[1] for r in stages["language_id"]}


def test_near_duplicate_stage(stages):
    before = [r for r in stages["language_id"] if r[0] is not None]
    sets = {k: shingles(r[1]) for k, r in enumerate(before)}
    u = Union(sets)
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                u.join(i, j)
    smallest = {}
    for k, r in enumerate(before):
        smallest[u.find(k)] = min(smallest.get(u.find(k), r[0]), r[0])
    component = {}
    for k, r in enumerate(before):
        component[r[0]] = min(component.get(r[0], r[0]), smallest[u.find(k)])
    expected = {i: min(r[1] for r in before if r[0] == i) for i in component if component[i] == i}
    assert {r[0]: r[1] for r in stages["near_duplicates"]} == expected and len(stages["near_duplicates"]) == len(expected)


def test_passage_stage(stages):
    before = sorted(stages["near_duplicates"])
    first = {}
    for r in before:
        raw = r[1].encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], r[0])
    expected = {}
    for r in before:
        raw = r[1].encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < r[0]:
                gone[p : p + 50] = True
        expected[r[0]] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode(errors="ignore")
    got = {r[0]: r[1] for r in stages["repeated_passages"]}
    assert got == expected and sum(len(expected[r[0]]) < len(r[1]) for r in before) >= 3


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def test_benchmark_stage(rows, stages):
    """What left holds most words of an item in a row; what stayed holds no long stretch of one."""
    kept = {r[0] for r in stages["decontamination"]}
    for r in stages["repeated_passages"]:
        words, most = tokens(r[1]), 0.0
        for _, item in rows[1]:
            goal = tokens(item)
            grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
            covered = np.zeros(len(goal), bool)
            for k in range(len(goal) - 4):
                if tuple(goal[k : k + 5]) in grams:
                    covered[k : k + 5] = True
            most = max(most, covered.mean())
        assert (r[0] in kept) == (most < 0.5), (r[0], most)
    assert len(kept) == len(stages["repeated_passages"]) - 1


def test_packing_stage(stages):
    import tokenizers
    from public_tokenizers import path

    machine = tokenizers.Tokenizer.from_file(path("word_bpe_49k.json"))
    pieces = {}
    for r in sorted(stages["packing"]):
        pieces.setdefault(r[0], []).append(r)
    used = {}
    assert pieces.keys() == {r[0] for r in stages["decontamination"]}
    for doc_id, text, *_ in stages["decontamination"]:
        ids = np.array([*machine.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for _, start, length, crc, total, sequence, offset, *_ in sorted(pieces[doc_id], key=lambda p: p[1]):
            assert start == at and total == len(ids) and zlib.crc32(ids[start : start + length].tobytes()) == crc
            used.setdefault(sequence, []).append((offset, length))
            at += length
        assert at == len(ids)
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert stages["run"] == len(stages["packing"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some benchmark item of a few words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
