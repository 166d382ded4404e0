"""Language profiles and the out-of-place distance against a plain version; texts without a letter."""

from collections import Counter

import numpy as np
import pytest

from cellgrain.llm import language_id


def plain_text(text):
    """Lower-case letters, one space for whatever else stands between them and at both ends."""
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    return f" {' '.join(words)} " if words else ""


def plain_profile(text, size):
    """The most frequent n-grams of 1 to 4 units, equal counts in code order."""
    units = np.frombuffer(plain_text(text).encode("utf-16-le"), np.uint16).tolist()
    grams = Counter(tuple(units[k : k + n]) for n in (1, 2, 3, 4) for k in range(len(units) - n + 1))
    grams.pop((32,), None)
    padded = {g + (0,) * (4 - len(g)): c for g, c in grams.items()}
    return sorted(padded, key=lambda g: (-padded[g], g))[:size]


def code(gram):
    return sum(u << s for u, s in zip(gram, (48, 32, 16, 0), strict=True))


TEXTS = ["the cat and the dog sat on the mat", "Der Hund und die Katze, der Baum.", "le chat et le chien sont là", "𐐀𐐁 letters beyond the plane 𐐨", "naïve café — 42 × ＡＢ", "x", "aaaa aaaa"]


@pytest.mark.parametrize("size", [5, 40, 300])
def test_out_of_place(size):
    profiles = {name: np.array([code(g) for g in plain_profile(t, size)], np.uint64) for name, t in zip("abc", TEXTS[:3], strict=True)}
    table = language_id.rank_table(profiles)
    for text in TEXTS:
        own = [code(g) for g in plain_profile(text, size)]
        assert own == language_id.ranked(*language_id.gram_counts(language_id.normalized(text)), size).tolist()
        mean = {}
        for name, codes in profiles.items():
            place = {c: k for k, c in enumerate(codes.tolist())}
            mean[name] = sum(abs(place[g] - k) if g in place else size for k, g in enumerate(own)) / len(own) / size
        best = min(mean, key=lambda name: (mean[name], name))
        lang, score = language_id.classify(text, *table, size)
        assert lang == best and abs(score - (1 - mean[best])) < 1e-12


def test_fitted_profiles(spark):
    rows = [(k, t, "abcdefg"[k % 3]) for k, t in enumerate(TEXTS * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language_id.fit_profiles(docs, docs["doc_id"] >= 0, size=50)
    for lang in "abc":
        grams = Counter()
        for _, t, name in rows:
            if name == lang:
                units = np.frombuffer(plain_text(t).encode("utf-16-le"), np.uint16).tolist()
                grams.update(code(tuple(units[k : k + n]) + (0,) * (4 - n)) for n in (1, 2, 3, 4) for k in range(len(units) - n + 1) if units[k : k + n] != [32])
        assert got[lang].tolist() == sorted(grams, key=lambda c: (-grams[c], c))[:50]


@pytest.mark.parametrize("text", ["😀😀", "12 345", "𝟘𝟙𝟚", "", None, " \n", "…!? 😀 7", "\U0001f600" * 5000])
def test_no_letter(text):
    table = language_id.rank_table({"a": np.array([1, 2], np.uint64)})
    assert language_id.classify(text, *table, 300) == ("und", 0.0)
