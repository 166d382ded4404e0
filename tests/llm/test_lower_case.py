"""Items are lower-cased as documents are, whichever way they are searched for."""

import pytest

from cellgrain.llm import decontamination


@pytest.mark.parametrize("item", ["Ο ΣΟΦΟΣ ΑΝΘΡΩΠΟΣ ΛΕΕΙ ΛΟΓΟΥΣ ΣΟΦΟΥΣ ΠΑΝΤΟΤΕ ΚΑΛΟΣ", "İKİ İNCE İP İLE İŞ İYİ İLERLER"])
def test_byte_for_byte_copies_are_found(spark, item):
    docs = spark.createDataFrame([(1, f"before it {item} and after"), (2, "nothing of that kind stands in here at all")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    for found in (decontamination.contaminated_pairs(docs, items), decontamination._joined(docs, items, decontamination.MATCH, decontamination.COVERAGE)):
        assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in found.collect()] == [(1, 7, 1.0)]
