"""What numpy holds at once doesn't grow with the slices whose entries are packed together."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cellgrain.llm import ngram_join, suffix_dedup


def batch(n_texts, size):
    letters = np.random.default_rng(3).integers(97, 123, (n_texts, size)).astype(np.uint8)
    letters[:, ::7] = 32
    texts = [row.tobytes().decode() for row in letters]
    return pa.RecordBatch.from_arrays([pa.array(range(n_texts), pa.int64()), pa.array(texts)], ["doc_id", "text"])


@pytest.mark.parametrize("work", [suffix_dedup._ranks(16), ngram_join._prefixes(16)])
def test_peak_of_two_slices(work):
    rows = batch(2000, 2048)
    tracemalloc.start()
    n = sum(b.num_rows for b in work([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 0 and peak < 75e6


def test_entries_of_small_pieces_are_packed_by_slice():
    rows = batch(1000, 2048)
    assert len(list(suffix_dedup._entries([rows.slice(k, 100) for k in range(0, 1000, 100)]))) == 1


def test_peak_of_what_is_left_of_a_bucket():
    texts = batch(4000, 2048)
    n = texts.num_rows
    columns = [pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()), texts.column(0), texts.column(1).cast(pa.binary()), *(pa.nulls(n, pa.binary()) for _ in "bc")]
    rows = pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "doc_id", "a", "b", "c"])
    work = suffix_dedup._removed(True)
    tracemalloc.start()
    found = sum(b.num_rows for b in work([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n and peak < 75e6
