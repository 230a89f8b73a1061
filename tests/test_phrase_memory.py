"""A batch of texts is not turned into Python strings as a whole."""

import tracemalloc

import pyarrow as pa

from quillrank.functions import phrases


def test_a_batch_is_searched_in_slices():
    texts = pa.array(["food " + "x" * 20_000 + f" bank{i % 2}" for i in range(1000)] + [None, ""])
    tracemalloc.start()
    got = phrases.search(texts, ("food", "bank1", "")).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [[0, 2] if i % 2 == 0 else [0, 1, 2] for i in range(1000)] + [[], [2]]
    assert peak < 5_000_000
