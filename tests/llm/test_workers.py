from __future__ import annotations

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from tickloom.llm import nbest
from tickloom.llm.workers import tidy


def resident_mb():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def test_a_task_leaves_no_free_memory_behind():
    pinned = []

    def apply(batches):
        # pieces below malloc's limit for mapped memory, and one that stays above them
        many = [np.ones(12_500) for _ in range(2000)]
        pinned.append(np.ones(12_500))
        for batch in batches:
            yield batch
        del many

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["x"])
    before = resident_mb()
    assert list(tidy(apply)(iter([batch, batch]))) == [batch, batch]
    assert resident_mb() - before < 100             # of 200


def test_memory_of_many_new_words_is_bounded():
    """Words are solved in blocks: beside what is kept of them, a task needs a few MB."""
    solver = nbest.Solver(nbest.Pieces.read())
    for i in range(25_000):
        solver.number[f"{nbest.SPACE}{i:011d}"]
    tracemalloc.start()
    try:
        solver.solve()
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(solver.words) == 25_000 and peak - kept < 30e6
