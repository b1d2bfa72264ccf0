"""The quality model's fit holds no second copy of its rows."""

import tracemalloc

import numpy as np
from textloom.llm.quality import dual_coordinate_descent


def test_descent_takes_less_than_its_rows():
    rows = [np.arange(k, 40_000, 2, dtype=np.int32) for k in range(2)] * 100
    y = np.array([1, -1] * 100)
    tracemalloc.start()
    w = dual_coordinate_descent(rows, np.ones(40_000), y, 0.01, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w[0] > 0 > w[1]
    assert peak < sum(r.nbytes for r in rows) / 2
