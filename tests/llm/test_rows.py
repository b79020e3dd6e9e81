"""What a step of the corpus operators leaves in its worker."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pytest

from wiregrain.llm import rows


def held() -> float:
    """MB of this process without mapped files."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024


def fragmented(batches):
    """60 MB of small arrays are freed, one after every 100 stays: the allocator can not shrink by itself."""
    arrays = [np.ones(2500) for _ in range(3000)]
    kept.extend(arrays[99::100])
    del arrays
    yield from batches


kept: list[np.ndarray] = []


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="Linux only")
def test_freed_memory_goes_back_when_a_task_ends():
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    rows.give_back()
    before = held()
    assert list(rows.released(fragmented)(iter([batch]))) == [batch]
    assert held() - before < 15
