"""Arrow batches are taken apart in short runs."""

from __future__ import annotations

import pyarrow as pa

from tessellum.operators.chunking import slices


def test_slices_keep_all_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in [(0, 5), (5, 5), (5, 12)]]
    cut = list(slices(batches, 3))
    assert [x for b in cut for x in b.column("x").to_pylist()] == list(range(12)) and max(b.num_rows for b in cut) == 3
