"""Texts are searched for names in short runs, whatever the batches."""

from __future__ import annotations

import pyarrow as pa

from tessellum.operators import registry


def test_names_are_looked_for_in_short_runs():
    texts = [None if i % 7 == 0 else f"Ann {i} met Bob" if i % 2 else "nobody" for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(3000)), "_scanned": texts})
    got = list(registry._hits([batch], ["ann", "bob", "carl"], ["id"], True))
    assert max(b.num_rows for b in got) <= 256
    rows = [x for b in got for x in b.to_pylist()]
    assert rows == [{"id": i, "_forms": ["ann", "bob"]} for i in range(3000) if i % 2 and i % 7]
