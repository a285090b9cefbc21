"""Close names against difflib over all pairs."""

from __future__ import annotations

import difflib
import random

import pytest

from tessellum.operators.similar_names import close_names
from tessellum.operators.taxonomy import suggestions


def _plain(s):
    return s.lower().replace("-", " ").replace("_", " ").strip()


@pytest.mark.parametrize(("n", "least", "most_bytes"), [(3, 0.4, 1 << 20), (1, 0.75, 40)])
def test_close_names(spark, n, least, most_bytes):
    rnd = random.Random(2)
    names = ["".join(rnd.choice("abcde-_ ÀéZ") for _ in range(rnd.randint(0, 14))) for _ in range(300)] + ["room", "Room", "rooms", "r_o-om", "x" * 250 + "abc", None, "room"]
    values = ["room", "ROOMS", "abc de", " ", "", None, "éa-b", "x" * 250, "room"]
    got = {}
    for r in close_names(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(x,) for x in names], "name string").repartition(5), n=n, least=least, most_bytes=most_bytes).orderBy("value", "rank").collect():
        got.setdefault(r.value, []).append((r.name, round(r.ratio, 9)))
    want = {}
    for v in {v for v in values if v and _plain(v)}:
        scored = [(difflib.SequenceMatcher(None, _plain(v), _plain(x)).ratio(), x) for x in {x for x in names if x and _plain(x)}]
        best = [(x, round(s, 9)) for s, x in sorted(scored, key=lambda p: (-p[0], p[1])) if s >= least][:n]
        if best:
            want[v] = best
        assert n != 3 or [x for x, _ in best] == suggestions(v, sorted({x for x in names if x and _plain(x)}))
    assert got == want and len(want) >= 3
