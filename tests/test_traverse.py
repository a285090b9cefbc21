"""The walk over shared wings against pairs of rooms, and its cost."""

from __future__ import annotations

import random
import re

from tessellum.operators import graph


def _walk(rooms, start, hops=2):
    seen, last = {start: (0, [])}, [start]
    for hop in range(1, hops + 1):
        fresh = {}
        for parent in sorted(last, reverse=True):  # the first parent stays
            for room, wings in rooms.items():
                if room not in seen and wings & rooms[parent]:
                    fresh[room] = (hop, sorted(wings & rooms[parent]))
        seen |= fresh
        last = list(fresh)
    return seen


def test_walk_equals_pairs_of_rooms(spark):
    rnd = random.Random(3)
    rooms = {f"r{k}": {f"w{rnd.randrange(25)}" for _ in range(rnd.randrange(1, 4))} for k in range(60)}
    df = spark.createDataFrame([(r, sorted(w), [], 1, []) for r, w in rooms.items()], "room string, wings array<string>, halls array<string>, count long, dates array<string>")
    got = {r.room: (r.hop, r.connected_via) for r in graph.traverse(df, "r3", limit=100).collect()}
    assert got == _walk(rooms, "r3") and {h for h, _ in got.values()} == {0, 1, 2}


def test_walk_makes_no_pairs_of_rooms(spark):
    """2,000 rooms of one wing: pairs of the frontier and the rooms behind it would be a million rows."""
    rooms = spark.range(2000).selectExpr("concat('a', id) AS room", "CASE WHEN id = 0 THEN array('x') WHEN id <= 1000 THEN array('x', 'y') ELSE array('y') END AS wings", "array('') AS halls", "1L AS count", "array('') AS dates")
    plan = graph.traverse(rooms, "a0")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count() == 50 and not re.search(r"Aggregate \[room#\d+L?, parent#\d+L?\]", text)
