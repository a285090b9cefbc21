"""The graph of rooms that share wings: nodes, edges, walks, tunnels, figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.operators.lineage import settled


def nodes(chunks: DataFrame) -> DataFrame:
    """``(room, wings, halls, count, dates)``: sorted sets, the five latest dates; rooms '' and general and wing '' don't count."""
    rows = chunks.filter((F.coalesce(F.col("room"), F.lit("")) != "") & (F.col("room") != "general") & (F.coalesce(F.col("wing"), F.lit("")) != ""))
    dates = F.sort_array(F.collect_set(F.when(F.col("date") != "", F.col("date"))))
    return rows.groupBy("room").agg(
        F.sort_array(F.collect_set("wing")).alias("wings"),
        F.sort_array(F.collect_set(F.when(F.col("hall") != "", F.col("hall")))).alias("halls"),
        F.count("*").alias("count"),
        F.slice(dates, F.greatest(F.size(dates) - 4, F.lit(1)), 5).alias("dates"),
    )


def edges(room_nodes: DataFrame) -> DataFrame:
    """``(room, wing_a, wing_b, hall, count)`` with wing_a < wing_b, for each hall of a room in several wings."""
    halls = room_nodes.filter((F.size("wings") >= 2) & (F.size("halls") >= 1)).select("room", "wings", "count", F.explode("halls").alias("hall"))
    first = halls.select("room", "hall", "count", "wings", F.posexplode("wings").alias("at", "wing_a"))
    later = first.withColumn("rest", F.slice("wings", F.col("at") + 2, F.greatest(F.size("wings") - F.col("at") - 1, F.lit(0))))
    return later.select("room", "wing_a", F.explode("rest").alias("wing_b"), "hall", "count")


def traverse(room_nodes: DataFrame, start: str, max_hops: int = 2, limit: int = 50) -> DataFrame:
    """``(room, wings, halls, count, hop, connected_via)`` of rooms reached over shared wings, breadth first.

    A hop joins each wing's first room of the frontier to the wing's rooms and drops the rooms seen before, so it grows with
    the memberships and not with pairs of rooms; connected_via comes from the first parent in order of its room's name: it
    is the first one of each wing that a room shares with it. The nearest come first, then the fullest, then by name.
    """
    member = room_nodes.select("room", F.explode("wings").alias("wing"))
    empty = F.array().cast("array<string>")
    found = room_nodes.filter(F.col("room") == start).select("room", F.lit(0).alias("hop"), empty.alias("connected_via"))
    frontier = found.select("room")
    for hop in range(1, max_hops + 1):
        first = member.join(frontier, "room", "left_semi").groupBy("wing").agg(F.min("room").alias("parent"))
        reach = member.join(found.select("room"), "room", "left_anti").join(first, "wing")
        shared = reach.groupBy("room").agg(F.min("parent").alias("parent"), F.collect_set(F.struct("wing", "parent")).alias("w"))
        via = F.sort_array(F.transform(F.filter("w", lambda x: x["parent"] == F.col("parent")), lambda x: x["wing"]))
        step = settled(shared.select("room", F.lit(hop).alias("hop"), via.alias("connected_via")))
        found, frontier = found.union(step), step.select("room")
    return room_nodes.join(found, "room").select("room", "wings", "halls", "count", "hop", "connected_via").orderBy("hop", F.desc("count"), "room").limit(limit)


def tunnels(room_nodes: DataFrame, wing_a: str | None = None, wing_b: str | None = None, limit: int = 50) -> DataFrame:
    """Rooms in several wings (in these, where given): ``(room, wings, halls, count, recent)``, fullest first."""
    rows = room_nodes.filter(F.size("wings") >= 2)
    for wing in (wing_a, wing_b):
        if wing:
            rows = rows.filter(F.array_contains("wings", wing))
    recent = F.when(F.size("dates") > 0, F.element_at("dates", -1)).otherwise("")
    return rows.select("room", "wings", "halls", "count", recent.alias("recent")).orderBy(F.desc("count"), "room").limit(limit)


def stats(room_nodes: DataFrame) -> DataFrame:
    """total_rooms, tunnel_rooms, total_edges, each from one pass over the nodes."""
    w, h = F.size("wings"), F.size("halls")
    return room_nodes.agg(
        F.count("*").alias("total_rooms"),
        F.coalesce(F.sum(F.when(w >= 2, 1).otherwise(0)), F.lit(0)).alias("tunnel_rooms"),
        F.coalesce(F.sum(F.expr("bigint(size(wings)) * (size(wings) - 1) div 2 * size(halls)")), F.lit(0)).alias("total_edges"),
    )


def rooms_per_wing(room_nodes: DataFrame) -> DataFrame:
    return room_nodes.select(F.explode("wings").alias("wing")).groupBy("wing").agg(F.count("*").alias("rooms"))


def top_tunnels(room_nodes: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` rooms of most wings, of which those in a single wing are then dropped."""
    return room_nodes.orderBy(F.desc(F.size("wings")), "room").limit(n).filter(F.size("wings") >= 2).select("room", "wings", "count")


def fuzzy_rooms(room_nodes: DataFrame, query: str, n: int = 5) -> DataFrame:
    """Rooms that hold the query (1.0) or one of its dash-parted words (0.5)."""
    q = query.lower()
    words = F.lit(False)
    for word in q.split("-"):
        words = words | F.col("room").contains(word)
    score = F.when(F.col("room").contains(q), 1.0).when(words, 0.5)
    return room_nodes.select("room", score.alias("score")).filter("score IS NOT NULL").orderBy(F.desc("score"), "room").limit(n)
