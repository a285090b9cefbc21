"""Facts, rooms and types over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.operators import code_graph, graph, kg
from tessellum.plans.registry import register
from tessellum.plans.views import ROOM_ROWS, SPARSE_ROOMS, TRIPLES, TYPE_FACTS, entities, room_rows, sparse_rooms, table, triples, type_facts

#: The window rule as SQL: a date starts at midnight and ends at 23:59:59.
_IN = "({t}.valid_from IS NULL OR {at} >= CAST({t}.valid_from AS TIMESTAMP)) AND ({t}.valid_to IS NULL OR {at} <= CAST({t}.valid_to AS TIMESTAMP) + INTERVAL '23:59:59')"
_FACT = "t.predicate, t.valid_from, t.valid_to, t.confidence, t.valid_to IS NULL AS current"


def _out(where: str = "TRUE") -> str:
    return f"SELECT 'outgoing' AS direction, 'User 7' AS subject, {_FACT}, e.name AS object FROM triples t JOIN entities e ON t.object = e.id WHERE t.subject = 'user_7' AND {where}"


@register("kg_entity_outgoing", f"WITH {TRIPLES} {_out()}")
def kg_entity_outgoing(spark, sf):
    return kg.query_entity(triples(spark, sf), entities(spark, sf), "User 7")


@register("kg_as_of", f"WITH {TRIPLES} {_out(_IN.format(t='t', at=chr(39).join(['TIMESTAMP ', '2024-02-15 00:00:00', ''])))}")
def kg_as_of(spark, sf):
    return kg.query_entity(triples(spark, sf), entities(spark, sf), "User 7", as_of="2024-02-15")


@register(
    "kg_entity_both",
    f"WITH {TRIPLES} SELECT 'outgoing' AS direction, 'Nation 3' AS subject, {_FACT}, e.name AS object FROM triples t JOIN entities e ON t.object = e.id WHERE t.subject = 'nation_3' "
    f"UNION ALL SELECT 'incoming', e.name, {_FACT}, 'Nation 3' FROM triples t JOIN entities e ON t.subject = e.id WHERE t.object = 'nation_3'",
)
def kg_entity_both(spark, sf):
    return kg.query_entity(triples(spark, sf), entities(spark, sf), "Nation 3", direction="both")


@register("kg_relationship", f"WITH {TRIPLES} SELECT s.name AS subject, t.predicate, o.name AS object, t.valid_from, t.valid_to, t.valid_to IS NULL AS current FROM triples t JOIN entities s ON t.subject = s.id JOIN entities o ON t.object = o.id WHERE t.predicate = 'lives_in'")
def kg_relationship(spark, sf):
    return kg.query_relationship(triples(spark, sf), entities(spark, sf), "lives in")


@register(
    "kg_range_as_of_join",
    f"WITH {TRIPLES}, m AS (SELECT user_id, subject, moment FROM (SELECT user_id, 'user_' || user_id AS subject, date_trunc('day', max(ts)) - INTERVAL 20 DAY AS moment FROM events GROUP BY user_id)) SELECT m.user_id, t.id, t.object FROM m JOIN triples t ON m.subject = t.subject WHERE {_IN.format(t='t', at="m.moment")}",
)
def kg_range_as_of_join(spark, sf):
    moments = table(spark, sf, "events").groupBy("user_id").agg((F.date_trunc("day", F.max("ts")).cast("timestamp") - F.expr("INTERVAL 20 DAY")).alias("at"))
    moments = moments.select("user_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("who"), "at")
    return kg.as_of_join(moments, triples(spark, sf), "who").select("user_id", "id", "object")


@register("kg_timeline_top100", f"WITH {TRIPLES} SELECT t.id, s.name AS subject, t.predicate, o.name AS object, t.valid_from, t.valid_to, t.valid_to IS NULL AS current FROM triples t JOIN entities s ON t.subject = s.id JOIN entities o ON t.object = o.id ORDER BY t.valid_from ASC NULLS LAST, t.id LIMIT 100")
def kg_timeline_top100(spark, sf):
    return kg.timeline(triples(spark, sf), entities(spark, sf))


@register("kg_stats", f"WITH {TRIPLES} SELECT (SELECT count(*) FROM entities) AS entities, count(*) AS triples, count(*) FILTER (valid_to IS NULL) AS current_facts, count(*) FILTER (valid_to IS NOT NULL) AS expired_facts, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates FROM triples")
def kg_stats(spark, sf):
    return kg.stats(triples(spark, sf), entities(spark, sf))


@register(
    "kg_dedupe_open",
    f"WITH {TRIPLES}, stored AS (SELECT * FROM triples WHERE hash_no % 2 = 0), incoming AS (SELECT * FROM triples) SELECT id, subject, object FROM stored".replace("hash_no % 2 = 0", "length(id) % 2 = 0").split(", incoming")[0]
    + ", fresh AS (SELECT t.* FROM triples t WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.subject = t.subject AND s.predicate = t.predicate AND s.object = t.object AND s.valid_to IS NULL)), "
    "held AS (SELECT *, coalesce(max(CASE WHEN valid_to IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY subject, predicate, object ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM fresh) "
    "SELECT id, subject, object FROM stored UNION ALL SELECT id, subject, object FROM held WHERE h = 0",
)
def kg_dedupe_open(spark, sf):
    t = triples(spark, sf)
    return kg.add_triples(t.filter("length(id) % 2 = 0"), t).select("id", "subject", "object")


@register("kg_invalidate", f"WITH {TRIPLES} SELECT id, CASE WHEN valid_to IS NULL AND (source_file = '/log/3' OR starts_with(source_file, '/log/3/')) AND predicate = 'did' AND (valid_from IS NULL OR valid_from <= '2024-02-01') THEN '2024-02-01' ELSE valid_to END AS valid_to FROM triples")
def kg_invalidate(spark, sf):
    hit = kg.under_root(F.col("source_file"), "/log/3") & (F.col("predicate") == "did")
    return kg.invalidate(triples(spark, sf), hit, "2024-02-01").select("id", "valid_to")


@register(
    "type_descendants",
    f"WITH RECURSIVE {TYPE_FACTS}, walk(type, depth) AS (SELECT 't1', 0 UNION SELECT f.subject, w.depth + 1 FROM walk w JOIN type_facts f ON f.object = w.type WHERE f.valid_to IS NULL AND w.depth < 3), d AS (SELECT type, min(depth) AS depth FROM walk WHERE type <> 't1' GROUP BY type) SELECT d.type, d.depth, f.predicate AS relationship FROM d JOIN type_facts f ON f.subject = d.type",
)
def type_descendants(spark, sf):
    return kg.type_chain(type_facts(spark, sf), "t1", 3, upward=False)


@register(
    "type_ancestors",
    f"WITH RECURSIVE {TYPE_FACTS}, walk(type, relationship, depth) AS (SELECT 't101', '', 0 UNION SELECT f.object, f.predicate, w.depth + 1 FROM walk w JOIN type_facts f ON f.subject = w.type WHERE f.valid_to IS NULL AND w.depth < 5) SELECT type, relationship, depth FROM walk WHERE depth > 0",
)
def type_ancestors(spark, sf):
    return kg.type_chain(type_facts(spark, sf), "t101", 5)


_NODES = "nodes AS (SELECT room, list_sort(list(DISTINCT wing)) AS wings, coalesce(list_sort(list(DISTINCT hall) FILTER (hall <> '')), []) AS halls, count(*) AS count, list_sort(list(DISTINCT date) FILTER (date <> '')) AS dates FROM room_rows WHERE room <> '' AND room <> 'general' AND wing <> '' GROUP BY room)"


@register("room_graph_nodes", f"WITH {ROOM_ROWS}, {_NODES} SELECT room, array_to_string(wings, ',') AS wings, array_to_string(halls, ',') AS halls, count, array_to_string(dates[-5:], ',') AS dates FROM nodes")
def room_graph_nodes(spark, sf):
    join = lambda c: F.array_join(c, ",").alias(c)
    return graph.nodes(room_rows(spark, sf)).select("room", join("wings"), join("halls"), "count", join("dates"))


@register("room_graph_edges", f"WITH {SPARSE_ROOMS}, {_NODES}, w AS (SELECT room, count, unnest(wings) AS wing, halls FROM nodes) SELECT a.room, a.wing AS wing_a, b.wing AS wing_b, unnest(a.halls) AS hall, a.count FROM w a JOIN w b ON a.room = b.room AND a.wing < b.wing")
def room_graph_edges(spark, sf):
    return graph.edges(graph.nodes(sparse_rooms(spark, sf)))


@register("graph_stats", f"WITH {ROOM_ROWS}, {_NODES} SELECT count(*) AS total_rooms, count(*) FILTER (len(wings) >= 2) AS tunnel_rooms, CAST(sum(len(wings) * (len(wings) - 1) // 2 * len(halls)) AS BIGINT) AS total_edges FROM nodes")
def graph_stats(spark, sf):
    return graph.stats(graph.nodes(room_rows(spark, sf)))


@register("rooms_per_wing", f"WITH {SPARSE_ROOMS}, {_NODES}, w AS (SELECT unnest(wings) AS wing FROM nodes) SELECT wing, count(*) AS rooms FROM w GROUP BY wing")
def rooms_per_wing(spark, sf):
    return graph.rooms_per_wing(graph.nodes(sparse_rooms(spark, sf)))


@register("tunnels", f"WITH {SPARSE_ROOMS}, {_NODES} SELECT room, array_to_string(wings, ',') AS wings, count, dates[-1] AS recent FROM nodes WHERE len(wings) >= 2 AND list_contains(wings, 'w7') ORDER BY count DESC, room LIMIT 50")
def tunnels(spark, sf):
    return graph.tunnels(graph.nodes(sparse_rooms(spark, sf)), "w7").select("room", F.array_join("wings", ",").alias("wings"), "count", "recent")


@register("top_tunnels", f"WITH {ROOM_ROWS}, {_NODES} SELECT room, array_to_string(wings, ',') AS wings, count FROM (SELECT * FROM nodes ORDER BY len(wings) DESC, room LIMIT 10) WHERE len(wings) >= 2")
def top_tunnels(spark, sf):
    return graph.top_tunnels(graph.nodes(room_rows(spark, sf))).select("room", F.array_join("wings", ",").alias("wings"), "count")


@register(
    "traverse_two_hops",
    f"WITH {SPARSE_ROOMS}, {_NODES}, m AS (SELECT room, unnest(wings) AS wing FROM nodes), h1 AS (SELECT b.room, 'r3' AS parent, list_sort(list(DISTINCT wing)) AS via FROM m a JOIN m b USING (wing) WHERE a.room = 'r3' AND b.room <> 'r3' GROUP BY b.room), "
    "p2 AS (SELECT b.room, a.room AS parent, list_sort(list(DISTINCT wing)) AS via FROM m a JOIN m b USING (wing) WHERE a.room IN (SELECT room FROM h1) AND b.room <> 'r3' AND b.room NOT IN (SELECT room FROM h1) GROUP BY ALL), h2 AS (SELECT room, arg_min(via, parent) AS via FROM p2 GROUP BY room), "
    "r AS (SELECT 'r3' AS room, 0 AS hop, [] AS via UNION ALL SELECT room, 1, via FROM h1 UNION ALL SELECT room, 2, via FROM h2) "
    "SELECT room, hop, count, array_to_string(wings, ',') AS wings, array_to_string(via, ',') AS connected_via FROM r JOIN nodes USING (room) ORDER BY hop, count DESC, room LIMIT 50",
)
def traverse_two_hops(spark, sf):
    return graph.traverse(graph.nodes(sparse_rooms(spark, sf)), "r3").select("room", "hop", "count", F.array_join("wings", ",").alias("wings"), F.array_join("connected_via", ",").alias("connected_via"))


@register("find_implementations", f"WITH {TYPE_FACTS} SELECT DISTINCT subject AS type, predicate AS relationship FROM type_facts WHERE object = 't5' AND valid_to IS NULL AND predicate = 'implements'")
def find_implementations(spark, sf):
    return code_graph.implementations(type_facts(spark, sf), "t5")


@register("find_references", f"WITH {TYPE_FACTS} SELECT CASE predicate WHEN 'implements' THEN 'implementations' WHEN 'inherits' THEN 'subclasses' WHEN 'extends' THEN 'extensions' END AS category, count(*) AS n, string_agg(subject, ',' ORDER BY subject) AS types FROM type_facts WHERE object = 't5' AND valid_to IS NULL GROUP BY 1")
def find_references(spark, sf):
    return code_graph.references(type_facts(spark, sf), "t5")


@register(
    "arch_patterns_layers",
    "WITH t AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN 'Repository' WHEN 1 THEN 'Controller' WHEN 2 THEN 'FactoryService' ELSE 'Dto' END AS type_name, 'App.' || p_brand AS namespace FROM part) "
    "SELECT id, CASE id % 4 WHEN 0 THEN 'repository' WHEN 2 THEN 'factory,service' WHEN 1 THEN 'controller' ELSE '' END AS patterns, CASE WHEN namespace LIKE 'App.Brand#1%' THEN 'core' WHEN id % 4 = 1 THEN 'presentation' WHEN id % 4 = 0 THEN 'data' WHEN id % 4 = 2 THEN 'business' END AS layer FROM t",
)
def arch_patterns_layers(spark, sf):
    kinds = F.element_at(F.array(*map(F.lit, ("Repository", "Controller", "FactoryService", "Dto"))), F.expr("int(p_partkey % 4) + 1"))
    types = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", kinds).alias("type_name"), F.concat(F.lit("App."), "p_brand").alias("namespace"))
    patterns = {"repository": ["Repository"], "factory": ["Factory"], "service": ["Service"], "controller": ["Controller"]}
    layers = [("core", ["App.Brand#1*"], []), ("presentation", [], ["Controller"]), ("data", [], ["Repository"]), ("business", [], ["Service"])]
    return types.select("id", F.array_join(F.array_sort(code_graph.patterns_of(F.col("type_name"), patterns)), ",").alias("patterns"), code_graph.layer_of(F.col("type_name"), F.col("namespace"), layers).alias("layer"))


@register(
    "project_graph",
    "WITH f AS (SELECT 's' || (o_custkey % 5) AS subject, 'contains_project' AS predicate, 'o' || (o_orderkey % 40) AS object FROM orders UNION SELECT 'o' || (l_orderkey % 40), 'depends_on', 'pk' || (l_partkey % 30) FROM lineitem) "
    "SELECT DISTINCT predicate, subject, object FROM f WHERE subject = 's3' OR subject IN (SELECT object FROM f WHERE subject = 's3' AND predicate = 'contains_project')",
)
def project_graph(spark, sf):
    o = table(spark, sf, "orders").selectExpr("concat('s', o_custkey % 5) AS subject", "'contains_project' AS predicate", "concat('o', o_orderkey % 40) AS object")
    li = table(spark, sf, "lineitem").selectExpr("concat('o', l_orderkey % 40) AS subject", "'depends_on' AS predicate", "concat('pk', l_partkey % 30) AS object")
    facts = o.union(li).distinct().withColumn("valid_to", F.lit(None).cast("string"))
    return code_graph.project_graph(facts, "s3")


@register("fuzzy_rooms", f"WITH {SPARSE_ROOMS}, {_NODES} SELECT room, CASE WHEN contains(room, 'r11-zz') THEN 1.0 ELSE 0.5 END AS score FROM nodes WHERE contains(room, 'r11-zz') OR contains(room, 'r11') OR contains(room, 'zz') ORDER BY score DESC, room LIMIT 5")
def fuzzy_rooms(spark, sf):
    return graph.fuzzy_rooms(graph.nodes(sparse_rooms(spark, sf)), "r11-zz").select("room", F.col("score").cast("double").alias("score"))


@register("kg_window_errors", f"WITH {TRIPLES}, t AS (SELECT id, CASE WHEN length(id) = 3 THEN 'soon' ELSE valid_from END AS valid_from, CASE WHEN length(id) = 4 THEN '2020-01-01' ELSE valid_to END AS valid_to FROM triples) SELECT id, CASE WHEN valid_from = 'soon' THEN 'invalid valid_from' ELSE 'valid_to before valid_from' END AS error FROM t WHERE valid_from = 'soon' OR (valid_to IS NOT NULL AND valid_from IS NOT NULL AND valid_to < valid_from)")
def kg_window_errors(spark, sf):
    t = triples(spark, sf).withColumn("valid_from", F.when(F.length("id") == 3, "soon").otherwise(F.col("valid_from"))).withColumn("valid_to", F.when(F.length("id") == 4, "2020-01-01").otherwise(F.col("valid_to")))
    return kg.window_errors(t).select("id", "error")


@register(
    "extract_reusable",
    "WITH f AS (SELECT 's' || (o_custkey % 50) AS own, 'o' || (o_orderkey % 400) AS name FROM orders UNION SELECT 'o' || (l_orderkey % 400), CASE WHEN l_partkey % 40 = 0 THEN 'framework' ELSE 'pk' END || (l_partkey % 300) FROM lineitem), d1 AS (SELECT DISTINCT name FROM f WHERE own = 's3'), "
    "d2 AS (SELECT DISTINCT f.name FROM f JOIN d1 ON f.own = d1.name WHERE f.name NOT IN (SELECT name FROM d1) AND f.name <> 's3'), r AS (SELECT 's3' AS name, 0 AS depth UNION ALL SELECT name, 1 FROM d1 UNION ALL SELECT name, 2 FROM d2) "
    "SELECT name, depth, CASE WHEN contains(name, 'framework') THEN 'platform' WHEN name IN (SELECT own FROM f WHERE name IN (SELECT name FROM r WHERE contains(name, 'framework'))) THEN 'glue' ELSE 'core' END AS kind FROM r",
)
def extract_reusable(spark, sf):
    o = table(spark, sf, "orders").selectExpr("concat('s', o_custkey % 50) AS subject", "'contains_project' AS predicate", "concat('o', o_orderkey % 400) AS object")
    li = table(spark, sf, "lineitem").selectExpr("concat('o', l_orderkey % 400) AS subject", "'depends_on' AS predicate", "concat(IF(l_partkey % 40 = 0, 'framework', 'pk'), l_partkey % 300) AS object")
    return code_graph.reusable(o.union(li).distinct().withColumn("valid_to", F.lit(None).cast("string")), "s3", 2)


@register("auto_entities", f"WITH {TRIPLES} SELECT 'order_' || CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS name FROM orders UNION ALL SELECT id, name FROM entities")
def auto_entities(spark, sf):
    names = table(spark, sf, "orders").selectExpr("concat('Order ', o_orderkey) AS name", "2 * o_orderkey AS order")
    return kg.auto_entities(entities(spark, sf), names.union(names.selectExpr("upper(name)", "order + 1"))).select("id", "name")


@register("export_facts", f"WITH {TRIPLES} SELECT id, subject, predicate, object, valid_from FROM triples WHERE valid_from IS NULL OR valid_from >= '2024-01-20'")
def export_facts(spark, sf):
    from tessellum.sources.jsonl import fact_records, parse_facts

    return parse_facts(fact_records(triples(spark, sf), "2024-01-20")).select("id", "subject", "predicate", "object", "valid_from")
