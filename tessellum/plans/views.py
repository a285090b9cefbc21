"""The engine's tables as views over the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("source_file", F.expr("concat('/src/', source, '/file_', doc_id div 10, '.txt')")).withColumn("chunk_index", F.expr("int(doc_id % 10)"))
    marks = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("hall"))
    return docs.join(marks, "doc_id", "left").select(
        F.col("doc_id"),
        F.expr("concat('drawer_', source, '_', lang, '_', left(md5(concat(source_file, '|', chunk_index)), 16))").alias("id"),
        "text",
        F.col("source").alias("wing"),
        F.col("lang").alias("room"),
        F.coalesce("hall", F.lit("")).alias("hall"),
        F.date_format(F.expr("date_add(DATE '2024-01-01', int(doc_id % 28))"), "yyyy-MM-dd").alias("date"),
        "source_file",
        "chunk_index",
        F.md5("text").alias("source_hash"),
        F.col("n_chars"),
    )


CHUNKS = """
chunks AS (
  SELECT d.doc_id, 'drawer_' || source || '_' || lang || '_' || left(md5(source_file || '|' || chunk_index), 16) AS id, text, source AS wing, lang AS room,
         coalesce('q' || quality, '') AS hall, strftime(DATE '2024-01-01' + CAST(d.doc_id % 28 AS INTEGER), '%Y-%m-%d') AS date, source_file, chunk_index, md5(text) AS source_hash, n_chars
  FROM (SELECT *, '/src/' || source || '/file_' || (doc_id // 10) || '.txt' AS source_file, CAST(doc_id % 10 AS INTEGER) AS chunk_index FROM documents) d
  LEFT JOIN labels USING (doc_id)
)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("wing"))


def query_vector(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    """One stated query vector."""
    row = table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


def room_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(wing, room, hall, date): nation, brand, priority and day of each line."""
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "part")}
    return (
        t["lineitem"]
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("n_name").alias("wing"), F.col("p_brand").alias("room"), F.col("o_orderpriority").alias("hall"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    )


ROOM_ROWS = """
room_rows AS (
  SELECT n_name AS wing, p_brand AS room, o_orderpriority AS hall, strftime(o_orderdate, '%Y-%m-%d') AS date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
)"""


def sparse_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """(wing, room, hall, date): a day's users as wings, kinds of part as rooms, so that a walk has somewhere to go."""
    return table(spark, sf, "part").select(
        F.expr("concat('w', p_partkey % 61)").alias("wing"), F.expr("concat('r', p_partkey div 3)").alias("room"), F.col("p_brand").alias("hall"), F.expr("date_format(date_add(DATE '2024-01-01', int(p_partkey % 300)), 'yyyy-MM-dd')").alias("date")
    )


SPARSE_ROOMS = """
room_rows AS (
  SELECT 'w' || (p_partkey % 61) AS wing, 'r' || (p_partkey // 3) AS room, p_brand AS hall, strftime(DATE '2024-01-01' + CAST(p_partkey % 300 AS INTEGER), '%Y-%m-%d') AS date FROM part
)"""


def triples(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    def fact(df: DataFrame, key: str, subject: str, predicate: str, obj: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select(F.expr(key).alias("id"), F.expr(subject).alias("subject"), F.lit(predicate).alias("predicate"), F.expr(obj).alias("object"), none.alias("valid_from"), none.alias("valid_to"), F.lit(1.0).alias("confidence"), F.lit("seed").alias("source_file"))

    day = F.date_format("ts", "yyyy-MM-dd")
    following = F.lead(day).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    did = table(spark, sf, "events").select(
        F.expr("concat('e', event_id)").alias("id"), F.expr("concat('user_', user_id)").alias("subject"), F.lit("did").alias("predicate"), F.col("event_type").alias("object"), day.alias("valid_from"), following.alias("valid_to"), F.lit(1.0).alias("confidence"), F.expr("concat('/log/', user_id % 7, '/day.json')").alias("source_file")
    )
    parts = [
        fact(table(spark, sf, "nation"), "concat('n', n_nationkey)", "concat('nation_', n_nationkey)", "in_region", "concat('region_', n_regionkey)"),
        fact(table(spark, sf, "customer"), "concat('c', c_custkey)", "concat('customer_', c_custkey)", "lives_in", "concat('nation_', c_nationkey)"),
        fact(table(spark, sf, "supplier"), "concat('s', s_suppkey)", "concat('supplier_', s_suppkey)", "based_in", "concat('nation_', s_nationkey)"),
    ]
    for p in parts:
        did = did.unionByName(p)
    return did


def entities(spark: SparkSession, sf: str) -> DataFrame:
    def named(t: str, key: str, name: str, kind: str) -> DataFrame:
        return table(spark, sf, t).select(F.expr(key).alias("id"), F.expr(name).alias("name"), F.lit(kind).alias("type"))

    out = named("nation", "concat('nation_', n_nationkey)", "n_name", "nation").unionByName(named("region", "concat('region_', r_regionkey)", "r_name", "region"))
    out = out.unionByName(named("customer", "concat('customer_', c_custkey)", "c_name", "customer")).unionByName(named("supplier", "concat('supplier_', s_suppkey)", "s_name", "supplier"))
    out = out.unionByName(named("events", "concat('user_', user_id)", "concat('User ', user_id)", "user").distinct())
    return out.unionByName(named("events", "event_type", "event_type", "event").distinct())


TRIPLES = """
triples AS (
  SELECT 'e' || event_id AS id, 'user_' || user_id AS subject, 'did' AS predicate, event_type AS object, strftime(ts, '%Y-%m-%d') AS valid_from,
         lead(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, CAST(1.0 AS DOUBLE) AS confidence, '/log/' || (user_id % 7) || '/day.json' AS source_file FROM events
  UNION ALL SELECT 'n' || n_nationkey, 'nation_' || n_nationkey, 'in_region', 'region_' || n_regionkey, NULL, NULL, 1.0, 'seed' FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'customer_' || c_custkey, 'lives_in', 'nation_' || c_nationkey, NULL, NULL, 1.0, 'seed' FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'supplier_' || s_suppkey, 'based_in', 'nation_' || s_nationkey, NULL, NULL, 1.0, 'seed' FROM supplier
), entities AS (
  SELECT 'nation_' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'region_' || r_regionkey, r_name FROM region
  UNION ALL SELECT 'customer_' || c_custkey, c_name FROM customer UNION ALL SELECT 'supplier_' || s_suppkey, s_name FROM supplier
  UNION ALL SELECT DISTINCT 'user_' || user_id, 'User ' || user_id FROM events UNION ALL SELECT DISTINCT event_type, event_type FROM events
)"""


def type_facts(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of types from part keys: T<k> inherits, implements or extends T<k div 4>; every seventh fact is closed."""
    p = table(spark, sf, "part").filter("p_partkey >= 4")
    return p.select(
        F.expr("concat('p', p_partkey)").alias("id"), F.expr("concat('t', p_partkey)").alias("subject"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'inherits' WHEN 1 THEN 'implements' ELSE 'extends' END").alias("predicate"), F.expr("concat('t', p_partkey div 4)").alias("object"),
        F.lit(None).cast("string").alias("valid_from"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN '2024-06-01' END").alias("valid_to"), F.col("p_brand").alias("source_file"),
    )


TYPE_FACTS = """
type_facts AS (
  SELECT 'p' || p_partkey AS id, 't' || p_partkey AS subject, CASE p_partkey % 3 WHEN 0 THEN 'inherits' WHEN 1 THEN 'implements' ELSE 'extends' END AS predicate, 't' || (p_partkey // 4) AS object,
         CAST(NULL AS VARCHAR) AS valid_from, CASE WHEN p_partkey % 7 = 0 THEN '2024-06-01' END AS valid_to, p_brand AS source_file FROM part WHERE p_partkey >= 4
)"""
