"""Retrieval quality and latency figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_hit(results: DataFrame, expected: DataFrame, query: str = "query_id", item: str = "item") -> DataFrame:
    """``(query, hit_rank)``: the rank of the first result that is expected; null without one."""
    hits = results.join(expected.select(query, item).distinct(), [query, item]).groupBy(query).agg(F.min("rank").alias("hit_rank"))
    return expected.select(query).distinct().join(hits, query, "left")


def recall_and_mrr(ranks: DataFrame, by: list[str] | None = None, cut: tuple[int, ...] = (5, 10)) -> DataFrame:
    recalls = [F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)).alias(f"r_at_{k}") for k in cut]
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("queries"), *recalls, F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))).alias("mrr"))


def ndcg(results: DataFrame, k: int = 10, query: str = "query_id") -> DataFrame:
    """``(query, ndcg)`` of rows with ``rank`` and ``rel``; the ideal order is that of the retrieved relevances."""
    ideal = Window.partitionBy(query).orderBy(F.desc("rel"), "rank")
    rows = results.withColumn("best", F.row_number().over(ideal))

    def gain(place: str):
        return F.sum(F.when(F.col(place) <= k, F.col("rel") / F.log2(F.col(place) + 1.0)).otherwise(0.0))

    return rows.groupBy(query).agg(gain("rank").alias("dcg"), gain("best").alias("idcg")).select(query, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def percentiles(rows: DataFrame, column: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """Exact percentiles, linear between neighbours."""
    return rows.groupBy(*by).agg(*[F.percentile(column, p).alias(name) for name, p in points.items()])


def precision_at_k(results: DataFrame, expected: DataFrame, k: int = 5, query: str = "query_id", item: str = "item") -> DataFrame:
    """Share of labelled queries with an expected item among their first ``k`` results."""
    ranks = first_hit(results, expected, query, item)
    return ranks.agg(F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)).alias(f"precision_at_{k}"))


def recall_any_all(results: DataFrame, expected: DataFrame, k: int = 10, query: str = "query_id", item: str = "item") -> DataFrame:
    """``(query, recall_any, recall_all)``: whether any, and all, of the expected items are among the first ``k`` results."""
    top = results.filter(F.col("rank") <= k).select(query, item, F.lit(1).alias("_hit")).distinct()
    rows = expected.select(query, item).distinct().join(top, [query, item], "left").withColumn("_found", F.col("_hit").isNotNull())
    return rows.groupBy(query).agg(F.max("_found").cast("double").alias("recall_any"), F.min("_found").cast("double").alias("recall_all"))
