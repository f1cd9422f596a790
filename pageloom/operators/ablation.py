"""Chunking experiments: contexts of a variant and their scores by question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.context import sibling_order


def contexts(hits: DataFrame, chunks: DataFrame, parents: DataFrame, window: int = 1) -> DataFrame:
    """(qid, context_id, chars): what a question's policy makes of its hits.

    ``hits`` are (qid, rank, chunk_id, parent_id, policy), ``chunks`` (chunk_id, parent_id, chars),
    ``parents`` (parent_id, chars). A child policy keeps the hits, a neighbour policy adds the
    siblings within the window, a parent policy takes the parents; each context once.
    """
    child = hits.where("policy = 'child'").join(chunks.select("chunk_id", "chars"), "chunk_id").select("qid", F.col("chunk_id").alias("context_id"), "chars")
    near = hits.where("policy = 'neighbor'").select("qid", "parent_id", sibling_order(F.col("chunk_id")).alias("o"))
    near = near.join(chunks.withColumn("s", sibling_order(F.col("chunk_id"))), "parent_id").where(F.abs(F.col("s") - F.col("o")) <= window).select("qid", F.col("chunk_id").alias("context_id"), "chars")
    broad = hits.where("policy = 'parent'").select("qid", "parent_id").distinct().join(parents, "parent_id").select("qid", F.col("parent_id").alias("context_id"), "chars")
    return child.unionByName(near).unionByName(broad).distinct()


def context_costs(found: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, context_count, context_chars), 0 for a question without contexts."""
    sums = found.groupBy("qid").agg(F.count(F.lit(1)).alias("context_count"), F.sum("chars").alias("context_chars"))
    return questions.select("qid").join(sums, "qid", "left").select("qid", F.coalesce("context_count", F.lit(0)).alias("context_count"), F.coalesce("context_chars", F.lit(0)).alias("context_chars"))


def document_scores(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(qid, hit, doc_recall, mrr) of hits (qid, rank, doc) against gold documents (qid, doc)."""
    g = gold.select("qid", "doc").distinct()
    n = g.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    met = hits.join(g, ["qid", "doc"], "left_semi").groupBy("qid").agg(F.countDistinct(F.when(F.col("rank") <= k, F.col("doc"))).alias("n_hit"), F.min("rank").alias("first"))
    j = n.join(met, "qid", "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return j.select("qid", F.when(hit > 0, 1.0).otherwise(0.0).alias("hit"), (hit / F.col("n_gold")).alias("doc_recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def summary(costs: DataFrame, group: str) -> DataFrame:
    """(group, n, least, most and mean of context counts and characters)."""
    agg = [F.count(F.lit(1)).alias("n")]
    for c in ("context_count", "context_chars"):
        agg += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_avg")]
    return costs.groupBy(group).agg(*agg)


def best_by_strategy(rows: DataFrame) -> DataFrame:
    """The best variant of each strategy by balanced score; of those within 0.02 the one of smaller context, then index."""
    top = F.max("balanced_score").over(Window.partitionBy("strategy"))
    close = rows.withColumn("__top", top).where(F.col("__top") - F.col("balanced_score") < 0.02)
    w = Window.partitionBy("strategy").orderBy("context_chars_5", "index_chunks", "variant")
    return close.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__top")
