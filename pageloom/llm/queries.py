"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import encode, garbled, mix, nearest, pairs, pieces, scans, unify
from pageloom.session import materialize, shared_dir, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(table(spark, sf_dir, "page_blocks"))


def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(table(spark, sf_dir, "page_blocks"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        pairs.defects(table(spark, sf_dir, origin), key, question, answer).select(F.lit(origin).alias("origin"), "pair_key", "defect")
        for origin, key, question, answer in (("session_turns", "id", "user_original", "assistant_final"), ("eval_questions", "question_id", "question", "reference_answer"))
    ]
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pairs(spark, sf_dir).where("defect is not null")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        unify.look_alikes(table(spark, sf_dir, "child_chunks"), "child_id", "content").select(F.lit("child_chunks").alias("origin"), "key_a", "key_b"),
        unify.look_alikes(table(spark, sf_dir, "eval_questions"), "question_id", "question").select(F.lit("eval_questions").alias("origin"), "key_a", "key_b"),
    ]
    return reduce(DataFrame.unionByName, parts)


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        unify.unify(table(spark, sf_dir, origin).select(F.lit(origin).alias("origin"), F.col(key).alias("key"), F.col(text).alias("text")).distinct(), "text").drop("text")
        for origin, key, text in (("child_chunks", "child_id", "content"), ("eval_questions", "question_id", "question"))
    ]
    return reduce(DataFrame.unionByName, parts)


PARENT_LIMIT, CHILD_LIMIT, OVERLAP = 4000, 300, 60


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        pieces.oversized(table(spark, sf_dir, name), key, text, limit, OVERLAP).select(F.lit(origin).alias("origin"), F.col(key).alias("item_key"), "chunk_index", "content")
        for origin, name, key, text, limit in (("parent", "parent_chunks", "parent_id", "page_content", PARENT_LIMIT), ("child", "child_chunks", "child_id", "content", CHILD_LIMIT))
    ]
    return reduce(DataFrame.unionByName, parts)


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages written as text files of any length, and cut by byte ranges of the files."""
    path = f"{shared_dir(spark)}/pageloom-files-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "parent_chunks").select("parent_id", "page_content").distinct().repartitionByRange(4, "parent_id").sortWithinPartitions("parent_id", "page_content")
    pages.select(F.coalesce("page_content", F.lit(""))).write.text(path)
    cut = pieces.split_files(spark, path, PARENT_LIMIT, OVERLAP)
    return cut.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file_no"), "chunk_index", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).where("chunk_index = 0").select("origin", "item_key").distinct()


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "child_chunks"), "child_id", "embedding")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest.nearest(table(spark, sf_dir, "child_chunks"), "child_id", "embedding", at_least=0.85)
    return near.select(F.least("child_id", "neighbour").alias("child_a"), F.greatest("child_id", "neighbour").alias("child_b")).distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the documents, written once: they are read for the rates and again for the mix."""
    counts = encode.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return materialize(counts, "sizes")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_tokens")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.restore(table(spark, sf_dir, "documents"), "doc_id", "text").where("size(pairs) > 0").select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.restore(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_cleaned": p1_cleaned, "p2_found": p2_found, "p2_pairs": p2_pairs, "p3_found": p3_found, "p3_unified": p3_unified, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_files": p4_files, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}
ORACLE_SQL: dict[str, str] = {
    "p4_found": """
        SELECT DISTINCT 'parent' AS origin, parent_id AS item_key FROM parent_chunks WHERE length(page_content) > 4000
        UNION ALL
        SELECT DISTINCT 'child' AS origin, child_id AS item_key FROM child_chunks WHERE length(content) > 300
    """,
}
