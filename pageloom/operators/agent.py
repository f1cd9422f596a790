"""The deterministic rules around an answering agent, as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ITERATIONS, MAX_TOOL_CALLS, MAX_EVALUATIONS = 10, 8, 2


def after_intent(intent: Column, clear: Column) -> Column:
    return F.when(intent == "chitchat", "chitchat_response").when((intent == "clarification") | ~F.coalesce(clear, F.lit(False)), "request_clarification").otherwise("rewrite_query")


def after_call(iterations: Column, tools: Column, asks_tools: Column) -> Column:
    limit = (F.coalesce(iterations, F.lit(0)) >= MAX_ITERATIONS) | (F.coalesce(tools, F.lit(0)) > MAX_TOOL_CALLS)
    return F.when(limit, "fallback_response").when(~F.coalesce(asks_tools, F.lit(False)), "collect_answer").otherwise("tools")


def after_evaluation(mode: Column, satisfactory: Column, evaluations: Column, iterations: Column, tools: Column) -> Column:
    limit = (F.coalesce(evaluations, F.lit(0)) >= MAX_EVALUATIONS) | (F.coalesce(iterations, F.lit(0)) >= MAX_ITERATIONS) | (F.coalesce(tools, F.lit(0)) > MAX_TOOL_CALLS)
    return F.when(F.coalesce(mode == "knowledge_fallback", F.lit(False)) | F.coalesce(satisfactory, F.lit(False)), "end").when(limit, "knowledge_fallback").otherwise("task_executor")


def fan_out(plans: DataFrame, key: str, queries: str, most: int = 3) -> DataFrame:
    """(key, question_index, task_id, question): a row for each of the first ``most`` queries that isn't empty."""
    rows = plans.select(key, F.posexplode(F.slice(queries, 1, most)).alias("question_index", "question"))
    return rows.where("question is not null and question <> ''").select(key, "question_index", F.concat(F.lit("task_"), (F.col("question_index") + 1).cast("string")).alias("task_id"), "question")


def grade_evidence(results: DataFrame, key: str, threshold: float | None = 0.0) -> DataFrame:
    """(key, status, reason, best_score) over tool results (key, n_contexts, status, error, gap, best_score)."""
    g = results.groupBy(key).agg(
        F.sum(F.coalesce("n_contexts", F.lit(0))).alias("contexts"), F.max("best_score").alias("best_score"), F.coalesce(F.bool_or(F.col("status") == "low_score"), F.lit(False)).alias("low"),
        F.coalesce(F.bool_or((F.coalesce("error", F.lit("")) != "") | F.coalesce("gap", F.lit("")).startswith("RAG_RESEARCH_ERROR")), F.lit(False)).alias("failed"),
    )
    below = F.lit(False) if threshold is None else F.coalesce(F.col("best_score") < threshold, F.lit(False))
    status = F.when((F.col("contexts") > 0) & below, "low_score").when(F.col("contexts") > 0, "sufficient").when(F.col("low"), "low_score").when(F.col("failed"), "error").otherwise("insufficient")
    reason = F.when((F.col("contexts") > 0) & below, "best_rerank_score_below_threshold").when(F.col("contexts") > 0, "").when(F.col("low"), "rerank_score_below_threshold").when(F.col("failed"), "retrieval_error").otherwise("no_relevant_document_context")
    return g.select(key, status.alias("status"), reason.alias("reason"), "best_score")


def reduce_state(updates: DataFrame, key: str) -> DataFrame:
    """State after updates (key, seq, item, reset, tag, calls): items since the last reset, the union of tags, the sum of calls."""
    w = Window.partitionBy(key)
    last = F.max(F.when(F.col("reset"), F.col("seq"))).over(w)
    u = updates.withColumn("__last", last)
    live = F.col("__last").isNull() | (F.col("seq") > F.col("__last"))
    items = F.array_sort(F.collect_list(F.when(live & F.col("item").isNotNull(), F.struct("seq", "item"))))
    return u.groupBy(key).agg(F.transform(items, lambda x: x["item"]).alias("items"), F.array_sort(F.collect_set("tag")).alias("tags"), F.sum(F.coalesce("calls", F.lit(0))).alias("calls"))


def ordered_answers(answers: DataFrame, key: str) -> DataFrame:
    """(key, text): answers (key, index, question, answer) of a question's tasks in order, as one text."""
    part = F.concat(F.lit("Answer "), (F.col("index") + 1).cast("string"), F.lit(" ("), F.col("question"), F.lit("):\n"), F.coalesce("answer", F.lit("")))
    return answers.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def final_response(messages: DataFrame, key: str) -> DataFrame:
    """(key, response): the last plain or clarification message of the assistant."""
    plain = messages.where((F.col("role") == "assistant") & F.col("kind").isin("plain", "clarification") & F.col("text").isNotNull())
    return plain.groupBy(key).agg(F.max_by("text", "seq").alias("response"))


def unique_numbered(contents: DataFrame, key: str) -> DataFrame:
    """(key, text): distinct contents (key, seq, content) in the order first met, numbered."""
    first = contents.where("content is not null and content <> ''").groupBy(key, "content").agg(F.min("seq").alias("seq"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("seq", "content")))
    return numbered.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "), x["content"])), "\n").alias("text"))


def expired(tasks: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """Tasks (updated_at, status) that ended or stalled longer than their time to live ago."""
    return tasks.where(F.unix_micros(now) - F.unix_micros(F.col("updated_at").cast("timestamp")) > seconds * 1_000_000)
