"""From hits to contexts: child, neighbour window or parent, chosen by a policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import retrieval
from pageloom.session import materialize

# Words that ask for a broad context, and words that ask for a fact.
BROAD = [
    "why", "how do", "how does", "how can", "how to", "compare", "comparison", "different", "difference", "relationship", "mechanism", "process", "steps", "explain", "describe", "summarize", "cause",
    "effect", "impact", "role", "function", "interact", "interplay", "为什么", "为何", "如何", "怎么", "比较", "区别", "差异", "联系", "关系", "机制", "过程", "流程", "步骤", "解释", "说明", "总结", "概括", "原因", "影响", "作用",
    "讲讲", "内容", "讲了什么", "介绍", "谈谈", "概述", "梳理", "归纳", "阐述", "论述", "包含", "覆盖", "包括", "组成", "结构", "框架",
]
FACT = ["who", "when", "where", "which", "what", "how many", "how much", "谁", "何时", "什么时候", "哪里", "哪", "多少", "几个", "几种", "是什么"]
ABLATION_BROAD = ["why", "how do", "how does", "how can", "how to", "compare", "difference", "relationship", "mechanism", "process", "steps", "explain", "describe", "为什么", "如何", "比较", "区别", "联系", "机制", "流程", "步骤", "解释", "说明"]
ABLATION_FACT = ["who", "when", "where", "which", "what", "how many", "谁", "哪里", "多少", "哪"]
POLICIES = ("child", "neighbor", "parent", "adaptive")


def policy(query: Column, most_hits: Column, keeps: Column, configured: str = "adaptive", least_hits: int = 2) -> tuple[Column, Column]:
    """(policy, reason) of a query whose hits have ``most_hits`` under one parent."""
    if configured not in POLICIES:
        return F.lit("parent"), F.lit(f"invalid_config:{configured}")
    if configured != "adaptive":
        return F.when(keeps, "parent").otherwise(configured), F.when(keeps, "keep_parent_ids_requested").otherwise("configured_policy")
    broad, fact, many = T.contains_any(query, BROAD), T.contains_any(query, FACT), most_hits >= least_hits
    name = F.when(keeps | broad | many, "parent").when(fact, "child").otherwise("neighbor")
    reason = F.when(keeps, "keep_parent_ids_requested").when(broad, "query_requires_broad_context").when(many, "multiple_child_hits_same_parent").when(fact, "fact_query").otherwise("default_neighbor_context")
    return name, reason


def ablation_policy(query: Column, most_hits: Column) -> Column:
    """The rule set of chunking experiments: several hits under one parent widen to neighbours only."""
    return F.when(T.contains_any(query, ABLATION_BROAD), "parent").when(most_hits >= 2, "neighbor").when(T.contains_any(query, ABLATION_FACT), "child").otherwise("neighbor")


def most_hits(hits: DataFrame) -> DataFrame:
    """(qid, most_hits): the largest number of a query's hits under one parent."""
    return hits.where("parent_id is not null and parent_id <> ''").groupBy("qid", "parent_id").count().groupBy("qid").agg(F.max("count").alias("most_hits"))


def context_score(reranked: Column, fused: Column) -> Column:
    """The rerank score, unless it is null or zero; then the fused one."""
    return F.coalesce(F.nullif(reranked, F.lit(0.0)), fused)


def neighbours(anchors: DataFrame, children: DataFrame, window: int = 1) -> DataFrame:
    """Children within ``window`` of an anchor (qid, parent_id, chunk_index, request_order) under its parent.

    A child near several anchors belongs to the first. An equality join on the parent carries the
    band condition, so a parent's few children are all that meets.
    """
    a = anchors.select("qid", "parent_id", F.col("chunk_index").alias("anchor_index"), "request_order")
    near = a.join(children, "parent_id").where(F.col("chunk_index").between(F.col("anchor_index") - window, F.col("anchor_index") + window))
    w = Window.partitionBy("qid", "child_id").orderBy("request_order")
    return near.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "anchor_index")


def sibling_order(child_id: Column) -> Column:
    """The number after _child_ in an id, 0 without one."""
    return F.coalesce(F.regexp_extract(child_id, r"_child_(\d+)$", 1).try_cast("int"), F.lit(0))


def parents(hits: DataFrame, parent_rows: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(qid, parent_id, child_id, chunk_index, source, content, context_type, score, place): the parents of hits.

    ``hits`` are (qid, rank, parent_id, child_id, chunk_index, source, content, score), ``keep``
    (qid, parent_id, pos) parents that are asked for besides. A parent's score is that of its last
    hit. Stored parents come first, by their ordinal, then the page and id; those that aren't fall
    back to their last hit, in the order they were met, or are left out if they have none.
    """
    last = F.max_by(F.struct("child_id", "chunk_index", "source", "content", "score"), "rank").alias("hit")
    per = hits.where("parent_id is not null and parent_id <> ''").groupBy("qid", "parent_id").agg(last, F.min("rank").alias("met"))
    if keep is not None:
        asked = keep.where("parent_id is not null and parent_id <> ''").groupBy("qid", "parent_id").agg(F.min("pos").alias("pos"))
        per = per.join(asked, ["qid", "parent_id"], "full").withColumn("met", F.coalesce(F.col("pos") - F.lit(1 << 30), F.col("met"))).drop("pos")
    rows = parent_rows.select("parent_id", T.strip(F.col("page_content")).alias("page_content"), F.col("source").alias("parent_source"), F.lit(True).alias("stored"))
    both = per.join(rows, "parent_id", "left").where("stored or hit is not null")
    stored = F.coalesce("stored", F.lit(False))
    page = F.coalesce(F.regexp_extract("parent_id", r"_page_(\d+)_parent_", 1).try_cast("int"), F.lit(0))
    place = F.struct((~stored).cast("int").alias("a"), F.when(stored, T.parent_ordinal(F.col("parent_id"))).otherwise(F.col("met")).cast("int").alias("b"), F.when(stored, page).otherwise(0).alias("c"), F.when(stored, F.col("parent_id")).otherwise("").alias("d"))
    unless = lambda c: F.when(~stored, F.col(f"hit.{c}"))
    return both.select(
        "qid", "parent_id", unless("child_id").alias("child_id"), unless("chunk_index").alias("chunk_index"), F.when(stored, F.coalesce("parent_source", F.lit("unknown"))).otherwise(F.col("hit.source")).alias("source"),
        F.when(stored, F.coalesce("page_content", F.lit(""))).otherwise(F.col("hit.content")).alias("content"), F.when(stored, "parent").otherwise("child").alias("context_type"), F.col("hit.score").alias("score"), place.alias("place"),
    )


def _place(a, b):
    """The order of a context: first by a, then by b."""
    return F.struct(F.lit(0).alias("a"), a.cast("int").alias("b"), b.cast("int").alias("c"), F.lit("").alias("d"))


def child_contexts(hits: DataFrame) -> DataFrame:
    """Hits as contexts, each child once: the first; one without id counts by its parent and text."""
    key = F.coalesce(F.nullif("child_id", F.lit("")), F.concat(F.coalesce("parent_id", F.lit("")), F.lit(":"), F.coalesce("content", F.lit(""))))
    w = Window.partitionBy("qid", "__key").orderBy("rank")
    first = hits.withColumn("__key", key).withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    return first.select("qid", "parent_id", "child_id", "chunk_index", "source", F.coalesce("content", F.lit("")).alias("content"), F.lit("child").alias("context_type"), "score", _place(F.col("rank"), F.lit(0)).alias("place"))


def neighbour_contexts(hits: DataFrame, children: DataFrame, window: int = 1) -> DataFrame:
    """The neighbours of hits in the order of the hits and of the text, then the hits that aren't among them.

    A neighbour has its own score if it is a hit, else the best of its parent's hits. Hits without
    parent or index have no neighbours and stay themselves.
    """
    anchors = hits.where("parent_id is not null and parent_id <> '' and chunk_index is not null").withColumn("request_order", F.col("rank"))
    near = neighbours(anchors, children.select("parent_id", "child_id", "chunk_index", "source", "content"), window)
    own = hits.groupBy("qid", "child_id").agg(F.max_by("score", "rank").alias("own"))
    best = hits.groupBy("qid", "parent_id").agg(F.max("score").alias("best"))
    near = near.join(own, ["qid", "child_id"], "left").join(best, ["qid", "parent_id"], "left")
    near = near.select("qid", "parent_id", "child_id", "chunk_index", "source", T.strip(F.coalesce("content", F.lit(""))).alias("content"), F.lit("neighbor_child").alias("context_type"), F.coalesce("own", "best").alias("score"), _place(F.col("request_order"), F.col("chunk_index")).alias("place"))
    rest = child_contexts(hits).join(near.select("qid", "child_id"), ["qid", "child_id"], "left_anti")
    rest = rest.withColumn("place", F.struct(F.lit(1).alias("a"), F.col("place.b").alias("b"), F.lit(0).alias("c"), F.lit("").alias("d")))
    return near.unionByName(rest)


def research_contexts(hits: DataFrame, chosen: DataFrame, parent_rows: DataFrame, children: DataFrame, keep: DataFrame | None = None, window: int = 1) -> DataFrame:
    """The contexts of every query by its policy (qid, policy), with ``ctx_pos`` from 1."""
    routed = hits.join(chosen.select("qid", "policy"), "qid")
    kept = keep.join(chosen.where("policy = 'parent'").select("qid"), "qid", "left_semi") if keep is not None else None
    every = child_contexts(routed.where("policy = 'child'")).unionByName(neighbour_contexts(routed.where("policy = 'neighbor'"), children, window)).unionByName(parents(routed.where("policy = 'parent'"), parent_rows, kept))
    return every.withColumn("ctx_pos", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).drop("place")


def research(queries: DataFrame, candidates: DataFrame, parent_rows: DataFrame, children: DataFrame, scorer, keep: DataFrame | None = None, exclude: DataFrame | None = None, top: int = 3, threshold: float | None = 0.3, pool: int = 40, window: int = 1, configured: str = "adaptive") -> tuple[DataFrame, DataFrame]:
    """(results, contexts): research of a batch of queries from what a search found for them.

    ``queries`` are (qid, query, focus), ``candidates`` (qid, rank, child_id, parent_id, chunk_index,
    source, content, rrf_score); without content it is joined from ``children`` where it is needed, so
    texts don't move with every candidate. Candidates of excluded parents go; of the first ``pool`` the scorer,
    a function of the query's and the content's column, leaves the best ``top`` at or above the
    threshold. Parents asked to be kept join them. A policy chooses children, neighbours or parents
    as contexts. Every query has one result, also one that found nothing.
    """
    focus = F.coalesce("focus", F.lit(""))
    asked = queries.select("qid", F.col("query"), focus.alias("focus"), F.when(focus != "", F.concat("query", F.lit("\nFocus: "), focus)).otherwise(F.col("query")).alias("effective"))
    marked = candidates.withColumn("gone", F.lit(None).cast("boolean")) if exclude is None else candidates.join(exclude.select("qid", "parent_id").distinct().withColumn("gone", F.lit(True)), ["qid", "parent_id"], "left")
    counts = marked.groupBy("qid").agg(F.count(F.lit(1)).alias("child_candidates"), F.count_if(F.col("gone").isNull()).alias("remaining"))
    left = marked.where("gone is null").drop("gone")
    first = Window.partitionBy("qid").orderBy("rank")
    pooled = left.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= pool).join(asked.select("qid", "effective"), "qid")
    bare, texts = "content" not in candidates.columns, children.select("child_id", "content")
    if scorer:
        pooled = (pooled.join(texts, "child_id") if bare else pooled).withColumn("scored", scorer(F.col("effective"), F.col("content")))
    pooled = pooled.drop("effective", *["content"] * bare)
    ranked = retrieval.rerank(pooled, F.col("scored") if scorer else None, top, threshold)
    if bare:
        ranked = ranked.join(texts, "child_id")
    if scorer:
        ranked = ranked.drop("rank").withColumnRenamed("rerank_rank", "rank").withColumn("score", context_score(F.col("rerank_score"), F.col("rrf_score")))
    else:
        ranked = ranked.withColumn("score", F.col("rrf_score")).withColumn("rerank_score", F.lit(None).cast("double"))
    hits = materialize(ranked.select("qid", "rank", "child_id", "parent_id", "chunk_index", "source", "content", "score", "rerank_score"), "hits")  # read by every branch below
    met = hits.where("parent_id is not null and parent_id <> ''").groupBy("qid", "parent_id").agg(F.min("rank").cast("long").alias("at"))
    wanted = None
    if keep is not None:
        wanted = keep.where("parent_id is not null and parent_id <> ''").groupBy("qid", "parent_id").agg(F.min("pos").alias("pos"))
        met = met.unionByName(wanted.select("qid", "parent_id", (F.col("pos") - F.lit(1 << 30)).cast("long").alias("at"))).groupBy("qid", "parent_id").agg(F.min("at").alias("at"))
    ids = met.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "parent_id"))), lambda x: x["parent_id"]).alias("parent_ids"))
    keeps = asked.select("qid").join(wanted.select("qid").distinct().withColumn("keeps", F.lit(True)), "qid", "left") if wanted is not None else asked.select("qid", F.lit(None).cast("boolean").alias("keeps"))
    name, why = policy(F.col("effective"), F.coalesce("most_hits", F.lit(0)), F.coalesce("keeps", F.lit(False)), configured)
    chosen = asked.join(most_hits(hits), "qid", "left").join(keeps, "qid", "left").select("qid", "query", "focus", name.alias("policy"), why.alias("policy_reason"))
    chosen = materialize(chosen, "chosen")
    contexts = materialize(research_contexts(hits, chosen, parent_rows, children, wanted, window), "contexts")  # the results' plan and the caller's start from files, else each repeats all branches
    one = F.struct("ctx_pos", "parent_id", "source", "child_id", "chunk_index", "context_type", "content", "score")
    packed = contexts.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("ctx_pos")).alias("contexts"), F.array_sort(F.collect_set(F.nullif("source", F.lit("")))).alias("sources"), F.sum(F.length("content")).alias("chars"), F.count(F.lit(1)).alias("n"))
    scores = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("reranked"), F.max("rerank_score").alias("best"))
    out = chosen
    for part in (packed, ids, counts, scores):
        out = out.join(part, "qid", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    low = (none("remaining") > 0) & F.lit(scorer is not None and threshold is not None)
    status = F.when(none("n") > 0, "sufficient").when(low, "low_score").otherwise("insufficient")
    gaps = F.when(none("n") > 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("No relevant document context was retrieved.")))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    results = out.select(
        "qid", "query", "focus", "contexts", some("sources").alias("sources"), some("parent_ids").alias("parent_ids"), gaps.alias("gaps"),
        F.struct(
            F.lit("").alias("retry_reason"), F.lit("rrf").alias("retrieval_mode"), F.lit(scorer is not None).alias("reranker_enabled"), F.array().cast("array<string>").alias("course_scope_sources"),
            none("child_candidates").alias("child_candidates"), none("reranked").alias("reranked_contexts"), F.col("best").alias("best_rerank_score"), F.size(some("parent_ids")).alias("parent_ids"), none("n").alias("contexts"),
            F.col("policy").alias("context_policy"), F.col("policy_reason").alias("context_policy_reason"), F.lit(window).alias("neighbor_window"), none("chars").alias("returned_context_chars"), none("n").alias("returned_context_count"), status.alias("evidence_status"),
        ).alias("diagnostics"),
    )
    return results, contexts


def research_json(results: DataFrame) -> DataFrame:
    """(qid, result): every research result as one JSON object."""
    fields = [F.col("query"), F.col("focus"), F.coalesce("contexts", F.from_json(F.lit("[]"), results.schema["contexts"].dataType)).alias("contexts"), F.col("sources"), F.col("parent_ids"), F.col("gaps"), F.col("diagnostics")]
    return results.select("qid", F.to_json(F.struct(*fields)).alias("result"))


def hits_text(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, text): hits (qid, rank, parent_id, source, content) as text, NO_RELEVANT_CHUNKS for a query without any."""
    part = F.concat(F.lit("Parent ID: "), F.coalesce("parent_id", F.lit("")), F.lit("\nFile Name: "), F.coalesce("source", F.lit("")), F.lit("\nContent: "), T.strip(F.coalesce("content", F.lit(""))))
    text = hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
    return queries.select("qid").distinct().join(text, "qid", "left").select("qid", F.coalesce("text", F.lit("NO_RELEVANT_CHUNKS")).alias("text"))


def parents_text(asked: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """(qid, text): the stored parents of asked ids (qid, parent_id) in their order, NO_PARENT_DOCUMENTS for none."""
    ids = asked.distinct().join(parent_rows, "parent_id", "left")
    source = F.coalesce(F.get_json_object("metadata", "$.source"), F.lit("unknown"))
    part = F.concat(F.lit("Parent ID: "), "parent_id", F.lit("\nFile Name: "), source, F.lit("\nContent: "), T.strip(F.coalesce("page_content", F.lit(""))))
    page = F.coalesce(F.regexp_extract("parent_id", r"_page_(\d+)_parent_", 1).try_cast("int"), F.lit(0))
    stored = F.when(F.col("page_content").isNotNull(), F.struct(T.parent_ordinal(F.col("parent_id")).alias("o"), page.alias("p"), F.col("parent_id").alias("i"), part.alias("t")))
    text = ids.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(stored)), lambda x: x["t"]).alias("ts"))
    return text.select("qid", F.when(F.size("ts") > 0, F.array_join("ts", "\n\n")).otherwise("NO_PARENT_DOCUMENTS").alias("text"))
