"""Evaluation of retrieval over ingested documents: documents and sentences of the gold evidence that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.session import materialize


def squeezed(text: Column) -> Column:
    """White space as single spaces, none at the ends; null is the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def sentences_in(contexts: DataFrame, sentences: DataFrame) -> DataFrame:
    """(context columns, key): the sentences (doc, key, text) whose text stands in a context (doc, content).

    The join is on the document, so only the sentences of a context's own document are tried in it.
    """
    s = sentences.select("doc", "key", squeezed(F.col("text")).alias("__s"))
    return contexts.withColumn("__c", squeezed(F.col("content"))).join(s, "doc").where(F.contains("__c", "__s")).drop("__c", "__s")


def contexts_of(contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Contexts (qid, context_id, parent_id, child_id) of which the parent or the child is among the query's chunks (qid, k, parent_id, chunk_id), with k.

    Two joins on equal keys and a union; an or-condition would compare all pairs.
    """
    parents = chunks.where("parent_id is not null and parent_id <> ''").select("qid", "k", "parent_id").distinct()
    children = chunks.where("chunk_id is not null and chunk_id <> ''").select("qid", "k", F.col("chunk_id").alias("child_id")).distinct()
    columns = ["k", *contexts.columns]
    return contexts.join(parents, ["qid", "parent_id"]).select(columns).unionByName(contexts.join(children, ["qid", "child_id"]).select(columns)).dropDuplicates(["qid", "context_id", "k"])


def score(questions: DataFrame, chunks: DataFrame, contexts: DataFrame, gold_docs: DataFrame, gold_keys: DataFrame, sentences: DataFrame, ks: list[int]) -> DataFrame:
    """A row for each question (qid) and k with its measures; ``mrr`` is over all chunks.

    ``chunks`` are (qid, rank, chunk_id, parent_id, doc), ``contexts`` (qid, context_id, parent_id,
    child_id, doc, content), ``gold_docs`` (qid, doc), ``gold_keys`` (qid, key), ``sentences`` (doc,
    key, text). A question without gold documents has zeros and isn't ``scored``.
    """
    asked = questions.select("qid").distinct()
    cuts = asked.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    gold = gold_docs.where("doc is not null").distinct()
    keys = gold_keys.where("key is not null").distinct()
    marked = chunks.join(gold.withColumn("gold", F.lit(True)), ["qid", "doc"], "left")
    first = marked.where("gold").groupBy("qid").agg((1.0 / F.min("rank")).alias("mrr"))
    top = marked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    gain = F.when(F.col("gold"), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    found = top.groupBy("qid", "k").agg(F.count(F.lit(1)).alias("actual"), F.countDistinct(F.when(F.col("gold"), F.col("doc"))).alias("docs"), F.count_if("gold").alias("relevant"), F.sum(gain).alias("dcg"))
    met = materialize(contexts_of(contexts, top.select("qid", "k", "parent_id", "chunk_id")), "met")  # read twice
    sizes = met.groupBy("qid", "k").agg(F.count(F.lit(1)).alias("context_count"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("context_chars"))
    read = sentences_in(met, sentences).select("qid", "k", "key").distinct().join(keys.withColumn("gold", F.lit(True)), ["qid", "key"], "left")
    read = read.groupBy("qid", "k").agg(F.count(F.lit(1)).alias("read"), F.count_if("gold").alias("hits"))
    out = cuts.join(gold.groupBy("qid").agg(F.count(F.lit(1)).alias("gold_docs")), "qid", "left").join(keys.groupBy("qid").agg(F.count(F.lit(1)).alias("gold_sentences")), "qid", "left").join(first, "qid", "left")
    for part in (found, sizes, read):
        out = out.join(part, ["qid", "k"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    ratio = lambda a, b: F.when(n(b) > 0, n(a) / n(b)).otherwise(F.lit(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n("gold_docs"), F.col("k")), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return out.select(
        "qid", "k", (n("gold_docs") > 0).alias("scored"), n("mrr").cast("double").alias("mrr"), n("actual").alias("actual_results"), F.when(n("docs") > 0, 1.0).otherwise(0.0).alias("hitrate"), ratio("docs", "gold_docs").alias("doc_recall"), (n("relevant") / F.col("k")).alias("doc_precision"),
        ratio("hits", "gold_sentences").alias("sentence_recall"), ratio("hits", "read").alias("sentence_precision"), n("context_count").alias("context_count"), n("context_chars").alias("context_chars"), F.when(n("gold_docs") > 0, n("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


MEASURES = ("mrr", "actual_results", "hitrate", "doc_recall", "doc_precision", "sentence_recall", "sentence_precision", "context_count", "context_chars", "ndcg")


def aggregate(scores: DataFrame) -> DataFrame:
    """(k, rows, scored_rows, unscored_rows, evaluation_valid and the mean of each measure) over scored questions only."""
    mean = lambda m: F.coalesce(F.avg(F.when(F.col("scored"), F.col(m).cast("double"))), F.lit(0.0)).alias(m)
    return scores.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.count_if("scored").alias("scored_rows"), F.count_if(~F.col("scored")).alias("unscored_rows"), F.when(F.count_if("scored") > 0, 1.0).otherwise(0.0).alias("evaluation_valid"), *map(mean, MEASURES))


def means(rows: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """(metric, value): the mean of every numeric column."""
    names = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "decimal", "short") and f.name not in without]
    parts = [F.struct(F.lit(n).alias("metric"), F.avg(F.col(n).cast("double")).alias("value")) for n in names]
    return rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def agent_totals(rows: DataFrame) -> DataFrame:
    """Totals over agent runs (search_calls, research_calls, contexts, gaps, retries, evaluations, revisions, mode), as the report has them."""
    total = lambda c, name: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(name)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), total("search_calls", "total_search_calls"), total("research_calls", "total_rag_research_calls"), total("contexts", "total_rag_research_contexts"), total("gaps", "total_rag_research_gaps"), total("retries", "total_retry_searches"),
        F.count_if(F.coalesce("retries", F.lit(0)) > 0).alias("questions_with_retry_search"), total("evaluations", "total_answer_evaluations"), total("revisions", "total_answer_revisions"), F.count_if(F.coalesce("revisions", F.lit(0)) > 0).alias("questions_with_answer_revision"),
        F.count_if(F.col("mode") == "knowledge_fallback").alias("questions_with_knowledge_fallback"),
    )


def research_calls(results: DataFrame) -> DataFrame:
    """(thread, calls, contexts, gaps, parents) of the research results (thread, contexts, gaps, parent_ids) in each thread."""
    per = results.groupBy("thread").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.greatest(F.size("contexts"), F.lit(0))).alias("contexts"), F.sum(F.greatest(F.size("gaps"), F.lit(0))).alias("gaps"))
    ids = results.select("thread", F.explode("parent_ids").alias("p")).groupBy("thread").agg(F.countDistinct("p").alias("parents"))
    return per.join(ids, "thread", "left").select("thread", "calls", "contexts", "gaps", F.coalesce("parents", F.lit(0)).alias("parents"))


def sentence_offsets(docs: DataFrame, key: str, text: str, sentences: str) -> DataFrame:
    """(key, sentence_no, begin, end): where a document's sentences stand, each looked for after the one before.

    One that isn't found there is looked for from the start, and left out if it isn't anywhere.
    """
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<no:int,begin:int,end:int>>").alias("found"), F.lit(0).alias("no"))

    def place(acc: Column, sentence: Column) -> Column:
        ahead = F.instr(F.substr(F.col(text), acc["cursor"] + 1), sentence)
        begin = F.when(ahead > 0, acc["cursor"] + ahead - 1).otherwise(F.instr(F.col(text), sentence) - 1).cast("int")
        end = (begin + F.length(sentence)).cast("int")
        one = F.array(F.struct(acc["no"].alias("no"), begin.alias("begin"), end.alias("end")))
        return F.struct(F.when(begin >= 0, end).otherwise(acc["cursor"]).alias("cursor"), F.when(begin >= 0, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"), (acc["no"] + 1).alias("no"))

    found = F.aggregate(F.coalesce(sentences, F.array().cast("array<string>")), start, place)["found"]
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(found).alias("x")).select(key, F.col("x.no").alias("sentence_no"), "x.begin", "x.end")
