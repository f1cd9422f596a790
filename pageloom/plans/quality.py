"""Registered queries of ingestion evaluation, judged rows, agent totals, deletes and page selection, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators import evaluation, ingestion_eval, manifest, retrieval
from pageloom.plans.queries import _CANDIDATES, _RESEARCH, BLOCKS, CHILDREN, PARENTS, QUESTIONS, _asked, _blocks, _candidates, _children, _kept, _parents, _questions, _researched, query, table

# A question's documents are its gold parents; their sentences are the lines of the pages.
_NORMAL = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
_GOLD = f"""gd AS (SELECT DISTINCT question_id AS qid, unnest(gold_parent_ids) AS doc FROM {QUESTIONS}),
 sent AS (SELECT parent_id AS doc, unnest(string_split(page_content, chr(10))) AS text, unnest(range(len(string_split(page_content, chr(10))))) AS no FROM {PARENTS}),
 keyed AS (SELECT doc, doc || ':' || no AS key, {_NORMAL.format('text')} AS text FROM sent WHERE {_NORMAL.format('text')} <> ''),
 gk AS (SELECT qid, key FROM gd JOIN keyed USING (doc))"""


def _gold(spark, d):
    return _asked(spark, d).select(F.col("question_id").alias("qid"), F.explode("gold_parent_ids").alias("doc")).where("doc is not null").distinct()


def _sentences(spark, d):
    s = _parents(spark, d).select(F.col("parent_id").alias("doc"), F.posexplode(F.split("page_content", "\n")).alias("no", "text")).where(ingestion_eval.squeezed(F.col("text")) != "")
    return s.select("doc", F.concat_ws(":", "doc", "no").alias("key"), "text")


_KS = [1, 3, 5]
_SCORED = f"""{_RESEARCH}, {_GOLD},
 ch AS (SELECT question_id AS qid, rank, child_id AS chunk_id, parent_id, parent_id AS doc FROM cand), ks AS (SELECT unnest({_KS}) AS k), qq AS (SELECT question_id AS qid FROM {QUESTIONS}),
 top AS (SELECT ch.*, k, gd.doc IS NOT NULL AS gold FROM ch JOIN ks ON rank <= k LEFT JOIN gd ON gd.qid = ch.qid AND gd.doc = ch.doc),
 f AS (SELECT qid, k, count(*) AS actual, count(DISTINCT doc) FILTER (WHERE gold) AS docs, count(*) FILTER (WHERE gold) AS relevant, sum(CASE WHEN gold THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM top GROUP BY ALL),
 mr AS (SELECT ch.qid, 1.0 / min(rank) AS mrr FROM ch JOIN gd ON gd.qid = ch.qid AND gd.doc = ch.doc GROUP BY ALL),
 met AS (SELECT DISTINCT c.qid, c.ctx_pos, k, c.parent_id AS doc, c.content FROM ctx c JOIN top t ON t.qid = c.qid AND t.parent_id = c.parent_id UNION SELECT DISTINCT c.qid, c.ctx_pos, k, c.parent_id, c.content FROM ctx c JOIN top t ON t.qid = c.qid AND t.chunk_id = c.child_id),
 sz AS (SELECT qid, k, count(*) AS context_count, sum(length(content)) AS context_chars FROM met GROUP BY ALL),
 rd AS (SELECT qid, k, count(*) AS read, count(*) FILTER (WHERE own) AS hits FROM (SELECT DISTINCT m.qid, m.k, s.key, gk.qid IS NOT NULL AS own FROM met m JOIN keyed s ON s.doc = m.doc AND contains({_NORMAL.format('m.content')}, s.text) LEFT JOIN gk ON gk.qid = m.qid AND gk.key = s.key) GROUP BY ALL),
 ng AS (SELECT qid, count(*) AS gold_docs FROM gd WHERE doc IS NOT NULL GROUP BY ALL), nk AS (SELECT qid, count(*) AS gold_sentences FROM gk GROUP BY ALL),
 sc2 AS (SELECT qq.qid, ks.k, coalesce(gold_docs, 0) > 0 AS scored, coalesce(mrr, 0) AS mrr, coalesce(actual, 0) AS actual_results, CASE WHEN coalesce(docs, 0) > 0 THEN 1.0 ELSE 0.0 END AS hitrate, CASE WHEN coalesce(gold_docs, 0) > 0 THEN coalesce(docs, 0) / gold_docs ELSE 0 END AS doc_recall, coalesce(relevant, 0) / ks.k AS doc_precision,
   CASE WHEN coalesce(gold_sentences, 0) > 0 THEN coalesce(hits, 0) / gold_sentences ELSE 0 END AS sentence_recall, CASE WHEN coalesce(read, 0) > 0 THEN hits / read ELSE 0 END AS sentence_precision, coalesce(context_count, 0) AS context_count, coalesce(context_chars, 0) AS context_chars,
   CASE WHEN coalesce(gold_docs, 0) > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(gold_docs, ks.k) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg
   FROM qq CROSS JOIN ks LEFT JOIN ng USING (qid) LEFT JOIN nk USING (qid) LEFT JOIN mr USING (qid) LEFT JOIN f ON f.qid = qq.qid AND f.k = ks.k LEFT JOIN sz ON sz.qid = qq.qid AND sz.k = ks.k LEFT JOIN rd ON rd.qid = qq.qid AND rd.k = ks.k)"""


def _scores(spark, d):
    docs, sentences = _gold(spark, d), _kept(spark, d, "sentences", lambda: _sentences(spark, d))
    chunks = _candidates(spark, d).select(F.col("question_id").alias("qid"), "rank", F.col("child_id").alias("chunk_id"), "parent_id", F.col("parent_id").alias("doc"))
    _, contexts = _researched(spark, d)
    contexts = contexts.select("qid", F.col("ctx_pos").alias("context_id"), "parent_id", "child_id", F.col("parent_id").alias("doc"), "content")
    return ingestion_eval.score(_asked(spark, d).select(F.col("question_id").alias("qid")), chunks, contexts, docs, docs.join(sentences, "doc").select("qid", "key"), sentences, _KS)


def _rounded(df):
    whole = {"long", "integer"}
    return df.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name).cast("bigint").alias(f.name) if f.dataType.typeName() in whole else F.col(f.name) for f in df.schema.fields))


_MEASURES = ", ".join(f"round({m}::DOUBLE, 6) AS {m}" if m not in ("actual_results", "context_count", "context_chars") else f"{m}::BIGINT AS {m}" for m in ingestion_eval.MEASURES)


@query(f"WITH {_SCORED} SELECT qid, k::BIGINT AS k, scored, {_MEASURES} FROM sc2")
def ingestion_scores(spark, d):
    """Documents and evidence sentences that search and research bring back for every question."""
    return _rounded(_scores(spark, d))


@query(f"""WITH {_SCORED} SELECT k::BIGINT AS k, count(*) AS rows, count(*) FILTER (WHERE scored) AS scored_rows, count(*) FILTER (WHERE NOT scored) AS unscored_rows, CASE WHEN count(*) FILTER (WHERE scored) > 0 THEN 1.0 ELSE 0.0 END AS evaluation_valid,
 {", ".join(f"round(coalesce(avg({m}::DOUBLE) FILTER (WHERE scored), 0), 6) AS {m}" for m in ingestion_eval.MEASURES)} FROM sc2 GROUP BY k""")
def ingestion_summary(spark, d):
    return _rounded(ingestion_eval.aggregate(_scores(spark, d)))


@query(f"WITH {_SCORED}, m AS (SELECT {', '.join(f'avg({m}::DOUBLE) AS {m}' for m in ingestion_eval.MEASURES)} FROM sc2) SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON {', '.join(ingestion_eval.MEASURES)} INTO NAME metric VALUE value)")
def numeric_means(spark, d):
    return _rounded(ingestion_eval.means(_scores(spark, d), ("k",)))


@query(f"WITH {_GOLD} SELECT k.key, c.child_id FROM keyed k JOIN {CHILDREN} c ON c.parent_id = k.doc AND contains({_NORMAL.format('c.content')}, k.text)")
def sentences_in_chunks(spark, d):
    """The chunks in which each line of their page stands whole."""
    c = _children(spark, d).select("child_id", F.col("parent_id").alias("doc"), "content")
    return ingestion_eval.sentences_in(c, _sentences(spark, d)).select("key", "child_id")


@query(f"""
WITH RECURSIVE s AS (SELECT parent_id, page_content AS text, list_filter(string_split(page_content, chr(10)), lambda x: x <> '') AS ss FROM {PARENTS} WHERE page_content IS NOT NULL),
 o AS (SELECT parent_id, text, ss, 0 AS no, 0 AS cur, NULL::BIGINT AS b FROM s
  UNION ALL SELECT parent_id, text, ss, no + 1, CASE WHEN n >= 0 THEN n + length(ss[no + 1]) ELSE cur END, n FROM
   (SELECT parent_id, text, ss, no, cur, CASE WHEN instr(substring(text, cur + 1), ss[no + 1]) > 0 THEN cur + instr(substring(text, cur + 1), ss[no + 1]) - 1 ELSE instr(text, ss[no + 1]) - 1 END AS n FROM o WHERE no < len(ss)))
SELECT parent_id, no - 1 AS sentence_no, b AS "begin", b + length(ss[no]) AS "end" FROM o WHERE b >= 0""")
def sentence_offsets(spark, d):
    """Where the lines of every page stand in it, each looked for after the one before."""
    docs = _parents(spark, d).select("parent_id", "page_content", F.filter(F.split("page_content", "\n"), lambda x: x != "").alias("sentences"))
    out = ingestion_eval.sentence_offsets(docs, "parent_id", "page_content", "sentences")
    return out.select("parent_id", *(F.col(c).cast("bigint").alias(c) for c in ("sentence_no", "begin", "end")))


_JUDGED = "j AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS faithfulness, CASE WHEN event_type = 'view' THEN NULL ELSE '0.5' END AS context_precision, CASE WHEN event_type = 'error' THEN NULL ELSE '0.7' END AS context_recall FROM events)"


@query(f"""
WITH {_JUDGED}, u AS (SELECT *, TRY_CAST(faithfulness AS DOUBLE) IS NOT NULL AS f, TRY_CAST(context_precision AS DOUBLE) IS NOT NULL AS p, TRY_CAST(context_recall AS DOUBLE) IS NOT NULL AS r FROM j)
SELECT 'ragas_metric_missing' AS code, 'warning' AS severity, CAST(event_id AS VARCHAR) AS question_id, NULL AS detail FROM u WHERE NOT (f OR p OR r)
UNION ALL SELECT 'ragas_metric_missing', 'warning', CAST(event_id AS VARCHAR), 'faithfulness' FROM u WHERE (f OR p OR r) AND NOT f
UNION ALL SELECT 'ragas_metric_missing', 'warning', CAST(event_id AS VARCHAR), 'context_precision' FROM u WHERE (f OR p OR r) AND NOT p
UNION ALL SELECT 'ragas_metric_missing', 'warning', CAST(event_id AS VARCHAR), 'context_recall' FROM u WHERE (f OR p OR r) AND NOT r
UNION ALL SELECT 'ragas_row_count_mismatch', 'error', NULL, count(*) || '/1' FROM j HAVING count(*) <> 1""")
def judged_rows(spark, d):
    """Warnings about rows of scores; the events' kinds decide which scores are missing or no numbers."""
    kind = F.col("event_type")
    rows = table(spark, d, "events").select("event_id", F.when(kind == "error", "n/a").otherwise(F.col("value").cast("string")).alias("faithfulness"), F.when(kind.isNull() | (kind != "view"), "0.5").alias("context_precision"), F.when(kind.isNull() | (kind != "error"), "0.7").alias("context_recall"))
    return evaluation.validate_judged(rows, "event_id", 1)


@query("""
SELECT count(*) AS rows, sum(CASE event_type WHEN 'view' THEN 1 ELSE 0 END)::BIGINT AS total_search_calls, count(*) FILTER (WHERE event_type = 'click') AS total_rag_research_calls, 0 AS total_rag_research_contexts, 0 AS total_rag_research_gaps,
 sum(user_id % 3)::BIGINT AS total_retry_searches, count(*) FILTER (WHERE user_id % 3 > 0) AS questions_with_retry_search, 0 AS total_answer_evaluations, sum(user_id % 2)::BIGINT AS total_answer_revisions, count(*) FILTER (WHERE user_id % 2 > 0) AS questions_with_answer_revision,
 count(*) FILTER (WHERE event_type = 'error') AS questions_with_knowledge_fallback FROM events""")
def agent_totals(spark, d):
    """Totals over runs of an agent, with the events as runs."""
    e, none = table(spark, d, "events"), F.lit(None).cast("long")
    kind = lambda k: (F.col("event_type") == k).cast("long")
    rows = e.select(kind("view").alias("search_calls"), kind("click").alias("research_calls"), none.alias("contexts"), none.alias("gaps"), (F.col("user_id") % 3).alias("retries"), none.alias("evaluations"), (F.col("user_id") % 2).alias("revisions"), F.when(F.col("event_type") == "error", "knowledge_fallback").alias("mode"))
    return ingestion_eval.agent_totals(rows)


@query(f"""
WITH {_RESEARCH}, n AS (SELECT qid, count(*) AS n FROM ctx GROUP BY ALL), t AS (SELECT question_id AS qid, coalesce(source_file, '') AS thread FROM {QUESTIONS})
SELECT t.thread, count(*) AS calls, sum(coalesce(n, 0))::BIGINT AS contexts, count(*) FILTER (WHERE coalesce(n, 0) = 0) AS gaps, coalesce(any_value(p.parents), 0) AS parents FROM t LEFT JOIN n USING (qid)
LEFT JOIN (SELECT thread, count(DISTINCT parent_id) AS parents FROM ids JOIN t USING (qid) GROUP BY ALL) p ON p.thread = t.thread GROUP BY t.thread""")
def research_calls(spark, d):
    """Calls of research, what they brought and the distinct parents, by the question's file as thread."""
    r, _ = _researched(spark, d)
    q = _asked(spark, d).select(F.col("question_id").alias("qid"), F.coalesce("source_file", F.lit("")).alias("thread"))
    return ingestion_eval.research_calls(q.join(r, "qid"))


@query(f"SELECT question_id, child_id, rank FROM (WITH {_CANDIDATES} SELECT *, CASE WHEN chunk_index IS NULL THEN NULL ELSE rrf_score END AS known FROM cand) WHERE known IS NULL OR known >= 0.016")
def threshold_or_unknown(spark, d):
    """Hits whose score is unknown (here of chunks without index) or high enough."""
    c = _candidates(spark, d).withColumn("known", F.when(F.col("chunk_index").isNotNull(), F.col("rrf_score")))
    return retrieval.at_least_or_unknown(c, "known", 0.016).select("question_id", "child_id", F.col("rank").cast("bigint").alias("rank"))


_GONE = "(SELECT source_file FROM documents WHERE source_file IS NOT NULL GROUP BY source_file ORDER BY count(*) DESC, source_file LIMIT 1)"


@query(f"""
SELECT 'child_chunks' AS artifact, count(*) AS rows, count(*) FILTER (WHERE source_file = (SELECT * FROM {_GONE}) OR source = (SELECT * FROM {_GONE})) AS deleted, NULL AS error FROM child_chunks
UNION ALL SELECT 'documents', count(*), count(*) FILTER (WHERE source_file = (SELECT * FROM {_GONE}) OR source = (SELECT * FROM {_GONE})), NULL FROM documents
UNION ALL SELECT 'page_blocks', count(*), count(*) FILTER (WHERE source_file = (SELECT * FROM {_GONE})), NULL FROM page_blocks
UNION ALL SELECT 'sessions', count(*), 0, 'no key column' FROM sessions""")
def delete_document(spark, d):
    """The largest file is deleted from every artifact; a table without its columns is reported and kept."""
    largest = table(spark, d, "documents").where("source_file is not null").groupBy("source_file").count().orderBy(F.desc("count"), "source_file").limit(1).collect()  # one row
    _, report = manifest.delete_document({n: table(spark, d, n) for n in ("child_chunks", "documents", "page_blocks", "sessions")}, None, [r.source_file for r in largest])
    return report


@query(f"SELECT count(*) AS parents, count(DISTINCT doc_id) AS documents, coalesce(sum(length(page_content)), 0)::BIGINT AS characters, (SELECT count(*) FROM {CHILDREN}) AS children FROM {PARENTS}")
def collection_stats(spark, d):
    return manifest.collection_stats(_parents(spark, d), _children(spark, d))


@query(f"WITH w AS (SELECT source_file, max(coalesce(page_number, 1)) AS n FROM {BLOCKS} GROUP BY ALL) SELECT block_id FROM {BLOCKS} b JOIN w ON w.source_file = b.source_file AND coalesce(b.page_number, 1) = w.n")
def selected_pages(spark, d):
    """The last page of every file is rebuilt; a page without number counts as page 1."""
    b = _blocks(spark, d)
    chosen = b.groupBy("source_file").agg(F.max(F.coalesce("page_number", F.lit(1))).alias("page_number"))
    return manifest.selected_pages(b, chosen, "source_file").select("block_id")


@query(f"SELECT question_id, 'Represent this question: ' || coalesce(question, '') AS prefixed FROM {QUESTIONS}")
def query_prefix(spark, d):
    return _questions(spark, d).select("question_id", retrieval.with_prefix(F.col("question"), "Represent this question: ").alias("prefixed"))
