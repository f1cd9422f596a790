"""The registered queries of the reference's operators, each over its whole tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import ablation, agent, chunking, clean, context, courses, evaluation, images, manifest, pages, retrieval, sessions
from pageloom.session import materialize, scratch, table
from pageloom.sources import readers, sinks
from pageloom.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Parts of the SQL that many queries share: each record of a table once, the last one loaded.
def _last(name: str, key: str) -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC NULLS LAST) = 1)"


BLOCKS, PARENTS, CHILDREN, TURNS, QUESTIONS = (_last(n, k) for n, k in (("page_blocks", "block_id"), ("parent_chunks", "parent_id"), ("child_chunks", "child_id"), ("session_turns", "id"), ("eval_questions", "question_id")))
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
TOKENS = "regexp_extract_all(lower({0}), '\\p{{Han}}|(?:[^\\P{{L}}\\p{{Han}}]|\\p{{N}})+')"
LINES = f"""lines AS (SELECT block_id, source_file, page_pos, page_number, len(string_split(raw_text, chr(10))) AS n_lines,
    unnest(range(len(string_split(raw_text, chr(10))))) AS line_no, unnest(string_split(raw_text, chr(10))) AS line FROM {BLOCKS}),
  fenced AS (SELECT *, sum(CASE WHEN {STRIP.format("line")} LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY block_id ORDER BY line_no) % 2 = 1 AS in_fence FROM lines)"""
EDGE_KEY = (
    "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + STRIP.format("line") + ", '^\\s{0,3}#{1,6}\\s*', ''), '[*_`]+', '', 'g'), '(?i)\\b(page|p\\.)\\s*\\d+\\b', 'page', 'g'), "
    "'\\b\\d+\\s*/\\s*\\d+\\b', '', 'g'), '(?i)\\b\\d+\\s+of\\s+\\d+\\b', '', 'g'), '第\\s*\\d+\\s*页', '', 'g'), '\\s+', ' ', 'g')))"
)
BARE = "regexp_replace(" + STRIP.format("line") + ", '[*_`]', '', 'g')"
IS_PAGE = (
    f"(page_number IS NOT NULL AND length({BARE}) <= 30 AND regexp_matches({BARE}, '(?i)^(?:-+\\s*)?\\d+(?:\\s*-+)?$|^(?:page|p\\.)\\s*\\d+$|^第\\s*\\d+\\s*页$|^\\d+\\s*/\\s*\\d+$|^\\d+\\s+of\\s+\\d+$') "
    f"AND (regexp_matches({BARE}, '^-+\\s*\\d+\\s*-+$') OR NOT contains({BARE}, '-')) AND regexp_extract({BARE}, '(\\d+)', 1) = CAST(page_number AS VARCHAR))"
)
HEADING = "regexp_matches(line, '^\\s{0,3}#{1,6}\\s+\\S')"
STRIPPED = STRIP.format("line")
PROTECTED = f"({STRIPPED} <> '' AND (regexp_matches({STRIPPED}, '^#{{1,6}}\\s+\\S|^[-*+]\\s+\\S|^\\d+[.)]\\s+\\S|^\\|.*\\|$') OR (regexp_matches({STRIPPED}, '[:：]') AND length({STRIPPED}) > 6)))"


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def _kept(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of a session read, written for the first of them; a plan that starts from it ends at its files."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _KEPT:
        with scratch(spark):
            made = make()
            _KEPT[key] = materialize(made, name, lasting=True)
    return _KEPT[key]


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return pages.latest(table(spark, d, "page_blocks"), "block_id")


def _children(spark: SparkSession, d: str) -> DataFrame:
    return pages.latest(table(spark, d, "child_chunks"), "child_id")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return pages.latest(table(spark, d, "parent_chunks"), "parent_id")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return pages.latest(table(spark, d, "session_turns"), "id")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return pages.latest(table(spark, d, "eval_questions"), "question_id")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return pages.lines(_blocks(spark, d).select("block_id", "source_file", "page_pos", "page_number", "raw_text"), "block_id")


# ---- pages and cleaning --------------------------------------------------------------------------
@query(f"""
WITH {LINES}, full_lines AS (SELECT * FROM fenced WHERE {STRIPPED} <> ''),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY line_no) AS t, row_number() OVER (PARTITION BY block_id ORDER BY line_no DESC) AS b FROM full_lines),
 edge AS (SELECT source_file, block_id, {EDGE_KEY} AS edge_key FROM ranked WHERE (t <= 3 OR b <= 3) AND NOT coalesce({IS_PAGE}, false)),
 n AS (SELECT source_file, edge_key, count(DISTINCT block_id) AS n_pages FROM edge WHERE edge_key <> '' GROUP BY ALL),
 p AS (SELECT source_file, count(DISTINCT block_id) AS pages FROM lines GROUP BY ALL)
SELECT source_file, edge_key, n_pages, pages, round(least(0.99, n_pages / pages), 6) AS confidence FROM n JOIN p USING (source_file) WHERE n_pages >= greatest(3, ceil(pages * 0.3))""")
def repeated_edges(spark, d):
    return pages.repeated_edges(_lines(spark, d), "source_file", "block_id")


@query(f"WITH {LINES} SELECT block_id, line_no, line FROM fenced WHERE (line_no < 3 OR line_no >= greatest(n_lines - 3, 0)) AND NOT in_fence AND {IS_PAGE}")
def page_number_lines(spark, d):
    return pages.page_number_lines(_lines(spark, d)).select("block_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


_TITLED = LINES.replace(BLOCKS, f"(SELECT block_id, source_file, page_pos, page_number, coalesce('# ' || slide_title || chr(10) || chr(10), '') || raw_text AS raw_text FROM {BLOCKS})")


@query(f"""
WITH {_TITLED}, keyed AS (SELECT block_id, line_no, CASE WHEN NOT in_fence AND {HEADING} THEN lower(trim(regexp_replace(regexp_replace(regexp_replace({STRIPPED}, '^\\s{{0,3}}#{{1,6}}\\s*', ''), '[*_`]+', '', 'g'), '\\s+', ' ', 'g'))) END AS heading
 FROM fenced WHERE {STRIPPED} <> '')
SELECT block_id, line_no, heading FROM (SELECT *, lag(heading) OVER (PARTITION BY block_id ORDER BY line_no) AS b FROM keyed) WHERE heading = b""")
def duplicate_headings(spark, d):
    """All pages; a slide title is put above its page, so that it repeats where the page begins with it."""
    b = _blocks(spark, d).withColumn("raw_text", F.concat(F.coalesce(F.concat(F.lit("# "), "slide_title", F.lit("\n\n")), F.lit("")), "raw_text"))
    return pages.duplicate_headings(pages.lines(b.select("block_id", "raw_text"), "block_id"), "block_id").select("block_id", F.col("line_no").cast("bigint").alias("line_no"), "heading")


@query(f"""
WITH {LINES}, h AS (SELECT block_id, arg_min(trim(regexp_replace({STRIPPED}, '^#{{1,6}}\\s*', '')), line_no) AS x FROM lines WHERE regexp_matches({STRIPPED}, '^#{{1,6}}\\s+\\S') GROUP BY ALL),
 p AS (SELECT block_id, arg_min({STRIPPED}, line_no) AS x FROM lines WHERE line_no < 5 AND {STRIPPED} <> '' AND NOT {PROTECTED} GROUP BY ALL)
SELECT b.block_id, coalesce(h.x, p.x) AS title FROM (SELECT DISTINCT block_id FROM lines) b LEFT JOIN h USING (block_id) LEFT JOIN p USING (block_id)""")
def slide_titles(spark, d):
    return pages.slide_titles(_lines(spark, d), "block_id")


@query(f"WITH {LINES} SELECT block_id, count(*) FILTER (WHERE {PROTECTED}) AS n_protected, count(*) AS n_lines FROM lines GROUP BY ALL")
def protected_lines(spark, d):
    return _lines(spark, d).groupBy("block_id").agg(F.count_if(T.is_protected(F.col("line"))).alias("n_protected"), F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {LINES} SELECT source_file, {EDGE_KEY} AS edge_key, count(*) AS n FROM lines GROUP BY ALL")
def edge_normalize(spark, d):
    return _lines(spark, d).groupBy("source_file", T.edge_key(F.col("line")).alias("edge_key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH p AS (SELECT DISTINCT source_file, page_number AS n FROM {BLOCKS} WHERE page_number IS NOT NULL),
 i AS (SELECT *, n - row_number() OVER (PARTITION BY source_file ORDER BY n) AS g FROM p)
SELECT source_file, min(n) AS first_page, max(n) AS last_page, count(*) AS n_pages FROM i GROUP BY source_file, g""")
def page_groups(spark, d):
    return pages.page_groups(_blocks(spark, d), "source_file")


@query(f"SELECT source_file, page_number, sha256(raw_text) AS page_hash FROM {BLOCKS} WHERE page_number IS NOT NULL AND {STRIP.format('raw_text')} <> ''")
def page_hashes(spark, d):
    return chunking.page_hashes(_blocks(spark, d), "source_file", "raw_text")


@query(f"""
SELECT source_file, page_number, sha256({STRIP.format('raw_text')}) AS page_hash FROM {BLOCKS}
WHERE page_number IS NOT NULL AND {STRIP.format('raw_text')} <> ''""")
def split_pages(spark, d):
    """The pages of every file put together with markers and divided again."""
    b = _blocks(spark, d).where("page_number is not null")
    marked = F.concat("raw_text", F.lit("\n--- end of page.page_number="), F.col("page_number").cast("string"), F.lit(" ---"))
    docs = b.groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_pos", marked.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return pages.split_pages(docs, "source_file", "text").select("source_file", "page_number", F.sha2(T.strip(F.col("raw_text")), 256).alias("page_hash"))


_PUA = "regexp_replace(translate(text, chr(61656)||chr(61596)||chr(61623)||chr(61607)||chr(61692)||chr(61664)||chr(61649)||chr(61618), '•–•◆✓✉▶→'), '[\\x{E000}-\\x{F8FF}]', '', 'g')"


@query(f"SELECT doc_id, sha256({_PUA}) AS clean_hash FROM documents WHERE text IS NOT NULL AND {_PUA} <> text")
def pua_sanitize(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    c = T.without_private_use(F.col("text"))
    return docs.where(c != F.col("text")).select("doc_id", F.sha2(c, 256).alias("clean_hash"))


@query(f"SELECT doc_id, CASE WHEN length({SQUEEZE.format('text')}) > 240 THEN {SQUEEZE.format('text')}[1:237] || '...' ELSE {SQUEEZE.format('text')} END AS preview FROM documents WHERE text IS NOT NULL")
def text_preview(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.preview(F.col("text"), 240).alias("preview"))


@query()
def clean_full(spark, d):
    out, _ = clean.clean(_blocks(spark, d), "source_file", "block_id")
    return out


@query()
def clean_events(spark, d):
    _, events = clean.clean(_blocks(spark, d), "source_file", "block_id")
    return events


# ---- chunking ------------------------------------------------------------------------------------
def _windows(source: str, keys: str, text: str, size: int, overlap: int) -> str:
    return f"""SELECT {keys}, unnest(range(len(s))) AS chunk_no, unnest(s) AS start, unnest(list_transform(s, lambda p: substring({text}, p + 1, {size}))) AS chunk
      FROM (SELECT *, CASE WHEN length({text}) <= {size} THEN [0] ELSE range(0, length({text}) - {overlap}, {size - overlap}) END AS s FROM {source} WHERE length({text}) > 0)"""


@query(f"SELECT doc_id, chunk_no, start, md5(chunk) AS chunk_hash FROM ({_windows('documents', 'doc_id', 'text', 500, 100)})")
def chunk_fixed(spark, d):
    c = chunking.fixed(table(spark, d, "documents"), ["doc_id"], "text", 500, 100)
    return c.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("start").cast("bigint").alias("start"), F.md5("chunk").alias("chunk_hash"))


@query(f"""
WITH p AS (SELECT doc_id, chunk_no AS parent_no, chunk AS parent_text FROM ({_windows('documents', 'doc_id', 'text', 2000, 400)}))
SELECT doc_id, parent_no, chunk_no AS child_no, md5(chunk) AS chunk_hash FROM ({_windows('p', 'doc_id, parent_no', 'parent_text', 800, 160)})""")
def chunk_parent_child(spark, d):
    p = chunking.fixed(table(spark, d, "documents"), ["doc_id"], "text", 2000, 400).select("doc_id", F.col("chunk_no").cast("bigint").alias("parent_no"), F.col("chunk").alias("parent_text"))
    c = chunking.fixed(p, ["doc_id", "parent_no"], "parent_text", 800, 160)
    return c.select("doc_id", "parent_no", F.col("chunk_no").cast("bigint").alias("child_no"), F.md5("chunk").alias("chunk_hash"))


@query(f"""
WITH t AS (SELECT parent_id, page_content FROM {PARENTS} WHERE length(page_content) > 0),
 c AS (SELECT parent_id, chunk_no, start AS c_start, start + length(chunk) AS c_end FROM ({_windows('t', 'parent_id', 'page_content', 500, 100)})),
 l AS (SELECT parent_id, unnest(range(len(string_split(page_content, chr(10))))) AS s_no, unnest(string_split(page_content, chr(10))) AS line FROM t),
 s AS (SELECT parent_id, s_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY parent_id ORDER BY s_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_start FROM l)
SELECT c.parent_id, c.chunk_no, count(*) AS n_sentences, min(s_no) AS first_no, max(s_no) AS last_no FROM c JOIN s ON c.parent_id = s.parent_id AND s_start < c_end AND s_start + length(line) > c_start GROUP BY ALL""")
def sentence_overlap(spark, d):
    from pyspark.sql import Window

    p = _parents(spark, d).where("length(page_content) > 0").select("parent_id", "page_content")
    c = chunking.fixed(p, ["parent_id"], "page_content", 500, 100).select("parent_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("start").alias("c_start"), (F.col("start") + F.length("chunk")).alias("c_end"))
    lines = p.select("parent_id", F.posexplode(F.split("page_content", "\n")).alias("s_no", "line"))
    w = Window.partitionBy("parent_id").orderBy("s_no").rowsBetween(Window.unboundedPreceding, -1)
    s = lines.withColumn("s_start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))).withColumn("s_end", F.col("s_start") + F.length("line"))
    j = chunking.sentence_overlap(c, s, "parent_id")
    return j.groupBy("parent_id", "chunk_no").agg(F.count(F.lit(1)).alias("n_sentences"), F.min("s_no").cast("bigint").alias("first_no"), F.max("s_no").cast("bigint").alias("last_no"))


@query()
def split_recursive(spark, d):
    return chunking.recursive(table(spark, d, "documents"), "doc_id", "text", 300, 60)


@query()
def chunk_documents(spark, d):
    out, _ = clean.clean(_blocks(spark, d), "source_file", "block_id")
    pos = _blocks(spark, d).select("block_id", "page_pos")
    p = out.join(pos, "block_id").withColumn("stem", F.regexp_replace("source_file", r"\.[^.]*$", ""))
    return chunking.chunk_documents(p, "stem", "cleaned_text").drop("page_content")


# ---- retrieval -----------------------------------------------------------------------------------
_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_DENSE = f"""(SELECT q.vec_id AS qid, e.vec_id AS id, {_COS.format('q.embedding', 'e.embedding')} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)"""
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM {_DENSE})"


def _dense(spark, d, k):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.dense_search(e.where("id % 50 = 0"), e, k, exclude_self=True)


@query(f"SELECT qid, id, round(score, 6) AS score, rank FROM {_RANKED} WHERE rank <= 10")
def dense_topk(spark, d):
    return _dense(spark, d, 10).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS raw_square, 1.0 AS unit_square FROM embeddings WHERE embedding IS NOT NULL")
def unit_vectors(spark, d):
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.round(square(F.col("embedding")), 6).alias("raw_square"), F.round(square(retrieval.unit(F.col("embedding"))), 6).alias("unit_square"))


@query("SELECT coalesce(min(len(embedding)) = 64 AND max(len(embedding)) = 64, true) AS ok, min(len(embedding)) AS least, max(len(embedding)) AS most, count(*) AS n FROM child_chunks WHERE embedding IS NOT NULL")
def vector_dimension(spark, d):
    out = manifest.check_dimension(table(spark, d, "child_chunks"), "embedding", 64)
    return out.select("ok", F.col("least").cast("bigint").alias("least"), F.col("most").cast("bigint").alias("most"), "n")


_TITLES = f"(SELECT DISTINCT slide_title AS qid FROM {BLOCKS} WHERE slide_title IS NOT NULL)"


def _sparse_sql(queries: str, text: str = "qid", x: str = "", k: int = 30) -> str:
    """CTEs up to ``sparse`` (qid, id, score, rank) of full-text search in all chunks; x stands before their names."""
    return f"""
 {x}ch AS MATERIALIZED (SELECT child_id, {TOKENS.format('content')} AS toks FROM {CHILDREN} WHERE content IS NOT NULL),
 {x}post AS MATERIALIZED (SELECT child_id AS id, unnest(toks) AS term, unnest(range(1, len(toks) + 1)) AS pos FROM {x}ch),
 {x}q AS MATERIALIZED (SELECT qid, list_distinct({TOKENS.format(text)}) AS terms FROM {queries}),
 {x}qt AS MATERIALIZED (SELECT qid, len(terms) AS n, unnest(terms) AS term FROM {x}q WHERE len(terms) > 0),
 {x}full_hits AS MATERIALIZED (SELECT qid, n, id FROM {x}qt JOIN (SELECT DISTINCT id, term FROM {x}post) USING (term) GROUP BY ALL HAVING count(*) = n),
 {x}occ AS MATERIALIZED (SELECT f.qid, f.n, f.id, p.term, p.pos FROM {x}full_hits f JOIN {x}qt ON {x}qt.qid = f.qid JOIN {x}post p ON p.id = f.id AND p.term = {x}qt.term),
 {x}one AS (SELECT qid, id, sum(0.1 / (j * j)) / 1.64493406685 AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY pos) AS j FROM {x}occ WHERE n = 1) GROUP BY ALL),
 {x}many AS (SELECT a.qid, a.id, 1 - exp(sum(ln(1 - sqrt(0.01 * CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30 ELSE 1.0 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2.0)) END)))) AS score
   FROM {x}occ a JOIN {x}occ b ON a.qid = b.qid AND a.id = b.id AND a.term < b.term WHERE a.n > 1 GROUP BY ALL),
 {x}sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT * FROM {x}one UNION ALL SELECT * FROM {x}many) QUALIFY rank <= {k})"""


_SPARSE = _sparse_sql(_TITLES)


def _postings(spark, d):
    """The full-text index of all chunks."""
    return _kept(spark, d, "postings", lambda: retrieval.postings(_children(spark, d).where("content is not null"), "child_id", "content"))


def _sparse(spark, d, k=30):
    titles = _blocks(spark, d).where("slide_title is not null").select(F.col("slide_title").alias("qid")).distinct()
    return retrieval.sparse_search(titles.select("qid", T.tokens(F.col("qid")).alias("terms")), _postings(spark, d), k)


@query(f"WITH {_SPARSE} SELECT qid, id, round(score, 6) AS score, rank FROM sparse")
def sparse_topk(spark, d):
    """The distinct page titles as queries against all chunks."""
    return _sparse(spark, d).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""
WITH t AS (SELECT id, unnest({TOKENS.format('user_original')}) AS term FROM {TURNS} WHERE user_original IS NOT NULL),
 tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM {TURNS} WHERE user_original IS NOT NULL),
 idf AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM tf, n GROUP BY term, n), w AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term))
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""")
def tfidf_weights(spark, d):
    return retrieval.tf_idf(_turns(spark, d), "id", "user_original").select("id", "term", F.round("weight", 6).alias("weight"))


_LABELS = "(SELECT q.vec_id AS qid, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(q.vec_id - e.vec_id), e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 30)"


@query(f"""
WITH every_hit AS (SELECT qid, id, rank, 0 AS list FROM {_RANKED} WHERE rank <= 70 UNION ALL SELECT qid, id, rank, 1 FROM {_LABELS}),
 f AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS rrf, min(CASE WHEN list = 0 THEN rank END) AS rank_0, min(CASE WHEN list = 1 THEN rank END) AS rank_1, min(list) AS first_list, arg_min(rank, list) AS first_rank FROM every_hit GROUP BY ALL)
SELECT qid, id, round(rrf, 9) AS rrf_score, rank_0, rank_1, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, first_list, first_rank, id) AS rank FROM f QUALIFY rank <= 20""")
def rrf_fusion(spark, d):
    """Cosine neighbours fused with the neighbours by number under the same label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label")
    same = q.join(e, "label").where("qid <> vec_id").select("qid", F.col("vec_id").alias("id"))
    near = retrieval.top_k(same, 30, ["qid"], [F.abs(F.col("qid") - F.col("id")), "id"])
    fused = retrieval.fuse([_dense(spark, d, 70), near], 60, 20)
    return fused.select("qid", "id", F.round("rrf_score", 9).alias("rrf_score"), F.col("rank_0").cast("bigint").alias("rank_0"), F.col("rank_1").cast("bigint").alias("rank_1"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""
WITH {_SPARSE}, scope AS (SELECT DISTINCT source_file AS name FROM documents WHERE original_extension = '.pdf')
SELECT qid, id, rank FROM sparse JOIN {CHILDREN} c ON c.child_id = id WHERE c.source_file IN (SELECT name FROM scope) OR c.source IN (SELECT name FROM scope)""")
def scope_post_filter(spark, d):
    c = _children(spark, d).select(F.col("child_id").alias("id"), "source", "source_file")
    hits = _sparse(spark, d).join(c, "id")
    scope = table(spark, d, "documents").where("original_extension = '.pdf'").select(F.col("source_file").alias("name")).distinct()
    return retrieval.in_scope(hits, scope).select("qid", "id", F.col("rank").cast("bigint").alias("rank")).distinct()


@query(f"""
WITH {_SPARSE}, gone AS (SELECT DISTINCT unnest(gold_parent_ids) AS parent_id FROM {QUESTIONS})
SELECT qid, id, rank FROM sparse JOIN {CHILDREN} c ON c.child_id = id WHERE c.parent_id NOT IN (SELECT parent_id FROM gone WHERE parent_id IS NOT NULL)""")
def exclude_parents(spark, d):
    c = _children(spark, d).select(F.col("child_id").alias("id"), "parent_id")
    gone = _questions(spark, d).select(F.explode("gold_parent_ids").alias("parent_id")).distinct()
    return _sparse(spark, d).join(c, "id").join(gone, "parent_id", "left_anti").select("qid", "id", F.col("rank").cast("bigint").alias("rank"))


# Candidates of a question: what hybrid search finds in all chunks. No model is installed, so the vector of a question is
# the stored one of its first gold chunk; a question without one is searched by its words only.
_VALID = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL)) = 0 AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda e: e * e)) > 0"
_CANDIDATES = f"""h_items AS MATERIALIZED (SELECT child_id AS id, embedding AS v FROM {CHILDREN} WHERE {_VALID}),
 h_dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT q.question_id AS qid, i.id, {_COS.format('o.v', 'i.v')} AS score FROM {QUESTIONS} q JOIN h_items o ON o.id = q.gold_child_ids[1] CROSS JOIN h_items i) QUALIFY rank <= 70),
 {_sparse_sql(f"(SELECT question_id AS qid, question FROM {QUESTIONS} WHERE question IS NOT NULL)", "question", "h_")},
 h_every AS (SELECT qid, id, rank, 0 AS list FROM h_dense UNION ALL SELECT qid, id, rank, 1 FROM h_sparse),
 h_fused AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS rrf_score, min(list) AS first_list, arg_min(rank, list) AS first_rank FROM h_every GROUP BY ALL),
 h_top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf_score, 12) DESC, first_list, first_rank, id) AS rank FROM h_fused QUALIFY rank <= 40),
 cand AS (SELECT q.question_id, q.question, c.child_id, c.parent_id, c.chunk_index, c.source, c.source_file, c.content, t.rrf_score, t.rank
   FROM h_top t JOIN {QUESTIONS} q ON q.question_id = t.qid JOIN {CHILDREN} c ON c.child_id = t.id)"""


def _searched(spark, d):
    """(question_id, child_id, rrf_score, rank): the hits of all questions, searched once for all queries of a session that start from them."""

    def run():
        c = _children(spark, d)
        whole = F.col("embedding").isNotNull() & (F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull()) & (F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0)
        items = c.where(whole).select(F.col("child_id").alias("id"), F.col("embedding").alias("v"))
        q = _questions(spark, d).select("question_id", "question", F.get("gold_child_ids", F.lit(0)).alias("id"))
        index = _postings(spark, d)
        asked = materialize(q.join(items, "id", "left").select(F.col("question_id").alias("qid"), "v", F.col("question").alias("text")), "questions")  # both searches start from it
        top = retrieval.hybrid(asked, items, index)
        return top.select(F.col("qid").alias("question_id"), F.col("id").alias("child_id"), "rrf_score", "rank")

    return _kept(spark, d, "searched", run)


def _asked(spark, d):
    """The questions, each once."""
    return _kept(spark, d, "asked", lambda: _questions(spark, d))


def _chunks(spark, d):
    """The chunks without their vectors, each once."""
    return _kept(spark, d, "chunks", lambda: _children(spark, d).select("child_id", "parent_id", "chunk_index", "source", "source_file", "content"))


def _candidates(spark, d, most=None):
    """The hits of all questions, or the first ``most`` of each, without texts."""
    hits = _kept(spark, d, "candidates", lambda: _searched(spark, d).where("question_id is not null").join(_chunks(spark, d).drop("content"), "child_id"))
    return hits if most is None else hits.where(F.col("rank") <= most)


def _texts(spark, d, most):
    """The same with their texts, which are joined to those that are asked for."""
    return _candidates(spark, d, most).join(_chunks(spark, d).select("child_id", "content"), "child_id")


@query(f"WITH {_CANDIDATES} SELECT question_id, child_id, round(rrf_score, 9) AS rrf_score, rank FROM cand")
def hybrid_search(spark, d):
    """Dense and sparse search of the same chunks for every question, fused."""
    return _searched(spark, d).select("question_id", "child_id", F.round("rrf_score", 9).alias("rrf_score"), F.col("rank").cast("bigint").alias("rank"))


_OVERLAP = f"(CASE WHEN len(list_distinct({TOKENS.format('question')})) > 0 THEN len(list_intersect(list_distinct({TOKENS.format('question')}), list_distinct({TOKENS.format('content')}))) / len(list_distinct({TOKENS.format('question')})) ELSE 0.0 END)"


@query(f"""
WITH {_CANDIDATES}, s AS (SELECT question_id, child_id, rank, {_OVERLAP} AS score FROM cand WHERE content IS NOT NULL)
SELECT question_id, child_id, round(score, 6) AS rerank_score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, rank) AS rerank_rank FROM s WHERE score >= 0.1 QUALIFY rerank_rank <= 3""")
def rerank_threshold_topk(spark, d):
    c = _candidates(spark, d).select("question_id", "child_id", "rank").join(_asked(spark, d).select("question_id", "question"), "question_id").withColumnRenamed("question_id", "qid")
    c = c.join(_chunks(spark, d).where("content is not null").select("child_id", "content"), "child_id")
    r = retrieval.rerank(c, retrieval.overlap_score(F.col("question"), F.col("content")), 3, 0.1)
    return r.select(F.col("qid").alias("question_id"), "child_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rerank_rank").cast("bigint").alias("rerank_rank"))


def _any(markers: list[str]) -> str:
    import re

    return "regexp_matches(lower(question), '" + "|".join(re.escape(m).replace("\\ ", " ") for m in markers) + "')"


_MOST = f"WITH {_CANDIDATES}, top3 AS (SELECT * FROM cand WHERE rank <= 3), m AS (SELECT question_id, max(n) AS most_hits FROM (SELECT question_id, parent_id, count(*) AS n FROM top3 GROUP BY ALL) GROUP BY ALL)"


def _with_most(spark, d):
    """The questions with most_hits of their first three hits, for which neither texts of chunks nor later hits are written."""

    def run():
        first = _searched(spark, d).where("question_id is not null and rank <= 3").select(F.col("question_id").alias("qid"), "child_id")
        m = context.most_hits(first.join(_children(spark, d).select("child_id", "parent_id"), "child_id")).withColumnRenamed("qid", "question_id")
        return _questions(spark, d).select("question_id", "question", "question_type").join(m, "question_id", "left")

    return _kept(spark, d, "with_most", run)


@query(f"""{_MOST}
SELECT question_id, CASE WHEN {_any(context.BROAD)} OR coalesce(most_hits, 0) >= 2 THEN 'parent' WHEN {_any(context.FACT)} THEN 'child' ELSE 'neighbor' END AS policy,
 CASE WHEN {_any(context.BROAD)} THEN 'query_requires_broad_context' WHEN coalesce(most_hits, 0) >= 2 THEN 'multiple_child_hits_same_parent' WHEN {_any(context.FACT)} THEN 'fact_query' ELSE 'default_neighbor_context' END AS reason
FROM {QUESTIONS} LEFT JOIN m USING (question_id)""")
def context_policy(spark, d):
    name, reason = context.policy(F.col("question"), F.coalesce("most_hits", F.lit(0)), F.lit(False))
    return _with_most(spark, d).select("question_id", name.alias("policy"), reason.alias("reason"))


@query(f"""{_MOST}
SELECT question_id, CASE WHEN {_any(context.ABLATION_BROAD)} THEN 'parent' WHEN coalesce(most_hits, 0) >= 2 THEN 'neighbor' WHEN {_any(context.ABLATION_FACT)} THEN 'child' ELSE 'neighbor' END AS policy
FROM {QUESTIONS} LEFT JOIN m USING (question_id)""")
def ablation_policy(spark, d):
    return _with_most(spark, d).select("question_id", context.ablation_policy(F.col("question"), F.coalesce("most_hits", F.lit(0))).alias("policy"))


@query(f"""
WITH g AS (SELECT question_id, unnest(gold_child_ids) AS child_id, unnest(range(len(gold_child_ids))) AS request_order FROM {QUESTIONS}),
 a AS (SELECT g.question_id, g.request_order, c.parent_id, c.chunk_index FROM g JOIN {CHILDREN} c USING (child_id) WHERE c.chunk_index IS NOT NULL)
SELECT a.question_id, c.child_id, min(request_order) AS request_order FROM a JOIN {CHILDREN} c ON c.parent_id = a.parent_id AND c.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 1 GROUP BY ALL""")
def neighbor_window(spark, d):
    c = _children(spark, d).select("child_id", "parent_id", "chunk_index")
    g = _questions(spark, d).select(F.col("question_id").alias("qid"), F.posexplode("gold_child_ids").alias("request_order", "child_id"))
    near = context.neighbours(g.join(c.where("chunk_index is not null"), "child_id").drop("child_id"), c)
    return near.select(F.col("qid").alias("question_id"), "child_id", F.col("request_order").cast("bigint").alias("request_order"))


@query(f"""
WITH {_CANDIDATES}, h AS (SELECT question_id, parent_id, arg_max(rrf_score, rank) AS score, arg_max(coalesce(content, ''), rank) AS last_content, min(rank) AS met FROM cand WHERE rank <= 10 GROUP BY ALL),
 gone AS (SELECT DISTINCT parent_id FROM {CHILDREN} GROUP BY parent_id HAVING min(source_file) IS NULL), stored AS (SELECT parent_id, page_content FROM {PARENTS} WHERE metadata IS NOT NULL),
 j AS (SELECT h.*, s.page_content, s.parent_id IS NOT NULL AS ok, coalesce(TRY_CAST(regexp_extract(h.parent_id, '_parent_(\\d+)$', 1) AS INT), 0) AS o, coalesce(TRY_CAST(regexp_extract(h.parent_id, '_page_(\\d+)_parent_', 1) AS INT), 0) AS p FROM h LEFT JOIN stored s USING (parent_id))
SELECT question_id, parent_id, md5(CASE WHEN ok THEN coalesce({STRIP.format('page_content')}, '') ELSE last_content END) AS content_hash, CASE WHEN ok THEN 'parent' ELSE 'child' END AS context_type, round(score, 9) AS score,
 row_number() OVER (PARTITION BY question_id ORDER BY ok DESC, CASE WHEN ok THEN o ELSE met END, CASE WHEN ok THEN p ELSE 0 END, CASE WHEN ok THEN parent_id ELSE '' END) AS ctx_pos FROM j""".replace(f" gone AS (SELECT DISTINCT parent_id FROM {CHILDREN} GROUP BY parent_id HAVING min(source_file) IS NULL),", ""))
def parent_fallback(spark, d):
    """Parents of the first ten hits; those whose metadata was lost count as not stored and fall back to their last hit."""
    hits = _texts(spark, d, 10).select(F.col("question_id").alias("qid"), "rank", "parent_id", "child_id", "chunk_index", "source", F.coalesce("content", F.lit("")).alias("content"), F.col("rrf_score").alias("score"))
    out = context.parents(hits, _stored(spark, d).where("metadata is not null"))
    from pyspark.sql import Window

    out = out.withColumn("ctx_pos", F.row_number().over(Window.partitionBy("qid").orderBy("place")).cast("bigint"))
    return out.select(F.col("qid").alias("question_id"), "parent_id", F.md5("content").alias("content_hash"), "context_type", F.round("score", 9).alias("score"), "ctx_pos")


def _stored(spark, d):
    return _parents(spark, d).select("parent_id", "page_content", F.get_json_object("metadata", "$.source").alias("source"), "metadata")


# Parents asked for besides (of questions tagged with two gold parents the second) and those excluded (every gold parent of a question without gold chunks).
_KEEP = f"(SELECT question_id AS qid, gold_parent_ids[2] AS parent_id, 0 AS pos FROM {QUESTIONS} WHERE len(gold_parent_ids) > 1 AND gold_parent_ids[2] IS NOT NULL)"
_EXCLUDE = f"(SELECT DISTINCT question_id AS qid, unnest(gold_parent_ids) AS parent_id FROM {QUESTIONS} WHERE coalesce(len(gold_child_ids), 0) = 0)"


def _researched(spark, d):
    q = _asked(spark, d)
    keep = q.select(F.col("question_id").alias("qid"), F.get("gold_parent_ids", F.lit(1)).alias("parent_id"), F.lit(0).alias("pos")).where("parent_id is not null")
    exclude = q.where(F.coalesce(F.size("gold_child_ids"), F.lit(0)) <= 0).select(F.col("question_id").alias("qid"), F.explode("gold_parent_ids").alias("parent_id"))
    asked = q.select(F.col("question_id").alias("qid"), F.col("question").alias("query"), F.col("question_type").alias("focus"))
    return context.research(asked, _candidates(spark, d).withColumnRenamed("question_id", "qid"), _stored(spark, d), _chunks(spark, d), retrieval.overlap_score, keep, exclude)


_EFFECTIVE = "CASE WHEN coalesce(question_type, '') <> '' THEN question || chr(10) || 'Focus: ' || question_type ELSE question END"
_RESEARCH = f"""{_CANDIDATES}, e AS (SELECT question_id AS qid, {_EFFECTIVE} AS question FROM {QUESTIONS}),
 keep AS {_KEEP}, exclude AS {_EXCLUDE},
 rem AS (SELECT c.*, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS r FROM cand c WHERE NOT EXISTS (SELECT 1 FROM exclude x WHERE x.qid = c.question_id AND x.parent_id = c.parent_id)),
 sc AS (SELECT rem.question_id AS qid, r, child_id, parent_id, chunk_index, source, content, rrf_score, CASE WHEN content IS NULL THEN NULL ELSE {_OVERLAP.replace('question', 'e.question')} END AS rerank_score FROM rem JOIN e ON e.qid = rem.question_id WHERE r <= 40),
 hits AS MATERIALIZED (SELECT *, coalesce(nullif(rerank_score, 0), rrf_score) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 9) DESC, r) AS rank FROM sc WHERE rerank_score >= 0.3 QUALIFY rank <= 3),
 mh AS (SELECT qid, max(n) AS most FROM (SELECT qid, parent_id, count(*) AS n FROM hits GROUP BY ALL) GROUP BY ALL),
 pol AS (SELECT e.qid, CASE WHEN k.qid IS NOT NULL OR {{broad}} OR coalesce(most, 0) >= 2 THEN 'parent' WHEN {{fact}} THEN 'child' ELSE 'neighbor' END AS policy,
   CASE WHEN k.qid IS NOT NULL THEN 'keep_parent_ids_requested' WHEN {{broad}} THEN 'query_requires_broad_context' WHEN coalesce(most, 0) >= 2 THEN 'multiple_child_hits_same_parent' WHEN {{fact}} THEN 'fact_query' ELSE 'default_neighbor_context' END AS reason
   FROM e LEFT JOIN mh USING (qid) LEFT JOIN (SELECT DISTINCT qid FROM keep) k ON k.qid = e.qid),
 c_child AS (SELECT h.qid, parent_id, child_id, source, coalesce(content, '') AS content, 'child' AS context_type, score, 0 AS a, rank AS b, 0 AS c, '' AS d FROM hits h JOIN pol USING (qid) WHERE policy = 'child'),
 nb AS (SELECT h.qid, n.child_id, n.parent_id, n.chunk_index, n.source, n.content, min(h.rank) AS b FROM hits h JOIN pol USING (qid) JOIN {CHILDREN} n ON n.parent_id = h.parent_id AND n.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 WHERE policy = 'neighbor' GROUP BY ALL),
 c_near AS (SELECT nb.qid, nb.parent_id, nb.child_id, nb.source, {STRIP.format("coalesce(nb.content, '')")} AS content, 'neighbor_child' AS context_type, coalesce(o.score, bp.score) AS score, 0 AS a, nb.b, nb.chunk_index AS c, '' AS d
   FROM nb LEFT JOIN hits o ON o.qid = nb.qid AND o.child_id = nb.child_id LEFT JOIN (SELECT qid, parent_id, max(score) AS score FROM hits GROUP BY ALL) bp ON bp.qid = nb.qid AND bp.parent_id = nb.parent_id),
 c_rest AS (SELECT h.qid, parent_id, child_id, source, coalesce(content, '') AS content, 'child' AS context_type, score, 1 AS a, rank AS b, 0 AS c, '' AS d FROM hits h JOIN pol USING (qid) WHERE policy = 'neighbor' AND NOT EXISTS (SELECT 1 FROM nb WHERE nb.qid = h.qid AND nb.child_id = h.child_id)),
 ids AS (SELECT qid, parent_id, min(met_at) AS met_at FROM (SELECT qid, parent_id, pos - 1073741824 AS met_at FROM keep UNION ALL SELECT qid, parent_id, rank FROM hits WHERE coalesce(parent_id, '') <> '') GROUP BY ALL),
 lasts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY qid, parent_id ORDER BY rank DESC) = 1),
 pj AS (SELECT i.qid, i.parent_id, i.met_at, p.parent_id IS NOT NULL AS ok, l.child_id, l.source AS l_source, l.content AS l_content, l.score, coalesce(json_extract_string(p.metadata, '$.source'), 'unknown') AS p_source, coalesce({STRIP.format('p.page_content')}, '') AS p_content
   FROM ids i JOIN pol ON pol.qid = i.qid AND policy = 'parent' LEFT JOIN lasts l ON l.qid = i.qid AND l.parent_id = i.parent_id LEFT JOIN {PARENTS} p ON p.parent_id = i.parent_id WHERE p.parent_id IS NOT NULL OR l.qid IS NOT NULL),
 c_parent AS (SELECT qid, parent_id, CASE WHEN NOT ok THEN child_id END AS child_id, CASE WHEN ok THEN p_source ELSE l_source END AS source, CASE WHEN ok THEN p_content ELSE l_content END AS content, CASE WHEN ok THEN 'parent' ELSE 'child' END AS context_type, score, CASE WHEN ok THEN 0 ELSE 1 END AS a,
   CASE WHEN ok THEN coalesce(TRY_CAST(regexp_extract(parent_id, '_parent_(\\d+)$', 1) AS INT), 0) ELSE met_at END AS b, CASE WHEN ok THEN coalesce(TRY_CAST(regexp_extract(parent_id, '_page_(\\d+)_parent_', 1) AS INT), 0) ELSE 0 END AS c, CASE WHEN ok THEN parent_id ELSE '' END AS d FROM pj),
 ctx AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY a, b, c, d) AS ctx_pos FROM (SELECT * FROM c_child UNION ALL SELECT * FROM c_near UNION ALL SELECT * FROM c_rest UNION ALL SELECT * FROM c_parent))"""
_RESEARCH = _RESEARCH.replace("{broad}", _any(context.BROAD)).replace("{fact}", _any(context.FACT))


@query(f"WITH {_RESEARCH} SELECT qid, ctx_pos, parent_id, child_id, source, context_type, md5(content) AS content_hash, round(score, 9) AS score FROM ctx")
def research_contexts(spark, d):
    """The contexts of research for every question: hybrid search, excluded and kept parents, reranking, policy."""
    _, contexts = _researched(spark, d)
    return contexts.select("qid", F.col("ctx_pos").cast("bigint").alias("ctx_pos"), "parent_id", "child_id", "source", "context_type", F.md5("content").alias("content_hash"), F.round("score", 9).alias("score"))


@query(f"""
WITH {_RESEARCH}, n AS (SELECT qid, count(*) AS n, sum(length(content)) AS chars, string_agg(DISTINCT nullif(source, ''), '|' ORDER BY nullif(source, '')) AS sources FROM ctx GROUP BY ALL),
 ip AS (SELECT qid, string_agg(parent_id, '|' ORDER BY met_at, parent_id) AS parents FROM ids GROUP BY ALL), hs AS (SELECT qid, count(*) AS reranked, max(rerank_score) AS best FROM hits GROUP BY ALL),
 cc AS (SELECT question_id AS qid, count(*) AS candidates FROM cand GROUP BY ALL), rc AS (SELECT question_id AS qid, count(*) AS remaining FROM rem GROUP BY ALL)
SELECT pol.qid, policy, reason, coalesce(n, 0) AS n_contexts, coalesce(chars, 0) AS chars, coalesce(sources, '') AS sources, coalesce(parents, '') AS parents, coalesce(candidates, 0) AS candidates, coalesce(reranked, 0) AS reranked, round(best, 9) AS best,
 CASE WHEN coalesce(n, 0) > 0 THEN '' ELSE 'No relevant document context was retrieved.' END AS gaps, CASE WHEN coalesce(n, 0) > 0 THEN 'sufficient' WHEN coalesce(remaining, 0) > 0 THEN 'low_score' ELSE 'insufficient' END AS status
FROM pol LEFT JOIN n USING (qid) LEFT JOIN ip USING (qid) LEFT JOIN hs USING (qid) LEFT JOIN cc USING (qid) LEFT JOIN rc USING (qid)""")
def research(spark, d):
    """The result of research for every question, with its diagnostics as columns; research_json packs the same."""
    r, _ = _researched(spark, d)
    x = F.col("diagnostics")
    return r.select(
        "qid", x["context_policy"].alias("policy"), x["context_policy_reason"].alias("reason"), x["contexts"].alias("n_contexts"), x["returned_context_chars"].alias("chars"), F.array_join("sources", "|").alias("sources"), F.array_join("parent_ids", "|").alias("parents"),
        x["child_candidates"].alias("candidates"), x["reranked_contexts"].alias("reranked"), F.round(x["best_rerank_score"], 9).alias("best"), F.array_join("gaps", "|").alias("gaps"), x["evidence_status"].alias("status"),
    )


@query()
def research_json(spark, d):
    return context.research_json(_researched(spark, d)[0])


@query(f"""WITH {_CANDIDATES} SELECT q.question_id AS qid, md5(coalesce(string_agg('Parent ID: ' || coalesce(parent_id, '') || chr(10) || 'File Name: ' || coalesce(source, '') || chr(10) || 'Content: ' || {STRIP.format("coalesce(content, '')")}, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE rank IS NOT NULL), 'NO_RELEVANT_CHUNKS')) AS h
 FROM (SELECT question_id FROM {QUESTIONS}) q LEFT JOIN (SELECT * FROM cand WHERE rank <= 5) c USING (question_id) GROUP BY ALL""")
def hits_text(spark, d):
    hits = _texts(spark, d, 5).withColumnRenamed("question_id", "qid")
    return context.hits_text(hits, _asked(spark, d).select(F.col("question_id").alias("qid"))).select("qid", F.md5("text").alias("h"))


@query(f"""
WITH a AS (SELECT DISTINCT question_id AS qid, unnest(gold_parent_ids) AS parent_id FROM {QUESTIONS}), j AS (SELECT a.qid, a.parent_id, p.page_content, coalesce(json_extract_string(p.metadata, '$.source'), 'unknown') AS src, coalesce(TRY_CAST(regexp_extract(a.parent_id, '_parent_(\\d+)$', 1) AS INT), 0) AS o, coalesce(TRY_CAST(regexp_extract(a.parent_id, '_page_(\\d+)_parent_', 1) AS INT), 0) AS pg FROM a LEFT JOIN {PARENTS} p USING (parent_id))
SELECT qid, md5(coalesce(string_agg('Parent ID: ' || parent_id || chr(10) || 'File Name: ' || src || chr(10) || 'Content: ' || {STRIP.format("page_content")}, chr(10) || chr(10) ORDER BY o, pg, parent_id) FILTER (WHERE page_content IS NOT NULL), 'NO_PARENT_DOCUMENTS')) AS h FROM j GROUP BY ALL""")
def parents_text(spark, d):
    asked = _questions(spark, d).select(F.col("question_id").alias("qid"), F.explode("gold_parent_ids").alias("parent_id"))
    return context.parents_text(asked, _parents(spark, d).select("parent_id", "page_content", "metadata")).select("qid", F.md5("text").alias("h"))


@query(f"SELECT qid, id, rank FROM {_RANKED} WHERE rank <= 20")
def search_dense_mode(spark, d):
    return retrieval.search("dense", _dense(spark, d, 70), None, 20).withColumn("rank", F.col("rank").cast("bigint"))


_IMAGES = "im AS (SELECT doc_id, unnest(['img%20' || doc_id || '.png', 'http://x/' || doc_id || '.png', 'a.png']) AS path, unnest([0, 1, 2]) AS ref_no FROM documents WHERE text IS NOT NULL)"


def _illustrated(spark, d):
    docs = table(spark, d, "documents").where("text is not null").where(~F.col("text").rlike(r"!\[[^\]]*\]\("))
    i = F.col("doc_id").cast("string")
    return docs.select("doc_id", F.concat("text", F.lit("\n![one](img%20"), i, F.lit('.png "a title")\n![two](http://x/'), i, F.lit(".png)\n![three](<a.png>)\n")).alias("text"))


@query(f"WITH {_IMAGES} SELECT doc_id, ref_no, replace(path, '%20', ' ') AS path, starts_with(path, 'http') AS is_remote FROM im")
def image_references(spark, d):
    """Three references are added to every document: with a title, remote, in angle brackets."""
    return images.references(_illustrated(spark, d), "doc_id", "text")


@query(f"WITH {_IMAGES} SELECT doc_id, ref_no, replace(path, '%20', ' ') AS path FROM im WHERE ref_no = 0 OR (ref_no = 2 AND false)")
def image_selection(spark, d):
    sizes = spark.createDataFrame([("a.png", 10, 10)], "path string, width int, height int")
    return images.describable(images.references(_illustrated(spark, d), "doc_id", "text"), "doc_id", sizes, 64, 64)


@query()
def image_contexts(spark, d):
    return images.contexts(_illustrated(spark, d), "doc_id", "text")


@query()
def image_enrichment(spark, d):
    docs = _illustrated(spark, d)
    notes = images.references(docs, "doc_id", "text").where("ref_no = 0").select("doc_id", "ref_no", F.concat(F.lit("RAG_SUMMARY: picture "), "path").alias("description"))
    return images.enrich(docs, "doc_id", "text", notes)


# ---- evaluation ----------------------------------------------------------------------------------
_G = f"""q AS (SELECT question_id, source_file, list_distinct(list_filter(coalesce(gold_child_ids, []), lambda x: x IS NOT NULL)) AS cg, list_distinct(list_filter(coalesce(gold_parent_ids, []), lambda x: x IS NOT NULL)) AS pg,
   list_distinct(list_filter(coalesce(gold_source_files, []), lambda x: x IS NOT NULL)) AS sg FROM {QUESTIONS}),
 r AS (SELECT question_id, rank, child_id AS chunk_id, parent_id, source_file FROM cand WHERE rank <= 20),
 g AS (SELECT q.question_id, q.cg, q.pg, q.sg, r.rank, r.chunk_id, r.parent_id, r.source_file, CASE WHEN len(cg) > 0 THEN list_contains(cg, chunk_id) ELSE list_contains(pg, parent_id) END AS rel,
   CASE WHEN list_contains(cg, chunk_id) THEN 3 WHEN list_contains(pg, parent_id) THEN 2 WHEN len(cg) = 0 AND len(pg) = 0 AND list_contains(sg, r.source_file) THEN 1 ELSE 0 END AS grade FROM q LEFT JOIN r ON r.question_id = q.question_id)"""


def _results(spark, d):
    return _candidates(spark, d, 20).select("question_id", "rank", F.col("child_id").alias("chunk_id"), "parent_id", "source_file")


def _per_k(k: int) -> str:
    c = f"count(DISTINCT chunk_id) FILTER (WHERE rank <= {k} AND list_contains(cg, chunk_id))"
    p = f"count(DISTINCT parent_id) FILTER (WHERE rank <= {k} AND list_contains(pg, parent_id))"
    s = f"count(DISTINCT source_file) FILTER (WHERE rank <= {k} AND list_contains(sg, source_file))"
    rel = f"(CASE WHEN len(cg) > 0 THEN {c} ELSE {p} END)"
    gold = "(CASE WHEN len(cg) > 0 THEN len(cg) ELSE len(pg) END)"
    dcg = f"coalesce(sum((pow(2.0, grade) - 1) / log2(rank + 1.0)) FILTER (WHERE rank <= {k}), 0)"
    n = f"least((CASE WHEN len(cg) > 0 THEN len(cg) WHEN len(pg) > 0 THEN len(pg) ELSE len(sg) END), {k})"
    ig = "(CASE WHEN len(cg) > 0 THEN 3 WHEN len(pg) > 0 THEN 2 ELSE 1 END)"
    idcg = f"list_sum(list_transform(range(1, {n} + 1), lambda i: (pow(2.0, {ig}) - 1) / log2(i + 1.0)))"
    f = lambda num, den: f"CASE WHEN {den} > 0 THEN round({num} / {den}, 6) ELSE 0.0 END"
    return (
        f"{f(rel, gold)} AS recall_{k}, CASE WHEN {rel} > 0 THEN 1.0 ELSE 0.0 END AS hitrate_{k}, round({rel} / {k}.0, 6) AS precision_{k}, {f(c, 'len(cg)')} AS child_recall_{k}, {f(p, 'len(pg)')} AS parent_recall_{k}, "
        f"CASE WHEN {s} > 0 THEN 1.0 ELSE 0.0 END AS source_hitrate_{k}, CASE WHEN {n} > 0 THEN round({dcg} / {idcg}, 6) ELSE 0.0 END AS ndcg_{k}, count(rank) FILTER (WHERE rank <= {k}) AS actual_results_{k}"
    )


_SCORES = f"""WITH {_CANDIDATES}, {_G}, scores AS (SELECT question_id, min(rank) FILTER (WHERE rel) AS first_relevant_rank, round(coalesce(1.0 / min(rank) FILTER (WHERE rel), 0), 6) AS mrr, len(cg) > 0 OR len(pg) > 0 AS scored,
 len(cg) > 0 AS has_child_gold, len(pg) > 0 AS has_parent_gold, len(sg) > 0 AS has_source_gold, {", ".join(_per_k(k) for k in evaluation.K_VALUES)} FROM g GROUP BY question_id, cg, pg, sg)"""


def _tidy(df):
    return df.select(*((F.round(c, 6) if t == "double" else F.col(c).cast("bigint") if t == "int" else F.col(c)).alias(c) for c, t in df.dtypes))


@query(f"{_SCORES} SELECT * FROM scores")
def retrieval_metrics(spark, d):
    return _tidy(evaluation.score_questions(_asked(spark, d), _results(spark, d)))


_AGG = ["avg(mrr) FILTER (WHERE scored) AS mrr"]
for _k in evaluation.K_VALUES:
    _AGG += [f"coalesce(avg({m}_{_k}) FILTER (WHERE scored), 0) AS {m}_{_k}" for m in ("recall", "hitrate", "precision", "ndcg")]
    _AGG += [f"coalesce(avg({m}_{_k}) FILTER (WHERE {g}), 0) AS {m}_{_k}" for m, g in (("child_recall", "has_child_gold"), ("parent_recall", "has_parent_gold"), ("source_hitrate", "has_source_gold"))]
    _AGG += [f"coalesce(avg(actual_results_{_k}), 0) AS actual_results_{_k}"]


@query(f"{_SCORES} SELECT metric, round(value, 4) AS value FROM (UNPIVOT (SELECT {', '.join(_AGG)}, count(*)::DOUBLE AS rows, count(*) FILTER (WHERE scored)::DOUBLE AS scored_rows, CASE WHEN count(*) FILTER (WHERE scored) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS evaluation_valid FROM scores) ON COLUMNS(*) INTO NAME metric VALUE value)")
def metric_means(spark, d):
    m = evaluation.aggregate_scores(_tidy(evaluation.score_questions(_asked(spark, d), _results(spark, d))))
    return m.select("metric", F.round("value", 4).alias("value"))


@query(f"""{_SCORES} SELECT * FROM (SELECT s.question_id, CASE WHEN q.source_file IS NOT NULL AND q.source_file <> '' AND source_hitrate_5 = 0 THEN 'missed_source' WHEN has_parent_gold AND parent_recall_5 = 0 THEN 'missed_parent'
 WHEN has_child_gold AND child_recall_5 = 0 THEN 'missed_child' WHEN first_relevant_rank > 3 THEN 'bad_ranking' END AS failure_type, first_relevant_rank FROM scores s JOIN q USING (question_id)) WHERE failure_type IS NOT NULL""")
def failure_cases(spark, d):
    return _tidy(evaluation.failures(evaluation.score_questions(_asked(spark, d), _results(spark, d)), _asked(spark, d), 5))


_WARNINGS = f"""{_CANDIDATES}, {_G}, dup AS (SELECT question_id FROM eval_questions GROUP BY ALL HAVING count(*) > 1), res AS (SELECT * FROM r WHERE rank > 1 OR chunk_id IS NOT NULL),
 act AS (SELECT q.question_id, count(DISTINCT rank) AS actual FROM q LEFT JOIN res USING (question_id) GROUP BY ALL),
 warned AS (SELECT 'duplicate_question_id' AS code, 'error' AS severity, question_id, NULL::VARCHAR AS detail FROM dup
UNION ALL SELECT 'missing_result_row', 'warning', question_id, NULL FROM q WHERE question_id NOT IN (SELECT question_id FROM res)
UNION ALL SELECT 'missing_primary_gold', 'warning', question_id, NULL FROM q WHERE len(cg) = 0 AND len(pg) = 0
UNION ALL SELECT 'insufficient_results_for_k', 'warning', question_id, actual || '/' || k FROM act CROSS JOIN (SELECT unnest([1, 3, 5, 10, 20]) AS k) WHERE actual < k
UNION ALL SELECT 'score_threshold_ignored', 'warning', NULL, 'rrf'
UNION ALL SELECT 'no_scored_rows', 'error', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM q WHERE len(cg) > 0 OR len(pg) > 0)
UNION ALL SELECT 'gold_result_id_no_overlap', 'warning', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM q JOIN res USING (question_id) WHERE CASE WHEN len(cg) > 0 THEN list_contains(cg, chunk_id) ELSE list_contains(pg, parent_id) END))"""


def _warnings(spark, d):
    return evaluation.validate(table(spark, d, "eval_questions"), _results(spark, d), [1, 3, 5, 10, 20], 0.3, "rrf")


@query(f"WITH {_WARNINGS} SELECT * FROM warned")
def validity_warnings(spark, d):
    """Of the questions as delivered, repeated rows included."""
    return _warnings(spark, d)


@query(f"WITH {_WARNINGS}, per AS (SELECT code, count(*) AS n, count(*) FILTER (WHERE severity = 'error') AS e FROM warned GROUP BY ALL) SELECT 'retrieval' AS evaluation_type, (SELECT count(*) FROM eval_questions) AS rows, sum(n)::BIGINT AS warning_count, sum(e)::BIGINT AS error_count, sum(e) = 0 AS evaluation_valid, string_agg(code || '=' || n, ',' ORDER BY code) AS warning_codes FROM per")
def validity_summary(spark, d):
    return evaluation.validity_summary(_warnings(spark, d), table(spark, d, "eval_questions").count(), "retrieval")


@query(f"""
WITH s AS (SELECT coalesce(question_type, 'unknown') AS question_type, len(list_filter(coalesce(gold_source_files, []), lambda x: x IS NOT NULL)) > 0 AS s, len(list_filter(coalesce(gold_parent_ids, []), lambda x: x IS NOT NULL)) > 0 AS p, len(list_filter(coalesce(gold_child_ids, []), lambda x: x IS NOT NULL)) > 0 AS c FROM {QUESTIONS})
SELECT question_type, count(*) AS n, round(avg(s::INT), 4) AS source_coverage, round(avg(p::INT), 4) AS parent_coverage, round(avg(c::INT), 4) AS child_coverage FROM s GROUP BY ALL
UNION ALL SELECT 'total', count(*), round(avg(s::INT), 4), round(avg(p::INT), 4), round(avg(c::INT), 4) FROM s""")
def dataset_stats(spark, d):
    return evaluation.dataset_stats(_questions(spark, d))


# scores of a judge are made from lengths, so that some are low, some missing and some no number
_JUDGED = f"""j AS (SELECT question_id, CASE WHEN length(question) % 13 = 0 THEN 'nan'::DOUBLE ELSE (length(question) % 101) / 100.0 END AS faithfulness, CASE WHEN length(coalesce(reference_answer, '')) = 0 THEN NULL ELSE (length(reference_answer) % 101) / 100.0 END AS context_precision,
  (length(question_id || coalesce(reference_answer, '')) % 97) / 90.0 AS context_recall FROM {QUESTIONS})"""


def _judged(spark, d):
    q = _questions(spark, d)
    n = F.length(F.coalesce("reference_answer", F.lit("")))
    return q.select(
        "question_id", F.when(F.length("question") % 13 == 0, F.lit(float("nan"))).otherwise((F.length("question") % 101) / F.lit(100.0)).alias("faithfulness"), F.when(n == 0, None).otherwise((n % 101) / F.lit(100.0)).alias("context_precision"),
        (F.length(F.concat("question_id", F.coalesce("reference_answer", F.lit("")))) % 97 / F.lit(90.0)).alias("context_recall"),
    )


@query(f"WITH {_JUDGED} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg(greatest(0, least(1, {m}))) FILTER (WHERE NOT isnan({m})), 6) AS mean, count(*) FILTER (WHERE NOT isnan({m})) AS rows, count(*) - count(*) FILTER (WHERE NOT isnan({m})) AS missing_rows FROM j" for m in ("faithfulness", "context_precision", "context_recall")))
def judge_summary(spark, d):
    out = evaluation.judge_summary(_judged(spark, d), ["faithfulness", "context_precision", "context_recall"])
    return out.select("metric", F.round("mean", 6).alias("mean"), "rows", "missing_rows")


@query(f"""
WITH {_JUDGED}, v AS (SELECT question_id, CASE WHEN NOT isnan(faithfulness) THEN faithfulness END AS f, context_precision AS p, context_recall AS r FROM j),
 l AS (SELECT question_id, list_filter([CASE WHEN f < 0.75 THEN 'faithfulness' END, CASE WHEN p < 0.65 THEN 'context_precision' END, CASE WHEN r < 0.70 THEN 'context_recall' END], lambda x: x IS NOT NULL) AS low, list_filter([CASE WHEN f IS NULL THEN 'faithfulness' END, CASE WHEN p IS NULL THEN 'context_precision' END, CASE WHEN r IS NULL THEN 'context_recall' END], lambda x: x IS NOT NULL) AS miss FROM v)
SELECT question_id, CASE WHEN list_contains(low, 'context_recall') THEN 'insufficient_context' WHEN len(miss) > 0 THEN 'judge_metric_missing' WHEN list_contains(low, 'faithfulness') THEN 'hallucination' ELSE 'low_answer_quality' END AS failure_type, array_to_string(low, ',') AS low_metrics, array_to_string(miss, ',') AS missing_metrics
FROM l WHERE len(low) > 0 OR len(miss) > 0""")
def ragas_error_cases(spark, d):
    return evaluation.judge_failures(_judged(spark, d), "question_id")


_RUNS = "a AS (SELECT event_type AS metric, avg(value) AS value FROM events WHERE user_id % 2 = 0 AND event_type <> 'error' GROUP BY ALL), b AS (SELECT event_type AS metric, avg(value) AS value FROM events WHERE user_id % 2 = 1 AND event_type <> 'view' GROUP BY ALL)"


@query(f"WITH {_RUNS} SELECT metric, round(coalesce(a.value, 0), 6) AS baseline, round(coalesce(b.value, 0), 6) AS current, round(coalesce(b.value, 0) - coalesce(a.value, 0), 6) AS delta FROM a FULL JOIN b USING (metric)")
def compare_runs(spark, d):
    """Two runs of the events: even and odd users, each without one kind."""
    e = table(spark, d, "events")
    run = lambda cond: e.where(cond).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    c = evaluation.compare_runs(run("user_id % 2 = 0 and event_type <> 'error'"), run("user_id % 2 = 1 and event_type <> 'view'"))
    return c.select("metric", *(F.round(x, 6).alias(x) for x in ("baseline", "current", "delta")))


@query("""
WITH v AS (SELECT source AS variant, avg(length(text)) AS context_chars_5, count(*) AS index_chunks, avg(CASE WHEN length(text) > 500 THEN 1.0 ELSE 0.0 END) AS mrr, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS hitrate_5, avg(CASE WHEN n_chars > 300 THEN 1.0 ELSE 0.0 END) AS sentence_recall_5, avg(CASE WHEN page_number IS NOT NULL THEN 1.0 ELSE 0.0 END) AS sentence_precision_5 FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT variant, round(0.30 * mrr + 0.25 * hitrate_5 + 0.30 * sentence_recall_5 + 0.15 * sentence_precision_5 - 0.05 * context_chars_5 / max(context_chars_5) OVER () - 0.03 * index_chunks / max(index_chunks) OVER (), 6) AS balanced_score FROM v""")
def balanced_score(spark, d):
    """Sources stand in for variants."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    v = table(spark, d, "documents").where("text is not null").groupBy(F.col("source").alias("variant")).agg(
        F.avg(F.length("text")).alias("context_chars_5"), F.count(F.lit(1)).cast("double").alias("index_chunks"), share(F.length("text") > 500).alias("mrr"), share(F.col("lang") == "en").alias("hitrate_5"), share(F.col("n_chars") > 300).alias("sentence_recall_5"), share(F.col("page_number").isNotNull()).alias("sentence_precision_5")
    )
    return evaluation.balanced_scores(v).select("variant", F.round("balanced_score", 6).alias("balanced_score"))


@query(f"""
WITH r AS (SELECT parent_id AS row_id, row_number() OVER (PARTITION BY parent_id ORDER BY child_id) AS pos, coalesce(length(content) > 200, false) AS relevant FROM {CHILDREN}), n AS (SELECT row_id, count(*) FILTER (WHERE relevant) AS n_relevant, coalesce(1.0 / min(pos) FILTER (WHERE relevant), 0) AS mrr,
 {", ".join(f"count(*) FILTER (WHERE relevant AND pos <= {k}) AS h{k}, coalesce(sum(1.0 / log2(pos + 1.0)) FILTER (WHERE relevant AND pos <= {k}), 0) AS d{k}" for k in evaluation.K_VALUES)} FROM r GROUP BY ALL)
SELECT row_id, n_relevant, round(mrr, 6) AS mrr, {", ".join(f"round(h{k} / {k}.0, 6) AS precision_{k}, CASE WHEN n_relevant > 0 THEN round(h{k} / n_relevant, 6) ELSE 0.0 END AS recall_{k}, CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END AS hitrate_{k}, CASE WHEN n_relevant > 0 THEN round(d{k} / list_sum(list_transform(range(1, least(n_relevant, {k}) + 1), lambda i: 1.0 / log2(i + 1.0))), 6) ELSE 0.0 END AS ndcg_{k}" for k in evaluation.K_VALUES)} FROM n""")
def order_metrics(spark, d):
    """Children in order of id under their parents; long ones count as relevant."""
    c = _children(spark, d).select(F.col("parent_id").alias("row_id"), "child_id", F.coalesce(F.length("content") > 200, F.lit(False)).alias("relevant"))
    ranked = retrieval.top_k(c, 2**31 - 1, ["row_id"], ["child_id"]).withColumnRenamed("rank", "pos")
    return _tidy(evaluation.order_metrics(ranked))


def _ablation(spark, d):
    q = _with_most(spark, d).select("question_id", context.ablation_policy(F.col("question"), F.coalesce("most_hits", F.lit(0))).alias("policy"), "question_type")
    hits = _candidates(spark, d, 5).join(q, "question_id").select(F.col("question_id").alias("qid"), "rank", F.col("child_id").alias("chunk_id"), "parent_id", "policy")
    chunks = _chunks(spark, d).select(F.col("child_id").alias("chunk_id"), "parent_id", F.coalesce(F.length("content"), F.lit(0)).alias("chars"))
    parents = _parents(spark, d).select("parent_id", F.coalesce(F.length("page_content"), F.lit(0)).alias("chars"))
    return q.withColumnRenamed("question_id", "qid"), ablation.context_costs(ablation.contexts(hits, chunks, parents), q.select(F.col("question_id").alias("qid")))


_ABLATION = f"""{_MOST}, pol AS (SELECT question_id AS qid, question_type, CASE WHEN {_any(context.ABLATION_BROAD)} THEN 'parent' WHEN coalesce(most_hits, 0) >= 2 THEN 'neighbor' WHEN {_any(context.ABLATION_FACT)} THEN 'child' ELSE 'neighbor' END AS policy FROM {QUESTIONS} LEFT JOIN m USING (question_id)),
 hits AS (SELECT qid, policy, child_id, parent_id FROM cand JOIN pol ON qid = question_id WHERE rank <= 5),
 ch2 AS (SELECT child_id, parent_id, coalesce(length(content), 0) AS chars, coalesce(TRY_CAST(regexp_extract(child_id, '_child_(\\d+)$', 1) AS INT), 0) AS o FROM {CHILDREN}),
 ctx AS (SELECT qid, h.child_id AS c, chars FROM hits h JOIN ch2 USING (child_id) WHERE policy = 'child' UNION SELECT qid, s.child_id, s.chars FROM hits h JOIN ch2 a ON a.child_id = h.child_id JOIN ch2 s ON s.parent_id = h.parent_id AND abs(s.o - a.o) <= 1 WHERE policy = 'neighbor'
   UNION SELECT qid, h.parent_id, coalesce(length(page_content), 0) FROM hits h JOIN {PARENTS} p ON p.parent_id = h.parent_id WHERE policy = 'parent'),
 costs AS (SELECT pol.qid, question_type, count(c) AS context_count, coalesce(sum(chars), 0) AS context_chars FROM pol LEFT JOIN ctx USING (qid) GROUP BY ALL)"""


@query(f"{_ABLATION} SELECT qid, context_count, CAST(context_chars AS BIGINT) AS context_chars FROM costs")
def ablation_contexts(spark, d):
    return _ablation(spark, d)[1]


@query(f"{_ABLATION} SELECT question_type, count(*) AS n, min(context_count) AS context_count_min, max(context_count) AS context_count_max, round(avg(context_count), 6) AS context_count_avg, CAST(min(context_chars) AS BIGINT) AS context_chars_min, CAST(max(context_chars) AS BIGINT) AS context_chars_max, round(avg(context_chars), 6) AS context_chars_avg FROM costs GROUP BY ALL")
def context_stats(spark, d):
    q, costs = _ablation(spark, d)
    return _tidy(ablation.summary(costs.join(q.select("qid", "question_type"), "qid"), "question_type"))


@query(f"""
WITH {_CANDIDATES}, gold AS (SELECT DISTINCT question_id AS qid, unnest(gold_parent_ids) AS doc FROM {QUESTIONS}), n AS (SELECT qid, count(*) AS n FROM gold GROUP BY ALL),
 met AS (SELECT question_id AS qid, count(DISTINCT CASE WHEN rank <= 3 THEN doc END) AS h, min(rank) AS f FROM cand JOIN gold ON gold.qid = question_id AND doc = parent_id GROUP BY ALL)
SELECT qid, CASE WHEN coalesce(h, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit, round(coalesce(h, 0) / n, 6) AS doc_recall, round(coalesce(1.0 / f, 0), 6) AS mrr FROM n LEFT JOIN met USING (qid)""")
def ablation_documents(spark, d):
    """What hybrid search found, parents as documents."""
    hits = _candidates(spark, d).select(F.col("question_id").alias("qid"), "rank", F.col("parent_id").alias("doc"))
    gold = _asked(spark, d).select(F.col("question_id").alias("qid"), F.explode("gold_parent_ids").alias("doc"))
    return _tidy(ablation.document_scores(hits, gold, 3))


# ---- sessions ------------------------------------------------------------------------------------
@query(f"SELECT s.id, s.course_name, s.title, s.updated_at, count(t.id) AS turn_count FROM sessions s LEFT JOIN {TURNS} t ON t.session_id = s.id GROUP BY ALL")
def list_sessions(spark, d):
    return sessions.list_sessions(table(spark, d, "sessions").select("id", "course_name", "title", "updated_at"), _turns(spark, d))


@query(f"SELECT session_id AS id, coalesce(min(course_name), '') AS course_name, min(created_at) AS created_at, max(created_at) AS updated_at FROM {TURNS} WHERE session_id NOT IN (SELECT id FROM sessions WHERE id IS NOT NULL) GROUP BY ALL")
def missing_sessions(spark, d):
    return sessions.missing_sessions(table(spark, d, "sessions"), _turns(spark, d))


_RECENT = f"(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, id) AS place FROM (SELECT * FROM {TURNS} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC, id DESC) <= 5))"


@query(f"SELECT session_id, id, turn_index, place FROM {_RECENT}")
def recent_turns(spark, d):
    return sessions.recent_turns(_turns(spark, d)).select("session_id", "id", "turn_index", F.col("place").cast("bigint").alias("place"))


@query(f"SELECT s.id, coalesce(max(t.turn_index), 0) + 1 AS next_index FROM sessions s LEFT JOIN {TURNS} t ON t.session_id = s.id GROUP BY ALL")
def next_turn(spark, d):
    return sessions.next_turn(table(spark, d, "sessions"), _turns(spark, d))


@query(f"""SELECT session_id, md5('Conversation memory (not evidence):' || chr(10) || string_agg('Turn ' || turn_index || chr(10) || 'User: ' || coalesce(user_original, '') || chr(10) || 'Assistant: ' || coalesce(assistant_final, ''), chr(10) || chr(10) ORDER BY place)) AS memory_hash FROM {_RECENT} GROUP BY ALL""")
def memory_block(spark, d):
    return sessions.memory_block(_turns(spark, d)).select("session_id", F.md5("memory").alias("memory_hash"))


@query(f"SELECT session_id, CASE WHEN length(q) > 40 THEN q[1:40] || '...' ELSE q END AS title FROM (SELECT session_id, coalesce(arg_min_null(user_original, (turn_index, id)), '') AS q FROM {TURNS} GROUP BY ALL)".replace("arg_min_null(user_original, (turn_index, id))", "first(user_original ORDER BY turn_index, id)"))
def session_titles(spark, d):
    return sessions.titles(_turns(spark, d))


@query(f"""
WITH m AS (SELECT session_id, turn_index, id, unnest([0, 1]) AS p, unnest(['user: ' || coalesce(user_original, ''), 'assistant: ' || coalesce(assistant_final, '')]) AS t FROM {TURNS}),
 n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, id, p) AS i, count(*) OVER (PARTITION BY session_id) - 2 AS n FROM m)
SELECT session_id, max(n) AS n_messages, md5(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE n >= 4 AND i <= n AND i > n - 6), '')) AS window_hash FROM n GROUP BY ALL""")
def history_window(spark, d):
    return sessions.history_window(_turns(spark, d)).select("session_id", F.col("n_messages").cast("bigint").alias("n_messages"), F.md5("window").alias("window_hash"))


@query(f"""
WITH o AS (SELECT * FROM {TURNS} WHERE turn_index <= 3), n AS (SELECT * FROM {TURNS} WHERE turn_index > 3), m AS (SELECT session_id, max(turn_index) AS m FROM o GROUP BY ALL)
SELECT n.session_id, n.id, coalesce(m, 0) + row_number() OVER (PARTITION BY n.session_id ORDER BY n.created_at, n.id) AS turn_index FROM n LEFT JOIN m USING (session_id)""")
def append_turns(spark, d):
    """The first three turns are there; the later ones are appended and numbered anew."""
    t = _turns(spark, d)
    return sessions.append_turns(t.where("turn_index <= 3"), t.where("turn_index > 3")).select("session_id", "id", F.col("turn_index").cast("bigint").alias("turn_index"))


# ---- ingestion -----------------------------------------------------------------------------------
_FILES = f"files AS (SELECT source_file, sha256(string_agg(raw_text, chr(10) ORDER BY page_pos, block_id)) AS raw_file_hash FROM {BLOCKS} GROUP BY ALL)"


def _files(spark, d):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_pos", "block_id", "raw_text"))), lambda x: x["raw_text"]), "\n")
    return _blocks(spark, d).groupBy("source_file").agg(F.sha2(text, 256).alias("raw_file_hash"))


@query(f"""
WITH {_FILES}, m AS (SELECT source_file, CASE WHEN length(source_file) % 3 = 0 THEN 'old' ELSE raw_file_hash END AS old_hash, CASE WHEN length(source_file) % 5 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN length(source_file) % 7 = 0 THEN 'c0' ELSE 'c1' END AS cfg, length(source_file) % 4 <> 0 AS md FROM files WHERE length(source_file) % 11 <> 0),
 r AS (SELECT f.source_file, CASE WHEN m.source_file IS NULL THEN 'new_document' WHEN cfg <> 'c1' THEN 'index_config_changed' WHEN status <> 'success' THEN 'previous_index_not_successful' WHEN old_hash <> f.raw_file_hash THEN 'file_changed' WHEN NOT md THEN 'markdown_missing' ELSE 'unchanged_file' END AS reason FROM files f LEFT JOIN m USING (source_file))
SELECT source_file, reason = 'unchanged_file' AS skip, reason FROM r""")
def skip_reasons(spark, d):
    """A manifest made from the files' own hashes, with every kind of difference."""
    f = _files(spark, d)
    n = F.length("source_file")
    m = f.where(n % 11 != 0).select("source_file", F.when(n % 3 == 0, "old").otherwise(F.col("raw_file_hash")).alias("raw_file_hash"), F.when(n % 5 == 0, "failed").otherwise("success").alias("status"), F.when(n % 7 == 0, "c0").otherwise("c1").alias("config_hash"), (n % 4 != 0).alias("markdown_exists"))
    return manifest.skip_reasons(f, m, "c1")


@query("""
WITH c AS (SELECT child_id, content, loaded_at, min(loaded_at) OVER (PARTITION BY child_id) AS first_at FROM child_chunks), o AS (SELECT child_id, min(content) AS content FROM c WHERE loaded_at = first_at GROUP BY ALL),
 n AS (SELECT child_id, arg_max('new ' || coalesce(content, ''), loaded_at) AS content FROM c WHERE loaded_at > first_at GROUP BY ALL)
SELECT child_id, md5(content) AS h FROM n UNION ALL SELECT child_id, md5(content) FROM o WHERE child_id NOT IN (SELECT child_id FROM n)""")
def upsert(spark, d):
    """What was delivered again upserted over the first deliveries; the last of several counts."""
    c = table(spark, d, "child_chunks").select("child_id", "content", "loaded_at")
    first = c.groupBy("child_id").agg(F.min("loaded_at").alias("first_at"))
    j = c.join(first, "child_id")
    old = j.where("loaded_at = first_at").groupBy("child_id").agg(F.min("content").alias("content")).withColumn("loaded_at", F.lit(None).cast("timestamp_ntz"))
    new = j.where("loaded_at > first_at").select("child_id", F.concat(F.lit("new "), F.coalesce("content", F.lit(""))).alias("content"), "loaded_at")
    return manifest.upsert(old, new, "child_id", "loaded_at").select("child_id", F.md5("content").alias("h"))


@query(f"SELECT child_id FROM {CHILDREN} WHERE coalesce(source_file, '') NOT IN (SELECT source_file FROM documents WHERE original_extension = '.pdf' AND source_file IS NOT NULL) AND coalesce(source, '') NOT IN (SELECT source_file FROM documents WHERE original_extension = '.pdf' AND source_file IS NOT NULL)")
def delete_source(spark, d):
    names = table(spark, d, "documents").where("original_extension = '.pdf' and source_file is not null").select(F.col("source_file").alias("name"))
    return manifest.delete_source(_children(spark, d), names).select("child_id")


@query(f"""
WITH p AS (SELECT source_file, parent_id, child_id, coalesce(chunk_index, 2147483647) AS i, unnest(page_numbers) AS page FROM {CHILDREN} WHERE page_numbers IS NOT NULL),
 c AS (SELECT source_file, page, string_agg(child_id, ',' ORDER BY i, child_id) AS child_ids FROM (SELECT DISTINCT source_file, page, child_id, i FROM p) GROUP BY ALL),
 q AS (SELECT source_file, page, string_agg(parent_id, ',' ORDER BY i, child_id) AS parent_ids FROM (SELECT source_file, page, parent_id, i, child_id FROM p QUALIFY row_number() OVER (PARTITION BY source_file, page, parent_id ORDER BY i, child_id) = 1) GROUP BY ALL)
SELECT c.source_file, c.page, parent_ids, child_ids FROM c JOIN q ON c.source_file IS NOT DISTINCT FROM q.source_file AND c.page = q.page""")
def manifest_rollup(spark, d):
    r = manifest.rollup(_children(spark, d))
    return r.select("source_file", "page", F.array_join("parent_ids", ",").alias("parent_ids"), F.array_join("child_ids", ",").alias("child_ids"))


@query(f"""WITH {_FILES}, s AS (SELECT CASE length(source_file) % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'skipped' ELSE 'failed' END AS status FROM files)
SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed FROM s""")
def ingest_summary(spark, d):
    n = F.length("source_file") % 3
    return manifest.batch_summary(_files(spark, d).select(F.when(n == 0, "added").when(n == 1, "skipped").otherwise("failed").alias("status")))


@query(f"""WITH {_FILES} SELECT source_file, unnest([0, 1]) AS stage_no, unnest(['validate', 'clean']) AS stage, unnest(['ok', CASE WHEN length(source_file) % 3 = 0 THEN 'failed' ELSE 'ok' END]) AS status FROM files""")
def stage_log(spark, d):
    stages = F.array(F.struct(F.lit("validate").alias("stage"), F.lit("ok").alias("status")), F.struct(F.lit("clean").alias("stage"), F.when(F.length("source_file") % 3 == 0, "failed").otherwise("ok").alias("status")))
    return manifest.stage_log(_files(spark, d).select("source_file", stages.alias("stages")))


@query("SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_documents(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT question_id, count(*) AS n FROM eval_questions GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return table(spark, d, "eval_questions").groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"""
WITH e AS (SELECT question_id, CASE WHEN len(coalesce(gold_source_files, [])) > 0 THEN gold_source_files WHEN coalesce(source_file, '') <> '' THEN [source_file] ELSE [] END AS g FROM {QUESTIONS})
SELECT question_id, array_to_string(list_transform(g, lambda x: regexp_replace(regexp_replace(x, '^.*/', ''), '\\.[^.]*$', '') || '.md'), ',') AS gold FROM e""")
def gold_normalize(spark, d):
    return readers.normalize_gold(_questions(spark, d)).select("question_id", F.array_join("gold_source_files", ",").alias("gold"))


@query(f"""
WITH g AS (SELECT DISTINCT parent_id AS doc_id FROM {PARENTS} WHERE parent_id IN (SELECT unnest(gold_parent_ids) FROM {QUESTIONS}))
SELECT doc_id, true AS is_gold FROM g UNION ALL (SELECT parent_id, false FROM {PARENTS} WHERE parent_id NOT IN (SELECT doc_id FROM g) ORDER BY parent_id LIMIT 120)""")
def distractor_sample(spark, d):
    """Gold parents and 120 others, as many as the experiments draw."""
    corpus = _parents(spark, d).select(F.col("parent_id").alias("doc_id"))
    gold = _questions(spark, d).select(F.explode("gold_parent_ids").alias("doc_id"))
    return readers.distractor_sample(corpus, gold, 120)


@query(f"""SELECT question_id AS qid, array_to_string(list_sort(list_distinct(list(pid))), ',') AS gold_docs FROM (SELECT question_id, unnest(gold_child_ids) AS pid FROM {QUESTIONS}) WHERE pid IN (SELECT child_id FROM child_chunks) AND length(pid) % 4 > 0 GROUP BY ALL""")
def qrels_build(spark, d):
    q = _questions(spark, d)
    qrels = q.select(F.col("question_id").alias("qid"), F.explode("gold_child_ids").alias("pid")).withColumn("score", F.length("pid") % 4)
    out = readers.qrels_rows(q.select(F.col("question_id").alias("qid")), qrels, _children(spark, d).select(F.col("child_id").alias("doc_id")))
    return out.select("qid", F.array_join("gold_docs", ",").alias("gold_docs"))


@query(f"""SELECT source_file AS doc_id, md5('# ' || source_file || chr(10) || chr(10) || string_agg(raw_text, chr(10) || chr(10) ORDER BY page_pos, block_id)) AS text_hash FROM {BLOCKS} WHERE trim(coalesce(raw_text, '')) <> '' GROUP BY source_file""")
def passages_to_documents(spark, d):
    p = _blocks(spark, d).select(F.col("source_file").alias("doc_id"), F.col("source_file").alias("title"), F.col("page_pos").alias("paragraph_no"), F.col("block_id").alias("id"), F.col("raw_text").alias("text"))
    return readers.passages_to_documents(p).select("doc_id", F.md5("text").alias("text_hash"))


@query(f"""
WITH l AS (SELECT parent_id AS question_id, unnest(range(len(string_split(page_content, chr(10) || chr(10))))) AS doc_no, unnest(string_split(page_content, chr(10) || chr(10))) AS document FROM {PARENTS}),
 s AS (SELECT question_id, doc_no, document, unnest(range(len(string_split(document, chr(10))))) AS i, unnest(string_split(document, chr(10))) AS sentence FROM l)
SELECT question_id || '_doc_' || doc_no AS doc_id, doc_no || chr(97 + (i % 26)::INT) AS sentence_key, md5(sentence) AS sentence_hash, i % 26 = 0 AS relevant, doc_no::VARCHAR AS key_doc FROM s""")
def nested_contexts(spark, d):
    """Parents as rows of nested documents (paragraphs) and sentences (lines), the first of each relevant."""
    docs = F.split("page_content", "\n\n")
    sents = F.transform(docs, lambda x, i: F.transform(F.split(x, "\n"), lambda s, j: F.array(F.concat(i.cast("string"), F.char(F.lit(97) + j % 26)), s)))
    rows = _parents(spark, d).select(F.col("parent_id").alias("id"), docs.alias("documents"), sents.alias("documents_sentences"))
    rows = rows.withColumn("all_relevant_sentence_keys", F.transform("documents", lambda x, i: F.concat(i.cast("string"), F.lit("a"))))
    n = readers.nested_contexts(rows)
    return n.select("doc_id", "sentence_key", F.md5("sentence").alias("sentence_hash"), "relevant", T.leading_digits(F.col("sentence_key")).alias("key_doc"))


# ---- courses -------------------------------------------------------------------------------------
_MEMBERS = "members AS (SELECT DISTINCT trim(c) AS course, source_file FROM (SELECT unnest(regexp_split_to_array(course_name, '[,，\\n;；]+')) AS c, source_file FROM documents WHERE course_name IS NOT NULL) WHERE trim(c) <> '')"
_SLUG = "CASE WHEN regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\s+', '-', 'g'), '[^a-z0-9一-鿿_-]+', '', 'g'), '^[-_]+|[-_]+$', '', 'g') = '' THEN 'course' ELSE regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\s+', '-', 'g'), '[^a-z0-9一-鿿_-]+', '', 'g'), '^[-_]+|[-_]+$', '', 'g') END"


def _members(spark, d):
    return courses.memberships(table(spark, d, "documents"), "course_name", "source_file")


@query(f"WITH {_MEMBERS} SELECT 'course_' || {_SLUG.format('course')} || '_' || sha1(course)[1:8] AS course_id, course, count(DISTINCT source_file) AS n_documents FROM members GROUP BY course")
def course_list(spark, d):
    return courses.course_list(_members(spark, d))


_SECTIONS = f"""{LINES}, x AS (SELECT source_file, page_pos, line_no, line, coalesce(page_number, 1) AS page, CASE WHEN regexp_matches(line, '^\\s{{0,3}}#{{1,4}}\\s+\\S') THEN length(regexp_extract(line, '^\\s{{0,3}}(#{{1,4}})\\s', 1)) END AS level FROM lines
   WHERE regexp_matches(line, '^\\s{{0,3}}#{{1,4}}\\s+\\S') OR (regexp_matches({STRIPPED}, '^([-*+]|\\d+[.)])\\s+\\S') AND length(regexp_replace({STRIPPED}, '^([-*+]|\\d+[.)])\\s+', '')) BETWEEN 4 AND 80 AND NOT starts_with(regexp_replace({STRIPPED}, '^([-*+]|\\d+[.)])\\s+', ''), 'http'))),
 y AS (SELECT *, level IS NOT NULL AND (level <= 2 OR coalesce(count(level) OVER (PARTITION BY source_file ORDER BY page_pos, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0) AS opens FROM x),
 z AS (SELECT *, sum(opens::INT) OVER (PARTITION BY source_file ORDER BY page_pos, line_no) AS section_no, {SQUEEZE.format("regexp_replace(line, '^\\s{0,3}#+\\s*', '')")} AS title FROM y),
 sec AS (SELECT source_file, section_no, title, page AS page_number FROM z WHERE opens AND section_no <= 20 UNION ALL SELECT DISTINCT source_file, 1, regexp_replace(source_file, '\\.[^.]*$', ''), 1 FROM lines WHERE source_file NOT IN (SELECT source_file FROM z WHERE opens))"""


def _sections(spark, d):
    lines = _lines(spark, d)
    return courses.sections(lines, lines.select("source_file"))


@query(f"WITH {_SECTIONS} SELECT source_file, section_no, title, page_number, 'section_' || {_SLUG.format('''(source_file || ':' || title || ':' || page_number)''')} || '_' || sha1(source_file || ':' || title || ':' || page_number)[1:8] AS section_id FROM sec")
def course_sections(spark, d):
    return _sections(spark, d)[0].select("source_file", "section_no", "title", "page_number", "section_id")


@query(f"""WITH {_SECTIONS}, n AS (SELECT *, trim(regexp_replace(CASE WHEN level IS NOT NULL THEN title ELSE {SQUEEZE.format('line')} END, '^[-*+\\d.)\\s]+', '')) AS name FROM z WHERE section_no >= 1 AND section_no <= 20 AND NOT opens),
 u AS (SELECT * FROM n WHERE length(name) BETWEEN 1 AND 80 QUALIFY row_number() OVER (PARTITION BY source_file, section_no, lower(name) ORDER BY page_pos, line_no) = 1)
SELECT source_file, section_no, row_number() OVER (PARTITION BY source_file, section_no ORDER BY page_pos, line_no) AS point_no, name, page AS page_number FROM u QUALIFY point_no <= 10""")
def knowledge_points(spark, d):
    return _sections(spark, d)[1].select("source_file", "section_no", F.col("point_no").cast("bigint").alias("point_no"), "name", "page_number")


@query(f"""WITH {_SECTIONS}, e AS (SELECT DISTINCT source_file, title, upper(title) AS kept FROM sec WHERE length(title) % 2 = 0)
SELECT s.source_file, s.section_no, coalesce(kept, s.title) AS title, s.title AS original_title, kept IS NOT NULL AS user_edited FROM sec s LEFT JOIN e ON s.source_file = e.source_file AND s.title = e.title""")
def carry_titles(spark, d):
    """Users gave the sections with titles of even length capital letters; a rebuild keeps them."""
    s = _sections(spark, d)[0]
    edited = s.where("length(title) % 2 = 0").select("source_file", F.col("title").alias("original_title"), F.upper("title").alias("title"))
    return courses.carry_titles(s, edited).select("source_file", "section_no", "title", "original_title", "user_edited")


@query(f"""WITH {_SECTIONS}, {_MEMBERS}, j AS (SELECT course, m.source_file, section_no, title FROM members m LEFT JOIN sec USING (source_file)), t AS (SELECT course, string_agg(title, '、' ORDER BY source_file, section_no) AS first_titles FROM (SELECT * FROM j WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY course ORDER BY source_file, section_no) <= 5) GROUP BY ALL)
SELECT course, count(DISTINCT source_file) AS n_documents, count(title) AS n_sections, coalesce(first_titles, '') AS first_titles FROM j LEFT JOIN t USING (course) GROUP BY course, first_titles""")
def course_summary(spark, d):
    return courses.summary(_members(spark, d), _sections(spark, d)[0])


# ---- agent rules ---------------------------------------------------------------------------------
_AGENT = "a AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'chitchat' WHEN 1 THEN 'clarification' ELSE 'question' END AS intent, value > 5 AS clear, (value * 3)::BIGINT % 14 AS it, user_id % 12 AS tools, event_type = 'click' AS calls, user_id % 4 AS evals, event_type = 'error' AS sat FROM events)"


@query(f"""WITH {_AGENT} SELECT event_id, CASE WHEN intent = 'chitchat' THEN 'chitchat_response' WHEN intent = 'clarification' OR NOT clear THEN 'request_clarification' ELSE 'rewrite_query' END AS r1, CASE WHEN it >= 10 OR tools > 8 THEN 'fallback_response' WHEN NOT calls THEN 'collect_answer' ELSE 'tools' END AS r2,
 CASE WHEN sat THEN 'end' WHEN evals >= 2 OR it >= 10 OR tools > 8 THEN 'knowledge_fallback' ELSE 'task_executor' END AS r3 FROM a""".replace("(value * 3)::BIGINT", "floor(value * 3)::BIGINT"))
def route_rules(spark, d):
    e = table(spark, d, "events")
    intent = F.when(F.col("user_id") % 4 == 0, "chitchat").when(F.col("user_id") % 4 == 1, "clarification").otherwise("question")
    it, tools = F.floor(F.col("value") * 3).cast("bigint") % 14, F.col("user_id") % 12
    return e.select("event_id", agent.after_intent(intent, F.col("value") > 5).alias("r1"), agent.after_call(it, tools, F.col("event_type") == "click").alias("r2"), agent.after_evaluation(F.lit(None).cast("string"), F.col("event_type") == "error", F.col("user_id") % 4, it, tools).alias("r3"))


@query(f"""WITH p AS (SELECT question_id, regexp_split_to_array(question, '[ ，,]+')[1:3] AS qs FROM {QUESTIONS}), u AS (SELECT question_id, unnest(range(len(qs))) AS question_index, unnest(qs) AS question FROM p)
SELECT question_id, question_index, 'task_' || (question_index + 1) AS task_id, question FROM u WHERE question <> ''""")
def task_fanout(spark, d):
    p = _questions(spark, d).select("question_id", F.split("question", "[ ，,]+").alias("qs"))
    out = agent.fan_out(p, "question_id", "qs")
    return out.withColumn("question_index", F.col("question_index").cast("bigint"))


@query("""
WITH r AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END * (user_id % 2) AS n, CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'low_score' END AS status, CASE WHEN event_type = 'error' AND user_id % 3 = 1 THEN 'boom' END AS error, CASE WHEN value < 3 THEN NULL ELSE (value - 6) / 50 END AS score FROM events),
 g AS (SELECT user_id, sum(n) AS c, max(score) AS best, coalesce(bool_or(status = 'low_score'), false) AS low, coalesce(bool_or(coalesce(error, '') <> ''), false) AS failed FROM r GROUP BY ALL)
SELECT user_id, CASE WHEN c > 0 AND coalesce(best < 0.5, false) THEN 'low_score' WHEN c > 0 THEN 'sufficient' WHEN low THEN 'low_score' WHEN failed THEN 'error' ELSE 'insufficient' END AS status, round(best, 6) AS best_score FROM g""")
def evidence_grade(spark, d):
    e = table(spark, d, "events")
    r = e.select("user_id", (F.when(F.col("event_type") == "view", 1).otherwise(0) * (F.col("user_id") % 2)).alias("n_contexts"), F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), "low_score").alias("status"), F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 1), "boom").alias("error"), F.lit(None).cast("string").alias("gap"), F.when(F.col("value") >= 3, (F.col("value") - 6) / 50).alias("best_score"))
    return agent.grade_evidence(r, "user_id", 0.5).select("user_id", "status", F.round("best_score", 6).alias("best_score"))


@query("""
WITH l AS (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last_reset FROM events)
SELECT user_id, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE (last_reset IS NULL OR event_id > last_reset)), '') AS items, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS tags, sum(user_id % 3) AS calls FROM l GROUP BY ALL""")
def state_reducers(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("item"), (F.col("event_type") == "error").alias("reset"), F.col("event_type").alias("tag"), (F.col("user_id") % 3).alias("calls"))
    r = agent.reduce_state(e, "user_id")
    return r.select("user_id", F.array_join("items", ",").alias("items"), F.array_join("tags", ",").alias("tags"), "calls")


@query("SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts) > 600000000")
def task_ttl(spark, d):
    t = table(spark, d, "events").select("event_id", F.col("ts").alias("updated_at"))
    return agent.expired(t, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


@query(f"""SELECT session_id, md5(string_agg('Answer ' || turn_index || ' (' || user_original || '):' || chr(10) || coalesce(assistant_final, ''), chr(10) || chr(10) ORDER BY turn_index)) AS h FROM {TURNS} WHERE user_original IS NOT NULL GROUP BY ALL""")
def ordered_answers(spark, d):
    t = _turns(spark, d).where("user_original is not null").select("session_id", (F.col("turn_index") - 1).alias("index"), F.col("user_original").alias("question"), F.col("assistant_final").alias("answer"))
    return agent.ordered_answers(t, "session_id").select("session_id", F.md5("text").alias("h"))


@query(f"SELECT session_id, arg_max(assistant_final, turn_index) AS response FROM {TURNS} WHERE assistant_final IS NOT NULL AND turn_index % 3 <> 0 GROUP BY ALL")
def final_response(spark, d):
    """Every third answer counts as a tool's message."""
    m = _turns(spark, d).select("session_id", F.col("turn_index").alias("seq"), F.lit("assistant").alias("role"), F.when(F.col("turn_index") % 3 == 0, "tool").when(F.col("turn_index") % 3 == 1, "plain").otherwise("clarification").alias("kind"), F.col("assistant_final").alias("text"))
    return agent.final_response(m, "session_id")


@query("""
WITH f AS (SELECT user_id, event_type AS c, min(event_id) AS s FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, c) AS n FROM f)
SELECT user_id, string_agg('[' || n || '] ' || c, chr(10) ORDER BY n) AS text FROM n GROUP BY ALL""")
def unique_numbered(spark, d):
    return agent.unique_numbered(table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("content")), "user_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def json_extract(spark, d):
    """The object stands inside other text, as a model writes it."""
    return table(spark, d, "events").select("event_id", T.json_object(F.concat(F.lit("Here it is: "), "props", F.lit(" done")), "k").alias("k"))


@query(f"SELECT source_file, array_to_string(list_sort(list_distinct(list(child_id || '.md'))), ',') AS sources FROM {CHILDREN} WHERE source_file IS NOT NULL GROUP BY ALL")
def sources_block(spark, d):
    lines = _children(spark, d).where("source_file is not null").groupBy("source_file").agg(F.array_join(F.transform(F.sort_array(F.collect_list("child_id")), lambda x: F.concat(F.lit("- "), x, F.lit(".md\n- none"))), "\n").alias("t"))
    return lines.select("source_file", F.array_join(T.sources_block(F.concat(F.lit("An answer.\n\n**Sources:**\n"), "t")), ",").alias("sources"))


@query("SELECT event_type AS metric, printf('%.6f', avg(value)) AS value FROM events GROUP BY ALL")
def metrics_csv(spark, d):
    return sinks.metrics_csv(table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value")))


# ---- streaming -----------------------------------------------------------------------------------
@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_counts(spark, d):
    """A stream of the events counted by day in complete mode, run until its end; equal to the batch."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"stream_event_counts_{abs(hash(d)) % 10**8}"
    out = incremental.run_once(spark, incremental.windowed_counts(stream, "ts"), name, "complete")
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


from pageloom.plans import quality  # noqa: E402, F401 - registers its queries
