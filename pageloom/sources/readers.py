"""Sources: documents from files, evaluation sets, nested benchmark rows, and samples built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = ("pdf", "md", "docx", "pptx")
QUESTION_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("question_id", "question", "reference_answer", "source_file")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("gold_source_files", "gold_parent_ids", "gold_child_ids", "gold_evidence_text")]
    + [T.StructField(n, T.StringType()) for n in ("question_type", "difficulty")]
    + [T.StructField("tags", T.ArrayType(T.StringType()))]
)


def markdown_name(path):
    """The stem of a path with the extension .md, the identity of a document."""
    return F.concat(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", ""), F.lit(".md"))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_file, raw_file_hash, text, status, reason) of the files under a path.

    Markdown is read as UTF-8; files of other known kinds wait for a converter; unknown kinds and
    blank texts are failed rows, so one bad file doesn't end a batch.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.when(ext == "md", F.decode("content", "UTF-8"))
    reason = F.when(~ext.isin(*EXTENSIONS), "validation_failed").when((ext == "md") & (F.trim(F.regexp_replace(text, r"\s+", " ")) == ""), "empty_markdown").when(ext != "md", "needs_conversion").otherwise("")
    return files.select("path", markdown_name(F.col("path")).alias("source_file"), F.sha2("content", 256).alias("raw_file_hash"), text.alias("text"), F.when(reason.isin("validation_failed", "empty_markdown"), "failed").when(reason == "needs_conversion", "pending").otherwise("ok").alias("status"), reason.alias("reason"))


def convert(files: DataFrame, converter) -> DataFrame:
    """Pending files (path, content) converted by a function of bytes and name to Markdown, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            yield pdf[["path"]].assign(text=[converter(bytes(c), p) for c, p in zip(pdf["content"], pdf["path"], strict=True)])

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def new_only(files: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Files not converted yet, by name; all of them if ``overwrite``."""
    return files if overwrite else files.join(existing.select("source_file"), "source_file", "left_anti")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, a missing file gives no rows, a bad line is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions; an error if a required field is missing or an id repeats."""
    rows = read_jsonl(spark, path, QUESTION_SCHEMA)
    bad = rows.where("question_id is null or question is null or reference_answer is null or trim(question_id) = '' or trim(question) = ''").limit(1).count()
    if bad:
        raise ValueError("a question lacks a required field")
    if rows.groupBy("question_id").count().where("count > 1").limit(1).count():
        raise ValueError("a question_id occurs twice")
    return normalize_gold(rows)


def normalize_gold(rows: DataFrame) -> DataFrame:
    """gold_source_files never null: the source file where none is listed; names end in .md."""
    own = F.when(F.col("source_file").isNotNull() & (F.col("source_file") != ""), F.array("source_file")).otherwise(F.array().cast("array<string>"))
    files = F.when(F.size(F.coalesce("gold_source_files", F.array())) > 0, F.col("gold_source_files")).otherwise(own)
    return rows.withColumn("gold_source_files", F.transform(files, markdown_name))


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metric string, value double").option("header", True).csv(path)


def nested_contexts(rows: DataFrame) -> DataFrame:
    """(question_id, doc_id, doc_no, document, sentence_key, sentence, relevant) of rows with nested documents.

    ``rows`` have id, documents array<string>, documents_sentences array<array<array<string>>> of
    (key, text), all_relevant_sentence_keys array<string>.
    """
    docs = rows.select("id", "all_relevant_sentence_keys", F.posexplode(F.arrays_zip("documents", "documents_sentences")).alias("doc_no", "d"))
    sents = docs.select("id", "all_relevant_sentence_keys", "doc_no", F.col("d.documents").alias("document"), F.explode("d.documents_sentences").alias("s"))
    key = F.col("s")[0]
    return sents.select(F.col("id").alias("question_id"), F.concat(F.col("id"), F.lit("_doc_"), F.col("doc_no").cast("string")).alias("doc_id"), "doc_no", "document", key.alias("sentence_key"), F.col("s")[1].alias("sentence"), F.array_contains("all_relevant_sentence_keys", key).alias("relevant"))


def slice_rows(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """``limit`` rows from ``offset`` on in the order of a column."""
    return rows.orderBy(order).offset(offset).limit(limit)


def distractor_sample(corpus: DataFrame, gold: DataFrame, n: int) -> DataFrame:
    """(doc_id, is_gold): the gold documents and the first n others in order of id; all others if n is 0 or less."""
    ids = corpus.select("doc_id").distinct()
    golden = ids.join(gold.select("doc_id").distinct(), "doc_id", "left_semi")
    rest = ids.join(golden, "doc_id", "left_anti")
    rest = rest.orderBy("doc_id").limit(n) if n > 0 else rest
    return golden.withColumn("is_gold", F.lit(True)).unionByName(rest.withColumn("is_gold", F.lit(False)))


def qrels_rows(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(qid, gold_docs): queries with positive judgements of documents in the corpus, in order of id."""
    good = qrels.where("score > 0").join(corpus.select(F.col("doc_id").alias("pid")).distinct(), "pid", "left_semi").join(queries.select("qid"), "qid", "left_semi")
    rows = good.groupBy("qid").agg(F.array_sort(F.collect_set("pid")).alias("gold_docs"))
    return rows if limit is None and not offset else slice_rows(rows, "qid", offset, limit if limit is not None else 2**31 - 1)


def passages_to_documents(passages: DataFrame) -> DataFrame:
    """(doc_id, text): a document of its title as heading and its paragraphs that aren't blank, in order."""
    full = passages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    w = Window.partitionBy("doc_id").orderBy("paragraph_no", "id")
    ordered = full.withColumn("n", F.row_number().over(w))
    return ordered.groupBy("doc_id").agg(F.concat(F.lit("# "), F.first("title", ignorenulls=True), F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n")).alias("text"))
