"""Retrieval evaluation: metrics by question, aggregates, error cases, validation, judge scores, ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_VALUES = (1, 3, 5, 10, 20)


def _ids(c: str) -> Column:
    return F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()))


def _first(k: int) -> Column:
    return F.filter("hits", lambda h: h["rank"] <= k)


def _found(hits: Column, field: str, gold: str) -> Column:
    return F.size(F.array_intersect(F.transform(hits, lambda h: h[field]), F.col(gold)))


def score_questions(questions: DataFrame, results: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """A row of metrics for every question (question_id, gold_child_ids, gold_parent_ids, gold_source_files).

    ``results`` are (question_id, rank, chunk_id, parent_id, source_file). Child gold is primary,
    parent gold where there is none; a question without either isn't scored. Precision divides by
    k, recall by the gold; graded gains are 3, 2 and 1, and a parent hit twice counts twice.
    """
    q = questions.select("question_id", _ids("gold_child_ids").alias("cg"), _ids("gold_parent_ids").alias("pg"), _ids("gold_source_files").alias("sg"))
    hits = results.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "parent_id", "source_file"))).alias("hits"))
    j = q.join(hits, "question_id", "left").withColumn("hits", F.coalesce("hits", F.array()))
    by_child = F.size("cg") > 0
    relevant = lambda h: F.when(by_child, F.array_contains("cg", h["chunk_id"])).otherwise(F.array_contains("pg", h["parent_id"]))
    first = F.array_min(F.transform(F.filter("hits", lambda h: F.coalesce(relevant(h), F.lit(False))), lambda h: h["rank"]))
    grade = lambda h: (
        F.when(F.array_contains("cg", h["chunk_id"]), 3).when(F.array_contains("pg", h["parent_id"]), 2).when((F.size("cg") == 0) & (F.size("pg") == 0) & F.array_contains("sg", h["source_file"]), 1).otherwise(0)
    )
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1.0) / F.log2(r + 1.0)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    ideal_grade = F.when(by_child, 3).when(F.size("pg") > 0, 2).when(F.size("sg") > 0, 1).otherwise(0)
    ideal_n = F.when(by_child, F.size("cg")).when(F.size("pg") > 0, F.size("pg")).otherwise(F.size("sg"))
    cols = ["question_id", first.alias("first_relevant_rank"), F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"), (by_child | (F.size("pg") > 0)).alias("scored"), by_child.alias("has_child_gold"), (F.size("pg") > 0).alias("has_parent_gold"), (F.size("sg") > 0).alias("has_source_gold")]
    for k in k_values:
        top = _first(k)
        c, p, s = _found(top, "chunk_id", "cg"), _found(top, "parent_id", "pg"), _found(top, "source_file", "sg")
        rel, gold_n = F.when(by_child, c).otherwise(p), F.when(by_child, F.size("cg")).otherwise(F.size("pg"))
        dcg = total(F.transform(top, lambda h: gain(grade(h), h["rank"])))
        n_ideal = F.least(ideal_n, F.lit(k))
        idcg = F.when(n_ideal > 0, total(F.transform(F.sequence(F.lit(1), F.greatest(n_ideal, F.lit(1))), lambda i: gain(ideal_grade, i)))).otherwise(F.lit(0.0))
        cols += [
            ratio(rel, gold_n).alias(f"recall_{k}"), F.when(rel > 0, 1.0).otherwise(0.0).alias(f"hitrate_{k}"), (rel / F.lit(float(k))).alias(f"precision_{k}"),
            ratio(c, F.size("cg")).alias(f"child_recall_{k}"), ratio(p, F.size("pg")).alias(f"parent_recall_{k}"), F.when(s > 0, 1.0).otherwise(0.0).alias(f"source_hitrate_{k}"),
            ratio(dcg, idcg).alias(f"ndcg_{k}"), F.size(top).alias(f"actual_results_{k}"),
        ]
    return j.select(*cols)


def aggregate_scores(per_question: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(metric, value): means over the questions each metric is defined for, and the counts."""
    mean = lambda c, flag: F.coalesce(F.avg(F.when(F.col(flag), F.col(c).cast("double"))), F.lit(0.0))
    cols = {"mrr": mean("mrr", "scored")}
    for k in k_values:
        for m in ("recall", "hitrate", "precision", "ndcg"):
            cols[f"{m}_{k}"] = mean(f"{m}_{k}", "scored")
        cols[f"child_recall_{k}"] = mean(f"child_recall_{k}", "has_child_gold")
        cols[f"parent_recall_{k}"] = mean(f"parent_recall_{k}", "has_parent_gold")
        cols[f"source_hitrate_{k}"] = mean(f"source_hitrate_{k}", "has_source_gold")
        cols[f"actual_results_{k}"] = F.coalesce(F.avg(F.col(f"actual_results_{k}").cast("double")), F.lit(0.0))
    cols["rows"], cols["scored_rows"] = F.count(F.lit(1)).cast("double"), F.count_if("scored").cast("double")
    cols["evaluation_valid"] = F.when(F.count_if("scored") > 0, 1.0).otherwise(0.0)
    one = per_question.agg(*(c.alias(n) for n, c in cols.items()))
    return one.unpivot([], list(cols), "metric", "value")


def failures(per_question: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(question_id, failure_type) of the questions whose results miss source, parent or child, or rank it low."""
    j = per_question.join(questions.select("question_id", "source_file"), "question_id")
    kind = F.when(F.col("source_file").isNotNull() & (F.col("source_file") != "") & (F.col(f"source_hitrate_{k}") == 0), "missed_source").when(F.col("has_parent_gold") & (F.col(f"parent_recall_{k}") == 0), "missed_parent").when(
        F.col("has_child_gold") & (F.col(f"child_recall_{k}") == 0), "missed_child"
    ).when(F.col("first_relevant_rank") > 3, "bad_ranking")
    return j.select("question_id", kind.alias("failure_type"), "first_relevant_rank").where("failure_type is not null")


def validate(questions: DataFrame, results: DataFrame, ks: list[int], score_threshold: float | None = None, mode: str | None = None) -> DataFrame:
    """(code, severity, question_id, detail): what is wrong with the inputs of an evaluation.

    ``results`` are (question_id, rank, chunk_id, parent_id), several runs of a question told apart
    by an optional ``run``. What concerns the whole input has a null question_id; an empty dataset
    has that one warning only.
    """
    q = questions.select("question_id", _ids("gold_child_ids").alias("cg"), _ids("gold_parent_ids").alias("pg"))
    r = results.where("question_id is not null")
    warn = lambda df, code, severity, detail=None: df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "question_id", (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
    one = F.lit(None).cast("string").alias("question_id")
    whole = q.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.first("cg").alias("cg"), F.first("pg").alias("pg"))
    runs = r.select("question_id", *(["run"] if "run" in r.columns else [])).distinct().groupBy("question_id").count()
    asked = whole.select("question_id")
    actual = asked.join(r.groupBy("question_id").agg(F.countDistinct("rank").alias("actual")), "question_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    few = actual.withColumn("k", F.explode(F.array(*(F.lit(k) for k in sorted({k for k in ks if k > 0}))))).where("actual < k")
    primary = F.when(F.size("cg") > 0, F.col("cg")).otherwise(F.col("pg"))
    seen = r.groupBy("question_id").agg(F.collect_set("chunk_id").alias("c"), F.collect_set("parent_id").alias("p"))
    meets = F.size(F.array_intersect(primary, F.when(F.size("cg") > 0, F.col("c")).otherwise(F.col("p")))) > 0
    overlap = whole.join(seen, "question_id", "left").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size(primary) > 0).alias("scored"), F.count("c").alias("seen"), F.count_if(F.coalesce(meets, F.lit(False))).alias("met"))
    parts = [
        warn(whole.where("n > 1"), "duplicate_question_id", "error"),
        warn(runs.where("count > 1"), "duplicate_result_question_id", "error"),
        warn(r.select("question_id").distinct().join(asked, "question_id", "left_anti"), "result_without_question", "warning"),
        warn(asked.join(r, "question_id", "left_anti"), "missing_result_row", "warning"),
        warn(whole.where((F.size("cg") == 0) & (F.size("pg") == 0)), "missing_primary_gold", "warning"),
        warn(few, "insufficient_results_for_k", "warning", F.concat_ws("/", "actual", "k")),
        warn(overlap.where("rows > 0 and scored = 0").select(one), "no_scored_rows", "error"),
        warn(overlap.where("scored > 0 and seen > 0 and met = 0").select(one), "gold_result_id_no_overlap", "warning"),
    ]
    if score_threshold is not None and mode in ("rrf", "dense", "sparse"):
        parts.append(warn(overlap.select(one), "score_threshold_ignored", "warning", F.lit(mode)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    filled = overlap.where("rows > 0").select(F.lit(True).alias("filled"))
    empty = warn(overlap.where("rows = 0").select(one), "empty_dataset", "error")
    return out.join(F.broadcast(filled)).drop("filled").unionByName(empty)  # one row or none


def validity_summary(warnings: DataFrame, rows: int, kind: str) -> DataFrame:
    """(evaluation_type, rows, warning_count, error_count, evaluation_valid, warning_codes) of the warnings (code, severity)."""
    per = warnings.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "error").alias("errors"))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: F.concat(x["code"], F.lit("="), x["n"].cast("string"))), ",")
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("warning_count"), F.coalesce(F.sum("errors"), F.lit(0)).alias("error_count"), codes.alias("warning_codes"))
    return out.select(F.lit(kind).alias("evaluation_type"), F.lit(rows).cast("bigint").alias("rows"), "warning_count", "error_count", (F.col("error_count") == 0).alias("evaluation_valid"), "warning_codes")


#: The columns that can give each metric a judge's row needs.
METRIC_GROUPS = {"faithfulness": ["faithfulness"], "context_precision": ["context_precision", "llm_context_precision_with_reference"], "context_recall": ["context_recall"]}


def validate_judged(rows: DataFrame, key: str, expected: int | None = None, groups: dict[str, list[str]] = METRIC_GROUPS) -> DataFrame:
    """(code, severity, question_id, detail) of judged rows; values may be text.

    A row without any usable value has one warning, any other one for each metric it lacks and each
    value that is there but no number.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    has = {m: [c for c in names if c in rows.columns] for m, names in groups.items()}
    usable = {m: F.coalesce(*(number(c) for c in names)).isNotNull() if names else F.lit(False) for m, names in has.items()}
    none = ~F.greatest(*(u.cast("int") for u in usable.values())).cast("boolean")
    item = lambda code, detail: F.struct(F.lit(code).alias("code"), F.lit(detail).cast("string").alias("detail"))
    found = [F.when(none, item("ragas_metric_missing", None))]
    for m, names in has.items():
        found.append(F.when(~none & ~usable[m], item("ragas_metric_missing", m)))
        found += [F.when(~none & usable[m] & F.col(c).isNotNull() & number(c).isNull(), item("ragas_metric_invalid", c)) for c in names]
    out = rows.select(F.col(key).cast("string").alias("question_id"), F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.code", F.lit("warning").alias("severity"), "question_id", "x.detail")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    whole = lambda df, code, detail: df.select(F.lit(code).alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("question_id"), detail.cast("string").alias("detail"))
    out = out.unionByName(whole(n.where("n = 0"), "empty_ragas_results", F.lit(None)))
    return out if expected is None else out.unionByName(whole(n.where(F.col("n") != expected), "ragas_row_count_mismatch", F.concat_ws("/", "n", F.lit(str(expected)))))


def dataset_stats(questions: DataFrame) -> DataFrame:
    """(question_type, n, source_coverage, parent_coverage, child_coverage), the last row over all types."""
    has = lambda c: F.round(F.avg((F.size(_ids(c)) > 0).cast("double")), 4)
    agg = [F.count(F.lit(1)).alias("n"), has("gold_source_files").alias("source_coverage"), has("gold_parent_ids").alias("parent_coverage"), has("gold_child_ids").alias("child_coverage")]
    total = questions.agg(*agg).select(F.lit("total").alias("question_type"), "*")
    return questions.groupBy(F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(*agg).unionByName(total)


def missing_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def judge_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, rows, missing_rows): NaN and null are missing, values are clamped to [0, 1]."""
    parts = []
    for m in metrics:
        v = missing_to_null(F.col(m))
        parts.append(F.struct(F.lit(m).alias("metric"), F.avg(F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))).alias("mean"), F.count(v).alias("rows"), (F.count(F.lit(1)) - F.count(v)).alias("missing_rows")))
    return rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


#: The least acceptable scores, first of metrics every row needs, then of optional ones.
REQUIRED, OPTIONAL = {"faithfulness": 0.75, "context_precision": 0.65, "context_recall": 0.70}, {"answer_relevancy": 0.75, "response_relevancy": 0.75}


def judge_failures(rows: DataFrame, key: str) -> DataFrame:
    """(key, failure_type, low_metrics, missing_metrics) of rows with low or missing scores."""
    values = {m: missing_to_null(F.col(m)) for m in [*REQUIRED, *OPTIONAL] if m in rows.columns}
    low = F.array_compact(F.array(*(F.when(v < (REQUIRED | OPTIONAL)[m], F.lit(m)) for m, v in values.items())))
    missing = F.array_compact(F.array(*(F.when(values[m].isNull(), F.lit(m)) for m in REQUIRED)))
    out = rows.select(key, low.alias("low"), missing.alias("missing"))
    kind = F.when(F.array_contains("low", "context_recall"), "insufficient_context").when(F.size("missing") > 0, "judge_metric_missing").when(F.array_contains("low", "faithfulness"), "hallucination").otherwise("low_answer_quality")
    return out.where((F.size("low") > 0) | (F.size("missing") > 0)).select(key, kind.alias("failure_type"), F.array_join("low", ",").alias("low_metrics"), F.array_join("missing", ",").alias("missing_metrics"))


def compare_runs(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, baseline, current, delta): a metric missing in one run counts as 0 there."""
    a, b = baseline.select("metric", F.col("value").alias("baseline")), current.select("metric", F.col("value").alias("current"))
    j = a.join(b, "metric", "full_outer")
    base, cur = F.coalesce("baseline", F.lit(0.0)), F.coalesce("current", F.lit(0.0))
    return j.select("metric", base.alias("baseline"), cur.alias("current"), (cur - base).alias("delta"))


def balanced_scores(rows: DataFrame) -> DataFrame:
    """Variants with their balanced score: quality less the cost of context and index, each over the largest.

    One row for each variant, a list that doesn't grow with the data, so the maxima are over one window.
    """
    most = lambda c: F.greatest(F.coalesce(F.max(c).over(Window.partitionBy()), F.lit(0.0)), F.lit(0.0))
    cost = lambda c: F.coalesce(F.col(c) / F.when(most(c) > 0, most(c)).otherwise(1.0), F.lit(0.0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = 0.30 * z("mrr") + 0.25 * z("hitrate_5") + 0.30 * z("sentence_recall_5") + 0.15 * z("sentence_precision_5") - 0.05 * cost("context_chars_5") - 0.03 * cost("index_chunks")
    return rows.withColumn("balanced_score", score)


def order_metrics(ranked: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """Prefix precision, recall, hits and binary nDCG of items in their given order (row_id, pos from 1, relevant)."""
    n = F.sum(F.col("relevant").cast("int"))
    cols = [n.alias("n_relevant"), F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("pos"))), F.lit(0.0)).alias("mrr")]
    for k in k_values:
        hit = F.sum((F.col("relevant") & (F.col("pos") <= k)).cast("int"))
        dcg = F.sum(F.when(F.col("relevant") & (F.col("pos") <= k), 1.0 / F.log2(F.col("pos") + 1.0)).otherwise(0.0))
        idcg = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
        cols += [(hit / F.lit(float(k))).alias(f"precision_{k}"), F.when(n > 0, hit / n).otherwise(0.0).alias(f"recall_{k}"), F.when(hit > 0, 1.0).otherwise(0.0).alias(f"hitrate_{k}"), F.when(n > 0, dcg / idcg).otherwise(0.0).alias(f"ndcg_{k}")]
    return ranked.groupBy("row_id").agg(*cols)
