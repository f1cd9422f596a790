import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.operators import context, evaluation, retrieval
from pageloom.plans import queries


def test_dense_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v[7] = 0
    v[9] = v[8]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "id long, v array<double>")
    got = {(r.qid, r["rank"]): r.id for r in retrieval.dense_search(df.where("id < 5 or id = 8"), df, 4, exclude_self=True).collect()}
    norm = np.linalg.norm(v, axis=1)
    for q in (0, 1, 2, 3, 4, 8):
        s = v @ v[q] / np.where(norm * norm[q] > 0, norm * norm[q], 1)
        order = sorted((i for i in range(60) if i not in (q, 7)), key=lambda i: (-round(s[i], 9), i))[:4]
        assert [got[q, k + 1] for k in range(4)] == order


def test_dense_search_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 20)
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 300)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 8)).astype(np.float32)
    v[100:140] = v[3] * np.arange(1, 41)[:, None]  # ties go to the smaller id
    names = [f"i{k:04d}" for k in rng.permutation(1500)]
    df = spark.createDataFrame([(n, [float(x) for x in r]) for n, r in zip(names, v, strict=True)], "id string, v array<float>")
    asked = df.where("id < 'i0055'").unionByName(df.where("id = 'i0007'"))  # one is given twice
    got = {}
    for r in retrieval.dense_search(asked, df, 30).collect():
        got.setdefault(r.qid, set()).add((r["rank"], r.id))
    w = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    for i, name in enumerate(names):
        if name < "i0055" and name != "i0007":
            s = (w @ w[i]).round(9)
            assert got[name] == {(k + 1, names[j]) for k, j in enumerate(sorted(range(1500), key=lambda j: (-s[j], names[j]))[:30])}
    assert len(got) == 55
    monkeypatch.undo()
    # 24,000 questions in 108,000 chunks: few blocks, so neither side moves many times
    nq, ni = retrieval._pairs_of_blocks(24_000, 108_000, 6, 70)
    assert nq * ni <= 8


def test_sparse_search_needs_all_terms(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "cat and dog"), (3, "dog far " + "x " * 200 + "cat"), (4, None), (5, "机器学习")], "id long, t string")
    index = retrieval.postings(docs.where("t is not null"), "id", "t")
    q = spark.createDataFrame([("a", ["cat", "dog"]), ("b", ["cat"]), ("c", []), ("d", ["学", "习"])], "qid string, terms array<string>")
    got = [(r.qid, r.id, r["rank"]) for r in retrieval.sparse_search(q, index, 5).orderBy("qid", "rank").collect()]
    assert got == [("a", 2, 1), ("a", 3, 2), ("b", 1, 1), ("b", 2, 2), ("b", 3, 3), ("d", 5, 1)]


def test_postings_without_a_group_for_each_term(spark):
    docs = spark.createDataFrame([("a", "b a b, B a-b"), ("b", None), ("c", ""), ("d", "机器 b 机"), (None, "x")], "id string, t string")
    index = retrieval.postings(docs, "id", "t")
    assert sorted((str(r.id), r.term, r.positions) for r in index.collect()) == [("None", "x", [1]), ("a", "a", [2, 5]), ("a", "b", [1, 3, 4, 6]), ("d", "b", [3]), ("d", "器", [2]), ("d", "机", [1, 4])]
    assert "Aggregate" not in index._jdf.queryExecution().optimizedPlan().toString()


def test_fusion_order(spark):
    dense = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2), ("q", "d3", 3)], "qid string, id string, rank int")
    sparse = spark.createDataFrame([("q", "d2", 1), ("q", "d4", 2), ("q", "d1", 3), ("q", "d2", 9)], "qid string, id string, rank int")
    got = [r.id for r in retrieval.fuse([dense, sparse], 60, 20).orderBy("rank").collect()]
    assert got[0] == "d2" and got.index("d1") < got.index("d3") and got.index("d1") < got.index("d4")


def test_rerank(spark):
    c = spark.createDataFrame([("q", "c0", 1, 0.2), ("q", "c1", 2, 0.9), ("q", "c2", 3, 0.4)], "qid string, id string, rank int, s double")
    order = lambda df: [r.id for r in df.orderBy("rerank_rank").collect()]
    assert order(retrieval.rerank(c, F.col("s"), 3)) == ["c1", "c2", "c0"]
    assert order(retrieval.rerank(c, F.col("s"), 2, 0.5)) == ["c1"]
    assert [r.id for r in retrieval.rerank(c, None, 2).orderBy("rank").collect()] == ["c0", "c1"]


def test_policy(spark):
    q = spark.createDataFrame([("How many antigens?", 1), ("Why does it fail", 1), ("who", 2), ("hello", 0)], "q string, m int")
    name, reason = context.policy(F.col("q"), F.col("m"), F.lit(False))
    got = [tuple(r) for r in q.select(name.alias("n"), reason.alias("r")).collect()]
    assert got == [("child", "fact_query"), ("parent", "query_requires_broad_context"), ("parent", "multiple_child_hits_same_parent"), ("neighbor", "default_neighbor_context")]
    assert q.select(context.policy(F.col("q"), F.col("m"), F.lit(True))[0].alias("n")).first().n == "parent"
    assert q.select(context.policy(F.col("q"), F.col("m"), F.lit(False), "odd")[1].alias("n")).first().n == "invalid_config:odd"


def test_scope_and_research(spark):
    hits = spark.createDataFrame([("q", "a.md", "a.md"), ("q", None, "b.md"), ("q", "c.md", None)], "qid string, source string, source_file string")
    scope = spark.createDataFrame([("a.md",), ("c.md",)], "name string")
    assert retrieval.in_scope(hits, scope).count() == 2 and retrieval.in_scope(hits, scope.limit(0)).count() == 3


def researched(spark, queries, found, keep=None, exclude=None, **kw):
    q = spark.createDataFrame(queries, "qid string, query string, focus string")
    h = spark.createDataFrame(found, "qid string, rank int, child_id string, parent_id string, chunk_index int, source string, content string, rrf_score double")
    children = spark.createDataFrame([(f"p{p}_child_{i}", f"p{p}", i, "f.md", f" text {p} {i} ") for p in (1, 2) for i in (0, 1, 998, 999, 1000)], "child_id string, parent_id string, chunk_index int, source string, content string")
    parents = spark.createDataFrame([("p1", " whole one ", "f.md"), ("p2", "whole two", None)], "parent_id string, page_content string, source string")
    pairs = lambda rows: spark.createDataFrame(rows, "qid string, parent_id string, pos int") if rows else None
    results, contexts = context.research(q, h, parents, children, retrieval.overlap_score, pairs(keep), pairs(exclude), **kw)
    out = {}
    for r in contexts.orderBy("qid", "ctx_pos").collect():
        out.setdefault(r.qid, []).append(r)
    return {r.qid: r for r in results.collect()}, out, {r.qid: json.loads(r.result) for r in context.research_json(results).collect()}


def test_research_neighbours_fallbacks_and_gaps(spark):
    found = [
        ("near", 1, "p1_child_999", "p1", 999, "f.md", "alpha text", 0.5),
        ("near", 2, "p9_child_x", "p9", None, "g.md", "alpha only itself", 0.4),
        ("low", 1, "p1_child_0", "p1", 0, "f.md", "nothing alike", 0.5),
        ("why lost", 1, "a", "p7", 0, "g.md", "alpha FIRST", 0.5),
        ("why lost", 2, "b", "p7", 1, "g.md", "alpha LAST", 0.4),
        ("why lost", 3, "p2_child_0", "p2", 0, "f.md", "alpha two", 0.3),
    ]
    queries = [("near", "alpha", None), ("low", "alpha", ""), ("none", "alpha", None), ("why lost", "why alpha", None)]
    r, c, j = researched(spark, queries, found)
    # neighbours in the order of the text over the thousand, then a hit without index as itself
    assert [x.child_id for x in c["near"]] == ["p1_child_998", "p1_child_999", "p1_child_1000", "p9_child_x"]
    assert [x.context_type for x in c["near"]] == ["neighbor_child"] * 3 + ["child"] and c["near"][0].content == "text 1 998"
    assert r["near"].diagnostics.evidence_status == "sufficient" and r["near"].diagnostics.context_policy == "neighbor"
    assert r["low"].diagnostics.evidence_status == "low_score" and r["none"].diagnostics.evidence_status == "insufficient"
    assert r["none"].gaps == ["No relevant document context was retrieved."] and j["none"]["contexts"] == [] and j["near"]["sources"] == ["f.md", "g.md"]
    # stored parents first; one that isn't stored falls back to its last hit, content and score from the same
    assert [(x.parent_id, x.context_type, x.content) for x in c["why lost"]] == [("p2", "parent", "whole two"), ("p7", "child", "alpha LAST")]
    assert c["why lost"][1].score == 0.5 and c["why lost"][0].source == "unknown" and r["why lost"].parent_ids == ["p7", "p2"]


def test_research_keeps_and_excludes(spark):
    found = [("k", 1, "p2_child_0", "p2", 0, "f.md", "alpha", 0.5), ("x", 1, "p1_child_0", "p1", 0, "f.md", "alpha", 0.5), ("x", 2, "p2_child_0", "p2", 0, "f.md", "alpha", 0.4)]
    r, c, _ = researched(spark, [("k", "alpha", None), ("x", "alpha", "who")], found, keep=[("k", "p1", 0), ("k", "p8", 1)], exclude=[("x", "p1", 0)])
    assert r["k"].parent_ids == ["p1", "p8", "p2"] and [x.parent_id for x in c["k"]] == ["p1", "p2"] and c["k"][0].score is None
    assert r["k"].diagnostics.context_policy_reason == "keep_parent_ids_requested"
    assert [x.child_id for x in c["x"]] == ["p2_child_0"] and r["x"].diagnostics.child_candidates == 2 and r["x"].focus == "who"
    r, c, _ = researched(spark, [("k", "alpha", None)], found, configured="child", threshold=None)
    assert c["k"][0].context_type == "child" and r["k"].diagnostics.context_policy_reason == "configured_policy"


def test_research_joins_texts_that_candidates_lack(spark):
    q = spark.createDataFrame([("a", "alpha", None), ("b", "beta", None)], "qid string, query string, focus string")
    children = spark.createDataFrame([("c0", "p1", 0, "f.md", "alpha one"), ("c1", "p1", 1, "f.md", None), ("c2", "p2", 0, "g.md", "beta two")], "child_id string, parent_id string, chunk_index int, source string, content string")
    parents = spark.createDataFrame([("p1", "whole", "f.md")], "parent_id string, page_content string, source string")
    ranks = spark.createDataFrame([("a", 1, "c1", 0.5), ("a", 2, "c0", 0.4), ("a", 3, "c2", 0.3), ("b", 1, "c2", 0.5)], "qid string, rank int, child_id string, rrf_score double")
    full = ranks.join(children, "child_id")
    for scorer in (retrieval.overlap_score, None):
        with_texts, without = ([sorted(map(repr, x.collect())) for x in context.research(q, h, parents, children, scorer)] for h in (full, full.drop("content")))
        assert with_texts == without and with_texts[1]


def test_scratch_tables_go(spark):
    from pageloom import session

    with session.scratch(spark):
        a, b = session.materialize(spark.range(5), "a"), session.materialize(spark.range(7).repartition(3), "b", lasting=True)
        gone, kept = a.inputFiles()[0], b.inputFiles()[0]
        assert a.count() == 5
    there = lambda f: os.path.exists(f.removeprefix("file://"))
    assert not there(gone) and there(kept) and b.count() == 7


def test_hooks_and_thresholds(spark):
    hits = spark.createDataFrame([(1, None), (2, 0.5), (3, 0.1)], "id int, score double")
    assert {x.id for x in retrieval.at_least_or_unknown(hits, "score", 0.3).collect()} == {1, 2} and retrieval.at_least_or_unknown(hits, "score", None).count() == 3
    q = spark.createDataFrame([("ab",), (None,)], "t string")
    got = retrieval.embed(q, "t", "v", lambda texts: [[len(x), 1.0] for x in texts], "query: ").collect()
    assert [x.v for x in got] == [[9.0, 1.0], [7.0, 1.0]]


def test_metrics(spark):
    q = spark.createDataFrame([("a", ["c2"], ["p9"], ["f"], "f"), ("b", [], ["p1"], [], "f"), ("c", None, None, None, None)], "question_id string, gold_child_ids array<string>, gold_parent_ids array<string>, gold_source_files array<string>, source_file string")
    r = spark.createDataFrame([("a", 1, "c1", "p1", "f"), ("a", 2, "c2", "p1", "f"), ("b", 1, "x", "p0", "g"), ("b", 2, "y", "p1", "g"), ("b", 3, "z", "p1", "g")], "question_id string, rank int, chunk_id string, parent_id string, source_file string")
    s = {x.question_id: x for x in evaluation.score_questions(q, r).collect()}
    assert s["a"].first_relevant_rank == 2 and s["a"].recall_1 == 0 and s["a"].recall_3 == 1 and s["a"].mrr == 0.5
    assert s["b"].mrr == 0.5 and s["b"].ndcg_3 > 1 and not s["c"].scored and s["c"].mrr == 0
    m = {x.metric: x.value for x in evaluation.aggregate_scores(evaluation.score_questions(q, r)).collect()}
    assert m["rows"] == 3 and m["scored_rows"] == 2 and m["mrr"] == 0.5
    f = {x.question_id: x.failure_type for x in evaluation.failures(evaluation.score_questions(q, r), q, 1).collect()}
    assert f["a"] == "missed_parent" and f["b"] == "missed_source"
    codes = {(x.code, x.question_id) for x in evaluation.validate(q, r, [1, 3]).collect()}
    assert ("missing_result_row", "c") in codes and ("missing_primary_gold", "c") in codes and ("insufficient_results_for_k", "a") in codes


def test_judge_rows(spark):
    j = spark.createDataFrame([("1", float("nan"), 0.9, 0.9), ("2", 0.5, 0.9, 0.2), ("3", 0.9, 0.9, 0.9), ("4", 2.0, None, 0.9)], "id string, faithfulness double, context_precision double, context_recall double")
    s = {r.metric: r for r in evaluation.judge_summary(j, ["faithfulness"]).collect()}["faithfulness"]
    assert s["rows"] == 3 and s.missing_rows == 1 and abs(s["mean"] - 0.8) < 1e-9
    f = {r.id: r.failure_type for r in evaluation.judge_failures(j, "id").collect()}
    assert f == {"1": "judge_metric_missing", "2": "insufficient_context", "4": "judge_metric_missing"}


def test_images(spark):
    from pageloom.operators import images

    docs = spark.createDataFrame([(1, 'a ![x](b%20c.png "t") mid ![y](<d.png>) end ![z](http://h/e.png)'), (2, None), (3, "")], "id long, text string")
    refs = images.references(docs, "id", "text")
    assert [(r.path, r.is_remote) for r in refs.orderBy("ref_no").collect()] == [("b c.png", False), ("d.png", False), ("http://h/e.png", True)]
    sizes = spark.createDataFrame([("d.png", 5, 5)], "path string, width int, height int")
    assert [r.path for r in images.describable(refs, "id", sizes, 10, 10).collect()] == ["b c.png"]
    assert images.contexts(docs, "id", "text").where("ref_no = 1").first().context == "a mid end"
    notes = spark.createDataFrame([(1, 0, "note")], "id long, ref_no int, description string")
    out = {r.id: r.text for r in images.enrich(docs, "id", "text", notes).collect()}
    assert out[1].index("note") < out[1].index("mid") and out[3] == ""


def test_ablation(spark):
    from pageloom.operators import ablation

    rows = spark.createDataFrame([("a", "s", 0.80, 50.0, 9.0), ("b", "s", 0.79, 40.0, 9.0), ("c", "s", 0.70, 1.0, 1.0), ("d", "t", 0.1, 1.0, 1.0)], "variant string, strategy string, balanced_score double, context_chars_5 double, index_chunks double")
    assert sorted(r.variant for r in ablation.best_by_strategy(rows).collect()) == ["b", "d"]
    try:
        retrieval.search("odd", None, None, 3)
    except ValueError:
        return
    raise AssertionError


#: The most joins and windows that the plans of the queries that start from hybrid search have; the driver's memory follows them.
PLANS = {
    "ablation_contexts": 12, "context_stats": 13, "ablation_documents": 3, "context_policy": 2, "ablation_policy": 2, "hits_text": 3, "parent_fallback": 4, "retrieval_metrics": 2, "metric_means": 2, "failure_cases": 3, "validity_summary": 6,
    "validity_warnings": 6, "rerank_threshold_topk": 3, "threshold_or_unknown": 1, "research_contexts": 1, "research": 7, "research_json": 7, "research_calls": 6, "ingestion_scores": 14, "ingestion_summary": 14, "numeric_means": 14,
}


@pytest.mark.parametrize("name", PLANS)
def test_plans_start_from_written_tables(name, spark, sf):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin\b|\bWindow \[", plan)) <= PLANS[name]


def written_for(name, spark, sf, monkeypatch, place):
    """The names of the tables that a query writes when no other ran before, and the input files of each."""
    place.symlink_to(sf)
    written = {}
    for module in (queries, retrieval, context):
        keep = module.materialize

        def note(df, table, *args, keep=keep, **kwargs):
            written[table] = df.inputFiles()
            return keep(df, table, *args, **kwargs)

        monkeypatch.setattr(module, "materialize", note)
    queries.QUERIES[name](spark, str(place)).collect()
    return written


def test_search_starts_from_written_questions(spark, sf, monkeypatch, tmp_path):
    written = written_for("context_policy", spark, sf, monkeypatch, tmp_path / "own")
    again = [t for t in ("queries", "known", "searched") if any("child_chunks" in f or "eval_questions" in f for f in written[t])]
    assert not again  # else every part of the plan deals all vectors again


def test_policies_need_first_hits_only(spark, sf, monkeypatch, tmp_path):
    written = written_for("ablation_policy", spark, sf, monkeypatch, tmp_path / "own")
    assert "searched" in written and not {"chunks", "candidates"} & set(written)  # texts of all chunks, all hits again
