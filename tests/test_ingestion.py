import json

import pytest
from pyspark.sql import functions as F

from pageloom.operators import agent, courses, manifest, sessions
from pageloom.sources import readers, sinks
from pageloom.streaming import incremental


def test_scan_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hi")
    (tmp_path / "b.md").write_text("  \n")
    (tmp_path / "c.zip").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r.source_file: (r.status, r.reason) for r in readers.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("ok", ""), "b.md": ("failed", "empty_markdown"), "c.md": ("failed", "validation_failed"), "d.md": ("pending", "needs_conversion")}


def test_questions_from_jsonl(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    row = {"question_id": "1", "question": "q", "reference_answer": "a", "source_file": "x/y.pdf"}
    path.write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"question_id": "2", "gold_source_files": ["z.docx"]}) + "\n")
    got = {r.question_id: r.gold_source_files for r in readers.load_questions(spark, str(path)).collect()}
    assert got == {"1": ["y.md"], "2": ["z.md"]}
    path.write_text(json.dumps(row) + "\n" + json.dumps(row) + "\n")
    with pytest.raises(ValueError):
        readers.load_questions(spark, str(path))
    assert readers.load_questions(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([("b", 1.0), ("a", 0.5)], "metric string, value double")
    sinks.write_metrics_csv(m, str(tmp_path / "m"))
    assert [tuple(r) for r in readers.read_metrics_csv(spark, str(tmp_path / "m")).collect()] == [("a", 0.5), ("b", 1.0)]
    at = str(tmp_path / "t")
    sinks.replace_table(m, at)
    sinks.replace_table(spark.read.parquet(at).where("metric = 'a'"), at)
    assert spark.read.parquet(at).count() == 1


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("1", "a", 0), ("2", "b", 0)], "id string, v string, t int")
    new = spark.createDataFrame([("2", "c", 1), ("2", "d", 2), ("3", "e", 1)], "id string, v string, t int")
    assert sorted((r.id, r.v) for r in manifest.upsert(old, new, "id", "t").collect()) == [("1", "a"), ("2", "d"), ("3", "e")]
    rows = spark.createDataFrame([("a.md", None), (None, "a.md"), ("b.md", "b.md")], "source string, source_file string")
    assert manifest.delete_source(rows, spark.createDataFrame([("a.md",)], "name string")).count() == 1


def test_sessions(spark):
    s = spark.createDataFrame([("s",), ("e",)], "id string")
    t = spark.createDataFrame([(i, "s", i, f"q{i}", f"a{i}") for i in range(1, 8)], "id long, session_id string, turn_index int, user_original string, assistant_final string")
    assert [r.turn_index for r in sessions.recent_turns(t).orderBy("place").collect()] == [3, 4, 5, 6, 7]
    assert {r.id: r.next_index for r in sessions.next_turn(s, t).collect()} == {"s": 8, "e": 1}
    assert "not evidence" in sessions.memory_block(t).first().memory


def test_courses(spark):
    lines = spark.createDataFrame([("f.md", 0, 1, 0, "### Deep first"), ("f.md", 0, 1, 1, "- point one"), ("f.md", 0, 1, 2, "- Point One"), ("f.md", 0, 1, 3, "#### sub"), ("f.md", 1, 2, 0, "# Next"), ("g.md", 0, None, 0, "no heading")], "source_file string, page_pos int, page_number int, line_no int, line string")
    sec, pts = courses.sections(lines, lines)
    assert sorted((r.source_file, r.section_no, r.title) for r in sec.collect()) == [("f.md", 1, "Deep first"), ("f.md", 2, "Next"), ("g.md", 1, "g")]
    assert [r.name for r in pts.orderBy("point_no").collect()] == ["point one", "sub"]
    m = spark.createDataFrame([("A", "f.md"), ("B", "g.md")], "course string, source_file string")
    with pytest.raises(ValueError):
        courses.rename_course(m, "A", "b")
    assert {r.course for r in courses.rename_course(m, "A", "C").collect()} == {"B", "C"}


def test_evidence(spark):
    r = spark.createDataFrame([("a", 0, "low_score", None, None, None), ("b", 2, None, None, None, 0.1), ("c", 2, None, None, None, None), ("d", 0, None, None, "RAG_RESEARCH_ERROR: x", None), ("e", 0, None, None, None, None)], "k string, n_contexts int, status string, error string, gap string, best_score double")
    assert {x.k: x.status for x in agent.grade_evidence(r, "k", 0.5).collect()} == {"a": "low_score", "b": "low_score", "c": "sufficient", "d": "error", "e": "insufficient"}


def test_streams(spark, tmp_path):
    src = tmp_path / "turns"
    spark.createDataFrame([("s", 1, "2024-01-01"), ("s", 2, "2024-01-02"), ("u", 3, "2024-01-01")], "session_id string, id long, created_at string").write.parquet(str(src))
    stream = spark.readStream.schema("session_id string, id long, created_at string").parquet(str(src))
    got = sorted((r.session_id, r.id, r.turn_index) for r in incremental.run_once(spark, incremental.number_turns(stream), "numbered").collect())
    assert got == [("s", 1, 1), ("s", 2, 2), ("u", 3, 1)]
    table = str(tmp_path / "table")
    for _ in range(2):
        q = incremental.ingest(spark.readStream.schema("session_id string, id long, created_at string").parquet(str(src)), table, "id").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(table).count() == 3


def test_late_rows_and_expiry(spark, tmp_path):
    src = tmp_path / "tasks"
    spark.createDataFrame([("t1", "done", "2024-01-01 00:00:00"), ("t2", "running", "2024-01-01 00:00:00")], "task_id string, status string, updated_at string").write.parquet(str(src))
    stream = spark.readStream.schema("task_id string, status string, updated_at string").parquet(str(src))
    q = incremental.expire_tasks(stream).writeStream.format("memory").queryName("expired").outputMode("append").trigger(once=True).start()
    try:
        assert q.awaitTermination(60) or True
        got = [tuple(r) for r in spark.table("expired").collect()]
    finally:
        q.stop()
    assert got == [("t1", "done")]
    old = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:09:00")], "id string, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))
    assert [r.id for r in agent.expired(old, F.to_timestamp(F.lit("2024-01-01 00:10:01"))).collect()] == ["a"]


def test_reasons_deletes_and_selected_pages(spark):
    from pageloom.operators import manifest

    incoming = spark.createDataFrame([("new", "h"), ("old", "h")], "source_file string, raw_file_hash string")
    m = spark.createDataFrame([("old", "h", "success", "c1", True)], "source_file string, raw_file_hash string, status string, config_hash string, markdown_exists boolean")
    reasons = lambda table, h: {r.source_file: r.reason for r in manifest.skip_reasons(incoming, table, h).collect()}
    assert reasons(m, "c1") == {"new": "new_document", "old": "unchanged_file"}
    assert reasons(m, "c2") == {"new": "index_config_changed", "old": "index_config_changed"} and set(reasons(m.limit(0), "c2").values()) == {"new_document"}
    tables = {
        "chunks": spark.createDataFrame([("d1", "a.md", None), ("d2", "b.md", "a.md"), ("d3", "c.md", None), (None, None, None)], "doc_id string, source_file string, source string"),
        "parents": spark.createDataFrame([("p1",), ("p2",)], "parent_id string"),
        "other": spark.createDataFrame([(1,)], "x int"),
    }
    left, report = manifest.delete_document(tables, "d1", ["a.md"], ["p1"])
    r = {x.artifact: x for x in report.collect()}
    assert left["chunks"].count() == 2 and r["chunks"].deleted == 2 and left["parents"].count() == 1 and r["other"].error and left["other"].count() == 1
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", 2)], "f string, page_number int")
    chosen = spark.createDataFrame([("a", 1)], "f string, page_number int")
    assert manifest.selected_pages(pages, chosen, "f").count() == 2
    assert manifest.config_hash({"b": 1, "a": [2]}) == manifest.config_hash({"a": [2], "b": 1}) != manifest.config_hash({"a": [1], "b": 1})
