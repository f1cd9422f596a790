from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import chunking, clean, pages


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


MARK = "--- end of page.page_number={} ---"
PAGED = "\n".join(
    ["# Agentic RAG Overview", "- Tool calling", "Company Confidential", MARK.format(1), "# Retrieval Pipeline", "1. Query rewrite", "Company Confidential", MARK.format(2), "# Evaluation", "第 1 步：检索", "3 / 3", "Company Confidential", MARK.format(3)]
)


def test_split_by_markers_feeds_and_not_at_all(spark):
    docs = spark.createDataFrame([("m", PAGED), ("f", "one\f \f three"), ("p", "plain"), ("n", None), ("t", "a\n" + MARK.format(4) + "\nrest")], "doc string, text string")
    out = {(r.doc, r.page_number): r.raw_text for r in pages.split_pages(docs, "doc", "text").collect()}
    assert sorted((k for k in out), key=str) == sorted([("m", 1), ("m", 2), ("m", 3), ("f", 1), ("f", 3), ("p", None), ("n", None), ("t", 4), ("t", 5)], key=str)
    assert out["m", 1].startswith("# Agentic") and out["t", 5] == "rest" and out["f", 3] == "three"


def test_cleaner_removes_layout_and_keeps_content(spark):
    docs = spark.createDataFrame([("d", PAGED)], "doc string, text string")
    p = pages.split_pages(docs, "doc", "text").withColumn("page", F.concat_ws("-", "doc", "page_pos"))
    out, events = clean.clean(p, "doc", "page")
    text = "\n".join(r.cleaned_text for r in out.collect())
    assert "Company Confidential" not in text and "3 / 3" not in text
    for kept in ("# Agentic RAG Overview", "- Tool calling", "1. Query rewrite", "第 1 步：检索"):
        assert kept in text
    assert {r.reason for r in events.collect()} == {"repeated_header_footer", "page_number"}
    assert sorted(r.slide_title for r in out.collect()) == ["Agentic RAG Overview", "Evaluation", "Retrieval Pipeline"]


def test_duplicate_headings_on_one_page_only(spark):
    p = spark.createDataFrame([("f", "1", 1, "# A\n\n# A\nx\n```\n# A\n```"), ("f", "2", 2, "# A\ny")], "file string, page string, page_number int, raw_text string")
    assert rows(pages.duplicate_headings(pages.lines(p, "page"), "page"), "page", "line_no") == [("1", 2)]


def test_picture_and_analysis_blocks():
    assert clean.picture_reason("<br>BJUT<br>") and clean.picture_reason("short words")
    assert clean.picture_reason("attenuation 20 dB at 1 km<br>") is None
    assert clean.picture_reason("x " * 60) is None
    assert clean.analysis_reason("nothing") == "incomplete_image_analysis"
    assert clean.analysis_reason("RAG_SUMMARY: tiny\nKEY_TERMS: a") == "low_quality_image_analysis"
    assert clean.analysis_reason("RAG_SUMMARY: a long and telling summary\nKEY_TERMS: a") is None


def test_empty_tables(spark):
    e = spark.createDataFrame([], "file string, page string, page_number int, raw_text string")
    out, events = clean.clean(e, "file", "page")
    assert out.count() == 0 and events.count() == 0


def test_recursive_split_keeps_everything_in_order():
    text = "para one is here.\n\npara two\nwith a line " + "word " * 40 + "x" * 90
    parts = chunking.recursive_split(text, 60, 15)
    assert all(0 < len(p) <= 60 for p in parts)
    at = 0
    for p in parts:
        found = text.find(p.strip(), max(0, at - 60))
        assert found >= 0
        at = found
    assert chunking.recursive_split("", 10, 2) == [] and chunking.recursive_split("short", 10, 2) == ["short"]


def test_sections_and_parents():
    s = chunking.sections("intro\n# A\nx\n## B\ny\n# C\nz\n```\n# no\n```")
    assert [h for h, _ in s] == [{}, {"H1": "A"}, {"H1": "A", "H2": "B"}, {"H1": "C"}]
    parts = [chunking._Part("a" * 30, [1], ["t"]), chunking._Part("b" * 30, [2], ["u"]), chunking._Part("c" * 10, [3], [])]
    out = chunking.parents(parts, 50, 200, 10)
    assert len(out) == 1 and out[0].pages == [1, 2, 3] and out[0].titles == ["t", "u"]
    assert len(chunking.parents([chunking._Part("w " * 200, [1], [])], 50, 100, 10)) >= 4


def test_chunk_ids(spark):
    p = spark.createDataFrame([("slides", i - 1, i, None, f"# Page {i}\npage {i}") for i in (1, 2, 3, 5)], "doc string, page_pos int, page_number int, slide_title string, text string")
    out = chunking.chunk_documents(p, "doc", "text", least=1, most=2000, child_size=1000, child_overlap=0)
    assert [r.parent_id for r in out.orderBy("chunk_index").collect()] == [f"slides_page_{i}_parent_0" for i in (1, 2, 3, 5)]
    assert {r.child_id for r in out.collect()} == {f"slides_page_{i}_parent_0_child_0" for i in (1, 2, 3, 5)}


def test_gap_in_pages_stops_merging(spark):
    p = spark.createDataFrame([("d", 0, 1, None, "a"), ("d", 1, 2, None, "b"), ("d", 2, 4, None, "c")], "doc string, page_pos int, page_number int, slide_title string, text string")
    out = chunking.chunk_documents(p, "doc", "text", least=100, most=200)
    assert sorted(r.page_numbers for r in out.collect()) == [[1, 2], [4]]


def test_variants():
    assert chunking.parse_variant("single_500_100")["strategy"] == "single"
    assert chunking.parse_variant("pc_adaptive")["parent_size"] == 2000
    for bad in ("single_10_10", "x", "pc_1_2_3_4"):
        try:
            chunking.parse_variant(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_scalars(spark):
    df = spark.createDataFrame([("Database Systems， Computer Networks; database systems",)], "c string")
    assert df.select(T.course_names(F.col("c")).alias("x")).first().x == ["Database Systems", "Computer Networks"]
    df = spark.createDataFrame([("a\uf0b7\ue123b",), ("",), (None,)], "c string")
    assert [r.x for r in df.select(T.without_private_use(F.col("c")).alias("x")).collect()] == ["a•b", "", None]
    df = spark.createDataFrame([('{"a": 1}',), ('text {"a": 2} end',), ("none",)], "c string")
    assert [r.x for r in df.select(T.json_object(F.col("c"), "a").alias("x")).collect()] == ["1", "2", None]
    df = spark.createDataFrame([("第 3 页", 3), ("3 / 9", 3), ("-- 3 --", 3), ("p. 3", 3), ("3 of 7", 3), ("4", 3), ("page 3", None)], "line string, page int")
    assert [r.x for r in df.select(T.is_page_number(F.col("line"), F.col("page")).alias("x")).collect()] == [True] * 5 + [False, False]


def test_cleaner_numbers_between_headings_blocks_and_kept_lines(spark):
    from pageloom.operators import clean

    block = "**----- Start of picture text -----**<br>Figure 3<br>**----- End of picture text -----**<br>"
    analysis = "<!-- image-analysis:start\nOCR: x\nRAG_SUMMARY: short\nNOTE: goes on in the summary\nKEY_TERMS: a, b\nimage-analysis:end -->"
    bad = "<!-- image-analysis:start\nRAG_SUMMARY: only this\nimage-analysis:end -->"
    pages = [("f", f"p{n}", n, f"- shared bullet\n  running line  \n# Title {n}\nbody {n}") for n in (1, 2, 3)]
    pages += [("f", "p4", 4, "# Same\n4\n# Same\n# Same\n" + block + "\n" + analysis + "\n" + bad)]
    out, events = clean.clean(spark.createDataFrame(pages, "file string, page string, page_number int, raw_text string"), "file", "page")
    text = {r.page: r.cleaned_text for r in out.collect()}
    assert text["p4"].count("# Same") == 2 and "goes on" in text["p4"] and "only this" not in text["p4"] and "Figure" not in text["p4"]
    assert text["p1"] == "- shared bullet\n# Title 1\nbody 1"
    e = {(r.page, r.action, r.reason, r.text) for r in events.collect()}
    assert ("p1", "removed", "repeated_header_footer", "running line") in e and ("p1", "kept", "repeated_edge_line_but_protected", "- shared bullet") in e
    assert ("p4", "removed", "page_number", "4") in e and ("p4", "removed", "duplicate_heading", "# Same") in e
    assert ("p4", "removed", "low_value_picture_text", "Figure 3") in e and ("p4", "removed", "incomplete_image_analysis", "RAG_SUMMARY: only this") in e


def test_document_of_blank_feeds_is_one_empty_page(spark):
    from pageloom.operators import pages

    got = pages.split_pages(spark.createDataFrame([("a", "\f \f\n"), ("b", "x\f\fy")], "d string, t string"), "d", "t").orderBy("d", "page_pos").collect()
    assert [(r.d, r.page_number, r.raw_text) for r in got] == [("a", None, ""), ("b", 1, "x"), ("b", 3, "y")]


def test_split_pages_of_one_long_file(spark):
    import time

    text = "\n".join(f"{'line of text\n' * 39}--- end of page.page_number={k} ---" for k in range(1, 4001)) + "\nthe rest"
    began = time.time()
    got = {r.page_pos: (r.page_number, r.raw_text) for r in pages.split_pages(spark.createDataFrame([("long", text)], "doc string, text string"), "doc", "text").collect()}
    assert time.time() - began < 60  # 160,000 lines; each read again up to the end of the file took minutes
    assert len(got) == 4001 and got[3999][0] == 4000 and got[4000] == (4001, "the rest") and got[7] == (8, "\n".join(["line of text"] * 39))
