"""Courses, their documents, sections and knowledge points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T

SECTIONS, POINTS = 20, 10


def memberships(docs: DataFrame, names: str, file: str) -> DataFrame:
    """(course, source_file): one row for each course a document is in; names may list several."""
    return docs.where(f"{names} is not null").select(F.explode(T.course_names(F.col(names))).alias("course"), F.col(file).alias("source_file")).distinct()


def course_list(members: DataFrame) -> DataFrame:
    """(course_id, course, n_documents)."""
    return members.groupBy("course").agg(F.countDistinct("source_file").alias("n_documents")).select(T.stable_id("course", F.col("course")).alias("course_id"), "course", "n_documents")


def _is_point(line: Column) -> Column:
    s = T.strip(line)
    body = F.regexp_replace(s, r"^([-*+]|\d+[.)])\s+", "")
    return s.rlike(r"^([-*+]|\d+[.)])\s+\S") & F.length(body).between(4, 80) & ~body.startswith("http")


def sections(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, points) of lines (source_file, page_pos, page_number, line_no, line).

    A heading of level one or two, or the first of any level up to four, opens a section; deeper
    ones and list items are its points, each once whatever its case. A file without headings is one
    section under its stem. The first 20 sections and the first 10 points of each count.
    """
    order = ["page_pos", "line_no"]
    level = F.when(F.col("line").rlike(r"^\s{0,3}#{1,4}\s+\S"), F.length(F.regexp_extract("line", r"^\s{0,3}(#{1,4})\s", 1)))
    x = lines.withColumn("level", level).where(F.col("level").isNotNull() | _is_point(F.col("line"))).withColumn("page", F.coalesce("page_number", F.lit(1)))
    w = Window.partitionBy("source_file").orderBy(*order)
    first = F.coalesce(F.count("level").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    x = x.withColumn("opens", F.col("level").isNotNull() & ((F.col("level") <= 2) | first))
    x = x.withColumn("section_no", F.sum(F.col("opens").cast("int")).over(w)).withColumn("title", T.clean_title(F.col("line")))
    heads = x.where("opens").select("source_file", "section_no", "title", F.col("page").alias("page_number"))
    alone = files.select("source_file").distinct().join(heads, "source_file", "left_anti").select("source_file", F.lit(1).cast("bigint").alias("section_no"), F.regexp_replace("source_file", r"\.[^.]*$", "").alias("title"), F.lit(1).alias("page_number"))
    out = heads.unionByName(alone).where(F.col("section_no") <= SECTIONS)
    out = out.withColumn("section_id", T.stable_id("section", F.concat_ws(":", "source_file", "title", F.col("page_number").cast("string"))))
    name = F.trim(F.regexp_replace(F.when(F.col("level").isNotNull(), F.col("title")).otherwise(T.squeeze(F.col("line"))), r"^[-*+\d.)\s]+", ""))
    points = x.where((F.col("section_no") >= 1) & ~F.col("opens")).withColumn("name", name).where(F.length("name").between(1, 80))
    seen = Window.partitionBy("source_file", "section_no", F.lower("name")).orderBy(*order)
    points = points.withColumn("rn", F.row_number().over(seen)).where("rn = 1")
    points = points.withColumn("point_no", F.row_number().over(Window.partitionBy("source_file", "section_no").orderBy(*order))).where((F.col("point_no") <= POINTS) & (F.col("section_no") <= SECTIONS))
    return out, points.select("source_file", "section_no", "point_no", "name", F.col("page").alias("page_number"))


def carry_titles(new: DataFrame, edited: DataFrame) -> DataFrame:
    """New sections with the titles users gave them before, by file and original title."""
    e = edited.select("source_file", F.col("original_title").alias("title"), F.col("title").alias("kept")).dropDuplicates(["source_file", "title"])
    return new.join(e, ["source_file", "title"], "left").withColumn("original_title", F.col("title")).withColumn("title", F.coalesce("kept", "title")).withColumn("user_edited", F.col("kept").isNotNull()).drop("kept")


def rename_course(members: DataFrame, old: str, new: str) -> DataFrame:
    """Memberships with a course renamed; an error if another course has the name already."""
    if members.where((F.lower("course") == new.lower()) & (F.col("course") != old)).limit(1).count():
        raise ValueError(f"course exists: {new}")
    return members.withColumn("course", F.when(F.col("course") == old, new).otherwise(F.col("course")))


def summary(members: DataFrame, section_rows: DataFrame) -> DataFrame:
    """(course, n_documents, n_sections, first_titles): the counts and the first five titles of each course."""
    j = members.join(section_rows, "source_file", "left")
    w = Window.partitionBy("course").orderBy("source_file", "section_no")
    top = j.where("title is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("course").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda x: x["title"]), "、").alias("first_titles"))
    return j.groupBy("course").agg(F.countDistinct("source_file").alias("n_documents"), F.count("title").alias("n_sections")).join(top, "course", "left").withColumn("first_titles", F.coalesce("first_titles", F.lit("")))
