"""Pages and lines of documents, and the noise the layout leaves in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T

MARKER = r"(?i)^\s*-{3,}\s*end\s+of\s+page\.page_number\s*=\s*(\d+)\s*-{3,}\s*$"


def latest(df: DataFrame, key: str) -> DataFrame:
    """Each record once: of rows delivered again under the same key the last one loaded counts."""
    by = Window.partitionBy(key).orderBy(F.col("loaded_at").desc_nulls_last())
    return df.withColumn("__rn", F.row_number().over(by)).where("__rn = 1").drop("__rn")


def split_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_pos, page_number, raw_text): the pages of every document.

    A document with end-of-page markers is divided at them, each with its own number; what follows
    the last marker is the page after it. One with form feeds is divided there, and blank pages are
    left out but counted; one of blank pages only is one empty page. Any other is one page without
    number.
    """
    body = docs.select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    marked = body.where(F.col("text").rlike(r"(?m)" + MARKER.replace("^", "(?:^)")))
    lines = marked.select("doc", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("number", F.regexp_extract("line", MARKER, 1).try_cast("int"))
    # a marker stands on the page it ends, so a page's number comes with its lines; a frame to the document's end would be read again for each line
    before = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("page", F.coalesce(F.count("number").over(before), F.lit(0)))
    own = F.when(F.col("number").isNull(), F.struct("n", "line"))
    pages = lines.groupBy("doc", "page").agg(F.max("number").alias("own"), F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["line"]), "\n").alias("raw_text"))
    pages = pages.withColumn("page_number", F.coalesce("own", F.max("own").over(Window.partitionBy("doc")) + 1))
    pages = pages.where(F.col("page_number").isNotNull() & (T.strip(F.col("raw_text")) != "")).select("doc", F.col("page").cast("int").alias("page_pos"), F.col("page_number").cast("int").alias("page_number"), "raw_text")
    other = body.join(marked.select("doc"), "doc", "left_anti")
    fed = other.where(F.contains("text", F.lit("\f"))).select("doc", F.posexplode(F.split("text", "\f")).alias("page_pos", "raw_text")).where(T.strip(F.col("raw_text")) != "")
    fed = fed.select("doc", "page_pos", (F.col("page_pos") + 1).alias("page_number"), T.strip(F.col("raw_text")).alias("raw_text"))
    blank = other.where(F.contains("text", F.lit("\f")) & (T.strip(F.replace(F.col("text"), F.lit("\f"), F.lit(""))) == "")).select("doc", F.lit(0).alias("page_pos"), F.lit(None).cast("int").alias("page_number"), F.lit("").alias("raw_text"))
    plain = other.where(~F.contains("text", F.lit("\f"))).select("doc", F.lit(0).alias("page_pos"), F.lit(None).cast("int").alias("page_number"), F.col("text").alias("raw_text"))
    return pages.unionByName(fed).unionByName(blank).unionByName(plain).withColumnRenamed("doc", key)


def lines(pages: DataFrame, page_key: str, text: str = "raw_text") -> DataFrame:
    """A row for each line with its index, the number of lines and whether it is inside a fence."""
    out = pages.withColumn("__x", F.split(F.col(text), "\n")).select("*", F.size("__x").alias("n_lines"), F.posexplode("__x").alias("line_no", "line")).drop("__x", text)
    fence = F.when(T.strip(F.col("line")).startswith("```"), 1).otherwise(0)
    return out.withColumn("is_fence", fence == 1).withColumn("in_fence", F.coalesce(F.sum(fence).over(Window.partitionBy(page_key).orderBy("line_no")), F.lit(0)) % 2 == 1)


def repeated_edges(page_lines: DataFrame, file: str, page: str, scan: int = 3, least: int = 3, share: float = 0.3) -> DataFrame:
    """(file, edge_key, n_pages, pages, confidence): lines that repeat among the first or last of a file's pages."""
    full = page_lines.where(T.strip(F.col("line")) != "")
    top, bottom = Window.partitionBy(page).orderBy("line_no"), Window.partitionBy(page).orderBy(F.desc("line_no"))
    edge = full.withColumn("t", F.row_number().over(top)).withColumn("b", F.row_number().over(bottom)).where((F.col("t") <= scan) | (F.col("b") <= scan))
    edge = edge.where(~T.is_page_number(F.col("line"), F.col("page_number"))).withColumn("edge_key", T.edge_key(F.col("line"))).where("edge_key <> ''")
    pages = page_lines.select(file, page).distinct().groupBy(file).agg(F.count(F.lit(1)).alias("pages"))
    n = edge.select(file, page, "edge_key").distinct().groupBy(file, "edge_key").agg(F.count(F.lit(1)).alias("n_pages"))
    need = F.greatest(F.lit(least), F.ceil(F.col("pages") * share))
    return n.join(pages, file).where(F.col("n_pages") >= need).withColumn("confidence", F.round(F.least(F.lit(0.99), F.col("n_pages") / F.col("pages")), 6))


def page_number_lines(page_lines: DataFrame, scan: int = 3) -> DataFrame:
    """Lines at a page's edge that hold only its number."""
    edge = (F.col("line_no") < scan) | (F.col("line_no") >= F.greatest(F.col("n_lines") - scan, F.lit(0)))
    return page_lines.where(edge & ~F.col("in_fence") & T.is_page_number(F.col("line"), F.col("page_number")))


def duplicate_headings(page_lines: DataFrame, page: str, between: str | None = None) -> DataFrame:
    """Headings that repeat the line before them on the same page, blank lines aside.

    Lines where the column ``between`` holds stand between two headings without being one.
    """
    full = page_lines.where((T.strip(F.col("line")) != ""))
    by = Window.partitionBy(page).orderBy("line_no")
    heading = ~F.col("in_fence") & T.heading_level(F.col("line")).isNotNull()
    key = F.when(heading if between is None else heading & ~F.coalesce(between, F.lit(False)), T.heading_key(F.col("line")))
    return full.withColumn("k", key).withColumn("before", F.lag("k").over(by)).where("k = before").drop("before").withColumnRenamed("k", "heading")


def slide_titles(page_lines: DataFrame, page: str) -> DataFrame:
    """(page, title): the first heading, else the first unprotected line among the first five."""
    s = T.strip(F.col("line"))
    heading = F.min(F.when(T.heading_level(s).isNotNull(), F.struct("line_no", T.strip(F.regexp_replace(s, r"^#{1,6}\s*", "")).alias("x"))))
    plain = F.min(F.when((F.col("line_no") < 5) & (s != "") & ~T.is_protected(F.col("line")), F.struct("line_no", s.alias("x"))))
    return page_lines.groupBy(page).agg(heading.alias("h"), plain.alias("p")).select(page, F.coalesce("h.x", "p.x").alias("title"))


def page_groups(pages: DataFrame, file: str, number: str = "page_number") -> DataFrame:
    """(file, first_page, last_page, n_pages): runs of consecutive page numbers."""
    p = pages.where(F.col(number).isNotNull()).select(file, F.col(number).alias("n")).distinct()
    island = p.withColumn("g", F.col("n") - F.row_number().over(Window.partitionBy(file).orderBy("n")))
    return island.groupBy(file, "g").agg(F.min("n").alias("first_page"), F.max("n").alias("last_page"), F.count(F.lit(1)).alias("n_pages")).drop("g")
