"""Image references in Markdown: found, resolved to their text around, and enriched with descriptions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T

REFERENCE = r"!\[[^\]]*\]\(([^)]+)\)"


def clean_reference(c: Column) -> Column:
    """The path of a reference: without angle brackets or a title, percent signs decoded."""
    s = T.strip(c)
    angle = F.regexp_extract(s, r"^<([^>]*)>", 1)
    titled = F.regexp_extract(s, r"""^(.+?)\s+['"].*['"]$""", 1)
    path = F.when(s.rlike(r"^<[^>]*>"), angle).when(titled != "", titled).otherwise(s)
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ref_no, path, is_remote): the image references of every text in order."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(REFERENCE), F.lit(1))).alias("ref_no", "ref"))
    out = found.select(key, "ref_no", clean_reference(F.col("ref")).alias("path"))
    return out.withColumn("is_remote", F.col("path").rlike(r"^(?:https?://|data:)"))


def describable(refs: DataFrame, key: str, sizes: DataFrame, min_width: int, min_height: int, most: int = 80) -> DataFrame:
    """References worth describing: local, the first of each path, at most ``most`` a document, not known to be tiny.

    ``sizes`` has (path, width, height); an image of unknown size is kept.
    """
    first = refs.where("not is_remote").groupBy(key, "path").agg(F.min("ref_no").alias("ref_no"))
    sized = first.join(sizes, "path", "left").where(F.col("width").isNull() | F.col("height").isNull() | ((F.col("width") >= min_width) & (F.col("height") >= min_height)))
    w = Window.partitionBy(key).orderBy("ref_no")
    return sized.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select(key, "ref_no", "path")


def _around(span: int):
    ref, comment, space = regex.compile(REFERENCE), regex.compile(r"<!--.*?-->", regex.S), regex.compile(r"\s+")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                for k, m in enumerate(ref.finditer(text or "")):
                    near = text[max(0, m.start() - span) : m.start()] + "\n" + text[m.end() : m.end() + span]
                    rows.append((key, k, space.sub(" ", comment.sub("", ref.sub("", near))).strip()))
            yield pd.DataFrame(rows, columns=["key", "ref_no", "context"])

    return run


def contexts(docs: DataFrame, key: str, text: str, span: int = 1200) -> DataFrame:
    """(key, ref_no, context): the text around every reference without images and comments, squeezed."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(_around(span), f"key {kind}, ref_no int, context string").withColumnRenamed("key", key)


def _splice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ref = regex.compile(REFERENCE)
    for pdf in batches:
        out = []
        for text, notes in zip(pdf["text"], pdf["notes"], strict=True):
            by = {n["ref_no"]: n["description"] for n in (notes if notes is not None else [])}
            parts, at = [], 0
            for k, m in enumerate(ref.finditer(text or "")):
                parts.append((text or "")[at : m.end()])
                at = m.end()
                if k in by:
                    parts.append(f"\n\n<!-- image-analysis:start\n{by[k]}\nimage-analysis:end -->\n")
            out.append("".join(parts) + (text or "")[at:])
        yield pd.DataFrame({"key": pdf["key"], "text": out})


def enrich(docs: DataFrame, key: str, text: str, descriptions: DataFrame) -> DataFrame:
    """(key, text): every description (key, ref_no, description) set after its reference, in order."""
    kind = docs.schema[key].dataType.simpleString()
    notes = descriptions.groupBy(key).agg(F.collect_list(F.struct("ref_no", "description")).alias("notes"))
    rows = docs.join(notes, key, "left").select(F.col(key).alias("key"), F.col(text).alias("text"), "notes")
    return rows.mapInPandas(_splice, f"key {kind}, text string").withColumnRenamed("key", key).withColumnRenamed("text", text)
