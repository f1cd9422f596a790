"""The cleaner: layout noise and low-value blocks out of every page, with an audit row for each removal."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import pages as P

# What encloses the text of a picture and an image's analysis, and the fields of one.
_PICTURE = re.compile(r"\*\*-{5} Start of picture text -{5}\*\*<br>(.*?)\*\*-{5} End of picture text -{5}\*\*<br>", re.S)
_ANALYSIS = re.compile(r"<!--\s*image-analysis:start(.*?)image-analysis:end\s*-->", re.S)
_FIELD = re.compile(r"^(OCR|RAG_SUMMARY|KEY_TERMS):\s*(.*)$")
# Lines of pictures that say nothing, and words that make a short one worth keeping.
NOISE_LINES = (r"^college of computer science\b", r"\bbjut\b", r"^figure\s+\d+(?:\.\d+)?\b", r"^page\s+\d+\b")
_DATA = re.compile(r"\b(?:db|mhz|ghz|km|hz|mbps|next|acr|attenuation|frequency|horizon|loss)\b", re.I)


def plain_picture(block: str) -> str:
    """The text of a picture without marks; its breaks are lines."""
    return re.sub(r"<[^>]+>|\*\*", "", re.sub(r"<br\s*/?>", "\n", block, flags=re.I))


def picture_reason(block: str, noise: tuple[str, ...] = NOISE_LINES) -> str | None:
    """Why the text of a picture is dropped, None if it is kept."""
    rows = [" ".join(x.split()) for x in plain_picture(block).split("\n") if x.strip()]
    telling = " ".join(x for x in rows if not any(re.search(n, x.lower()) for n in noise))
    if not telling or len(telling) < 80 and not (_DATA.search(telling) and any(c.isdigit() for c in telling)):
        return "low_value_picture_text"
    return None


def analysis_fields(block: str) -> dict[str, str]:
    """The three fields of an analysis; lines after a field's first one belong to it."""
    out: dict[str, str] = {}
    name = None
    for line in map(str.strip, block.splitlines()):
        if m := _FIELD.match(line):
            name, out[m.group(1)] = m.group(1), m.group(2).strip()
        elif name and line:
            out[name] = f"{out[name]} {line}".strip()
    return out


def analysis_reason(block: str) -> str | None:
    """Why a comment with an image's analysis is dropped, None if it is kept."""
    fields = analysis_fields(block)
    if not fields.get("RAG_SUMMARY") or not fields.get("KEY_TERMS"):
        return "incomplete_image_analysis"
    return "low_quality_image_analysis" if len(fields["RAG_SUMMARY"]) < 15 else None


def _blocks(noise: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, events = [], []
            for text in pdf["raw_text"]:
                removed: list[dict] = []

                def judge(m: re.Match, reason: str | None, shown: str, removed: list[dict] = removed) -> str:
                    if reason is None:
                        return m.group()
                    compact = " ".join(shown.split())
                    removed.append({"text": compact if len(compact) <= 240 else compact[:237] + "...", "reason": reason, "confidence": 0.9})
                    return ""

                out = _PICTURE.sub(lambda m: judge(m, picture_reason(m.group(1), noise), plain_picture(m.group(1))), text or "")
                texts.append(_ANALYSIS.sub(lambda m: judge(m, analysis_reason(m.group(1)), m.group(1)), out))
                events.append(removed)
            yield pdf.assign(raw_text=texts, events=events)

    return run


def without_low_value_blocks(pages: DataFrame, noise: tuple[str, ...] = NOISE_LINES) -> DataFrame:
    """``pages`` with the blocks of pictures that say nothing taken out of raw_text and listed in events.

    ``noise`` are patterns of lines, in lower case, that say nothing: layout of the user's own files.
    """
    schema = pages.withColumn("events", F.lit(None).cast("array<struct<text:string,reason:string,confidence:double>>")).schema
    return pages.mapInPandas(_blocks(noise), schema)


def clean(pages: DataFrame, file: str, page: str, scan: int = 3, least: int = 3, share: float = 0.3, noise: tuple[str, ...] = NOISE_LINES) -> tuple[DataFrame, DataFrame]:
    """(pages, events) of pages (file, page, page_number, raw_text).

    Out go lines holding the page's number, headings that repeat the one before (a number between
    them sets them apart), header and footer lines that repeat over the file, and blocks of pictures
    without value. Every removal is an event with its reason and confidence; a repeated line that is
    protected content is one too, of action ``kept``. Repetition is detected on the pages as they
    came.
    """
    raw = P.lines(pages.select(file, page, "page_number", "raw_text"), page)
    repeated = P.repeated_edges(raw, file, page, scan, least, share).select(file, "edge_key", "confidence")
    blocked = without_low_value_blocks(pages.select(file, page, "page_number", F.regexp_replace(T.without_private_use(F.col("raw_text")), "\r\n?", "\n").alias("raw_text")), noise)
    body = P.lines(blocked.drop("events"), page)
    titles = P.slide_titles(body, page)
    at_edge = (F.col("line_no") < scan) | (F.col("line_no") >= F.greatest(F.col("n_lines") - scan, F.lit(0)))
    body = body.withColumn("number", F.coalesce(at_edge & ~F.col("in_fence") & T.is_page_number(F.col("line"), F.col("page_number")), F.lit(False)))
    twice = P.duplicate_headings(body, page, "number").select(page, "line_no", F.lit(True).alias("twice"))
    marked = body.join(twice, [page, "line_no"], "left").withColumn("edge_key", F.when(at_edge & ~F.col("in_fence") & ~F.col("is_fence") & (T.strip(F.col("line")) != ""), T.edge_key(F.col("line"))))
    marked = marked.join(repeated, [file, "edge_key"], "left").join(titles, page, "left")
    bare = T.strip(F.col("line"))
    protected = T.is_protected(F.col("line")) | F.coalesce(bare == F.col("title"), F.lit(False))
    again = F.col("confidence").isNotNull()
    reason = F.when(F.col("number"), "page_number").when(F.col("twice"), "duplicate_heading").when(again & ~protected, "repeated_header_footer")
    marked = marked.withColumn("reason", reason).withColumn("kept_reason", F.when(reason.isNull() & again, "repeated_edge_line_but_protected"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = marked.groupBy(file, page, "page_number").agg(F.regexp_replace(text, r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "").alias("cleaned_text"), F.first("title").alias("slide_title"))
    sure = F.when(F.col("reason").isin("page_number", "duplicate_heading"), F.lit(0.95)).otherwise(F.col("confidence"))
    events = marked.where("reason is not null or kept_reason is not null").select(file, page, "page_number", bare.alias("text"), F.when(F.col("reason").isNull(), "kept").otherwise("removed").alias("action"), F.coalesce("reason", "kept_reason").alias("reason"), sure.alias("confidence"))
    blocks = blocked.select(file, page, "page_number", F.explode("events").alias("e")).select(file, page, "page_number", "e.text", F.lit("removed").alias("action"), "e.reason", "e.confidence")
    return out, events.unionByName(blocks)


def join_pages(cleaned: DataFrame, file: str, order: str) -> DataFrame:
    """(file, text): the cleaned pages of a file, blank ones left out, with an empty line between."""
    rows = cleaned.where(T.strip(F.col("cleaned_text")) != "")
    return rows.groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "cleaned_text"))), lambda x: x["cleaned_text"]), "\n\n").alias("text"))
