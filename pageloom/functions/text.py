"""Scalar text functions as column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"\p{IsHan}|(?:[^\P{L}\p{IsHan}]|\p{N})+"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case words; every ideograph is a token of its own."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def preview(c: Column, limit: int) -> Column:
    """Squeezed text, cut to ``limit`` characters with three dots."""
    s = squeeze(c)
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 3), F.lit("..."))).otherwise(s)


def session_title(c: Column, limit: int = 40) -> Column:
    """The first ``limit`` characters, with three dots if there were more."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(c)), r"\s+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9一-鿿_-]+", ""), r"^[-_]+|[-_]+$", "")
    return F.when(s == "", F.lit("course")).otherwise(s)


def stable_id(prefix: str, c: Column) -> Column:
    """prefix, slug and the first eight digits of the value's SHA-1."""
    return F.concat_ws("_", F.lit(prefix), slug(c), F.substring(F.sha1(c), 1, 8))


def clean_title(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"^\s{0,3}#+\s*", ""))


def heading_level(line: Column) -> Column:
    """1 to 6 for a Markdown heading, null for another line."""
    return F.when(line.rlike(r"^\s{0,3}#{1,6}\s+\S"), F.length(F.regexp_extract(line, r"^\s{0,3}(#{1,6})", 1)))


def edge_key(line: Column) -> Column:
    """Equal for header and footer lines that differ in numbers, marks or case only."""
    s = F.regexp_replace(strip(line), r"^\s{0,3}#{1,6}\s*", "")
    s = F.regexp_replace(s, r"[*_`]+", "")
    s = F.regexp_replace(s, r"(?i)\b(page|p\.)\s*\d+\b", "page")
    s = F.regexp_replace(s, r"\b\d+\s*/\s*\d+\b", "")
    s = F.regexp_replace(s, r"(?i)\b\d+\s+of\s+\d+\b", "")
    s = F.regexp_replace(s, r"第\s*\d+\s*页", "")
    return F.lower(squeeze(s))


def heading_key(line: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(strip(line), r"^\s{0,3}#{1,6}\s*", ""), r"[*_`]+", "")
    return F.lower(squeeze(s))


def is_protected(line: Column) -> Column:
    """Headings, lists, tables and lines with a colon are content wherever they stand."""
    s = strip(line)
    structure = s.rlike(r"^#{1,6}\s+\S") | s.rlike(r"^[-*+]\s+\S") | s.rlike(r"^\d+[.)]\s+\S") | s.rlike(r"^\|.*\|$")
    return (s != "") & (structure | (s.rlike("[:：]") & (F.length(s) > 6)))


def is_page_number(line: Column, page: Column) -> Column:
    """Whether a line holds the number of its page and nothing else."""
    s = F.regexp_replace(strip(line), r"[*_`]", "")
    n = r"\d+"
    shaped = s.rlike(rf"(?i)^(?:-+\s*)?{n}(?:\s*-+)?$|^(?:page|p\.)\s*{n}$|^第\s*{n}\s*页$|^{n}\s*/\s*\d+$|^{n}\s+of\s+\d+$")
    balanced = s.rlike(r"^-+\s*\d+\s*-+$") | ~s.rlike("-")
    return page.isNotNull() & (F.length(s) <= 30) & shaped & balanced & (F.regexp_extract(s, r"(\d+)", 1) == page.cast("string"))


# Private-use glyphs of common symbol fonts and what they show.
GLYPHS = {0xF0D8: "•", 0xF09C: "–", 0xF0B7: "•", 0xF0A7: "◆", 0xF0FC: "✓", 0xF0E0: "✉", 0xF0D1: "▶", 0xF0B2: "→"}


def without_private_use(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "".join(map(chr, GLYPHS)), "".join(GLYPHS.values())), "[\\uE000-\\uF8FF]+", "")


def leading_digits(c: Column) -> Column:
    return F.regexp_extract(c, r"^\d*", 0)


def parent_ordinal(c: Column) -> Column:
    """The number at the end of a parent's id, 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"_parent_(\d+)$", 1).try_cast("int"), F.lit(0))


def json_object(c: Column, field: str) -> Column:
    """A field of a JSON object that may stand inside other text; null if there is none."""
    return F.coalesce(F.get_json_object(c, f"$.{field}"), F.get_json_object(F.regexp_extract(c, r"(?s)(\{.*\})", 1), f"$.{field}"))


def sources_block(c: Column) -> Column:
    """Names listed after **Sources:**, sorted, each once; only those with a dot are names of files."""
    block = F.regexp_extract(c, r"(?s)\*\*Sources:\*\*(.*)$", 1)
    names = F.transform(F.split(block, r"\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^-+\s*", "")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x.contains("."))))


def course_names(c: Column) -> Column:
    """Names divided by commas, semicolons or line breaks, each once whatever its case, in order."""
    parts = F.filter(F.transform(F.split(c, r"[,，\n;；]+"), lambda x: F.trim(x)), lambda x: x != "")
    lowered = F.transform(parts, F.lower)
    return F.filter(F.transform(parts, lambda x, i: F.when(F.array_position(lowered, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())


def contains_any(c: Column, markers: list[str]) -> Column:
    """Substring test against a fixed list, as one pattern."""
    import re

    return F.lower(c).rlike("|".join(re.escape(m) for m in markers))
