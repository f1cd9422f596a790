"""Noise of scanned and laid-out pages: found, and repaired into continuous paragraphs.

Lines are one row each. Lines the layout repeats are found by a key in which look-alike characters
and all numbers are equal; page numbers by their distance from the page's position, which is the
same over a file. Words divided at the end of a line are judged by the line that follows, on the
next page too. Misread words are found as rare words whose anagram hash differs from that of a much
more frequent word by the difference of a known confusion, or of two: the join is one on equal
numbers, and what it finds is checked and ranked. Misread ideographs are learnt from contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import materialize

EDGE = 3  # lines from the top or bottom that the layout may use
SHARE = 0.2  # share of a file's pages a running line is on
RATIO = 8  # a word counts as much more frequent from this ratio on
BROADCAST_ROWS = 200_000  # a table of words or keys is broadcast only if it is known to be no larger
# What recognition makes of a letter (read as, written).
CONFUSIONS = [
    ("l", "i"), ("I", "l"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("i", "l"), ("l", "I"), ("1", "I"), ("!", "I"), ("|", "l"), ("5", "s"), ("5", "S"), ("0", "o"), ("0", "O"), ("o", "0"),
    ("9", "g"), ("6", "b"), ("6", "ó"), ("6", "é"), ("8", "B"), ("3", "e"), ("†", "t"), ("†", "T"), ("c", "e"), ("e", "c"), ("C", "E"), ("6", "B"), ("9", "G"), ("!", "l"), ("M", "IN"), ("VV", "W"), ("LI", "H"), ("II", "U"), ("L", "I"),
    ("B", "ß"), ("ii", "u"), ("ii", "ü"), ("li", "h"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("m", "in"), ("m", "rn"), ("nn", "m"), ("d", "cl"), ("h", "li"), ("u", "ii"), ("tl", "d"),
]
_HYPHENS = "-‐‑¬­"
_DIGIT = "0-9lIoOSBZ|!i"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", "")


def fold(line: Column) -> Column:
    """A key under which a line equals its misread versions: numbers are #, look-alike letters are one."""
    c = _trim(line)
    c = F.regexp_replace(c, r"(?<![\p{IsLatin}\p{N}])(?:[0-9lIOSB|!] )+[0-9lIOSB|!](?![\p{IsLatin}\p{N}!|†])", "#")
    c = F.regexp_replace(c, rf"(?<![\p{{IsLatin}}\p{{N}}!|])(?=[{_DIGIT}]*[0-9])[{_DIGIT}]+(?![\p{{IsLatin}}\p{{N}}†!|])", "#")
    c = F.translate(F.lower(c), "1!|lr056†9cß", "iiiiiosbtgeb")
    for long, short in (("h", "ii"), ("u", "ii"), ("m", "in"), ("d", "ei"), ("w", "vv")):
        c = F.replace(c, F.lit(long), F.lit(short))
    return F.regexp_replace(c, r"\s+", " ")


# Forms of a line that holds a page's number, in the folded key.
_PAGE_KEY = r"^(?:第 ?# ?页|(?:page|p\.|pg\.|s\.|seite|pagina|página|pág\.|blatt) ?#(?: ?(?:of|von|de|sii?i|/) ?#)?|[-–—~·•\[(|*_=]+ ?# ?[-–—~·•\])|*_=]+|# ?/ ?#|# (?:of|von|de|sii?i) #|#|# ?页)$"


def _roman(n: int) -> str:
    out = ""
    for value, text in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
        out, n = out + text * (n // value), n % value
    return out


def _number(line: Column) -> Column:
    """The first number of a line, with digits that were read as letters put right."""
    joined = F.regexp_replace(_trim(line), r"(?<=^|[^\p{L}\p{N}])([0-9lIOSB|!]) (?=[0-9lIOSB|!](?:[^\p{L}\p{N}]|$))", "$1")
    found = F.regexp_extract(joined, rf"(?<![\p{{IsLatin}}\p{{N}}!|])((?=[{_DIGIT}]*[0-9])[{_DIGIT}]+)", 1)
    return F.translate(found, "lI|!iOoSBZ", "1111100582").try_cast("int")


def blocks_of(df: DataFrame) -> DataFrame:
    """(block_id, source_file, page_pos, text): each block once, from raw_lines where raw_text is null."""
    text = F.coalesce("raw_text", F.array_join("raw_lines", "\n"))
    rows = df.where("block_id is not null").select("block_id", "source_file", "page_pos", text.alias("text"))
    return rows.groupBy("block_id").agg(F.min_by(F.struct("source_file", "page_pos", "text"), F.coalesce("text", F.lit(""))).alias("x")).select("block_id", "x.*")


def lines_of(blocks: DataFrame) -> DataFrame:
    """A row for each line with its place among the lines that aren't blank, from both edges, and its kind."""
    split = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    lines = blocks.select("block_id", "source_file", "page_pos", F.posexplode(split).alias("line_no", "line"))
    # places are within one page, so the windows are as small as a page
    by = Window.partitionBy("block_id").orderBy("line_no")
    full = F.when(F.length(F.trim("line")) > 0, 1).otherwise(0)
    fence = F.when(F.col("line").rlike(r"^\s*(?:```|~~~)"), 1).otherwise(0)
    lines = lines.withColumn("top", F.sum(full).over(by) - 1).withColumn("bottom", F.sum(full).over(Window.partitionBy("block_id")) - F.sum(full).over(by)).withColumn("fences", F.sum(fence).over(by))
    kind = (
        F.when(F.length(F.trim("line")) == 0, "blank")
        .when((F.col("fences") % 2 == 1) | F.col("line").rlike(r"^\s*(?:```|~~~)"), "code")
        .when(F.col("line").rlike(r"^\s*#{1,6}\s"), "heading")
        .when(F.col("line").rlike(r"^\s*\|"), "table")
        .when(F.col("line").rlike(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+\S") & ~F.col("line").rlike(r"^\s*-\s*\S+\s*-\s*$"), "list")
        .otherwise("text")
    )
    return lines.withColumn("kind", kind).drop("fences")


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a table whose size is counted first: broadcast up to BROADCAST_ROWS, else salted against hot keys."""
    small = materialize(small, "sized")
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salts = 16
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).join(spread, [*on, "__salt"], how).drop("__salt")


def layout(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """``lines`` with the column layout: running_line, page_number or null.

    A line counts if it repeats over the file's pages, or holds the page's number, and only such
    lines stand between it and the edge of the page.
    """
    pages = blocks.groupBy("source_file").agg(F.count(F.lit(1)).alias("pages"))
    edge = lines.where(((F.col("top") < EDGE) | (F.col("bottom") < EDGE)) & F.col("kind").isin("text", "list")).withColumn("key", fold(F.col("line")))
    is_roman = F.lower(_trim("line")).rlike(r"^[-–—~·\[( ]*[ivxlc1!]+[-–—~·\]) ]*$") & F.lower("line").rlike("[ivxlc]") & ~F.col("line").rlike(r"[IL]\p{Ll}")
    romans = F.broadcast(lines.sparkSession.createDataFrame([(_roman(k), k) for k in range(1, 4000)], "roman string, roman_value int"))
    edge = edge.withColumn("roman", F.when(is_roman, F.translate(F.lower(F.regexp_replace("line", r"[^\p{L}1!]", "")), "1!", "ii")))
    edge = materialize(edge.join(romans, "roman", "left").select("block_id", "source_file", "page_pos", "line_no", "line", "kind", "top", "bottom", "key", "roman_value"), "edges")
    numbered = edge.where(F.col("key").rlike(_PAGE_KEY) | F.col("roman_value").isNotNull()).withColumn("value", F.coalesce("roman_value", _number(F.col("line")))).where("value is not null")
    numbered = numbered.withColumn("offset", F.col("value") - F.col("page_pos"))
    # the offset most pages of a file agree on
    offsets = numbered.select("source_file", "offset", "block_id").distinct().groupBy("source_file", "offset").agg(F.count(F.lit(1)).alias("n"))
    chosen = offsets.groupBy("source_file").agg(F.max_by("offset", F.struct(F.col("n"), -F.col("offset"))).alias("offset"), F.max("n").alias("agree")).join(pages, "source_file").where(F.col("agree") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.15)))
    keys = edge.where((F.col("kind") == "text") & F.col("key").rlike(r"[\p{L}]{1}.*[\p{L}]{1}.*[\p{L}]{1}") & ~F.col("key").rlike(_PAGE_KEY) & ~F.col("line").rlike(r"[:：]\s*$"))
    repeated = keys.select("source_file", "key", "block_id").distinct().groupBy("source_file", "key").agg(F.count(F.lit(1)).alias("n"))
    repeated = repeated.join(pages, "source_file").where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * SHARE))).select("source_file", "key", F.lit(True).alias("repeats"))
    edge = sized_join(edge, repeated, ["source_file", "key"])
    edge = sized_join(edge, chosen.select("source_file", F.col("offset").alias("file_offset")), ["source_file"])
    value = F.coalesce("roman_value", _number(F.col("line")))
    shaped = F.col("key").rlike(_PAGE_KEY) | F.col("roman_value").isNotNull()
    # one digit may be misread as another; a bare number has to agree
    wrapped = ~F.col("key").isin("#") & F.col("roman_value").isNull()
    page = shaped & F.col("file_offset").isNotNull() & ((value - F.col("page_pos") == F.col("file_offset")) | wrapped & (F.col("kind") == "text"))
    edge = edge.withColumn("cand", F.when(page, "page_number").when(F.col("repeats") & (F.col("kind") == "text"), "running_line")).where("cand is not null")
    by = Window.partitionBy("block_id")
    down = F.count(F.lit(1)).over(by.orderBy("top").rangeBetween(Window.unboundedPreceding, 0)) == F.col("top") + 1
    up = F.count(F.lit(1)).over(by.orderBy("bottom").rangeBetween(Window.unboundedPreceding, 0)) == F.col("bottom") + 1
    found = edge.withColumn("down", down).withColumn("up", up).where("down or up").select("block_id", "line_no", F.col("cand").alias("layout"))
    return lines.join(found, ["block_id", "line_no"], "left")


def divided(body: DataFrame) -> DataFrame:
    """(block_id, line_no, joins): lines of the body whose last word goes on in the following line.

    ``joins`` is the following line's place: in the same block, or -1 for the first line of the
    next page.
    """
    text = body.where("kind in ('text', 'list')")
    by = Window.partitionBy("block_id").orderBy("line_no")
    following = text.withColumn("next_line", F.lead("line").over(by)).withColumn("next_no", F.lead("line_no").over(by)).withColumn("next_kind", F.lead("kind").over(by))
    first = body.where("kind <> 'blank'").groupBy("source_file", "page_pos").agg(F.min_by(F.struct("line", "kind"), "line_no").alias("f")).select("source_file", (F.col("page_pos") - 1).alias("page_pos"), F.col("f.line").alias("page_line"), F.col("f.kind").alias("page_kind"))
    ends = following.where(F.col("line").rlike(rf"[\p{{L}}\p{{M}}†0-9!][{_HYPHENS}]$") & F.col("line").rlike(rf"\p{{L}}\S*[{_HYPHENS}]$"))
    ends = ends.join(first, ["source_file", "page_pos"], "left")
    last = F.col("next_line").isNull()
    rest = F.when(last, F.col("page_line")).otherwise(F.col("next_line"))
    rest_kind = F.when(last, F.col("page_kind")).otherwise(F.col("next_kind"))
    goes_on = _trim(rest).rlike(r"^[\p{L}\p{M}†!0-9]") & (rest_kind == "text")
    # the hyphen of a word that ends here stands before a joining word
    joining = _trim(rest).rlike(r"^(?i:and|or|und|oder|bzw\.|sowie|et|ou|y|o|e|u|resp\.|to|bis)\b")
    soft = F.col("line").rlike("[¬­]$")
    keep = F.when(rest.isNull(), soft).otherwise(F.when(soft, rest_kind.isNotNull()).otherwise(goes_on & ~joining))
    left, right = F.regexp_extract("line", rf"([\p{{L}}\p{{M}}]+)[{_HYPHENS}]$", 1), F.regexp_extract(F.coalesce(rest, F.lit("")), r"^\s*([\p{L}\p{M}]+)", 1)
    return ends.where(keep).select("block_id", "line_no", F.when(last, F.lit(-1)).otherwise(F.col("next_no")).alias("joins"), F.lower(left).alias("left"), F.lower(right).alias("right"), soft.alias("soft"))


def hyphens(cuts: DataFrame, text: DataFrame) -> DataFrame:
    """(block_id, line_no, hyphen): whether a divided word keeps its hyphen.

    The evidence is the whole corpus: the hyphen stays where the compound is in more blocks with it
    than the word is without. Marks that are only set for a division never stay.
    """
    compound = text.select("block_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+-\p{L}+"), F.lit(0)))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("with"))
    plain = text.select("block_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("without"))
    asked = cuts.where("not soft and left <> '' and right <> ''").withColumn("w", F.concat("left", F.lit("-"), "right"))
    asked = sized_join(asked, compound.join(asked.select("w").distinct(), "w", "left_semi"), ["w"], "inner").withColumn("w", F.concat("left", "right"))
    asked = sized_join(asked, plain.join(asked.select("w").distinct(), "w", "left_semi"), ["w"])
    return asked.where(F.col("with") > F.coalesce("without", F.lit(0))).select("block_id", "line_no", F.lit(True).alias("hyphen"))


def _hash(word: Column) -> Column:
    """Anagram hash: the sum of the characters' third powers; the order of characters has no effect."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda s, c: s + F.when(c == "", F.lit(0).cast("bigint")).otherwise(F.ascii(c).cast("bigint") * F.ascii(c) * F.ascii(c)))


def _value(text: str) -> int:
    return sum(ord(c) ** 3 for c in text)


def body_text(body: DataFrame, cuts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_id, text): the body of each block without code; words divided at line ends are whole.

    The two parts of a word divided between pages are no words of either.
    """
    kept = body.where("kind not in ('code', 'blank')")
    over = cuts.where("joins = -1").select("block_id", "line_no", F.lit(True).alias("over"))
    after = over.select("block_id").distinct().join(blocks.select("block_id", "source_file", "page_pos"), "block_id").select("source_file", (F.col("page_pos") + 1).alias("page_pos"), F.lit(True).alias("given")).distinct()
    kept = kept.join(over, ["block_id", "line_no"], "left").join(after, ["source_file", "page_pos"], "left")
    kept = kept.withColumn("line", F.when(F.col("over"), F.regexp_replace("line", r"\S+$", "")).when(F.col("given") & (F.row_number().over(Window.partitionBy("block_id").orderBy("line_no")) == 1), F.regexp_replace("line", r"^\s*\S+", "")).otherwise(F.col("line")))
    text = kept.groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    text = text.withColumn("text", F.regexp_replace("text", rf"(?<=\p{{L}})[{_HYPHENS}]\n\s*(?=\p{{Ll}})", ""))
    return text.withColumn("text", F.regexp_replace("text", r"(?<=[\p{IsHan}，。：；、“”（）])\n\s*(?=[\p{IsHan}，。：；、“”（）])", ""))


_WORD = r"(?<![\p{L}\p{N}_†!|=.(\[])[\p{L}\p{M}\p{N}†!|]*[\p{L}\p{M}\p{N}†](?![\p{L}\p{N}_†(=\[])"


def words_of(text: DataFrame) -> DataFrame:
    """(block_id, word): the distinct words of each block that can be misread ones or models of them."""
    bare = F.regexp_replace("text", r"`[^`\n]*`|0x[0-9a-f]+", " ")
    words = text.select("block_id", F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(_WORD), F.lit(0)))).alias("word"))
    return words.where(F.col("word").rlike(r"^[\p{IsLatin}\p{M}0-9†!|]+$") & F.col("word").rlike(r"\p{L}") & (F.length("word") >= 2))


def corrections(words: DataFrame) -> DataFrame:
    """(word, correction): rare words that are a much more frequent one with a confusion, or with two.

    A word's frequency is the number of blocks it is in. The anagram hash of a misread word less
    the difference of a confusion is the hash of the word it was; the join is on that number.
    """
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.withColumn("h", _hash(F.col("word"))).withColumn("odd", F.col("word").rlike(r"[†!|]|\p{L}[0-9]+\p{L}|^[0-9]\p{Ll}{2}|\p{Ll}{3}[0-9]$")), "words")
    single = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(_value(a) - _value(b)).cast("bigint").alias("v")) for a, b in dict.fromkeys(CONFUSIONS)))
    # a model is a plain word; what can be misread has the marks of the confusion in it
    models = counts.where(~F.col("odd") & ~F.col("word").rlike(r"[0-9]") & (F.length("word") >= 2)).select(F.col("word").alias("correction"), F.col("n").alias("m"), "h")
    tries = counts.where((F.length("word") >= 3) | F.col("odd") & (F.length("word") >= 2)).withColumn("one", F.filter(single, lambda x: F.contains(F.col("word"), x["a"])))
    step = lambda x, y, k: F.struct(x["a"].alias("a"), (y["a"] if k == 2 else F.lit("")).alias("c"), x["b"].alias("b"), (y["b"] if k == 2 else F.lit("")).alias("d"), (x["v"] + y["v"] if k == 2 else x["v"]).alias("v"), F.lit(k).alias("steps"))
    ones = F.transform("one", lambda x: step(x, x, 1))
    twos = F.flatten(F.transform("one", lambda x, i: F.transform(F.slice("one", i + 1, F.size("one")), lambda y: step(x, y, 2))))
    able = F.when(F.length("word") >= 5, F.concat(ones, twos)).otherwise(ones)
    tries = tries.select("word", "n", "odd", F.explode(able).alias("s"), "h").withColumn("h", F.col("h") - F.col("s.v"))
    pairs = tries.join(models, "h").where((F.col("m") >= F.lit(RATIO) * F.col("n")) | F.col("odd") & (F.col("m") > F.col("n")))
    pairs = pairs.where(F.col("odd") | (F.length("word") >= 4) | (F.col("m") >= 40 * F.col("n")))
    # equal hashes may be chance or another order: the one word must be made of the other by these steps
    once = _replaceable(F.col("word"), F.col("correction"), F.col("s.a"), F.col("s.b"))
    twice = F.exists(_replaced(F.col("word"), F.col("s.a"), F.col("s.b")), lambda x: _replaceable(x, F.col("correction"), F.col("s.c"), F.col("s.d")))
    pairs = pairs.where(F.when(F.col("s.steps") == 1, once).otherwise(twice))
    w = Window.partitionBy("word").orderBy("s.steps", F.desc("m"), "correction")
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("word", "correction")


def _replaced(word: Column, a: Column, b: Column) -> Column:
    """All results of replacing one occurrence of ``a`` by ``b``."""
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, i, F.length(a)) == a)
    return F.transform(places, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), b, F.substr(word, i + F.length(a))))


def _replaceable(word: Column, target: Column, a: Column, b: Column) -> Column:
    return F.exists(_replaced(word, a, b), lambda x: x == target)


def ideographs(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Misread ideographs: (trigrams, pairs).

    ``trigrams`` (block_id, tri) are those of every block; ``pairs`` (tri, correction) those whose
    middle was misread. A rare ideograph that, in most of its contexts, stands where one other
    ideograph stands far more often is taken for a misreading of that one.
    """
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 2, F.lit(1))), lambda i: F.substr("text", i, F.lit(3)))
    tri = text.where(F.col("text").rlike(r"\p{IsHan}")).select("block_id", F.explode(F.array_distinct(spans)).alias("tri")).where(F.col("tri").rlike(r"^[^\s]\p{IsHan}[^\s]$"))
    tri = materialize(tri, "trigrams")
    n = tri.groupBy("tri").agg(F.count(F.lit(1)).alias("n")).select("tri", "n", F.concat(F.substr("tri", F.lit(1), F.lit(1)), F.substr("tri", F.lit(3), F.lit(1))).alias("around"), F.substr("tri", F.lit(2), F.lit(1)).alias("c"))
    total = n.groupBy("c").agg(F.sum("n").alias("total"))
    best = n.groupBy("around").agg(F.max_by("c", F.struct("n", "c")).alias("d"), F.max("n").alias("m"))
    rare = n.join(best, "around").where((F.col("c") != F.col("d")) & (F.col("m") >= RATIO * F.col("n")))
    for_pair = rare.groupBy("c", "d").agg(F.sum("n").alias("explained"), F.count(F.lit(1)).alias("contexts"))
    sums = for_pair.join(total, "c").join(total.select(F.col("c").alias("d"), F.col("total").alias("d_total")), "d")
    share = F.col("explained") / F.col("total")
    sure = sums.where((share >= 0.5) & (F.col("total") * RATIO <= F.col("d_total")))
    w = Window.partitionBy("c").orderBy(F.desc("explained"), "d")
    sure = sure.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("c", "d", share.alias("share"))
    pairs = n.join(sure, "c").select("tri", F.concat(F.substr("tri", F.lit(1), F.lit(1)), "d", F.substr("tri", F.lit(3), F.lit(1))).alias("correction"))
    return tri, pairs


def analyse(df: DataFrame) -> dict[str, DataFrame]:
    """The tables of an analysis: lines with their layout, divisions, and misread words by block."""
    blocks = materialize(blocks_of(df), "blocks")
    lines = materialize(layout(lines_of(blocks), blocks), "lines")
    body = lines.where("layout is null")
    cuts = materialize(divided(body), "divided")
    text = materialize(body_text(body, cuts, blocks), "bodies")
    words = words_of(text)
    fixes = corrections(words)
    wrong = sized_join(words, fixes, ["word"], "inner").select("block_id", "word", "correction")
    tri, pairs = ideographs(text)
    wrong_han = sized_join(tri, pairs, ["tri"], "inner").select("block_id", F.col("tri").alias("word"), "correction")
    return {"blocks": blocks, "lines": lines, "divided": cuts, "text": text, "misread": wrong.unionByName(wrong_han)}


def noise(df: DataFrame) -> DataFrame:
    """(block_id, noise): a row for each block and kind of noise in it.

    Blocks with null id take no part; one given twice counts once. A null or empty text has no
    noise. Texts are read whole; other columns have no effect; an empty table gives no rows.
    """
    t = analyse(df)
    parts = [
        t["lines"].where("layout is not null").select("block_id", F.col("layout").alias("noise")),
        t["divided"].select("block_id", F.lit("hyphen_break").alias("noise")),
        t["misread"].select("block_id", F.lit("misread").alias("noise")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


_CJK = regex.compile(r"[\p{Han}，。：；、“”（）！？《》]")
_PART = regex.compile(rf"[{_HYPHENS}]$")
_STOP = regex.compile(r"[.!?:。！？：][\"'”’»)]*$")


def _paragraphs(lines: list[dict], words: dict[str, str]) -> str:
    """The body's lines as paragraphs: wrapped lines joined, divided words whole, misread ones put right."""
    out: list[str] = []
    open_text, before = False, 0
    width = max((len(x["line"].strip()) for x in lines if x["kind"] == "text"), default=0)
    for x in lines:
        line, kind = x["line"], x["kind"]
        if kind == "blank":
            if out and out[-1] and not (open_text and _PART.search(out[-1])):
                open_text = False
                out.append("")
            continue
        if kind == "code":
            out.append(line)
            open_text = False
            continue
        line = line.strip() if kind == "text" else line.rstrip()
        # a wrapped line is about as long as the page is wide; a short one ends what it stands in
        ended = open_text and x["continues"] is None and (before < 0.5 * width or before < 0.8 * width and _STOP.search(out[-1]))
        before = len(line)
        if kind != "text" or not open_text or not out or ended:
            if kind in ("heading",) and out and out[-1] != "":
                out.append("")
            out.append(line)
            if kind == "heading":
                out.append("")
        elif _PART.search(out[-1]) and x["continues"] is not None:
            head, tail = out[-1][:-1], line
            out[-1] = head + ("-" if x["continues"] == "-" else "") + tail
        else:
            gap = "" if _CJK.match(out[-1][-1:]) and _CJK.match(line[:1]) else " "
            out[-1] = out[-1] + gap + line
        open_text = kind == "text" or kind == "list"
    text = regex.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")
    latin = {k: v for k, v in words.items() if not _CJK.search(k[1:2])}
    if latin:
        pieces = regex.split(r"(```.*?```|`[^`\n]*`)", text, flags=regex.S)
        pattern = regex.compile("(?<![\\p{L}\\p{N}_])(?:" + "|".join(regex.escape(k) for k in sorted(latin, key=len, reverse=True)) + ")(?![\\p{L}\\p{N}_])")
        text = "".join(p if k % 2 else pattern.sub(lambda m: latin[m.group()], p) for k, p in enumerate(pieces))
    for k, v in words.items():
        if _CJK.search(k[1:2]):
            text = text.replace(k, v)
    return text


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = []
        for lines, words, carry, given in zip(pdf["body"], pdf["words"], pdf["carry"], pdf["given"], strict=True):
            rows = [{"line": x["line"], "kind": x["kind"], "join": x["joins"], "hyphen": "-" if x["hyphen"] else "", "continues": None} for x in sorted(lines if lines is not None else [], key=lambda x: x["line_no"])]
            if given and (first := next((r for r in rows if r["kind"] != "blank"), None)):
                first["line"] = regex.sub(r"^\s*\S+\s*", "", first["line"])  # this word ends on the page before
                if not first["line"]:
                    rows.remove(first)
            divided = None
            for r in rows:
                if r["kind"] != "blank":
                    r["continues"], divided = divided, r["hyphen"] if r["join"] is not None and r["join"] >= 0 else None
            if carry and (end := next((r for r in reversed(rows) if r["kind"] != "blank"), None)):
                end["line"] = _PART.sub(end["hyphen"], end["line"]) + carry
            fixes = {x["word"]: x["correction"] for x in (words if words is not None else [])}
            texts.append(_paragraphs(rows, fixes))
        yield pd.DataFrame({"block_id": pdf["block_id"], "cleaned_text": texts})


def repair(df: DataFrame) -> DataFrame:
    """(block_id, cleaned_text): each block's text in continuous paragraphs.

    Layout lines are gone, wrapped lines joined, words divided at line ends whole (one that goes on
    on the next page ends where it began), misread words put right; headings, lists, tables and
    code stay lines of their own. A block of a null or empty text comes out empty.
    """
    t = analyse(df)
    cuts = t["divided"]
    kept = materialize(hyphens(cuts, t["text"]), "hyphens")
    body = t["lines"].where("layout is null").join(cuts.select("block_id", "line_no", "joins"), ["block_id", "line_no"], "left").join(kept, ["block_id", "line_no"], "left")
    first = body.where("kind <> 'blank'").groupBy("source_file", "page_pos").agg(F.min_by("line", "line_no").alias("line"))
    over = cuts.where("joins = -1").join(t["blocks"].select("block_id", "source_file", "page_pos"), "block_id")
    carry = over.join(first.withColumn("page_pos", F.col("page_pos") - 1), ["source_file", "page_pos"]).select("block_id", "source_file", (F.col("page_pos") + 1).alias("next_pos"), F.regexp_extract("line", r"^\s*(\S+)", 1).alias("carry"))
    grouped = body.groupBy("block_id", "source_file", "page_pos").agg(F.collect_list(F.struct("line_no", "line", "kind", "joins", F.coalesce("hyphen", F.lit(False)).alias("hyphen"))).alias("body"))
    fixes = t["misread"].groupBy("block_id").agg(F.collect_set(F.struct("word", "correction")).alias("words"))
    given = carry.select("source_file", F.col("next_pos").alias("page_pos"), F.lit(True).alias("given")).distinct()
    rows = t["blocks"].select("block_id", "source_file", "page_pos").join(grouped.drop("source_file", "page_pos"), "block_id", "left").join(fixes, "block_id", "left").join(carry.select("block_id", "carry"), "block_id", "left").join(given, ["source_file", "page_pos"], "left")
    return rows.select("block_id", "body", "words", "carry", F.coalesce("given", F.lit(False)).alias("given")).mapInPandas(_clean, "block_id long, cleaned_text string")
