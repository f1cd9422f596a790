"""Oversized items cut at natural boundaries into overlapping pieces under a size limit.

A piece ends at the last paragraph border in the second half of its window, else the last sentence
border there, line border, word border, else the same in the first half, else at the limit (never
inside a combined character). The next piece begins with up to ``overlap`` characters of it, fewer
where a word would be cut. Where a piece begins decides all that follows, so a long item is done in
ranges: each range, read with halos, works out for every place a piece may begin at near its start
where the first piece beyond its end begins and how many lie between. Those tables are short; the
tables of RUN neighbouring ranges are composed into one, the composed ones are chained by prefix sums
of their lengths and numbers of pieces, and what enters each is carried down to its ranges, which emit
their pieces by offset. No worker ever holds a long file whole, nor all tables of one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.arrowtext import in_parts

RANGE = 1 << 18  # bytes of a file that one worker handles at a time
LIMITS = 4  # limits that a range of a text column holds
RUN = 512  # neighbouring ranges whose tables are composed into one
_PARAGRAPH = regex.compile(r"\n[ \t\r]*\n\s*")
_LINE = regex.compile(r"\n")
_SENTENCE = regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？；｡]+[”’」』）)]*")
_WORDISH = r"[\p{L}\p{N}\p{M}_'’‐‑-]"
_WIDE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]"
#: Places inside a word: between two of its characters, where the script sets words apart.
_INSIDE = regex.compile(rf"(?<=(?!{_WIDE}){_WORDISH})(?=(?!{_WIDE}){_WORDISH})")
#: Places that would tear a combined character.
_TEAR = regex.compile(r"(?=[\p{M}‍︎️\U0001F3FB-\U0001F3FF])|(?<=‍)|(?<=\r)(?=\n)")


class Cutter:
    """Where the pieces of one text (or of a range with its halos) begin and end."""

    def __init__(self, text: str, limit: int, overlap: int, end: int | None = None) -> None:
        if not 0 <= overlap < limit:
            raise ValueError("overlap must be at least 0 and below limit")
        self.text, self.limit, self.overlap = text, limit, overlap
        self.end = len(text) if end is None else end  # where the item ends, if it is in sight
        self.levels = [[m.end() for m in p.finditer(text)] for p in (_PARAGRAPH, _SENTENCE, _LINE)]

    def inside_word(self, at: int) -> bool:
        return 0 < at < len(self.text) and _INSIDE.match(self.text, at) is not None

    def tears(self, at: int) -> bool:
        return 0 < at < len(self.text) and _TEAR.match(self.text, at) is not None

    def piece(self, start: int) -> tuple[int, int]:
        """(end of the piece that begins at start, start of the next one)."""
        most = start + self.limit
        if most >= self.end:
            return self.end, self.end
        least = start + self.overlap + 1
        for lo in (max(least, start + self.limit // 2), least):
            for places in self.levels:
                k = bisect_right(places, most) - 1
                if k >= 0 and places[k] >= lo:
                    return self._with_next(places[k])
            for at in range(most, lo - 1, -1):
                if not self.inside_word(at) and not self.tears(at):
                    return self._with_next(at)
        at = most
        while at > least and self.tears(at):
            at -= 1
        return self._with_next(at if at > least else most)

    def _with_next(self, end: int) -> tuple[int, int]:
        for start in range(end - self.overlap, end):
            if not self.inside_word(start) and not self.tears(start):
                return end, start
        return end, end

    def pieces(self, start: int, stop: int | None = None) -> Iterator[tuple[int, int]]:
        """Begin and end of the pieces that begin in [start, stop)."""
        stop = self.end if stop is None else stop
        while start < stop:
            end, after = self.piece(start)
            yield start, end
            start = after if end < self.end else self.end


def split_text(text: str, limit: int, overlap: int) -> list[str]:
    """The pieces of one text."""
    return [text[a:b] for a, b in Cutter(text, limit, overlap).pieces(0)]


def range_table(text: str, left: int, own: int, limit: int, overlap: int, is_last: bool) -> list[tuple[int, int, int, int]]:
    """Runs (entry from, to, exit, pieces) of a range: where the first piece beyond it begins.

    ``text`` has ``left`` characters of the range before, ``own`` of the range, and those after it
    as far as a piece can reach. Entries and exits count from the range's and the next one's start.
    """
    cutter = Cutter(text, limit, overlap, len(text) if is_last else len(text) + limit)
    known: dict[int, tuple[int, int]] = {}

    def leave(start: int) -> tuple[int, int]:
        path = []
        while start < left + own and start not in known:
            path.append(start)
            end, after = cutter.piece(start)
            start = after if end < cutter.end else max(end, left + own)
        at, n = known.get(start, (start, 0))
        for p in reversed(path):
            n += 1
            known[p] = (at, n)
        return at, n

    runs: list[list[int]] = []
    for entry in range(left, left + min(limit if left else 1, own)):  # the first range is entered at its start
        at, n = leave(entry)
        at -= left + own
        if runs and runs[-1][2:] == [at, n]:
            runs[-1][1] = entry - left
        else:
            runs.append([entry - left, entry - left, at, n])
    return [tuple(r) for r in runs]


def _through(pdf: pd.DataFrame, entry: int, index: int) -> Iterator[tuple[int, int, int]]:
    """(number, entry, first piece) of tables in order, and at last of what would follow them."""
    no = -1
    for no, own, froms, exits, counts in zip(pdf["no"], pdf["own"], pdf["froms"], pdf["exits"], pdf["counts"], strict=True):
        yield no, entry, index
        if entry >= own:
            entry -= own
        else:
            k = bisect_right(froms, entry) - 1
            entry, index = int(exits[k]), index + int(counts[k])
    yield no + 1, entry, index


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """One table for a run of neighbouring ranges: the entries of the first one, followed through all."""
    pdf = pdf.sort_values("no")
    froms = pdf["froms"].iloc[0]
    ends = [list(_through(pdf, int(entry), 0))[-1] for entry in froms]
    return pd.DataFrame({"item": pdf["item"].iloc[:1], "run": pdf["run"].iloc[:1], "own": [pdf["own"].sum()], "froms": [froms], "exits": [[e for _, e, _ in ends]], "counts": [[n for _, _, n in ends]]})


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The entry and first piece of every run of one item."""
    pdf = pdf.rename(columns={"run": "no"}).sort_values("no")
    rows = list(_through(pdf, 0, 0))[:-1]
    return pd.DataFrame({"item": [pdf["item"].iloc[0]] * len(rows), "run": [r[0] for r in rows], "entry": [r[1] for r in rows], "index": [r[2] for r in rows]})


def _enter(pdf: pd.DataFrame) -> pd.DataFrame:
    """The entry and first piece of every range of a run, from those of the run."""
    pdf = pdf.sort_values("no")
    rows = list(_through(pdf, int(pdf["entry"].iloc[0]), int(pdf["index"].iloc[0])))[:-1]
    return pd.DataFrame({"item": [pdf["item"].iloc[0]] * len(rows), "range_no": [r[0] for r in rows], "entry": [r[1] for r in rows], "first_index": [r[2] for r in rows]})


def _tables(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            x = batch.to_pydict()
            found = [range_table(t, left, own, limit, overlap, last) for t, left, own, last in zip(x["text"], x["left"], x["own"], x["is_last"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), *(pa.array([[r[k] for r in f] for f in found], pa.list_(pa.int64())) for k in (0, 2, 3))],
                ["item", "no", "own", "froms", "exits", "counts"],
            )

    return run


def _emit(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            x = batch.to_pydict()
            key, index, content = [], [], []
            for item, text, left, own, last, entry, first in zip(*(x[c] for c in ("item", "text", "left", "own", "is_last", "entry", "first_index")), strict=True):
                cutter = Cutter(text, limit, overlap, len(text) if last else len(text) + limit)
                for k, (a, b) in enumerate(cutter.pieces(left + entry, left + own)):
                    key.append(item)
                    index.append(first + k)
                    content.append(text[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(key, batch.schema.field(0).type), pa.array(index, pa.int32()), pa.array(content, pa.string())], ["item", "chunk_index", "content"])

    return run


def _ranges_of_texts(size: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            for k in range(batch.num_rows):
                item, text = batch.column(0).slice(k, 1), batch.column(1)[k].as_py()
                for no, begin in enumerate(range(0, len(text), size)):
                    own, left = min(size, len(text) - begin), min(limit, begin)
                    yield pa.RecordBatch.from_arrays(
                        [item, pa.array([no], pa.int32()), pa.array([left], pa.int64()), pa.array([own], pa.int64()), pa.array([begin + own + limit + 8 >= len(text)]), pa.array([text[begin - left : begin + own + limit + 8]], pa.string())],
                        ["item", "range_no", "left", "own", "is_last", "text"],
                    )

    return run


def _by_ranges(ranges: DataFrame, limit: int, overlap: int, kind: str) -> DataFrame:
    table = "own bigint, froms array<bigint>, exits array<bigint>, counts array<bigint>"
    tables = ranges.mapInArrow(_tables(limit, overlap), f"item {kind}, no int, {table}").withColumn("run", F.expr(f"no div {RUN}"))
    runs = tables.groupBy("item", "run").applyInPandas(_compose, f"item {kind}, run bigint, {table}")
    entered = runs.groupBy("item").applyInPandas(_chain, f"item {kind}, run bigint, entry bigint, index bigint")
    entries = tables.join(entered, ["item", "run"]).groupBy("item", "run").applyInPandas(_enter, f"item {kind}, range_no int, entry bigint, first_index bigint")
    return ranges.join(entries, ["item", "range_no"]).mapInArrow(_emit(limit, overlap), f"item {kind}, chunk_index int, content string")


def oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int = 60, range_size: int | None = None) -> DataFrame:
    """(key, chunk_index, content): the pieces of every item longer than ``limit`` code points.

    Items within the limit, empty and null ones give no row. Rows that repeat key and text are one
    item; a key with several texts gives the pieces of each. A null key is a key. Every item is dealt
    into ranges of ``range_size`` code points, LIMITS times the limit unless given, never less than
    the limit; they go to different workers. Other columns have no effect.
    """
    size = max(limit, range_size or LIMITS * limit)
    items = df.select(F.col(key).alias("item"), F.col(text).alias("text")).where(F.length("text") > limit)
    items = items.withColumn("h", F.md5("text")).dropDuplicates(["item", "h"])
    kind = items.schema["item"].dataType.simpleString()
    items = items.select(F.struct("item", "h").alias("item"), "text")  # a key may have several texts, and be null
    of = f"struct<item:{kind},h:string>"
    ranges = items.mapInArrow(_ranges_of_texts(size, limit), f"item {of}, range_no int, left bigint, own bigint, is_last boolean, text string")
    ranges = ranges.repartition("item", "range_no")
    return _by_ranges(ranges, limit, overlap, of).select(F.col("item.item").alias(key), "chunk_index", "content")


def _read(path: str, begin: int, end: int) -> bytes:
    if path.startswith("file:") or path.startswith("/"):
        with open("/" + path.split(":", 1)[-1].lstrip("/"), "rb") as f:
            f.seek(begin)
            return f.read(end - begin)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        f.seek(begin)
        return f.read(min(end, f.size()) - begin)


def _ranges_of_files(size: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halo = 4 * (limit + 8) + 4
        for batch in batches:
            for path, length, no in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                begin, end = no * size, min((no + 1) * size, length)
                first, last = max(0, begin - halo), min(length, end + halo)
                data = _read(path, first, last)
                at = lambda place: next(p for p in range(place - first, len(data) + 1) if p == len(data) or data[p] & 0xC0 != 0x80)
                a, b = at(begin), at(end)  # a range owns the characters whose first byte lies in it
                left = data[at(first) : a].decode("utf-8", "replace")[-limit:]
                own = data[a:b].decode("utf-8", "replace")
                tail = data[b:]
                while tail and last < length and len(tail) and (tail[-1] & 0xC0) == 0x80:
                    tail = tail[:-1]
                if tail and last < length:
                    tail = tail[:-1]  # the lead byte of what may have been cut
                right = tail.decode("utf-8", "replace")[: limit + 8]
                complete = last == length and len(tail.decode("utf-8", "replace")) <= limit + 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([no], pa.int32()), pa.array([len(left)], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([complete]), pa.array([left + own + right])],
                    ["item", "range_no", "left", "own", "is_last", "text"],
                )

    return run


def split_files(spark: SparkSession, paths: str | list[str], limit: int, overlap: int = 60, range_bytes: int = RANGE) -> DataFrame:
    """(path, chunk_index, content): the pieces of UTF-8 files of any size, read by byte ranges.

    Only names and lengths are listed; each worker opens a file, seeks to its range and reads it
    with its halos. Files within the limit come out as one piece, empty ones give none; bytes that
    aren't UTF-8 become U+FFFD.
    """
    files = spark.read.format("binaryFile").load(paths).select(F.col("path"), F.col("length")).where("length > 0")
    tasks = files.select("path", "length", F.explode(F.sequence(F.lit(0), ((F.col("length") - 1) / range_bytes).cast("int"))).alias("no")).repartition("path", "no")
    ranges = tasks.mapInArrow(_ranges_of_files(range_bytes, limit), "item string, range_no int, left bigint, own bigint, is_last boolean, text string")
    return _by_ranges(ranges, limit, overlap, "string").withColumnRenamed("item", "path")

