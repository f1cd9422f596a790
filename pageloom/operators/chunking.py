"""Parent and child chunks: Markdown sections merged to parents, parents split to children."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as T

SEPARATORS = ("\n\n", "\n", " ", "")


def spans(text: Column, size: int, overlap: int) -> Column:
    """Start places of windows of ``size`` characters that overlap by ``overlap``."""
    step = size - overlap
    return F.when(F.length(text) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(text) - overlap - 1, F.lit(step)))


def fixed(df: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """(keys, chunk_no, start, chunk): windows of a fixed size; none of an empty or null text."""
    rows = df.where(F.length(text) > 0).select(*keys, F.col(text).alias("__t"))
    rows = rows.select(*keys, "__t", F.posexplode(spans(F.col("__t"), size, overlap)).alias("chunk_no", "start"))
    return rows.select(*keys, "chunk_no", "start", F.substr("__t", F.col("start") + 1, F.lit(size)).alias("chunk"))


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the first separator that occurs, going on with finer ones where a part is too long.

    Separators stay at the beginning of the part they precede; parts are packed up to ``size`` and
    the packs overlap by whole parts of up to ``overlap`` characters.
    """
    k = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    sep, finer = separators[k], separators[k + 1 :]
    if sep:
        first, *rest = text.split(sep)
        parts = [p for p in (first, *(sep + r for r in rest)) if p]
    else:
        parts = list(text)
    out: list[str] = []
    pack: list[str] = []
    length = 0

    def close() -> None:
        if joined := "".join(pack).strip():
            out.append(joined)

    for part in parts:
        if len(part) >= size and finer:
            close()
            pack, length = [], 0
            out += recursive_split(part, size, overlap, finer)
            continue
        if length + len(part) > size and pack:
            close()
            while pack and (length > overlap or length + len(part) > size):
                length -= len(pack.pop(0))
        pack.append(part)
        length += len(part)
    close()
    return out


def sections(text: str) -> list[tuple[dict[str, str], str]]:
    """(headings, text) of the sections that begin at headings of levels one to three, headings kept."""
    out: list[tuple[dict[str, str], str]] = []
    heads: dict[str, str] = {}
    own: list[str] = []
    fence = False
    for line in text.split("\n"):
        fence ^= line.lstrip().startswith(("```", "~~~"))
        m = None if fence else re.match(r"^(#{1,3})\s+(.*)$", line.strip())
        if m:
            if any(x.strip() for x in own):
                out.append((dict(heads), "\n".join(own).strip()))
            own = []
            level = len(m.group(1))
            heads = {k: v for k, v in heads.items() if int(k[1]) < level} | {f"H{level}": m.group(2).strip()}
        own.append(line.rstrip())
    if any(x.strip() for x in own):
        out.append((dict(heads), "\n".join(own).strip()))
    return out


class _Part:
    """A piece of a document on its way to a parent, with the pages and titles it comes from."""

    def __init__(self, text: str, pages: list[int], titles: list[str]) -> None:
        self.text, self.pages, self.titles = text, list(pages), list(titles)

    def take(self, other: _Part, before: bool = False) -> None:
        a, b = (other, self) if before else (self, other)
        self.text = a.text + "\n\n" + b.text
        self.pages, self.titles = list(dict.fromkeys(a.pages + b.pages)), list(dict.fromkeys(a.titles + b.titles))


def parents(parts: list[_Part], least: int, most: int, overlap: int) -> list[_Part]:
    """Merge forward until a parent is long enough, split what is too long, merge what is short again."""
    merged: list[_Part] = []
    open_part = None
    for part in parts:
        if open_part is None:
            open_part = _Part(part.text, part.pages, part.titles)
        else:
            open_part.take(part)
        if len(open_part.text) >= least:
            merged.append(open_part)
            open_part = None
    if open_part is not None:
        if merged:
            merged[-1].take(open_part)
        else:
            merged.append(open_part)
    split = [_Part(t, p.pages, p.titles) for p in merged for t in ([p.text] if len(p.text) <= most else recursive_split(p.text, most, overlap))]
    out: list[_Part] = []
    for k, part in enumerate(split):
        if len(part.text) >= least:
            out.append(part)
        elif out:
            out[-1].take(part)
        elif k + 1 < len(split):
            split[k + 1].take(part, before=True)
        else:
            out.append(part)
    return out


def _chunk_document(least: int, most: int, child_size: int, child_overlap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_pos")
        stem = str(pdf["doc"].iloc[0])
        runs: list[list[_Part]] = [[]]
        previous = None
        for number, title, text in zip(pdf["page_number"], pdf["slide_title"], pdf["text"], strict=True):
            number = None if pd.isna(number) else int(number)
            if previous is not None and number != previous + 1:
                runs.append([])  # merging never crosses a gap
            previous = number
            for _, body in sections(text or ""):
                runs[-1].append(_Part(body, [] if number is None else [number], [title] if isinstance(title, str) and title else []))
        rows, per_page, child_no = [], {}, 0
        for group in runs:
            for p in parents(group, least, most, child_overlap):
                start = min(p.pages) if p.pages else 1
                n = per_page[start] = per_page.get(start, -1) + 1
                parent_id = f"{stem}_page_{start}_parent_{n}"
                for i, child in enumerate(recursive_split(p.text, child_size, child_overlap)):
                    rows.append((stem, parent_id, p.text, p.pages, " -> ".join(p.titles), f"{parent_id}_child_{i}", child_no, child))
                    child_no += 1
        return pd.DataFrame(rows, columns=["doc_id", "parent_id", "page_content", "page_numbers", "slide_title", "child_id", "chunk_index", "content"])

    return run


def chunk_documents(pages: DataFrame, doc: str, text: str, least: int = 2000, most: int = 4000, child_size: int = 300, child_overlap: int = 60) -> DataFrame:
    """The children of every document with their parents, ids as ``stem_page_N_parent_M_child_I``.

    ``pages`` has (doc, page_pos, page_number, slide_title, text). Greedy merging depends on all
    that comes before in the document, so a document is one group; documents are independent.
    """
    rows = pages.select(F.col(doc).alias("doc"), "page_pos", "page_number", "slide_title", F.col(text).alias("text"))
    schema = "doc_id string, parent_id string, page_content string, page_numbers array<int>, slide_title string, child_id string, chunk_index int, content string"
    return rows.groupBy("doc").applyInPandas(_chunk_document(least, most, child_size, child_overlap), schema)


def _split(size: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(pieces=[recursive_split(t or "", size, overlap) for t in pdf["pieces"]])

    return run


def recursive(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, piece_no, piece): every text split recursively."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.array(F.col(text)).alias("pieces")).select(key, F.col("pieces")[0].alias("pieces"))
    return rows.mapInPandas(_split(size, overlap), f"`{key}` {kind}, pieces array<string>").select(key, F.posexplode("pieces").alias("piece_no", "piece"))


def parse_variant(raw: str) -> dict:
    """``single_SIZE_OVERLAP``, ``pc_CHILD_OVERLAP_PARENT_OVERLAP`` or ``pc_POLICY`` with default sizes."""
    name = raw.strip()
    if m := re.fullmatch(r"single_(\d+)_(\d+)", name):
        size, overlap = map(int, m.groups())
        out = {"name": name, "strategy": "single", "child_size": size, "child_overlap": overlap, "parent_size": None, "parent_overlap": 0, "context_policy": "child"}
    elif m := re.fullmatch(r"pc_(\d+)_(\d+)_(\d+)_(\d+)", name):
        cs, co, ps, po = map(int, m.groups())
        out = {"name": name, "strategy": "parent_child", "child_size": cs, "child_overlap": co, "parent_size": ps, "parent_overlap": po, "context_policy": "parent"}
    elif m := re.fullmatch(r"pc_(child|neighbor|parent|adaptive)", name):
        out = {"name": name, "strategy": "parent_child", "child_size": 800, "child_overlap": 160, "parent_size": 2000, "parent_overlap": 400, "context_policy": m.group(1)}
    else:
        raise ValueError(f"unknown variant: {raw}")
    if out["child_overlap"] >= out["child_size"] or (out["parent_size"] and out["parent_overlap"] >= out["parent_size"]):
        raise ValueError(f"overlap must be below the size: {raw}")
    return out


def sentence_overlap(chunks: DataFrame, sentences: DataFrame, key: str) -> DataFrame:
    """Chunks and the sentences that share a character with them: an interval join within a document."""
    return chunks.join(sentences, key).where((F.col("s_start") < F.col("c_end")) & (F.col("s_end") > F.col("c_start")))


def page_hashes(pages: DataFrame, file: str, text: str) -> DataFrame:
    """(file, page_number, page_hash) of the pages that aren't blank."""
    return pages.where(F.col("page_number").isNotNull() & (T.strip(F.col(text)) != "")).select(file, "page_number", F.sha2(text, 256).alias("page_hash"))
