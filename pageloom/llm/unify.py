"""One consistent form for texts that look the same but are written with different characters.

The form is computed on the code points of a whole Arrow batch at once: a table maps each code
point to its expansion (canonical decomposition, full and half width, radicals, ligatures and
look-alike letters folded), offsets of the expansions come from a prefix sum, and marks are put in
canonical order and composed by array operations. No string method is called for a row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.arrowtext import in_parts, row_of, to_arrow, to_code_points
from pageloom.session import materialize

# Letters of other scripts drawn like a Latin letter.
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝӏАВЕКМНОРСТУХЅІЈԚԜҮ", "aeopcyxsijhdqwlABEKMHOPCTYXSIJQWY", strict=True))
GREEK = dict(zip("οϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ocjABEZHIKMNOPTYX", strict=True))
ARMENIAN = dict(zip("օսհՕՍ", "ouhOU", strict=True))
# Hyphens, apostrophes and spaces drawn alike.
SIGNS = {"‐": "-", "‑": "-", "ʼ": "’", "µ": "μ", " ": "\n", " ": "\n", "\x85": "\n"}
# Radicals drawn like the ideograph beside them, beyond those with a compatibility mapping.
RADICALS = dict(
    zip(
        "⺆⺇⺈⺉⺊⺌⺎⺏⺐⺒⺓⺔⺖⺗⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺦⺨⺩⺭⺮⺯⺰⺲⺷⺸⺹⺺⺻⺼⺽⺾⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
        "冂𠘨𠂊刂卜小兀尣尢巳幺彑忄㣺扌攵旡日月歺民氵氺灬爫丬犭王礻竹糹纟罒羊𦍌耂肀聿⺼臼艹虎衤覀西见角讠贝车辶阝钅長镸长门阝雨青韦页风飞食飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
        strict=True,
    )
)
#: Compatibility classes whose members look like what they stand for.
_ALIKE = ("<wide>", "<narrow>", "<noBreak>", "<vertical>")
_LIMIT = sys.maxunicode + 1
_S, _L, _V, _T = 0xAC00, 0x1100, 0x1161, 0x11A7


def _folded(ch: str) -> str:
    """What one code point becomes before composing; by rule from the Unicode data, then the tables above."""
    point = ord(ch)
    if ch in SIGNS:
        return SIGNS[ch]
    category = unicodedata.category(ch)
    if category == "Zs":
        return " "
    invisible = category in ("Cf", "Cc") and ch not in "\t\n\r\v\f‭‮‍‌"
    if (invisible and not 0x600 <= point <= 0x8FF) or point in (0x34F, 0x115F, 0x1160, 0x3164, 0x17B4, 0x17B5) or 0x180B <= point <= 0x180F or 0xFE00 <= point <= 0xFE0D or 0xE0100 <= point <= 0xE01EF:
        return ""
    while (d := unicodedata.decomposition(ch)).startswith(_ALIKE):
        if len(parts := d.split()[1:]) != 1:
            break
        ch = chr(int(parts[0], 16))
    point = ord(ch)
    if 0x2F00 <= point < 0x2FE0 or 0xFB00 <= point <= 0xFB04 or 0x2160 <= point < 0x2180 or point in (0x2E9F, 0x2EF3) or 0x132 <= point <= 0x133 or 0x1C4 <= point <= 0x1CC:
        ch = unicodedata.normalize("NFKC", ch)
    ch = RADICALS.get(ch, ch)
    out = unicodedata.normalize("NFD", ch)
    return "".join(SIGNS.get(c) or CYRILLIC.get(c) or GREEK.get(c) or ARMENIAN.get(c) or c for c in out)


class _Tables:
    """Lookup tables over all code points, built once in each worker from the Unicode data."""

    def __init__(self) -> None:
        self.one = np.arange(_LIMIT, dtype=np.uint32)  # the only code point of the expansion
        self.length = np.ones(_LIMIT, np.uint8)
        self.start = np.zeros(_LIMIT, np.int32)  # place of a longer expansion in the pool
        self.ccc = np.zeros(_LIMIT, np.uint8)
        self.kind = np.zeros(_LIMIT, np.uint8)  # letters: 1 Latin, 2 Cyrillic, 3 Greek, 4 Armenian, 5 other
        pool: list[int] = []
        pairs: dict[int, int] = {}
        own = {**dict.fromkeys(CYRILLIC, 2), **dict.fromkeys(GREEK, 3), **dict.fromkeys(ARMENIAN, 4)}
        for point in range(0x80, _LIMIT):
            if 0xD800 <= point < 0xE000 or 0xF0000 <= point or 0x3400 <= point < 0xA000 or 0xAC00 <= point < 0xD7A4 or 0x20000 <= point < 0x2F800 or 0x30000 <= point < 0xE0000:
                continue  # no mapping, or by arithmetic
            ch = chr(point)
            category = unicodedata.category(ch)
            if category == "Cn":
                continue
            out = _folded(ch)
            if out != ch:
                self.length[point] = len(out)
                if len(out) == 1:
                    self.one[point] = ord(out)
                elif out:
                    self.start[point] = len(pool)
                    pool += map(ord, out)
            self.ccc[point] = unicodedata.combining(ch)
            if category[0] == "L":
                self.kind[point] = own.get(ch) or (1 if point < 0x370 else 2 if point < 0x530 else 3 if point < 0x400 else 5)
                if 0x370 <= point < 0x400:
                    self.kind[point] = 3
                elif 0x530 <= point < 0x590:
                    self.kind[point] = 4
            d = unicodedata.decomposition(ch)
            if d and d[0] != "<" and len(d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in d.split())
                pairs[a << 21 | b] = point
        for point in [*range(0x41, 0x5B), *range(0x61, 0x7B)]:
            self.kind[point] = 1
        for point in range(0x20):
            if chr(point) not in "\t\n\v\f\r":
                self.length[point] = 0
        self.length[0x7F] = 0
        self.pool = np.array(pool or [0], np.uint32)
        self.pair_keys = np.array(sorted(pairs), np.uint64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.second = np.zeros(_LIMIT, bool)
        self.second[[k & 0x1FFFFF for k in pairs]] = True
        self.second[_V : _V + 21] = True
        self.second[_T + 1 : _T + 28] = True
        self.back = {}  # Latin letter -> its look-alike, for words of another script
        for kind, table in ((2, CYRILLIC), (3, GREEK), (4, ARMENIAN)):
            back = np.arange(0x80, dtype=np.uint32)
            for other, latin in reversed(table.items()):
                back[ord(latin)] = ord(other)
            self.back[kind] = back
        self.ambiguous = np.zeros((5, 0x80), bool)
        for kind in (2, 3, 4):
            self.ambiguous[kind] = self.back[kind] != np.arange(0x80)
        # letters that words of nothing but look-alikes are made of in the languages of the script
        self.usual = self.ambiguous.copy()
        for c in "sijhdqwlSIJQW":
            self.usual[2][ord(c)] = False


@lru_cache(1)
def _tables() -> _Tables:
    return _Tables()


def _expand(points: np.ndarray, offsets: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Gather the expansion of every code point; Hangul syllables decompose by arithmetic."""
    length = t.length[points].astype(np.int64)
    syllable = (points >= _S) & (points < _S + 11172)
    if syllable.any():
        length[syllable] = np.where((points[syllable] - _S) % 28 == 0, 2, 3)
    # joiners are visible inside pictographs and in joining scripts, invisible elsewhere
    joiner = np.flatnonzero((points == 0x200D) | (points == 0x200C))
    if len(joiner):
        before = points[np.maximum(joiner - 1, 0)]
        after = points[np.minimum(joiner + 1, len(points) - 1)]
        pictograph = lambda c: (c >= 0x1F000) & (c < 0x20000) | (c >= 0x2600) & (c < 0x27C0) | (c == 0xFE0F)
        joining = lambda c: (c >= 0x600) & (c < 0xE00)
        keep = pictograph(before) & pictograph(after) & (points[joiner] == 0x200D) | joining(before) & joining(after)
        length[joiner] = keep
    # a carriage return before a line feed is no line of its own
    cr = np.flatnonzero(points == 13)
    if len(cr):
        row = row_of(offsets)
        follows = np.minimum(cr + 1, len(points) - 1)
        points = points.copy()
        length[cr[(points[follows] == 10) & (row[follows] == row[cr])]] = 0
        points[cr] = 10
    ends = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(ends[-1], np.uint32)
    single = length == 1
    out[ends[:-1][single]] = t.one[points[single]]
    longer = np.flatnonzero((length > 1) & ~syllable)
    if len(longer):
        n = length[longer]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(ends[longer], n) + within] = t.pool[np.repeat(t.start[points[longer]], n) + within]
    if syllable.any():
        at, index = ends[:-1][syllable], (points[syllable] - _S).astype(np.int64)
        out[at] = _L + index // 588
        out[at + 1] = _V + index % 588 // 28
        tail = index % 28 > 0
        out[at[tail] + 2] = _T + index[tail] % 28
    return out, ends[offsets]


def _order(points: np.ndarray, offsets: np.ndarray, t: _Tables) -> np.ndarray:
    """Canonical order: marks between two starters, stably by combining class."""
    ccc = t.ccc[points]
    marks = np.flatnonzero(ccc)
    if len(marks) < 2:
        return points
    group = marks - np.arange(len(marks))  # marks that stand together
    group = group + row_of(offsets)[marks] * (len(points) + 1)
    order = np.lexsort((ccc[marks], group))
    out = points.copy()
    out[marks] = points[marks[order]]
    return out


def _scripts(points: np.ndarray, offsets: np.ndarray, t: _Tables) -> np.ndarray:
    """Give words that are surely of another script their own letters back.

    A word with a letter only that script has takes it for all its look-alikes; a word made of
    look-alikes only takes the script that prevails in its text. Both depend on the folded
    characters alone, so texts that look the same still come out equal.
    """
    kind = t.kind[points]
    if not ((kind >= 2) & (kind <= 4)).any():
        return points
    letter = (kind > 0) | (t.ccc[points] > 0)
    row = row_of(offsets)
    begin = letter & np.concatenate(([True], ~letter[:-1] | (row[1:] != row[:-1]))) if len(points) else letter
    word = np.cumsum(begin) - 1
    inside = np.flatnonzero(letter)
    if not len(inside):
        return points
    n, rows = int(word[inside[-1]]) + 1, len(offsets) - 1
    out = points.copy()
    low = points < 0x80
    for k in (2, 3, 4):
        ambiguous, usual = np.zeros(len(points), bool), np.zeros(len(points), bool)
        ambiguous[low], usual[low] = t.ambiguous[k][points[low]], t.usual[k][points[low]]
        sure = kind == k
        if not sure.any():
            continue
        latin = (kind == 1) & ~ambiguous
        unusual = np.bincount(word[inside], ((kind == 1) & ~usual)[inside], n) > 0
        has_sure = np.bincount(word[inside], sure[inside], n) > 0
        has_latin = np.bincount(word[inside], latin[inside], n) > 0
        lead = np.bincount(row, sure, rows) > np.bincount(row, latin, rows)
        first = np.flatnonzero(begin)
        take = ~has_latin & (has_sure | lead[row[first]] & ~unusual)
        change = inside[take[word[inside]] & ambiguous[inside]]
        out[change] = t.back[k][points[change]]
    return out


def _compose(points: np.ndarray, offsets: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition, one mark of every group at a time."""
    n = len(points)
    if not n:
        return points, offsets
    ccc = t.ccc[points]
    follower = (ccc > 0) | t.second[points]
    follower[offsets[:-1][offsets[:-1] < n]] = False
    begins = np.flatnonzero(~follower)
    size = np.diff(np.concatenate((begins, [n]))) - 1  # followers after each beginning
    live = np.flatnonzero(size)
    if not len(live):
        return points, offsets
    out, keep = points.copy(), np.ones(n, bool)
    head = begins[live].copy()  # where the composing character stands
    first, left = begins[live], size[live]
    last = np.full(len(live), -1)  # class of the last mark that stayed; -1: none stayed
    for k in range(1, int(left.max()) + 1):
        on = left >= k
        head, first, left, last = head[on], first[on], left[on], last[on]
        at = first + k
        mark, here = out[at], ccc[at].astype(np.int64)
        base = out[head].astype(np.uint64)
        found = np.zeros(len(at), np.uint32)
        key = base << np.uint64(21) | mark.astype(np.uint64)
        place = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        hit = t.pair_keys[place] == key
        found[hit] = t.pair_to[place[hit]]
        b, m = base.astype(np.int64), mark.astype(np.int64)
        lv = (b >= _L) & (b < _L + 19) & (m >= _V) & (m < _V + 21)
        found[lv] = (_S + ((b - _L) * 21 + (m - _V)) * 28)[lv]
        lvt = (b >= _S) & (b < _S + 11172) & ((b - _S) % 28 == 0) & (m > _T) & (m < _T + 28)
        found[lvt] = (b + m - _T)[lvt]
        free = (last < 0) | (here > last) & (last > 0)
        done = (found > 0) & free & (ccc[head] == 0)
        out[head[done]] = found[done]
        keep[at[done]] = False
        stay = ~done
        starter = stay & (here == 0)  # it begins to compose itself
        head = np.where(starter, at, head)
        last = np.where(starter, -1, np.where(stay, here, last))
    ends = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], ends[offsets]


def unify_array(column: pa.Array) -> pa.Array:
    """The consistent form of a string column; null stays null, an empty text stays empty."""
    t = _tables()
    valid = np.asarray(column.is_valid()) if column.null_count else None
    points, offsets = to_code_points(column)
    if len(points) and points.max() >= 0x80 or len(points) and (points < 0x20).any():
        points, offsets = _expand(points, offsets, t)
        points = _order(points, offsets, t)
        points = _scripts(points, offsets, t)
        points, offsets = _compose(points, offsets, t)
    return to_arrow(points, offsets, valid)


def unify(df: DataFrame, text: str, out: str = "unified") -> DataFrame:
    """``df`` with the consistent form of column ``text`` in column ``out``.

    A null text gives null, an empty one the empty text; any length is processed whole. Should
    ``df`` already have a column ``out``, it is replaced. All other columns pass through.
    """
    schema = df.drop(out).withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, text):
            column = unify_array(batch.column(batch.schema.get_field_index(text)))
            names = [x for x in batch.schema.names if x != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in names), column], [*names, out])

    return df.mapInArrow(run, schema)


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (key_a < key_b) of records whose texts differ in characters but not in looks.

    Rows with a null key or text take no part; a key given twice with the same text is one record,
    and a key paired with itself is no pair. Each distinct form is reduced to its distinct
    spellings before anything is paired, so copies of one spelling are never paired among
    themselves: only forms with two spellings or more, and of them only records under unequal
    spellings, meet.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    # written once: four joins read it, and the form is computed from whole texts
    formed = materialize(unify(rows, "text", "form").select("key", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("spelling")).distinct(), "forms")
    several = formed.groupBy("form").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo < hi").select("form")
    # the forms that occur in two spellings are few; the semi-join leaves their records only
    members = formed.join(several, "form", "left_semi")
    spellings = members.select("form", "spelling").distinct()
    other = spellings.select("form", F.col("spelling").alias("spelling_b"))
    pairs = spellings.join(other, "form").where("spelling < spelling_b")
    a = members.select("form", "spelling", F.col("key").alias("a"))
    b = members.select("form", F.col("spelling").alias("spelling_b"), F.col("key").alias("b"))
    joined = pairs.join(a, ["form", "spelling"]).join(b, ["form", "spelling_b"]).where("a <> b")
    return joined.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
