"""Text decoded in another encoding than it was written in: found by a hidden Markov model, and undone.

The model has one clean state and one state for each pair (written in, read in). Characters that were
lost have no state: a U+FFFD outside the spans of the path is found by a plain test. The clean state gives a character by a bigram model trained on the corpus itself; a
pair's state gives the original character by the same model, through the pair's inverse transform.
The best path labels the characters of a text; each labelled span gets the inverse transform of its
state. Characters in ASCII are the same under all states, so only the others are steps of the path.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.arrowtext import in_parts, row_of, spread, to_code_points

# Pairs (written in, read in) that have a state of their own; the first ones are found by structure.
UTF8_READ_IN = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac-roman", "koi8-r", "gb18030", "cp932", "big5")
OTHER_PAIRS = (("gb18030", "cp1252"), ("big5", "cp1252"), ("cp932", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp1252", "mac-roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac-roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1251"))
SINGLE = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac-roman", "koi8-r")
ENTER_UTF8, ENTER_OTHER, ENTER_KNOWN = 7.0, 7.0, 5.0  # cost in nats of leaving the clean state
DROPPED = 0.3  # cost in nats of a byte that was dropped
LOST = 0xFFFD
_SYMBOLS = 0x3100  # code points below stand for themselves in bigrams, others for their class
_CLASSES = 12


def _classes() -> np.ndarray:
    """Symbol of every code point: itself, or a class of the code points above."""
    out = np.arange(0x110000, dtype=np.int64)
    out[_SYMBOLS:] = _SYMBOLS
    for k, (a, b) in enumerate(((0x3400, 0xA000), (0xAC00, 0xD7B0), (0xE000, 0xF900), (0xFE30, 0xFE50), (0xFF00, 0xFF61), (0xFF61, 0xFFA0), (0x1F000, 0x20000), (0x20000, 0x32000), (0xFFFD, 0xFFFE)), 1):
        out[a:b] = _SYMBOLS + k
    return out


@lru_cache(1)
def _symbol() -> np.ndarray:
    return _classes()


@lru_cache(16)
def _bytes_of(encoding: str) -> dict[str, bytes]:
    """Character -> bytes of a single-byte encoding; undefined bytes stand for the control of that number."""
    out = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, bytes([b]))
    if encoding == "cp1252":  # Latin-1 is the same with controls in place of its additions: one state for both
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), bytes([b]))
    return out


@lru_cache(1)
def _byte_tables() -> list[np.ndarray]:
    tables = []
    for encoding in ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac-roman"):  # in the others sound words have the shape too
        t = np.zeros(0x3000, np.uint8)
        for ch, b in _bytes_of(encoding).items():
            if encoding == "mac-roman" and 0xC4 <= b[0] < 0xE0:
                continue  # quotation marks and capitals before accented letters
            if ord(ch) >= 0x80 and ord(ch) < 0x3000:
                t[ord(ch)] = b[0]
        tables.append(t)
    return tables


def utf8_shaped(points: np.ndarray) -> np.ndarray:
    """Places where, read in some single-byte encoding, a whole UTF-8 sequence would begin."""
    n = len(points)
    out = np.zeros(n, bool)
    low = np.where(points < 0x3000, points, 0)
    for t in _byte_tables():
        b = t[low]
        follows = (b & 0xC0) == 0x80
        one = np.concatenate((follows[1:], [False]))
        two = np.concatenate((follows[2:], [False, False]))[:n]
        three = np.concatenate((follows[3:], [False] * 3))[:n]
        out |= (b >= 0xC2) & (b < 0xE0) & one | (b >= 0xE0) & (b < 0xF0) & one & two | (b >= 0xF0) & (b < 0xF5) & one & two & three
    return out


def _count(batches: Iterator[pa.RecordBatch], model: Model | None = None) -> Iterator[pa.RecordBatch]:
    """Bigram counts of symbols (a, b) and, as a = -1, counts of code points, of lines that look sound.

    With a model, lines that it labels garbled are left out too.
    """
    screen = Screen(Scorer(model)) if model else None
    symbol = _symbol()
    for batch in in_parts(batches, "text"):
        points, offsets = to_code_points(batch.column(0))
        if not len(points):
            continue
        points = points.astype(np.int64)
        row = row_of(offsets)
        start = np.concatenate(([True], (points[:-1] == 10) | (row[1:] != row[:-1])))
        line = np.cumsum(start) - 1
        # a sign of Latin-1 right beside another character of its upper half is no ordinary writing
        upper = (points >= 0xA0) & (points < 0x100)
        sign = (points > 0xA0) & (points < 0xC0) & ~np.isin(points, (0xA1, 0xAA, 0xAB, 0xB0, 0xB7, 0xBA, 0xBB, 0xBF))
        beside = np.concatenate((upper[1:] & ~start[1:], [False])) | np.concatenate(([False], upper[:-1])) & ~start
        odd = sign & beside | utf8_shaped(points) | (points == LOST) | (points >= 0xE000) & (points < 0xF900) | (points >= 0x80) & (points < 0xA0)
        sound = np.bincount(line, odd) == 0
        if screen:
            first = line[np.minimum(offsets[:-1], len(points) - 1)]
            sound[[first[r] + k for r, k in labelled(batch.column(0), screen, suspect)]] = False
        use = sound[line]
        s = symbol[points]
        before = np.concatenate(([10], s[:-1]))
        before[start] = 10
        key, n = np.unique((before << 21 | s)[use], return_counts=True)
        ch, m = np.unique(points[use], return_counts=True)
        a, b = np.concatenate((key >> 21, np.full(len(ch), -1))), np.concatenate((key & 0x1FFFFF, ch))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(np.concatenate((n, m)), pa.int64())], ["a", "b", "n"])


@dataclass
class Model:
    """Log-probabilities of characters. Its size is bounded by the code points, not by the corpus."""

    points: np.ndarray  # sorted code points seen
    weight: np.ndarray  # log P(code point)
    pairs: np.ndarray  # sorted keys of symbol bigrams
    given: np.ndarray  # log P(symbol | symbol before)
    floor: float
    back: dict[int, float]  # log of what a symbol leaves to bigrams it wasn't seen in


def train(df: DataFrame, text: str) -> Model:
    """Count the characters and symbol bigrams of all texts and make the model of them.

    Twice: a garbling that is frequent looks usual to the first model, so the second one is of the
    lines in which the first finds none.

    What reaches the driver has at most a row for each code point and each pair of the symbols
    (code points below U+3100 and a dozen classes) that occurs: an alphabet's worth, whatever the
    size of the corpus.
    """
    texts = spread(df.select(F.col(text).alias("text")).where("text is not null"))

    def counted(first: Model | None) -> pd.DataFrame:
        held = df.sparkSession.sparkContext.broadcast(first) if first else None
        return texts.mapInArrow(lambda batches: _count(batches, held.value if held else None), "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()

    return _fit(counted(_fit(counted(None))))


def _fit(counts: pd.DataFrame) -> Model:
    """The model of the counts."""
    one, two = counts[counts.a < 0].sort_values("b"), counts[counts.a >= 0]
    symbol = _symbol()
    points, n = one.b.to_numpy(np.int64), one.n.to_numpy(float)
    total = n.sum() + 1.0
    per_symbol = np.bincount(symbol[points], n, _SYMBOLS + _CLASSES) if len(points) else np.zeros(_SYMBOLS + _CLASSES)
    key = two.a.to_numpy(np.int64) << 21 | two.b.to_numpy(np.int64)
    order = np.argsort(key)
    key, m = key[order], two.n.to_numpy(float)[order]
    before = key >> 21
    out = np.bincount(before, m, _SYMBOLS + _CLASSES) if len(key) else np.zeros(_SYMBOLS + _CLASSES)
    kinds = np.bincount(before, minlength=_SYMBOLS + _CLASSES) if len(key) else np.zeros(_SYMBOLS + _CLASSES)
    # absolute discounting: what is taken from the pairs seen goes to all symbols by their own weight
    given = np.log(np.maximum(m - 0.5, 1e-9) / out[before]) if len(key) else np.zeros(0)
    rest = np.log(np.maximum(0.5 * kinds, 1.0) / np.maximum(out, 1.0) if len(key) else np.ones(_SYMBOLS + _CLASSES))
    weight = np.log(n / total) if len(points) else np.zeros(0)
    # a class gives its symbol; the code point within the class by its share
    big = points >= _SYMBOLS
    share = np.zeros(len(points))
    share[big] = np.log(n[big] / per_symbol[symbol[points[big]]])
    return Model(points, np.stack([weight, share]) if len(points) else np.zeros((2, 0)), key, given, -math.log(total) - 2.0, dict(enumerate(np.minimum(rest, 0.0))))


class Scorer:
    """log P(character | character before), for single characters and for whole arrays."""

    def __init__(self, model: Model) -> None:
        self.m, self.symbol = model, _symbol()
        self.rest = np.array([model.back.get(k, 0.0) for k in range(_SYMBOLS + _CLASSES)])
        self.known: dict[int, float] = {}
        self.fits: dict[tuple, tuple[int, ...]] = {}
        self.chosen: dict[tuple, list[str]] = {}
        self.runs: dict[tuple, tuple] = {}

    def array(self, before: np.ndarray, points: np.ndarray) -> np.ndarray:
        m = self.m
        if not len(m.points) or not len(m.pairs):
            return np.full(len(points), m.floor)
        a, b = self.symbol[before], self.symbol[points]
        key = a << 21 | b
        at = np.minimum(np.searchsorted(m.pairs, key), len(m.pairs) - 1)
        seen = m.pairs[at] == key
        p = np.minimum(np.searchsorted(m.points, points), len(m.points) - 1)
        there = m.points[p] == points
        weight = np.where(there, m.weight[0][p], m.floor)
        share = np.where(there, m.weight[1][p], m.floor)
        return np.where(seen, m.given[at] + np.where(points >= _SYMBOLS, share, 0.0), self.rest[a] + weight)

    def likeliest(self, points: np.ndarray) -> str:
        """The most frequent of some code points; nothing if the corpus has none of them."""
        if not len(self.m.points):
            return ""
        at = np.minimum(np.searchsorted(self.m.points, points), len(self.m.points) - 1)
        weight = np.where(self.m.points[at] == points, self.m.weight[0][at], -np.inf)
        k = int(np.argmax(weight))
        return chr(int(points[k])) if weight[k] > -np.inf else ""

    def rarity(self, points: np.ndarray) -> np.ndarray:
        """log P of a code point, within its class above the symbols' range."""
        if not len(self.m.points):
            return np.full(len(points), self.m.floor)
        at = np.minimum(np.searchsorted(self.m.points, points), len(self.m.points) - 1)
        return np.where(self.m.points[at] == points, self.m.weight[1][at], self.m.floor)

    def fitting(self, lead: int, rest: bytes, unseen: frozenset[int]) -> tuple[int, ...]:
        """The corpus's code points whose UTF-8 bytes are ``lead``, then ``rest`` and some of ``unseen`` among each other."""
        key = (lead, rest, unseen)
        if (got := self.fits.get(key)) is None:
            low, high = (((lead & 31) << 6, 64), ((lead & 15) << 12, 1 << 12), ((lead & 7) << 18, 1 << 18))[(lead >= 0xE0) + (lead >= 0xF0)]
            a, b = np.searchsorted(self.m.points, (low, low + high))
            found = []
            for x in self.m.points[a:b].tolist():
                if 0xD800 <= x < 0xE000 or unicodedata.category(chr(x)) in _NEVER or (tail := chr(x).encode())[0] != lead:
                    continue
                k = 0
                for y in tail[1:]:
                    if k < len(rest) and y == rest[k]:
                        k += 1
                    elif y not in unseen:
                        break
                else:
                    if k == len(rest):
                        found.append(x)
            got = self.fits[key] = tuple(found)
        return got

    def choose(self, before: int, items: list, after: int) -> list[tuple[str, int, int]]:
        """Originals with their ends and the bytes dropped; of those that are several the ones of the best path between their neighbours."""
        if not any(isinstance(x, tuple) for x, *_ in items):
            return [(x, last, 0) for x, last in items]
        key = (before, tuple(x for x, *_ in items), after)
        if (got := self.chosen.get(key)) is None:
            kept, score, back = np.array([before]), np.zeros(1), []
            for x, *_ in items:
                c = np.array(x if isinstance(x, tuple) else (ord(x),))
                grid = score[:, None] + (self.array(np.repeat(kept, len(c)), np.tile(c, len(kept))).reshape(len(kept), len(c)) if x != "�" else 0.0)
                back.append((c, grid.argmax(0)))
                kept, score = c, grid.max(0)
            k, got = int(np.argmax(score + self.array(kept, np.full(len(kept), after)))), []
            for c, came in reversed(back):
                got.append(chr(int(c[k])))
                k = int(came[k])
            got.reverse()
            if len(self.chosen) > 1 << 16:
                self.chosen.clear()
            self.chosen[key] = got
        return [(x, item[1], item[2] if isinstance(item[0], tuple) else 0) for x, item in zip(got, items, strict=True)]

    def made_of(self, first: int, run: str, after: int, following: int, among: list, closed: bool = True) -> tuple:
        """What the states make of a run; runs of a word or two come again and again, so each state's part is kept."""
        key = (first, run, after, following if after == 32 else 0, closed)
        if (got := self.runs.get(key)) is None:
            if len(self.runs) > 1 << 15:
                self.runs.clear()
            got = {}
            if len(run) < 24:
                self.runs[key] = got
        if missing := [s for s in among if s[0] not in got]:
            for s, *row in zip(missing, *_gains(first, list(run), after, following, self, missing, closed), strict=True):
                got[s[0]] = row
        rows = [got[s[0]] for s in among]
        return np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), [x[3] for x in rows]

    def one(self, before: int, point: int) -> float:
        key = before << 21 | point
        if (got := self.known.get(key)) is None:
            if len(self.known) > 1 << 20:
                self.known.clear()
            got = self.known[key] = float(self.array(np.array([before]), np.array([point]))[0])
        return got


@lru_cache(16)
def _unseen(read_in: str) -> frozenset[int]:
    """Continuation bytes that a reading encoding leaves undefined or shows as nothing, so that they are dropped easily."""
    out = set()
    for b in range(0x80, 0xC0):
        try:
            ch = bytes([b]).decode(read_in)
        except UnicodeDecodeError:
            ch = chr(b)
        if unicodedata.category(ch) in ("Cc", "Cf") or read_in == "cp1252" and b < 0xA0:  # Latin-1 is of that state too
            out.add(b)
    return frozenset(out)


@lru_cache(16)
def _leads(read_in: str) -> frozenset[str]:
    """The characters of ASCII and those whose bytes can begin a UTF-8 sequence, in a single-byte encoding; and U+FFFD."""
    return frozenset(ch for ch, b in _bytes_of(read_in).items() if b[0] < 0x80 or 0xC2 <= b[0] < 0xF5) | {"�"}


@lru_cache(4096)
def _fitting(lead: int, second: int, third: int) -> np.ndarray:
    """Code points of three UTF-8 bytes of which those given as 0xFF are unknown."""
    free = lambda b, among: among if b == 0xFF else (b,)
    tails = range(0x80, 0xC0)
    return np.array([(a & 15) << 12 | (b & 63) << 6 | c & 63 for a in free(lead, range(0xE2, 0xF0)) for b in free(second, tails) for c in free(third, tails)], np.int64)


def _undo_utf8(chars: list[str], read_in: str, likeliest=None, fitting=None) -> list[tuple] | None:
    """The original characters of a run with the number of the garbled one each ends in.

    Where one byte of three was lost, ``likeliest`` chooses among the characters that fit the
    others. Where bytes that the encoding doesn't show were dropped, ``fitting`` gives the code points
    that fit the others: they stand in the character's place, with the number of bytes dropped.
    Where more was lost the character is U+FFFD.
    """
    data, ends = bytearray(), []
    table = _bytes_of(read_in) if read_in in SINGLE else None
    if table is not None and _leads(read_in).isdisjoint(chars):
        return None  # nothing can begin here
    for k, ch in enumerate(chars):
        if ch == "�":
            b = b"\xff"
        elif table is not None:
            if (b := table.get(ch)) is None:
                return None
        else:
            try:
                b = ch.encode(read_in)
            except UnicodeEncodeError:
                if ord(ch) >= 0x100 and not 0xF8F0 <= ord(ch) <= 0xF8F3:
                    return None
                b = bytes([{0xF8F0: 0xA0, 0xF8F1: 0xFD, 0xF8F2: 0xFE, 0xF8F3: 0xFF}.get(ord(ch), ord(ch) & 0xFF)])
        data += b
        ends += [k] * len(b)
    out, i, n = [], 0, len(data)
    while i < n:
        b = data[i]
        if b < 0x80:
            out.append((chr(b), ends[i]))
            i += 1
            continue
        size = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        piece = bytes(data[i : i + size]) if size else b""
        try:
            out.append((piece.decode("utf-8") if len(piece) == size and size else "", ends[min(i + max(size, 1), n) - 1]))
        except UnicodeDecodeError:
            out.append(("", 0))
        if out[-1][0]:
            i += size
        else:  # a broken sequence: its bytes are lost as one character
            three = bytes(data[i : i + 3])
            if likeliest and len(three) == 3 and three.count(0xFF) == 1 and (three[0] == 0xFF or 0xE0 <= three[0] < 0xF0) and all(x == 0xFF or x & 0xC0 == 0x80 for x in three[1:]) and (guess := likeliest(_fitting(*three))):
                out[-1] = (guess, ends[i + 2])
                i += 3
                continue
            j = i + 1
            while j < n and j - i < max(size, 1) and data[j] & 0xC0 == 0x80:
                j += 1
            if j < n and data[j] == 0xFF and j - i < max(size, 1):
                j += 1
            if fitting and j - i < size and (j == n or data[j] != 0xFF) and (fits := fitting(b, bytes(data[i + 1 : j]), _unseen(read_in))):
                out[-1] = (fits, ends[j - 1], size - (j - i))
            else:
                out[-1] = ("�", ends[j - 1])
            i = j
    return out


@lru_cache(64)
def _originals(written: str, read_in: str) -> dict[str, str]:
    """Garbled character -> original, where both encodings have one byte a character."""
    out = {}
    for ch, b in _bytes_of(read_in).items():
        try:
            out[ch] = b.decode(written)
        except UnicodeDecodeError:
            continue
    return out


def _undo_other(chars: list[str], written: str, read_in: str) -> list[tuple[str, int]] | None:
    if written in SINGLE:
        back = _originals(written, read_in)
        got = [back.get(ch) for ch in chars]
        return None if None in got else list(zip(got, range(len(got)), strict=True))
    table = _bytes_of(read_in)
    data = bytearray()
    for ch in chars:
        if (b := table.get(ch)) is None:
            return None
        data += b
    out, i, n = [], 0, len(data)
    wide = written in ("gb18030", "big5", "cp932")
    while i < n:
        for size in (2, 1) if wide else (1,):
            try:
                original = bytes(data[i : i + size]).decode(written)
            except UnicodeDecodeError:
                continue
            if len(original) == 1:
                out.append((original, min(i + size, n) - 1))
                i += size
                break
        else:
            return None
    return out


def _undo_twice(chars: list[str]) -> list[tuple[str, int]] | None:
    once = _undo_utf8(chars, "cp1252")
    if once is None or any(x == "�" for x, _ in once):
        return None
    again: list[tuple[str, int]] = []
    for begin, end, own in _runs([x for x, _ in once]):
        if not own:
            again += once[begin:end]
        elif (part := _undo_utf8([x for x, _ in once[begin:end]], "cp1252")) is None:
            return None
        else:
            again += [(x, once[begin + k][1]) for x, k in part]
    return again


def _runs(chars: list[str]) -> list[tuple[int, int, bool]]:
    """(begin, end, whether outside ASCII) of the runs of characters."""
    out, i, n = [], 0, len(chars)
    while i < n:
        j, high = i, ord(chars[i]) >= 0x80
        while j < n and (ord(chars[j]) >= 0x80) == high:
            j += 1
        out.append((i, j, high))
        i = j
    return out


#: Every state but the clean one: name, undoing function, cost of entering it.
STATES = (
    [(f"utf-8>{r}", (lambda chars, scorer, r=r: _undo_utf8(chars, r, None, scorer.fitting) if r in SINGLE else _undo_utf8(chars, r, scorer.likeliest)), ENTER_UTF8) for r in UTF8_READ_IN]
    + [("utf-8>cp1252 twice", (lambda chars, scorer: _undo_twice(chars)), ENTER_UTF8)]
    + [(f"{w}>{r}", (lambda chars, scorer, w=w, r=r: _undo_other(chars, w, r)), ENTER_OTHER) for w, r in OTHER_PAIRS]
)
_NBSP_AT_A0 = tuple(f"utf-8>{r}" for r in ("cp1252", "cp1250", "cp1251"))
_EATEN = "\b"  # marks an original whose last byte became the space that follows it
_OUTSIDE = re.compile(r"[^\x00-\x7f]+")
_NEVER = ("Cn", "Co", "Cs", "Cc")  # kinds of characters no text was written with
_QUOTES = {"“": "”", "„": "“”", "‘": "’", "`": "`", '"': '"', "'": "'", "「": "」", "«": "»"}


@lru_cache(1 << 16)
def _writable(original: str) -> bool:
    return unicodedata.category(original)[:2] not in _NEVER or original in "\n\t"


def _gains(first: int, chars: list[str], after: int, following: int, scorer: Scorer, among: list, closed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """What the states make of a run between ``first`` and ``after``: gains, places where originals start and end, and the originals.

    ``closed`` is false for the part of a run that more of the run follows.
    """
    one, k = scorer.one, max(len(among), 1)
    codes = [ord(c) for c in chars]
    bases = [one(x, y) for x, y in zip([first, *codes], codes)]
    # gain over the clean state at each character; a state is entered and left between original characters only
    gains = np.full((k, len(chars)), -1e6)
    starts, ends = np.zeros((k, len(chars)), bool), np.zeros((k, len(chars)), bool)
    made: list = [None] * k
    pieces: dict[str, list] = {}
    for s, (name, undo, _) in enumerate(among):
        read_in = name.split(">")[1].split()[0]
        if read_in not in pieces:
            pieces[read_in] = _pieces(chars, name)
        for a, b in pieces[read_in]:
            got = undo(chars[a:b], scorer)
            if got is None or all(x == "�" for x, *_ in got):
                continue
            before, at = codes[a - 1] if a else first, a
            got = scorer.choose(before, got, codes[b] if b < len(chars) else after)
            # the no-break space of a sequence may have become the space that follows
            eaten = 0.0
            if b == len(chars) and name in _NBSP_AT_A0 and after == 32 and got[-1][2] == 1 and got[-1][1] == (got[-2][1] + 1 if len(got) > 1 else 0) and 0xC2 <= (lead := _bytes_of(name[6:])[chars[-1]][0]) < 0xE0:
                prior, x, y = ord(got[-2][0]) if len(got) > 1 else before, ord(got[-1][0]), (lead & 31) << 6 | 0x20
                if one(prior, y) + one(y, following) > one(prior, x) + one(x, 32) + one(32, following):
                    got[-1], eaten = (chr(y), got[-1][1], 1), one(y, following) - one(y, 32) - one(32, following)
            if len(got) == b - a and not eaten and all(x == y for (x, *_), y in zip(got, chars[a:b], strict=True)):
                continue
            if made[s] is None:
                made[s] = {}
            for original, last, dropped in got:
                last += a
                if dropped and last > at and chars[last] in _QUOTES.get(chr(codes[at - 1] if at else first), ""):
                    gain = -1e6  # a letter between quotation marks
                elif original == "�":  # possible only where characters were lost
                    gain = -6.0 if "�" in chars[at : last + 1] else -1e6
                else:
                    gain = one(before, ord(original)) - DROPPED * dropped if _writable(original) else -1e6
                if last >= at:
                    starts[s, at], ends[s, last] = True, True
                    gains[s, at : last + 1] = 0.0
                    gains[s, last] = gain - sum(bases[at : last + 1])
                else:
                    gains[s, last] += gain
                made[s].setdefault(last, []).append(original)
                before, at = ord(original), max(at, last + 1)
            if closed and b == len(chars) and codes[-1] != before:  # the character after it is the same in all states
                gains[s, b - 1] += one(before, after) - one(codes[-1], after) + eaten
            if eaten:
                made[s][b - 1].append(_EATEN)
    return gains, starts, ends, made


def _most(first: int, run: str, after: int, following: int, scorer: Scorer, among: list = STATES, closed: bool = True) -> np.ndarray:
    """The most that any stretch of a run can gain in each state."""
    return np.maximum(_stays([scorer.made_of(first, run, after, following, among, closed)], len(among)), 0.0)


def _worth(line: str, scorer: Scorer, known: frozenset[str] | None = None) -> list:
    """The states that the best path of a line can be in: a span gains no more than the line's runs can in its state."""
    among = [x for x in STATES if known is None or x[0] in known]
    if not among:
        return []
    total = np.zeros(len(among))
    for x in _OUTSIDE.finditer(line):
        begin, end = x.span()
        total += _most(ord(line[begin - 1]) if begin else 10, x[0], ord(line[end]) if end < len(line) else 10, ord(line[end + 1]) if end + 1 < len(line) else 10, scorer, among)
    return [s for s, most in zip(among, total, strict=True) if most > (s[2] if known is None else ENTER_KNOWN)]


_RANK = {s: k for k, s in enumerate(STATES)}
_WIDE = tuple(k for k, s in enumerate(STATES) if s[0] in ("utf-8>gb18030", "utf-8>cp932", "utf-8>big5"))
_NARROW = tuple(k for k in range(len(STATES)) if k not in _WIDE)


class Screen:
    """For the lines of a batch, the states their best paths can be in; no line is decided here.

    What a line can gain in a state is bounded from above. States read in one byte a character touch
    only stretches of such characters: each distinct stretch with its neighbours is worked out
    exactly once in a worker. For those read in several bytes, a span has to consist of UTF-8 sequences,
    and each of them counts with the most its character can ever have.
    """

    def __init__(self, scorer: Scorer) -> None:
        self.scorer, m = scorer, scorer.m
        self.narrow = np.zeros(0x110000, bool)
        for name in SINGLE:
            self.narrow[[ord(c) for c in _bytes_of(name) if ord(c) >= 0x80]] = True
        self.lead = np.zeros(0x110000, bool)
        for name in _NBSP_AT_A0:
            self.lead[[ord(c) for c, x in _bytes_of(name[6:]).items() if 0xC2 <= x[0] < 0xE0]] = True
        self.done: dict[int, np.ndarray] = {}
        self.coded = {k: (np.zeros(0x110000, bool), np.zeros((0x110000, 4), np.uint8), np.zeros(0x110000, np.uint8)) for k in _WIDE}
        # the most any character can have
        symbol, rest = scorer.symbol, float(scorer.rest.max())
        weight, share = np.full(0x110000, m.floor, np.float32), np.full(0x110000, m.floor, np.float32)
        weight[m.points], share[m.points] = m.weight[0], m.weight[1]
        best = np.full(_SYMBOLS + _CLASSES, -np.inf)
        np.maximum.at(best, m.pairs & 0x1FFFFF, m.given)
        share[:_SYMBOLS] = 0.0
        self.most = np.maximum(best[symbol] + share, rest + weight).astype(np.float32)

    def _bytes(self, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of characters in a state's reading encoding, and the character of each; 0 where there is none."""
        known, table, size = self.coded[k]
        read_in = STATES[k][0][6:]
        for x in np.unique(points[~known[points]]).tolist():
            try:
                data = chr(x).encode(read_in) if x >= 0x80 else b"\0"
            except UnicodeEncodeError:
                data = bytes([x & 0xFF]) if x < 0x100 else bytes([{0xF8F0: 0xA0, 0xF8F1: 0xFD, 0xF8F2: 0xFE, 0xF8F3: 0xFF}.get(x, 0)])
            known[x], table[x, : len(data)], size[x] = True, list(data), len(data)
        n = size[points].astype(np.int64)
        at = np.repeat(np.arange(len(points)), n)
        return table[points[at], np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)], at

    def _narrow_totals(self, points: np.ndarray, line: np.ndarray, totals: np.ndarray, text: str) -> None:
        inside = self.narrow[points] & (points >= 0x80)
        new = np.concatenate(([True], line[1:] != line[:-1]))
        begin = np.flatnonzero(inside & (np.concatenate(([False], ~inside[:-1])) | new))
        if not len(begin):
            return
        after_end = np.flatnonzero(inside & np.concatenate((~inside[1:] | new[1:], [True]))) + 1
        size = after_end - begin
        padded, ends = np.append(points, [10, 10]), np.append(new, [True, True])
        first = np.where(new[begin], 10, padded[begin - 1])
        after = np.where(ends[after_end], 10, padded[after_end])
        beyond = np.where(ends[after_end] | ends[np.minimum(after_end + 1, len(ends) - 1)], 10, padded[np.minimum(after_end + 1, len(padded) - 1)])
        following = np.where((after == 32) & self.lead[points[after_end - 1]], beyond, 0)  # has an effect only there
        # 64 bits of hash name a stretch and its neighbours
        mix = lambda x: (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        every = np.repeat(begin, size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        one = mix(mix(points[every + place].astype(np.uint64) + np.uint64(1)) + place.astype(np.uint64))
        key = np.add.reduceat(one, np.cumsum(size) - size)
        for part in (first, after, following, size):
            key = mix(key + part.astype(np.uint64) + np.uint64(1))
        names, where, back = np.unique(key, return_index=True, return_inverse=True)
        among = [STATES[k] for k in _NARROW]
        gains = np.empty((len(names), len(among)))
        for r, (name, w) in enumerate(zip(names.tolist(), where.tolist(), strict=True)):
            if (got := self.done.get(name)) is None:
                if len(self.done) > 1 << 18:
                    self.done.clear()
                a = int(after[w])
                got = self.done[name] = _most(int(first[w]), text[begin[w] : after_end[w]], a, int(following[w]) or int(beyond[w]), self.scorer, among, a < 0x80)
            gains[r] = got
        some = np.flatnonzero(gains.any(axis=1)[back])  # most stretches can gain nothing
        of = line[begin[some]]
        for j, k in enumerate(_NARROW):
            totals[:, k] += np.bincount(of, gains[back[some], j], len(totals))

    def _wide_totals(self, points: np.ndarray, line: np.ndarray, totals: np.ndarray) -> None:
        new = np.concatenate(([True], line[1:] != line[:-1]))
        before = np.where(new, 10, np.concatenate(([10], points[:-1])))
        base = self.scorer.array(before, points)
        # what the character after a run can gain by the run's new end
        high = points >= 0x80
        ends = high & np.concatenate((~high[1:] | new[1:], [True]))
        after = np.append(points[1:], 10)
        after = np.where(np.append(new[1:], True), 10, after)
        bonus = np.zeros(len(points))
        at = np.flatnonzero(ends)
        bonus[at] = np.maximum(self.most[after[at]] - self.scorer.array(points[at], after[at]), 0.0)
        for k in _WIDE:
            b, c = self._bytes(points, k)
            n = len(b)
            follows = np.append((b & 0xC0) == 0x80, [False] * 3)
            one, two, three = follows[1 : n + 1], follows[2 : n + 2], follows[3 : n + 3]
            # sequences never overlap, as a byte that leads one can't be inside another
            size = np.where(b < 0x80, b > 0, np.where(b < 0xE0, (b >= 0xC2) & one, np.where(b < 0xF0, one & two, (b < 0xF5) & one & two & three)) * (2 + (b >= 0xE0) + (b >= 0xF0)))
            i = np.flatnonzero(size)
            i = i[line[c[i + size[i] - 1]] == line[c[i]]]
            if not len(i):
                continue
            size, end = size[i], i + size[i]
            point = b[i].astype(np.int64)
            for length in (2, 3, 4):
                r = np.flatnonzero(size == length)
                point[r] &= 0xFF >> (length + 1)
                for j in range(1, length):
                    point[r] = point[r] << 6 | b[i[r] + j] & 0x3F
            # a character counts in the sequence that holds its last byte, or is left out where another span broke in it
            closes = np.append(c[1:] != c[:-1], True)
            cost = np.concatenate(([0.0], np.cumsum(np.where(closes & (b > 0), base[c], 0.0))))
            opens = np.concatenate(([True], closes[:-1]))
            filled = np.concatenate(([0], np.cumsum(b > 0)))
            goes_on = np.concatenate(([False], (filled[i[1:]] == filled[end[:-1]]) & (line[c[i[1:]]] == line[c[i[:-1]]])))
            gain = self.most[np.minimum(point, 0x10FFFF)] - (cost[end] - cost[i]) + np.where(closes[end - 1], bonus[c[end - 1]], 0.0)
            broken = ~goes_on & ~opens[i] & closes[i]
            gain = np.where(broken, gain + base[c[i]], gain)
            total = np.cumsum(gain - np.where(goes_on, 0.0, 1e6))
            least = np.minimum.accumulate(np.where(goes_on, np.concatenate(([0.0], total[:-1])), total - gain))
            may_end = np.flatnonzero(closes[end - 1])
            np.maximum.at(totals[:, k], line[c[i[may_end]]], (total - least)[may_end])

    def candidates(self, points: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
        """(lines, states): the most a line can gain in a state. ``points`` are those of lines that aren't ASCII."""
        totals = np.zeros((lines, len(STATES)))
        if len(points):
            text = points.astype("<u4").tobytes().decode("utf-32-le")
            self._narrow_totals(points, line, totals, text)
            self._wide_totals(points, line, totals)
        return totals


def _runs_of(text: str, scorer: Scorer, among: list) -> tuple[list, list]:
    """The runs outside ASCII of a line, and what the states make of each."""
    runs, n = [x.span() for x in _OUTSIDE.finditer(text)], len(text)
    made = [scorer.made_of(ord(text[begin - 1]) if begin else 10, text[begin:end], ord(text[end]) if end < n else 10, ord(text[end + 1]) if end + 1 < n else 10, among) for begin, end in runs] if among else []
    return runs, made


def _stays(made: list, states: int) -> np.ndarray:
    """The most a single stay in each state gains."""
    total = np.cumsum(np.concatenate([x[0] for x in made], axis=1), axis=1)
    least = np.minimum.accumulate(np.concatenate((np.zeros((states, 1)), total[:, :-1]), axis=1), axis=1)
    return (total - least).max(axis=1)


def suspect(text: str, scorer: Scorer, among: list) -> bool:
    """Whether a stay in one of the states would pay for entering it."""
    return any(_stays(_runs_of(text, scorer, [s])[1], 1)[0] > s[2] for s in among)


def labelled(column: pa.Array, screen: Screen, of=None) -> dict[tuple[int, int], list]:
    """(row, line number) -> spans, of the lines of a string column that have any.

    With ``of`` = suspect the lines are only told apart, which is enough for training.
    """
    points, offsets = to_code_points(column)
    if not len(points) or points.max() < 0x80:
        return {}
    points = points.astype(np.int64)
    row = row_of(offsets)
    newline = points == 10
    counted = np.concatenate(([0], np.cumsum(newline)))
    number = counted[:-1] - counted[offsets[:-1]][row]
    start = np.concatenate(([True], newline[:-1] | (row[1:] != row[:-1])))
    line = np.cumsum(start) - 1
    high = np.flatnonzero(np.bincount(line, points >= 0x80) > 0)
    name = np.full(line[-1] + 1, -1)
    name[high] = np.arange(len(high))
    use = (name[line] >= 0) & ~newline
    points, line, at = points[use], name[line[use]], np.flatnonzero(use)
    begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    end = np.append(begin[1:], len(points))
    totals = screen.candidates(points, line, len(high))
    worth = totals > np.array([s[2] for s in STATES])
    lost = np.bincount(line, points == LOST, len(high)) > 0
    out = {}
    for k in np.flatnonzero(worth.any(axis=1) | lost).tolist():
        text = points[begin[k] : end[k]].astype("<u4").tobytes().decode("utf-32-le")
        among = [STATES[j] for j in np.argsort(-totals[k], kind="stable") if worth[k, j]]
        if of is not None:
            got = not lost[k] and of(text, screen.scorer, among)
        else:
            got = label(text, screen.scorer, among=None if lost[k] else sorted(among, key=_RANK.get))
        if got:
            first = at[begin[k]]
            out[int(row[first]), int(number[first])] = got
    return out


def label(text: str, scorer: Scorer, known: frozenset[str] | None = None, among: list | None = None) -> list[tuple[int, int, str, str]]:
    """The best path through the states: spans (begin, end, state, original text) that aren't clean.

    A span that stands alone between quotation marks or in code marks, as a sample of one word, is
    an example of garbled text and belongs to the clean state. States that are ``known`` from other
    lines of the text are the only ones looked at then, and cheaper to enter. ``among`` gives the
    states that the path can be in, where that is known.
    """
    among = _worth(text, scorer, known) if among is None else among
    if not among and "�" not in text:
        return []
    none = -1e9
    enter = np.array([s[2] if known is None else ENTER_KNOWN for s in among])
    runs, made_of = _runs_of(text, scorer, among)
    if among:
        # a state pays for being entered each time, so one whose best stay gains less is never on the path
        use = np.flatnonzero(_stays(made_of, len(among)) > enter - 1e-3)
        among, enter = [among[s] for s in use], enter[use]
    if not among and "�" not in text:
        return []
    clean = 0.0
    k = len(enter)
    best = np.full(k, none)
    steps: list[tuple[int, int, list]] = []  # run and place of the step, what each state makes of the run
    came_clean: list[int] = []
    came_state: list[np.ndarray] = []
    leaves = np.ones(k, bool)  # states whose original character is complete
    for (begin, end), (gains, starts, ends, made) in zip(runs, made_of, strict=True) if among else ():
        gains, starts, ends, made = gains[use], starts[use], ends[use], [made[s] for s in use]
        for i in range(end - begin):
            out = np.where(leaves, best, none)
            to_clean = int(np.argmax(out)) if out.max() > clean else -1
            fresh = np.where(starts[:, i], clean - enter, none)
            stay = best >= fresh
            came_clean.append(to_clean)
            came_state.append(stay)
            steps.append((begin, begin + i, made))
            clean, best = max(clean, float(out.max())), np.where(stay, best, fresh) + gains[:, i]
            best[best < -1e5] = none
            leaves = ends[:, i]
    out = np.where(leaves, best, none)
    state = int(np.argmax(out)) if k and out.max() > clean else -1
    marks = []
    for t in range(len(steps) - 1, -1, -1):
        marks.append(state)
        state = came_clean[t] if state < 0 else state if came_state[t][state] else -1
    marks.reverse()
    spans: list[list] = []
    for (begin, place, made), s in zip(steps, marks, strict=True):
        if s < 0:
            continue
        original = "".join((made[s] or {}).get(place - begin, []))
        if spans and spans[-1][2] == s and spans[-1][1] == place:
            spans[-1][1], spans[-1][3] = place + 1, spans[-1][3] + original
        else:
            spans.append([place, place + 1, s, original])
    named = [(b, e + o.endswith(_EATEN), among[s][0], o.replace(_EATEN, "")) for b, e, s, o in spans]
    covered = {i for b, e, _, _ in named for i in range(b, e)}
    named += [(i, i + 1, "lost", "�") for i, c in enumerate(text) if c == "�" and i not in covered]
    return sorted(x for x in named if not _example(text, x[0], x[1], covered))


def _pieces(chars: list[str], state: str) -> list[tuple[int, int]]:
    """The stretches of a run that can be encoded by the state's reading encoding."""
    name = state.split(">")[1].split()[0]
    if name in SINGLE:
        table = _bytes_of(name)
        ok = [c in table or c == "�" for c in chars]
    else:
        ok = [True] * len(chars)
        try:
            "".join(chars).replace("�", "").encode(name)
        except UnicodeEncodeError:
            for i, c in enumerate(chars):
                try:
                    c.encode(name)
                except UnicodeEncodeError:
                    ok[i] = c == "�" or ord(c) < 0x100 or 0xF8F0 <= ord(c) <= 0xF8F3
    out, i = [], 0
    while i < len(ok):
        if ok[i]:
            j = i
            while j < len(ok) and ok[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def _example(text: str, begin: int, end: int, garbled: set[int]) -> bool:
    """Whether the span's word stands alone between quotation marks that are themselves clean."""
    i = begin
    while i > 0 and begin - i < 24 and text[i - 1] not in " \n\t\r":
        i -= 1
        if text[i] in _QUOTES and i not in garbled:
            j = end
            while j < len(text) and j - end < 24 and text[j] not in " \n\t\r":
                if text[j] in _QUOTES[text[i]] and j not in garbled:
                    return True
                j += 1
            return False
    return False


def _restore(model: Broadcast, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        screen = Screen(scorer)
        for batch in in_parts(batches, "__text"):
            column = batch.column(batch.schema.get_field_index("__text"))
            texts = column.to_pylist()
            restored, states = list(texts), [[] for _ in texts]
            garbled: dict[int, dict[int, list]] = {}
            for (r, k), got in labelled(column, screen).items():
                garbled.setdefault(r, {})[k] = got
            for r, spans in garbled.items():
                lines = texts[r].split("\n")
                # what one line shows makes the same in the others likelier
                known = frozenset(name for got in spans.values() for _, _, name, _ in got)
                spans = {k: got for k, x in enumerate(lines) if not x.isascii() and (got := label(x, scorer, known))} | ({} if known - {"lost"} else spans)
                found = {name for got in spans.values() for _, _, name, _ in got} or known
                for k, got in spans.items():
                    parts, at = [], 0
                    for b, e, _, original in got:
                        parts += [lines[k][at:b], original]
                        at = e
                    lines[k] = "".join(parts) + lines[k][at:]
                restored[r], states[r] = "\n".join(lines), sorted(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in keep), pa.array(restored, pa.string()), pa.array(states, pa.list_(pa.string()))], [*keep, "restored", "pairs"])

    return run


def restore(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, restored, pairs): every text with its garbled spans undone and the states they were in.

    ``pairs`` is empty for a text without such spans, which is unchanged; "lost" stands for
    characters that can't be recovered and stay U+FFFD. Null and empty texts come out as they are.
    One row for each row of ``df``, repeated ones included; other columns have no effect.
    """
    model = model or train(df, text)
    rows = spread(df.select(F.col(key).alias(key), F.col(text).alias("__text")))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_restore(df.sparkSession.sparkContext.broadcast(model), [key]), f"`{key}` {kind}, restored string, pairs array<string>")
