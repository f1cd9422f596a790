"""Token ids of a whole corpus: chunks cut by content are encoded once, then their joins are repaired.

A rolling hash over the code points cuts every text into chunks whose borders depend on their
surroundings only, so a passage that occurs in many documents gives the same chunks there. Each
distinct chunk is encoded once. Where two chunks meet, the tokens beside the border may differ from
those of the whole text; there the text is encoded again, pre-token by pre-token, until the borders
of the pre-tokens agree with those the right chunk was encoded by. From then on both are the same.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.arrowtext import in_parts, to_code_points

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the vocabulary, with white space named by its property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, LEAST, MOST, MASK = 16, 256, 4096, 1023  # code points; a cut about every LEAST + MASK of them


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a vocabulary file, read by the driver: workers need no file of their own. Some hundred kilobytes."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


@lru_cache(2)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


@lru_cache(1)
def _certain():
    """Places where a pre-token ends whatever stands around them: after a letter, a digit or before white space."""
    import regex

    return regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\P{White_Space})(?=\p{White_Space})")


def cut_places(points: np.ndarray, offsets: np.ndarray, block: int = 1 << 20) -> list[list[int]]:
    """Chunk borders of every row of a batch, its beginning and end included.

    A border is where the rolling hash of the last WINDOW code points ends in zeros, if the chunk is
    then LEAST long; a chunk ends at MOST at the latest. The hashes of all places come from WINDOW
    shifted products, block by block.
    """
    found = []
    for begin in range(0, len(points), block):
        part = points[max(0, begin - WINDOW + 1) : begin + block].astype(np.uint64)
        mixed = (part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        total = np.zeros(len(part), np.uint64)
        for k in range(min(WINDOW, len(part))):
            total[k:] += mixed[: len(part) - k] * np.uint64(pow(0x100000001B3, k, 1 << 64))
        total ^= total >> np.uint64(32)
        shift = begin - max(0, begin - WINDOW + 1)
        found.append(np.flatnonzero((total[shift:] & np.uint64(MASK)) == 0) + begin + 1)
    place = np.concatenate(found) if found else np.zeros(0, np.int64)
    lo, hi = np.searchsorted(place, offsets[:-1] + WINDOW, "left"), np.searchsorted(place, offsets[1:], "left")
    rows = []
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        cuts = [a]
        for p in [*place[lo[r] : hi[r]].tolist(), b]:
            while p - cuts[-1] > MOST:
                cuts.append(cuts[-1] + MOST)
            if p == b and p > cuts[-1] or p - cuts[-1] >= LEAST:
                cuts.append(p)
        rows.append([c - a for c in cuts])
    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches, "text"):
        points, offsets = to_code_points(batch.column(2))
        texts = batch.column(2).to_pylist()
        row, pos, size, chunk = [], [], [], []
        for r, cuts in enumerate(cut_places(points, offsets)):
            n = len(cuts) - 1
            row += [r] * n
            pos += range(n)
            size += [n] * n
            chunk += [texts[r]] if n == 1 else [texts[r][a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        rows = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos, pa.int32()), pa.array(size, pa.int32()), pa.array(chunk, pa.string())], ["doc", "text_key", "pos", "size", "chunk"])


def _settled(chunk: str) -> int:
    """The place up to which the pre-tokens of a chunk hold whatever follows it.

    The last two may go on in the next chunk: a contraction cut in two is two here. They are read
    from a place near the end where one pre-token surely ends and another begins.
    """
    pattern, certain = _pattern(), _certain()
    reach = 64
    while True:
        at = 0
        if reach < len(chunk):
            found = certain.search(chunk, len(chunk) - reach)
            at = found.end() if found else len(chunk)
        starts = [m.start() for m in pattern.finditer(chunk, at)]
        if len(starts) > 2 or reach >= len(chunk):
            return starts[-2] if len(starts) > 1 else 0
        reach *= 4


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32, copy=False) if parts else np.zeros(0, np.int32)))


def _ids_of(vocabulary: Broadcast):
    encode = _encoder(vocabulary.value).encode_ordinary
    return lambda text: np.array(encode(text), np.int32)


def _encode_chunks(vocabulary: Broadcast):
    """Every place of a chunk with its ids; rows come sorted by chunk, so each is encoded once.

    The text goes on only where there is a join to repair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, got, joins = _ids_of(vocabulary), None, None, False
        for batch in in_parts(batches, "chunk"):
            result, sent = [], []
            for key, chunk, size in zip(batch.column(5).to_pylist(), batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True):
                join = size > 1
                if key != last:
                    last, ids, joins = key, encode(chunk), False
                    got = (ids.tobytes(), None, None)
                if join and not joins:
                    safe, joins = _settled(chunk), True
                    got = (got[0], safe, len(ids) - len(encode(chunk[safe:])))
                result.append(got if join else (got[0], None, None))
                sent.append(chunk if join else None)
            columns = [pa.array([x[j] for x in result], kind) for j, kind in enumerate((pa.binary(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sent, pa.string()), *columns], ["doc", "text_key", "pos", "size", "chunk", "ids", "safe", "kept"])

    return run


def join_ids(chunks: list[str], ids: list[np.ndarray], safe: list[int], kept: list[int], encode) -> np.ndarray:
    """The ids of a text from those of its chunks, repaired at the joins.

    ``safe`` is the place in a chunk up to which its pre-tokens hold whatever follows, ``kept`` the
    number of its ids up to there.
    """
    if len(chunks) < 2:
        return ids[0] if chunks else np.zeros(0, np.int32)
    pattern, text = _pattern(), "".join(chunks)
    starts = [0]
    for chunk in chunks:
        starts.append(starts[-1] + len(chunk))
    out: list[np.ndarray] = []
    k, at, skip = 0, 0, 0  # from place ``at``, a border for both, chunk k's ids from number ``skip`` on hold
    last = len(chunks) - 1
    while k < last:
        if starts[k] + safe[k] > at:
            out.append(ids[k][skip : kept[k]])
            at = starts[k] + safe[k]
        nxt, own, border, skip = k + 1, None, -1, 0
        end = at
        # pre-tokens are encoded one by one: a run of white space reads otherwise where a text ends
        for m in pattern.finditer(text, at):
            end = m.end()
            out.append(encode(m.group()))
            while nxt < last and end >= starts[nxt + 1]:
                nxt, own, border, skip = nxt + 1, None, -1, 0
            if end < starts[nxt]:
                continue
            if own is None:
                own, border = pattern.finditer(text, starts[nxt], starts[nxt + 1]), starts[nxt]
            while border < end and (step := next(own, None)):
                border = step.end()
                skip += len(encode(step.group()))
            if border == end:
                break  # both are at a border here, and read the same from here on
        if end >= starts[-1]:
            return np.concatenate(out)
        k, at = nxt, end
    return np.concatenate([*out, ids[last][skip:]])


def _assemble(vocabulary: Broadcast):
    """(doc, ids) from the chunks of every text, which come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces = _ids_of(vocabulary), []
        for batch in in_parts(batches, "ids"):
            docs, result = [], []
            size, ids, more = batch.column(3).to_pylist(), batch.column(5), None
            for r, n in enumerate(size):
                own = np.frombuffer(ids[r].as_buffer(), np.int32)
                if n > 1:
                    more = more or [batch.column(j).to_pylist() for j in (4, 6, 7)]
                    pieces.append((more[0][r], own.copy(), more[1][r], more[2][r]))
                    if len(pieces) < n:
                        continue
                    own, pieces = join_ids(*map(list, zip(*pieces, strict=True)), encode), []
                docs.append(r)
                result.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), _list(result)], ["doc", "ids"])

    return run


def token_ids(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, ids): the ids of every text, without special tokens; their strings are ordinary text.

    An empty and a null text both give an empty list. Rows that repeat key and text give one row; a
    key given with several texts gives one row for each of them; a null key is a key like any other.
    Whatever other columns there are is of no effect.

    Chunks are brought together by their content; a partition that one frequent chunk makes large is
    split again, and the chunk is then encoded once in each part.
    """
    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    full = rows.where("length(text) > 0").withColumn("text_key", F.unhex(F.md5("text"))).dropDuplicates(["doc", "text_key"]).select("doc", "text_key", "text")
    kind, vocabulary = rows.schema["doc"].dataType.simpleString(), shipped(df.sparkSession, tokenizer)
    cut = full.mapInArrow(_cut, f"doc {kind}, text_key binary, pos int, size int, chunk string").withColumn("chunk_key", F.unhex(F.md5("chunk")))
    met = cut.hint("rebalance", F.col("chunk_key")).sortWithinPartitions("chunk_key")
    coded = met.mapInArrow(_encode_chunks(vocabulary), f"doc {kind}, text_key binary, pos int, size int, chunk string, ids binary, safe int, kept int")
    done = coded.repartition("doc", "text_key").sortWithinPartitions("doc", "text_key", "pos").mapInArrow(_assemble(vocabulary), f"doc {kind}, ids array<int>")
    none = rows.where("text is null or length(text) = 0").select("doc", F.array().cast("array<int>").alias("ids")).distinct()
    return done.unionByName(none).withColumnRenamed("doc", key)


def _count(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value).encode_ordinary
        for batch in in_parts(batches, "text"):
            sizes = [len(encode(x)) if x else 0 for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(df: DataFrame, columns: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``columns`` of every row and ``n_tokens``, the size of its text; 0 for an empty or null text."""
    rows = df.select(*columns, F.col(text).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    vocabulary = shipped(df.sparkSession, tokenizer)
    return rows.mapInArrow(_count(vocabulary), f"{kinds}, n_tokens bigint")
