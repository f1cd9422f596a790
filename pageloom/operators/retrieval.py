"""Batch retrieval: dense and sparse search of many queries at once, fusion, filters, reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.session import materialize

QUERY_BLOCK, ITEM_BLOCK = 65_536, 262_144  # vectors that one task holds at most
VOCABULARY = 50_000  # terms that are sent to all tasks at most
TILE = 4096  # items that one product compares
SINGLE = np.float32(2e-5)  # cosines in single precision err by less than half of it


def unit(v: Column) -> Column:
    """A vector of length one; one of length zero stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def top_k(scored: DataFrame, k: int, by: list[str], order: list) -> DataFrame:
    """The first k of each group with their rank; Spark limits the groups before it shuffles them."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _mixed(n: np.ndarray) -> np.ndarray:
    """A hash of row numbers."""
    h = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(8)


def _pairs_of_blocks(queries: int, items: int, tasks: int, k: int) -> tuple[int, int]:
    """Blocks of queries and of items: as few as their sizes allow, at least ``tasks`` pairs where there is that much, and of these the ones that move least."""
    nq, ni = max(1, math.ceil(queries / QUERY_BLOCK)), max(1, math.ceil(items / ITEM_BLOCK))
    moved = lambda q, i: q * items + i * queries * (1 + k / 16)  # noqa: E731 - in vectors; what a query finds in a block moves too
    wanted = max(nq * ni, min(tasks, math.ceil(queries / TILE) * math.ceil(items / TILE)))
    return min(((q, max(ni, math.ceil(wanted / q))) for q in range(nq, max(nq, wanted) + 1)), key=lambda x: moved(*x))


def _sent(role: int, own: int, other: int, chunks: int, kind: str):
    """Packed rows (task, role, chunk, ns, vs): vectors of a block for each block of the other side; items have role 0 and no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, v = batch.column(0).to_numpy(), batch.column(1)
            if not len(n):
                continue
            if pc.count_distinct(pc.list_value_length(v)).as_py() != 1:
                raise ValueError("vectors of different lengths")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(n), -1)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.linalg.norm(x.astype(float), axis=1)
            good = np.isfinite(norm) & (norm > 0)
            n, x = n[good], x[good]
            part = _mixed(n) % np.uint64(own if role == 0 else own * chunks)
            for c in np.unique(part).tolist():
                at = np.flatnonzero(part == c)
                for i in range(0, len(at), 4096):
                    r = at[i : i + 4096]
                    packed = [pa.array([z.tobytes()], pa.binary()) for z in (n[r].astype("<i8"), x[r])]
                    for o in range(other):
                        task = o * own + c if role == 0 else c % own * other + o
                        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([role], pa.int32()), pa.array([0 if role == 0 else c], pa.int64()), *packed], ["task", "role", "chunk", "ns", "vs"])

    return run


def _first(row: np.ndarray, n: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks) of the k best of each row by the rounded score, ties by number."""
    order = np.lexsort((n, -score.round(9), row))
    r, at = row[order], np.arange(len(row))
    rank = at - np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1])[: len(r)], at, 0)) if len(r) else at
    return order[rank < k], rank[rank < k] + 1


class _Items:
    """The items of a block. Products in single precision leave few items out of all, which are scored in double precision."""

    def __init__(self, n: np.ndarray, x: np.ndarray) -> None:
        self.n, self.x = n, x
        self.norm = np.concatenate([np.linalg.norm(x[i : i + TILE].astype(float), axis=1) for i in range(0, len(x), TILE)])
        self.unit = np.concatenate([(x[i : i + TILE].astype(float) / self.norm[i : i + TILE, None]).astype(np.float32) for i in range(0, len(x), TILE)])

    def best(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, cosine): the k best items of every query."""
        q = q.astype(float)
        norm = np.linalg.norm(q, axis=1)
        unit = (q / norm[:, None]).astype(np.float32)
        bar = np.full(len(q), -2, np.float32)  # what the k-th best so far has, less what single precision may err
        row, at, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        begin = 0
        while begin < len(self.n):
            end = min(len(self.n), begin + (TILE if begin else 2 * k + 1024))
            s = unit @ self.unit[begin:end].T
            if not begin and end > k:
                bar = np.partition(s, end - k, axis=1)[:, end - k] - SINGLE
            r, c = np.divmod(np.flatnonzero(s >= bar[:, None]), end - begin)
            row, at, sim = np.concatenate((row, r)), np.concatenate((at, c + begin)), np.concatenate((sim, s[r, c]))
            order = np.lexsort((-sim, row))
            row, at, sim = row[order], at[order], sim[order]
            first = np.searchsorted(row, np.arange(len(q)))
            full = np.append(first[1:], len(row)) - first >= k
            bar[full] = sim[first[full] + k - 1] - SINGLE
            keep = sim >= bar[row]
            row, at, sim = row[keep], at[keep], sim[keep]
            begin = end
        score = np.empty(len(row))
        for i in range(0, len(row), 1 << 16):
            r, c = row[i : i + (1 << 16)], at[i : i + (1 << 16)]
            score[i : i + (1 << 16)] = np.einsum("ij,ij->i", q[r], self.x[c].astype(float)) / (norm[r] * self.norm[c])
        keep, _ = _first(row, self.n[at], score, k)
        return row[keep], self.n[at[keep]], score[keep]


def _score_blocks(k: int, kind: str):
    """What the queries of a task find among its items, which come first; a row for each chunk of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*(batch.column(j)[i].as_py() for j in range(3)), *(batch.column(j)[i].as_buffer() for j in (3, 4))) for batch in batches for i in range(batch.num_rows))
        for _, own in groupby(rows, key=lambda r: r[0]):
            block, held = None, []
            for (role, chunk), parts in groupby(own, key=lambda r: r[1:3]):
                held = [(np.frombuffer(r[3], "<i8").copy(), np.frombuffer(r[4], kind).copy()) for r in parts]
                n, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                x = x.reshape(len(n), -1)
                if role == 0:
                    block = _Items(n, x)
                    continue
                if block is None:
                    continue
                for i in range(0, len(n), 1024):
                    row, found, score = block.best(x[i : i + 1024], k)
                    packed = [pa.array([z.tobytes()], pa.binary()) for z in (n[i : i + 1024][row], found, score)]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *packed], ["chunk", "qs", "ns", "scores"])

    return run


def _merge_blocks(k: int):
    """The k best of what a chunk's queries found in all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch.column(0)[i].as_py(), *(batch.column(j)[i].as_buffer() for j in (1, 2, 3))) for batch in batches for i in range(batch.num_rows))
        for _, parts in groupby(rows, key=lambda r: r[0]):
            q, n, score = (np.concatenate([np.frombuffer(b, t) for b in z]) for z, t in zip(list(zip(*parts, strict=True))[1:], ("<i8", "<i8", "<f8"), strict=True))
            keep, rank = _first(q, n, score, k)
            yield pa.RecordBatch.from_arrays([pa.array(q[keep], pa.int64()), pa.array(n[keep], pa.int64()), pa.array(score[keep], pa.float64()), pa.array(rank, pa.int32())], ["q", "n", "score", "rank"])

    return run


def dense_search(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k items of highest cosine for every query (id, v).

    Queries and items are dealt into blocks by hash; each pair of blocks is one task, which gets both
    as packed arrays and gives the best k of its block. Ids stay behind: numbers in their order move
    instead. Nothing is broadcast. Null and zero vectors are no candidates.
    """
    spark = queries.sparkSession
    kind = "float" if all(df.schema["v"].dataType.elementType.simpleString() == "float" for df in (queries, items)) else "double"
    have = lambda df: df.where(F.col("v").isNotNull() & (F.size("v") > 0)).select("id", F.col("v").cast(f"array<{kind}>").alias("v"))
    right = materialize(have(items).orderBy("id").select(F.monotonically_increasing_id().alias("n"), "id", "v"), "items")
    left = have(queries).groupBy("id").agg(F.collect_list("v").alias("vs")).select(F.monotonically_increasing_id().alias("q"), "id", F.col("vs"))  # an id given twice has one list
    left = materialize(left.select("q", "id", F.explode("vs").alias("v")), "queries")
    asked, there = left.count(), right.count()
    most = k
    if exclude_self:
        most += right.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    nq, ni = _pairs_of_blocks(asked, there, spark.sparkContext.defaultParallelism, most)
    chunks = max(1, math.ceil(asked / nq / 1024))
    code = "<f4" if kind == "float" else "<f8"
    packed = "task int, role int, chunk long, ns binary, vs binary"
    sent = right.select("n", "v").mapInArrow(_sent(0, ni, nq, 1, code), packed).unionByName(left.select("q", "v").mapInArrow(_sent(1, nq, ni, chunks, code), packed))
    sent = sent.repartitionById(nq * ni, "task").sortWithinPartitions("task", "role", "chunk")
    found = sent.mapInArrow(_score_blocks(most, code), "chunk long, qs binary, ns binary, scores binary")
    found = found.repartition(max(1, min(nq * chunks, 4000)), "chunk").sortWithinPartitions("chunk").mapInArrow(_merge_blocks(most), "q long, n long, score double, rank int")
    found = materialize(found, "found")  # the moved vectors go from disk before the ids come
    out = found.join(right.select("n", "id"), "n").join(left.select("q", F.col("id").alias("qid")).distinct(), "q").select("qid", "id", "score", "rank")
    if not exclude_self:
        return out
    return top_k(out.where("qid <> id").drop("rank"), k, ["qid"], [F.desc(F.round("score", 9)), "id"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, term, positions) of texts (id, terms): one sort of a batch's terms in place of a group for each."""
    for batch in batches:
        texts = batch.column(1)
        length = pc.fill_null(pc.list_value_length(texts), 0).to_numpy()
        terms = texts.flatten().dictionary_encode()
        if not len(terms):
            continue
        row = np.repeat(np.arange(len(length)), length)
        pos = np.arange(1, len(row) + 1) - np.repeat(np.cumsum(length) - length, length)
        code = terms.indices.to_numpy()
        order = np.lexsort((code, row))  # stable, so positions ascend
        r, c = row[order], code[order]
        first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])))
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(r)), pa.int32()), pa.array(pos[order], pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r[first])), terms.dictionary.take(pa.array(c[first])), positions], ["id", "term", "positions"])


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, term, positions): where every term stands in every text, from 1. A key is given once, as in ``pages.latest``."""
    terms = df.select(F.col(key).alias("id"), T.tokens(F.col(text)).alias("terms"))
    return terms.mapInArrow(_places, f"id {terms.schema['id'].dataType.simpleString()}, term string, positions array<int>")


def _of_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of some terms. A vocabulary goes to the postings, which then don't move; more terms than that are joined."""
    terms = terms.distinct()
    return index.join(F.broadcast(terms) if terms.limit(VOCABULARY + 1).count() <= VOCABULARY else terms, "term", "left_semi")


def _nearness(d: Column) -> Column:
    """What two terms at a distance add to the rank; far ones add next to nothing."""
    return F.when(d > 100, F.lit(1e-30)).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2.0)))


def sparse_search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): texts with all terms of a query (qid, terms), by full-text rank.

    A query of one term ranks by its occurrences, 0.1 / j² for the j-th; one of several by the
    distances of all pairs of occurrences of different terms. Queries without terms find nothing.
    A query's texts are taken from its rarest term; the others are looked up by text and term.
    """
    q = queries.select("qid", F.array_distinct("terms").alias("terms")).where(F.size("terms") > 0)
    asked = q.select("qid", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    known = asked.join(index.groupBy("term").agg(F.count(F.lit(1)).alias("texts")), "term").groupBy("qid", "n").agg(F.count(F.lit(1)).alias("met"), F.min_by("term", F.struct("texts", "term")).alias("term")).where("met = n")
    known = materialize(known, "known")  # queries all of whose terms occur somewhere
    asked = asked.join(known.select("qid"), "qid", "left_semi")
    near = known.join(_of_terms(index.select("id", "term"), known.select("term")), "term").select("qid", "id")
    found = near.join(asked, "qid").join(_of_terms(index, asked.select("term")), ["id", "term"]).groupBy("qid", "id", "n").agg(F.collect_list(F.struct("term", "positions")).alias("hits")).where(F.size("hits") == F.col("n"))
    hits = F.array_sort("hits")
    alone = F.aggregate(F.sequence(F.lit(1), F.size(F.element_at("hits", 1)["positions"])), F.lit(0.0), lambda s, j: s + F.lit(0.1) / (j * j)) / F.lit(1.64493406685)
    pair = lambda a, b: F.aggregate(a["positions"], F.lit(1.0), lambda s, x: s * F.aggregate(b["positions"], F.lit(1.0), lambda t, y: t * (1.0 - F.sqrt(F.lit(0.01) * _nearness(F.abs(x - y).cast("double"))))))
    joint = 1.0 - F.aggregate(
        F.transform(hits, lambda h, i: F.aggregate(F.slice(hits, i + 2, F.greatest(F.size(hits) - i - 1, F.lit(0))), F.lit(1.0), lambda s, g: s * pair(h, g))), F.lit(1.0), lambda s, x: s * x
    )
    scored = found.select("qid", "id", F.when(F.col("n") == 1, alone).otherwise(joint).alias("score"))
    return top_k(scored, k, ["qid"], [F.desc(F.round("score", 9)), "id"])


def tf_idf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, term, weight): smooth inverse document frequencies, rows of length one."""
    terms = df.select(F.col(key).alias("id"), F.explode(T.tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    idf = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    raw = terms.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def fuse(rankings: list[DataFrame], k: int, top: int) -> DataFrame:
    """(qid, id, rank_0 ..., rrf_score, rank): reciprocal-rank fusion of rankings (qid, id, rank).

    An id given twice by one ranking counts with its best rank. Equal scores keep the order in which
    ids are first met: the first ranking's, then the second's.
    """
    every = None
    for i, r in enumerate(rankings):
        one = r.select("qid", "id", "rank", F.lit(i).alias("list"))
        every = one if every is None else every.unionByName(one)
    ranks = [f"rank_{i}" for i in range(len(rankings))]
    best = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(c) for i, c in enumerate(ranks)]
    met = every.repartition("qid").groupBy("qid", "id").agg(*best)  # dealt by query once, for the sums and for the cut
    score = sum((F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0)) for c in ranks[1:]), F.coalesce(1.0 / (k + F.col(ranks[0])), F.lit(0.0)))
    first = F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("list"), F.col(c).alias("rank"))) for i, c in enumerate(ranks)))
    fused = met.select("qid", "id", score.alias("rrf_score"), first.alias("first"), *ranks)
    return top_k(fused, top, ["qid"], [F.desc(F.round("rrf_score", 12)), "first", "id"]).drop("first")


def in_scope(hits: DataFrame, scope: DataFrame) -> DataFrame:
    """Hits (source, source_file) of files in ``scope`` (name); an empty scope keeps all. Applied after the cut."""
    none = scope.limit(1).count() == 0
    if none:
        return hits
    names = scope.select("name").distinct()
    by_file = hits.join(names.withColumnRenamed("name", "source_file"), "source_file", "left_semi")
    by_source = hits.join(names.withColumnRenamed("name", "source"), "source", "left_semi").select(by_file.columns)
    return by_file.unionByName(by_source).distinct()


def overlap_score(query: Column, content: Column) -> Column:
    """The default reranker: share of the query's distinct tokens that the content has."""
    q, c = F.array_distinct(T.tokens(query)), F.array_distinct(T.tokens(content))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, score: Column | None, top: int, threshold: float | None = None) -> DataFrame:
    """Candidates (qid, rank) by ``score``: at least the threshold, then the first; ties keep their order.

    Without a scorer the first candidates come back unchanged, as they do where one can't be loaded.
    """
    if score is None:
        return candidates.where(F.col("rank") <= top)
    scored = candidates.withColumn("rerank_score", score)
    if threshold is not None:
        scored = scored.where(F.col("rerank_score") >= threshold)
    return top_k(scored.withColumnRenamed("rank", "was"), top, ["qid"], [F.desc(F.round("rerank_score", 9)), "was"]).withColumnRenamed("rank", "rerank_rank").withColumnRenamed("was", "rank")


def search(mode: str, dense: DataFrame | None, sparse: DataFrame | None, limit: int, rrf_k: int = 60) -> DataFrame:
    """(qid, id, rank) by mode: the dense list, the sparse one, or both fused; any other mode is an error."""
    if mode == "rrf":
        return fuse([dense, sparse], rrf_k, limit).select("qid", "id", "rank")
    if mode in ("dense", "sparse"):
        return (dense if mode == "dense" else sparse).where(F.col("rank") <= limit).select("qid", "id", "rank")
    raise ValueError(f"unknown retrieval mode: {mode}")


def hybrid(queries: DataFrame, items: DataFrame, index: DataFrame, dense_k: int = 70, sparse_k: int = 30, top: int = 40, rrf_k: int = 60) -> DataFrame:
    """(qid, id, rank_0, rank_1, rrf_score, rank): dense and sparse search of the same items, fused.

    ``queries`` are (qid, v, text), ``items`` (id, v), ``index`` the postings of the items' texts. A
    query without vector is searched by its words only, one without words by its vector only.
    """
    dense = dense_search(queries.select(F.col("qid").alias("id"), "v"), items, dense_k)
    sparse = sparse_search(queries.where("text is not null").select("qid", T.tokens(F.col("text")).alias("terms")), index, sparse_k)
    return fuse([dense, sparse], rrf_k, top)


def at_least_or_unknown(hits: DataFrame, score: str, threshold: float | None) -> DataFrame:
    """Hits whose score is unknown or at least the threshold; without one all of them."""
    return hits if threshold is None else hits.where(F.col(score).isNull() | (F.col(score) >= threshold))


def with_prefix(text: Column, instruction: str) -> Column:
    """A query with the instruction its embedder wants; null becomes the empty text. Documents take none."""
    return F.concat(F.lit(instruction), F.coalesce(text, F.lit("")))


def embed(df: DataFrame, text: str, out: str, embedder, instruction: str = "") -> DataFrame:
    """``df`` with the vectors a model gives for a text column.

    ``embedder`` is a function from a list of texts to a list of vectors; it is called with a whole
    Arrow batch. ``instruction`` stands before every text (for queries).
    """

    def run(batches):
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in embedder(texts.tolist())])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(with_prefix(F.col(text), instruction)))
