"""Sources mixed to target shares of the total size by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 14  # places of the unit interval a document's hash falls on


def poisson_count(u: np.ndarray, rate: float, cap: int) -> np.ndarray:
    """The inverse of the Poisson distribution at ``u``, cut off at ``cap``."""
    out = np.zeros(len(u), np.int64)
    if rate == math.inf:
        return out + cap
    below, term = 0.0, math.exp(-rate)
    for k in range(cap):
        below += term
        out[u >= below] = k + 1
        term *= rate / (k + 1)
    return out


def _rate_for(u: np.ndarray, sizes: np.ndarray, cap: int, target: float) -> float:
    """The smallest rate whose counts, at the places documents really have, reach the target size."""
    if target >= cap * sizes.sum() * (1 - 1e-12):
        return math.inf
    lo, hi = 0.0, 1.0
    size = lambda rate: float((poisson_count(u, rate, cap) * sizes).sum())
    while size(hi) < target and hi < 700:
        lo, hi = hi, hi * 2
    hi = min(hi, 700.0)
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if size(mid) < target else (lo, mid)
    return lo if abs(size(lo) - target) < abs(size(hi) - target) else hi


def plan(weights: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """The rate of every (mix, source): the total is the largest at which every source can reach its share.

    ``weights`` (source, bucket, size) has at most BUCKETS rows for each source that is named in
    ``targets``, however many documents there are. Shares are relative weights; sources without
    documents can give nothing and the others share the total by their weights.
    """
    rows = []
    by = {s: x for s, x in weights.groupby("source")}
    t = targets.dropna(subset=["source"])
    t = t.groupby(["mix_name", "source"], dropna=False, as_index=False).agg(target_share=("target_share", "sum"), max_repeats=("max_repeats", "max"))
    for mix, x in t.groupby("mix_name", dropna=False):
        x = x[(x.target_share > 0) & x.max_repeats.fillna(0).gt(0)]
        have = x[[s in by and by[s]["size"].sum() > 0 for s in x.source]]
        share = have.target_share / have.target_share.sum() if len(have) else have.target_share
        total = min((by[s]["size"].sum() * c / w for s, c, w in zip(have.source, have.max_repeats, share, strict=True)), default=0.0)
        for s, c, w in zip(have.source, have.max_repeats, share, strict=True):
            u = (by[s]["bucket"].to_numpy() + 0.5) / BUCKETS
            rate = _rate_for(u, by[s]["size"].to_numpy(float), int(c), total * w)
            rows.append((mix, s, float(w), int(c), float(total * w), rate))
    return pd.DataFrame(rows, columns=["mix_name", "source", "share", "cap", "target_size", "rate"])


def _bucket(key: str, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def steps(rate: float, cap: int) -> list[float]:
    """The cumulated probabilities of 0, 1, ... below ``cap``: a document's count is how many of them lie at or below u."""
    if rate == math.inf:
        return [0.0] * cap
    out, term = [], math.exp(-rate)
    for k in range(cap):
        out.append((out[-1] if out else 0.0) + term)
        term *= rate / (k + 1)
    return out


def mix(docs: DataFrame, targets: DataFrame, key: str, source: str, size: str, seed: int = 20) -> DataFrame:
    """(mix_name, key, source, copy, size, place): one row for each use of a document, in mixed order.

    The number of uses is the inverse of a Poisson distribution at a hash of the document's key and
    the seed, cut off at max_repeats; a source's rate is calibrated on its own sizes so that the
    counts give its share. ``place`` orders a mix at random; rows come sorted by it, so every file
    of the output is itself a mix. Documents with null source, a source without target, or null or
    zero size are never used; a null key is a key like any other. Rows that repeat a key are
    separate documents with the same hash. Empty tables give no rows.
    """
    use = docs.select(F.col(key).alias("__key"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size")).where("source is not null and size > 0")
    use = use.withColumn("bucket", _bucket("__key", seed))
    wanted = targets.select("mix_name", "source", "target_share", "max_repeats")
    names = F.broadcast(wanted.select("source").distinct())  # the targets are a fixed list of a few rows
    weights = use.join(names, "source", "left_semi").groupBy("source", "bucket").agg(F.sum("size").alias("size")).toPandas()
    weights["size"] = weights["size"].astype(float)
    rates = plan(weights, wanted.toPandas())
    spark = docs.sparkSession
    # a row for each mix and source with the places of u where the count goes up, as many as max_repeats
    found = [(r.mix_name, r.source, steps(r.rate, r.cap)) for r in rates.itertuples()]
    rates_df = spark.createDataFrame(found, "mix_name string, source string, steps array<double>")
    u = (F.col("bucket") + F.lit(0.5)) / F.lit(float(BUCKETS))
    counted = use.join(F.broadcast(rates_df), "source").withColumn("uses", F.size(F.filter("steps", lambda x: x <= u)))
    copies = counted.where("uses > 0").select("mix_name", "__key", "source", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"), "size")
    placed = copies.withColumn("place", F.xxhash64(F.lit(seed + 1), "mix_name", F.col("__key").cast("string"), "copy"))
    return placed.orderBy("mix_name", "place", "__key", "copy").withColumnRenamed("__key", key)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The actual share of every source beside its target, over what a mix came out as.

    ``target_share`` is the weight over the sum of a mix's weights; ``reachable_share`` is that over
    the weights of the sources that have documents, null for one that has none.
    """
    got = mixed.groupBy("mix_name", "source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("uses"))
    want = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    both = want.join(F.broadcast(got), ["mix_name", "source"], "left")
    w = Window.partitionBy("mix_name")
    has = F.col("size").isNotNull()
    return both.select(
        "mix_name",
        "source",
        (F.col("weight") / F.sum("weight").over(w)).alias("target_share"),
        F.when(has, F.col("weight") / F.sum(F.when(has, F.col("weight"))).over(w)).alias("reachable_share"),
        F.coalesce(F.col("size") / F.sum("size").over(w), F.lit(0.0)).alias("actual_share"),
        F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
        "max_repeats",
    )
