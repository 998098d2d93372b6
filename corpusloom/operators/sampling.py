"""Samples, mixes, shards and resumption. Order-dependent steps need an ``ord`` column."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seeded_permutation(n: int, seed: int) -> list[int]:
    """Old index at each new place of Python's seeded shuffle; it depends on n only, never on data."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def shuffled_take(df: DataFrame, n: int, seed: int = 42, order: str = "ord", total: int | None = None) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle, with their place ``pos``.

    ``order`` numbers rows from 0 without gaps. Exact, for sets whose permutation fits the
    driver; ``hashed_take`` has no such bound.
    """
    total = df.count() if total is None else total
    take = [(k, i) for k, i in enumerate(seeded_permutation(total, seed)[:n])]
    chosen = df.sparkSession.createDataFrame(take, f"pos long, {order} long")
    return df.join(F.broadcast(chosen), order).orderBy("pos")


def seeded_sample(df: DataFrame, n: int, seed: int = 42, order: str = "ord", total: int | None = None) -> DataFrame:
    """Rows of Python's seeded sample without replacement."""
    total = df.count() if total is None else total
    chosen = random.Random(seed).sample(range(total), min(n, total))
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(i,) for i in chosen], f"{order} long")), order, "left_semi")


def hashed_take(df: DataFrame, n: int, seed: int = 42, order: str = "ord") -> DataFrame:
    """A sample by hash order: no driver work, one top-k, the same rows every time."""
    return df.orderBy(F.xxhash64(F.lit(seed), order), order).limit(n)


def hard_pool(df: DataFrame, text: str, n: int, quirks: bool = False, order: str = "ord") -> DataFrame:
    """Longest texts first, as many as three times ``n``; with ``quirks`` all rows, only sorted."""
    ranked = df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.length(text)), order)) - 1) if quirks else None
    if ranked is not None:
        return ranked
    return df.orderBy(F.desc(F.length(text)), order).limit(3 * n)


def mixed(a: DataFrame, b: DataFrame, n: int, share: float, seed: int = 42, order: str = "ord") -> DataFrame:
    """``int(n * share)`` rows of a and the rest of b, each by hash order."""
    k = int(n * share)
    return hashed_take(a, k, seed, order).unionByName(hashed_take(b, n - k, seed, order))


def shard(df: DataFrame, shards: int, order: str = "ord", total: int | None = None) -> DataFrame:
    """Adds the number of the contiguous shard of ceil(n / k) rows; the last may be short or empty."""
    total = df.count() if total is None else total
    size = max(1, -(-total // shards))
    return df.withColumn("shard", F.floor(F.col(order) / size).cast("long"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Shards in id order."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("shard", F.lit(k).cast("long"))
        out = p if out is None else out.unionByName(p)
    return out.orderBy("shard")


def prefix(df: DataFrame, n: int | None, order: str = "ord") -> DataFrame:
    return df if n is None else df.filter(F.col(order) < n)


def span(df: DataFrame, offset: int, length: int, order: str = "ord") -> DataFrame:
    """``length`` rows from ``offset``; -1 takes the rest."""
    rest = F.col(order) >= offset
    return df.filter(rest if length < 0 else rest & (F.col(order) < offset + length))


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet done."""
    return df.join(done.select(key), key, "left_anti")
