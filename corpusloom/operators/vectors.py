"""Update vectors: pairwise cosines, summaries of pairs, norms of low-rank products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .ordered import with_previous


def with_norm(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("norm", stats.norm(F.col(vector)))


def pair_cosines(df: DataFrame, order: str, vector: str, keep: list[str], on: list[str] | None = None) -> DataFrame:
    """Cosine of every unordered pair, within equal ``on`` columns if given.

    Norms are taken once a row, not once a pair. This is the experiments' own
    all-pairs comparison: ``df`` has a row for each experiment, not for each document.
    """
    rows = with_norm(df, vector).select(order, vector, "norm", *keep)
    a, b = rows.alias("a"), rows.alias("b")
    condition = F.col(f"a.{order}") < F.col(f"b.{order}")
    for c in on or []:
        condition = condition & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    cos = stats.cosine(F.col(f"a.{vector}"), F.col(f"b.{vector}"), F.col("a.norm"), F.col("b.norm"))
    sides = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in [order, *keep] for s in "ab"]
    return a.join(b, condition).select(*sides, cos.alias("cosine"))


def block_cosines(blocks: DataFrame, order: str, block: str, vector: str) -> DataFrame:
    """Cosines of vectors too long for a row: partial products by block, then summed in double."""
    rows = blocks.select(order, block, vector)
    own = rows.groupBy(order).agg(F.sqrt(F.sum(stats.dot(F.col(vector), F.col(vector)))).alias("norm"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col(f"a.{block}") == F.col(f"b.{block}")) & (F.col(f"a.{order}") < F.col(f"b.{order}")))
    dots = pairs.groupBy(F.col(f"a.{order}").alias("first"), F.col(f"b.{order}").alias("second")).agg(
        F.sum(stats.dot(F.col(f"a.{vector}"), F.col(f"b.{vector}"))).alias("dot")
    )
    na, nb = (own.select(F.col(order).alias(k), F.col("norm").alias(f"norm_{k}")) for k in ("first", "second"))
    both = dots.join(na, "first").join(nb, "second")
    small = (F.col("norm_first") < 1e-10) | (F.col("norm_second") < 1e-10)
    return both.select("first", "second", F.when(small, 0.0).otherwise(F.col("dot") / (F.col("norm_first") * F.col("norm_second"))).alias("cosine"))


def pair_summary(pairs: DataFrame, group: str) -> DataFrame:
    """Mean, population deviation, extremes and count of cosines by unordered pair of groups."""
    key = F.sort_array(F.array(f"{group}_a", f"{group}_b"))
    c = F.col("cosine")
    return pairs.groupBy(key[0].alias(f"{group}_1"), key[1].alias(f"{group}_2")).agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count("*").alias("n")
    )


def consecutive_cosines(df: DataFrame, by: list[str], order: str, vector: str) -> DataFrame:
    """Cosine of each vector and the next of its group, in one scan ordered by group."""
    rows = with_previous(with_norm(df, vector), [*by, order], [*by, order, vector, "norm"])
    for c in by:
        rows = rows.filter(F.col(f"previous.{c}").eqNullSafe(F.col(c)))
    rows = rows.filter(F.col("previous").isNotNull())
    cos = stats.cosine(F.col(f"previous.{vector}"), F.col(vector), F.col("previous.norm"), F.col("norm"))
    return rows.select(*by, F.col(f"previous.{order}").alias("previous"), order, cos.alias("cosine"))


def effective_perturbation(df: DataFrame, reference: DataFrame, vector: str) -> DataFrame:
    """Norm times the cosine to one reference vector."""
    one = F.broadcast(reference.select(F.col(vector).alias("_r"), stats.norm(F.col(vector)).alias("_rn")).limit(1))
    rows = with_norm(df, vector).join(one)
    rows = rows.withColumn("cosine", stats.cosine(F.col(vector), F.col("_r"), F.col("norm"), F.col("_rn")))
    return rows.withColumn("effective", F.col("norm") * F.col("cosine")).drop("_r", "_rn")


def root_sum_squares(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.sum(value * value)).alias("rss"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"))


NORMS = "exp string, layer string, norm_a double, norm_b double, norm_ba double, sigma_max double, nuclear double, effective_rank double, stable_rank double, top_values array<double>"


def low_rank_norms(weights: DataFrame) -> DataFrame:
    """Norms of B @ A per experiment and layer; layers without both matrices are left out.

    ``weights``: exp, layer, side ('A' or 'B'), rows, cols, data. The singular values are
    those of the small product of the triangular factors, so nothing of the
    size of B @ A is built. A layer is one task's work: its matrices, bounded by the model.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        side = {r.side: np.array(r.data, float).reshape(r.rows, r.cols) for r in frame.itertuples()}
        if {"A", "B"} - side.keys():
            return pd.DataFrame(columns=[c.split()[0] for c in NORMS.split(", ")])
        a, b = side["A"], side["B"]
        ra, rb = np.linalg.qr(a.T, mode="r"), np.linalg.qr(b, mode="r")
        s = np.linalg.svd(rb @ ra.T, compute_uv=False)
        square = float((s * s).sum())
        return pd.DataFrame([{
            "exp": frame["exp"].iloc[0], "layer": frame["layer"].iloc[0], "norm_a": float(np.linalg.norm(a)), "norm_b": float(np.linalg.norm(b)),
            "norm_ba": square**0.5, "sigma_max": float(s[0]), "nuclear": float(s.sum()), "effective_rank": float(s.sum() ** 2 / (square + 1e-10)),
            "stable_rank": square / (float(s[0]) ** 2 + 1e-10), "top_values": s[:16].tolist(),
        }])

    return weights.groupBy("exp", "layer").applyInPandas(run, NORMS)


def masked_kl(df: DataFrame, policy: str, reference: str, attention: str, labels: str) -> DataFrame:
    """Mean over trained tokens of the divergence of two log-probability arrays; at least one token counts."""
    mask = F.zip_with(attention, labels, lambda a, l: F.when((a == 1) & (l != -100), 1.0).otherwise(0.0))
    term = F.zip_with(policy, reference, lambda p, q: F.exp(p) * (p - q))
    total = F.aggregate(F.zip_with(term, mask, lambda t, m: t * m), F.lit(0.0), lambda s, x: s + x)
    count = F.aggregate(mask, F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("kl", total / F.greatest(count, F.lit(1.0)))
