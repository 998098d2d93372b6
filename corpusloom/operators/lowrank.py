"""Whole low-rank updates compared without building them: cosines by layer, whole, and by family of experiments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable
from .experiments import parse_experiment

#: Experiments whose matrices of one layer meet in a task, on either side.
BLOCK = 16
PAIRS = "layer string, exp_1 string, exp_2 string, dot double, square_1 double, square_2 double"


def _factors(frame: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Matrices A and B of every experiment that has both and whose shapes agree."""
    side: dict[str, dict[str, np.ndarray]] = {}
    for r in frame.itertuples():
        side.setdefault(r.exp, {})[r.side] = np.asarray(r.data, np.float64).reshape(r.rows, r.cols)
    return {e: (s["A"], s["B"]) for e, s in sorted(side.items()) if {"A", "B"} <= s.keys() and s["B"].shape[1] == s["A"].shape[0]}


def layer_products(weights: DataFrame, block: int = BLOCK) -> DataFrame:
    """Inner products of the updates B @ A of every two experiments by layer: ``layer, exp_1, exp_2, dot, square_1, square_2``.

    ``weights``: exp, layer, side ('A' or 'B'), rows, cols, data. The inner product of two
    updates is the sum of (B1' B2) * (A1 A2'), numbers of the size of the ranks, and all those
    of a task are two matrix products. Layers meet by their name; experiments of a layer
    meet in blocks, so that a task holds at most ``2 * block`` of them. An experiment without
    both matrices of a layer, or of another shape, has no row there. ``exp_1`` is before
    ``exp_2``. Rows with a null exp, layer or side are left out; of repeated ones the last counts.
    """
    ensure_importable(weights.sparkSession)
    rows = weights.filter(F.col("exp").isNotNull() & F.col("layer").isNotNull() & F.col("data").isNotNull() & F.col("side").isin("A", "B"))
    blocks = -(-rows.select("exp").distinct().count() // block)
    own = F.pmod(F.xxhash64("exp"), F.lit(max(blocks, 1)))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        i, j, layer = frame["i"].iloc[0], frame["j"].iloc[0], frame["layer"].iloc[0]
        found = _factors(frame)
        block_of = dict(zip(frame["exp"], frame["own"], strict=True))
        out = []
        for shape in {(a.shape[1], b.shape[0]) for a, b in found.values()}:
            names = [e for e, (a, b) in found.items() if (a.shape[1], b.shape[0]) == shape]
            starts = np.cumsum([0, *(found[e][0].shape[0] for e in names)])[:-1]
            a, b = np.concatenate([found[e][0] for e in names]), np.concatenate([found[e][1] for e in names], 1)
            # Sums over each pair's block of ranks.
            dot = np.add.reduceat(np.add.reduceat((a @ a.T) * (b.T @ b), starts, 0), starts, 1)
            for p, x in enumerate(names):
                for q in range(p + 1, len(names)):
                    if {block_of[x], block_of[names[q]]} == {i, j}:
                        out.append((layer, x, names[q], dot[p, q], dot[p, p], dot[q, q]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")])

    return dealt.groupBy("layer", "i", "j").applyInPandas(run, PAIRS)


def _cosine(dot, one, two):
    small = (one < 1e-20) | (two < 1e-20)
    return F.when(small, 0.0).otherwise(dot / F.sqrt(one) / F.sqrt(two))


def layer_cosines(products: DataFrame) -> DataFrame:
    """Cosine of every layer that two experiments share; 0 where an update vanishes. ``number, module`` are those of its name."""
    part = lambda k: F.nullif(F.regexp_extract("layer", r"layers\.(\d+)\.(.+)", k), F.lit(""))
    return products.select(
        "exp_1", "exp_2", "layer", part(1).cast("int").alias("number"), part(2).alias("module"),
        _cosine(F.col("dot"), F.col("square_1"), F.col("square_2")).alias("cosine"),
    )


def update_cosines(products: DataFrame) -> DataFrame:
    """Cosine of two experiments' whole updates over the layers they share, as if flattened: ``exp_1, exp_2, layers, cosine``."""
    sums = products.groupBy("exp_1", "exp_2").agg(F.count("*").alias("layers"), *(F.sum(c).alias(c) for c in ("dot", "square_1", "square_2")))
    return sums.select("exp_1", "exp_2", "layers", _cosine(F.col("dot"), F.col("square_1"), F.col("square_2")).alias("cosine"))


def _named(cosines: DataFrame, dialect: str) -> DataFrame:
    told = {f"p_{k}": parse_experiment(F.col(f"exp_{k}"), dialect) for k in (1, 2)}
    parts = {f"{c}_{k}": F.col(f"p_{k}.{c}") for k in (1, 2) for c in ("source", "n")}
    return cosines.withColumns(told).withColumns(parts).drop(*told)


def equal_size_pairs(cosines: DataFrame, across: bool = True, dialect: str = "directions") -> DataFrame:
    """Pairs of experiments of equal size, by default of different sources, with a ``label`` as published."""
    rows = _named(cosines, dialect).filter("n_1 = n_2")
    rows = rows.filter(~F.col("source_1").eqNullSafe(F.col("source_2"))) if across else rows
    told = F.concat(F.lit("N="), F.col("n_1").cast("string"), F.lit(": "), F.coalesce("source_1", F.lit("")), F.lit(" vs "), F.coalesce("source_2", F.lit("")))
    return rows.withColumn("label", told)


def family_pairs(cosines: DataFrame, family: list[str], dialect: str = "directions") -> DataFrame:
    """Every experiment of the sources named against every other one: ``exp, n, other, other_source, other_n, cosine``."""
    rows = _named(cosines, dialect)
    inside = {k: F.coalesce(F.col(f"source_{k}").isin(family), F.lit(False)) for k in (1, 2)}
    side = lambda a, b: rows.filter(inside[a] & ~inside[b]).select(
        F.col(f"exp_{a}").alias("exp"), F.col(f"n_{a}").alias("n"), F.col(f"exp_{b}").alias("other"),
        F.col(f"source_{b}").alias("other_source"), F.col(f"n_{b}").alias("other_n"), "cosine",
    )
    return side(1, 2).unionAll(side(2, 1))
