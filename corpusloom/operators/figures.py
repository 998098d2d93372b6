"""The data behind figures: norms with accuracies and their lines, layer profiles, cosines by size and by pair of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .experiments import efficiency, parse_experiment
from .lowrank import _named
from .regression import fit_linear


def predicted(df: DataFrame, model: DataFrame, x: str, by: list[str], name: str = "predicted") -> DataFrame:
    """``df`` with the value of its group's line (``a``, ``b``) at x; null without a line."""
    line = model.select(*by, F.col("a").alias("_a"), F.col("b").alias("_b"))
    return df.join(F.broadcast(line), by, "left").withColumn(name, F.col("_a") * F.col(x) + F.col("_b")).drop("_a", "_b")


def norm_accuracy(experiments: DataFrame, base: float) -> DataFrame:
    """Experiments (``source, norm, accuracy``) with their source's line, what they lose for a unit of norm, and how well lines fit.

    ``r2_within`` is that of the source's own line and ``r2_pooled`` that of one line for all. Models have a
    row for each source.
    """
    model = fit_linear(experiments, "norm", "accuracy", ["source"])
    whole = fit_linear(experiments.withColumn("_all", F.lit(1)), "norm", "accuracy", ["_all"]).first()
    out = predicted(experiments, model, "norm", ["source"])
    out = out.join(F.broadcast(model.select("source", F.col("r2").alias("r2_within"))), "source")
    return out.withColumns({"r2_pooled": F.lit(whole["r2"] if whole else None).cast("double"), "efficiency": efficiency(F.col("accuracy"), base, F.col("norm"))})


def layer_profile(norms: DataFrame, dialect: str = "directions") -> DataFrame:
    """Mean, population deviation and count of layers' update norms by source, layer number and module, from ``exp, layer, norm_ba``."""
    part = lambda k: F.nullif(F.regexp_extract("layer", r"layers\.(\d+)\.(.+)", k), F.lit(""))
    rows = norms.select(parse_experiment(F.col("exp"), dialect)["source"].alias("source"), part(1).cast("int").alias("number"), part(2).alias("module"), "norm_ba")
    return rows.groupBy("source", "number", "module").agg(F.avg("norm_ba").alias("mean"), F.stddev_pop("norm_ba").alias("std"), F.count("*").alias("n"))


def cosines_by_size(cosines: DataFrame, dialect: str = "directions") -> DataFrame:
    """Mean cosine of experiments of equal size, by size and unordered pair of sources: ``n, source_a, source_b, mean, pairs``."""
    rows = _named(cosines, dialect).filter("n_1 = n_2")
    return rows.groupBy(F.col("n_1").alias("n"), F.least("source_1", "source_2").alias("source_a"), F.greatest("source_1", "source_2").alias("source_b")).agg(
        F.avg("cosine").alias("mean"), F.count("*").alias("pairs")
    )


def pair_classes(cosines: DataFrame, dialect: str = "directions") -> DataFrame:
    """Cosines by unordered pair of sources, with whether the pair is of one source: ``source_a, source_b, kind, mean, std, min, max, n``."""
    rows = _named(cosines, dialect).select(F.least("source_1", "source_2").alias("source_a"), F.greatest("source_1", "source_2").alias("source_b"), "cosine")
    kind = F.when(F.col("source_a") == F.col("source_b"), "within").otherwise("cross")
    c = F.col("cosine")
    return rows.groupBy("source_a", "source_b", kind.alias("kind")).agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count("*").alias("n")
    )
