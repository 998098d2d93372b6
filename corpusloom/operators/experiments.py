"""Experiment names, the log of experiments, and the frames that figures need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import non_empty

#: Corpora that names tell, in the order they are tried.
COMPILE_SOURCES = ["numinamath_comp", "numinamath_hard", "numinamath", "openr1", "orz_self"]
NORM_SOURCES = ["numinamath_comp", "numinamath_hard", "numinamath", "openr1", "orz_reject", "orz_self"]
DIALECTS = ("compile", "bootstrap", "norms", "directions")


def parse_experiment(name: Column, dialect: str = "directions") -> Column:
    """Struct ``source, n, rank, lr, epochs, seed, kl`` of a name, by one of four dialects.

    ``compile`` looks for known sources anywhere and wants epochs at the end, so names with a suffix
    have none; ``bootstrap`` takes all between ``sft_`` and the size; ``norms``
    knows six delimited sources, seeds and penalties; ``directions`` takes the
    shortest run before ``_n`` and 0 for a missing size.
    """
    get = lambda p: non_empty(F.regexp_extract(name, p, 1))
    if dialect == "compile":
        source = F.lit(None).cast("string")
        for s in reversed(COMPILE_SOURCES):
            source = F.when(F.contains(name, F.lit(f"sft_{s}")), s).otherwise(source)
        n, rank, lr, epochs = get(r"_n(\d+)_"), get(r"_r(\d+)_"), get(r"_lr([\de\-.]+)_"), get(r"_ep(\d+)$")
    elif dialect == "bootstrap":
        source, n = get(r"^sft_(.+?)_n\d+(?:_|$)"), get(r"^sft_.+?_n(\d+)(?:_|$)")
        rank, lr, epochs = get(r"_r(\d+)(?:_|$)"), get(r"_lr([^_]+)(?:_|$)"), get(r"_ep(\d+)(?:_|$)")
    elif dialect == "norms":
        source = F.lit(None).cast("string")
        for s in reversed(NORM_SOURCES):
            source = F.when(F.contains(name, F.lit(f"_{s}_")), s).otherwise(source)
        n, rank, lr, epochs = get(r"_n(\d+)"), get(r"_r(\d+)"), get(r"_lr([\d.e-]+)"), get(r"_ep(\d+)")
    elif dialect == "directions":
        source, n = get(r"sft_(\w+?)_n"), F.coalesce(get(r"_n(\d+)_"), F.lit("0"))
        rank, lr, epochs = get(r"_r(\d+)_"), get(r"_lr([^_]+)_"), get(r"_ep(\d+)")
    else:
        raise ValueError(f"no dialect {dialect}")
    return F.struct(
        source.alias("source"), n.cast("long").alias("n"), rank.cast("long").alias("rank"), lr.alias("lr"), epochs.cast("long").alias("epochs"),
        get(r"_seed(\d+)").cast("long").alias("seed"), F.replace(get(r"_kl(\d+p?\d*)"), F.lit("p"), F.lit(".")).cast("double").alias("kl"),
    )


def standard_config(name: Column, strict: bool = True) -> Column:
    """Rank 8, rate 5e-5, one epoch, neither seed nor penalty; ``strict`` also rules out 0p1 and 0p5."""
    parts = F.split(name, "_")
    has = lambda t: F.array_contains(parts, t)
    ok = has("r8") & has("lr5e-5") & has("ep1") & ~F.exists(parts, lambda t: t.startswith("seed") | t.startswith("kl"))
    return ok & ~F.contains(name, F.lit("0p1")) & ~F.contains(name, F.lit("0p5")) if strict else ok


def experiment_log(docs: DataFrame) -> DataFrame:
    """Flat log of evaluation documents, named by field or file, sorted; absent blocks give nulls."""
    names = set(docs.columns)
    get = lambda path, kind: F.col(path).cast(kind) if path.split(".")[0] in names else F.lit(None).cast(kind)
    name = F.coalesce(get("experiment_name", "string"), F.regexp_replace(get("file", "string"), "_eval.json$", ""))
    p = parse_experiment(F.col("name"), "compile")
    log = docs.select(
        name.alias("name"), get("orz.accuracy", "double").alias("orz_accuracy"), get("orz.correct", "long").alias("orz_correct"),
        get("orz.total", "long").alias("orz_total"), get("valid", "boolean").alias("valid"),
    ).withColumn("p", p)
    log = log.select("name", F.col("p.source").alias("data_source"), F.col("p.n").alias("num_samples"), F.col("p.lr").alias("lr"), F.col("p.rank").alias("rank"),
                     F.col("p.epochs").alias("epochs"), "orz_accuracy", "orz_correct", "orz_total", "valid")
    return log.orderBy(F.coalesce("data_source", F.lit("")), F.coalesce("num_samples", F.lit(0)), F.coalesce("lr", F.lit("")), F.coalesce("epochs", F.lit(0)), "name")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def with_log(df: DataFrame, log: DataFrame, key: str = "name", required: bool = False) -> DataFrame:
    """Looks experiments up in the log; ``required`` drops those not in it."""
    return df.join(log, key, "inner" if required else "left")


def first_present(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first frame that has a key."""
    every = None
    for k, f in enumerate(frames):
        f = f.withColumn("_priority", F.lit(k))
        every = f if every is None else every.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_priority")
    return every.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_priority")


def filled_up(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a, and those rows of b whose key it lacks."""
    return a.unionByName(b.join(a.select(key), key, "left_anti"), allowMissingColumns=True)


def seed_spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population deviation over replicates."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def endpoint_delta(df: DataFrame, by: list[str], size: str, value: str) -> DataFrame:
    """First and last value by size, and what they differ by."""
    out = df.groupBy(*by).agg(F.min_by(value, size).alias("first"), F.max_by(value, size).alias("last"))
    return out.withColumn("delta", F.col("last") - F.col("first"))


def efficiency(accuracy: Column, base: float, norm: Column) -> Column:
    """Accuracy lost for each unit of norm, the norm at least 0.01."""
    return (F.lit(base) - accuracy) / F.greatest(norm, F.lit(0.01))


def loss_split(strict: Column, tolerant: Column, base_tolerant: float) -> Column:
    """Struct of what format and what reasoning cost, and the format's share."""
    form, reason = tolerant - strict, F.lit(base_tolerant) - tolerant
    return F.struct(form.alias("format_loss"), reason.alias("reasoning_loss"), F.try_divide(form, form + reason).alias("format_share"))


def cosine_matrix(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """Square view of (first, second, cosine) over given labels, ones on the diagonal, values cut at 1."""
    spark = pairs.sparkSession
    own = spark.createDataFrame([(x, x, 1.0) for x in labels], "first string, second string, cosine double")
    both = pairs.select("first", "second", "cosine").unionAll(pairs.select("second", "first", "cosine")).unionAll(own)
    return both.groupBy("first").pivot("second", labels).agg(F.first(F.least("cosine", F.lit(1.0))))


def bar_frame(groups: list[tuple[str, DataFrame]], label: str, value: str, most: int = 15) -> DataFrame:
    """Bars of all categories one after another, the first ``most``."""
    out = None
    for k, (name, df) in enumerate(groups):
        part = df.select(F.lit(k).alias("place"), F.lit(name).alias("category"), F.col(label).alias("label"), F.col(value).alias("value"))
        out = part if out is None else out.unionAll(part)
    return out.orderBy("place", "label").limit(most)
