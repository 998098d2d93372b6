"""Evaluation metrics over graded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def _if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def accuracy(df: DataFrame, correct: Column, by: list[str]) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("total"), _if(correct).alias("correct"))
    return out.withColumn("accuracy", stats.ratio(F.col("correct"), F.col("total")))


def token_stats(df: DataFrame, tokens: Column, by: list[str], most: int = 1024) -> DataFrame:
    """Mean and largest number of tokens, rows at the limit, rows that have the number."""
    return df.groupBy(*by).agg(
        F.avg(tokens).alias("avg_tokens"), F.max(tokens).alias("max_tokens"), _if(tokens >= most).alias("hit_limit"), F.count(tokens).alias("with_stats")
    )


def tool_metrics(df: DataFrame, matched: Column, passed: Column, by: list[str]) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("total"), _if(matched).alias("func_correct"), _if(passed).alias("pass_count"))
    return out.withColumns({"func_accuracy": stats.ratio(F.col("func_correct"), F.col("total")), "pass_rate": stats.ratio(F.col("pass_count"), F.col("total"))})


def fallback_metrics(df: DataFrame, boxed: Column, correct: Column, by: list[str]) -> DataFrame:
    """Strict accuracy counts boxed answers only, the tolerant one those found otherwise too."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("total"), _if(boxed).alias("boxed_found"), _if(~boxed).alias("fallback_used"),
        _if(boxed & correct).alias("strict_correct"), _if(correct).alias("tolerant_correct"),
    )
    return out.withColumns({"strict": stats.ratio(F.col("strict_correct"), F.col("total")), "tolerant": stats.ratio(F.col("tolerant_correct"), F.col("total"))})


def budget_metrics(df: DataFrame, budget: Column, tokens: Column, chars: Column, boxed: Column, by: list[str]) -> DataFrame:
    """Per token budget: means, rows that hit it (at most one short of it), share boxed."""
    return df.groupBy(*by).agg(
        F.avg(tokens).alias("avg_tokens"), F.avg(chars).alias("avg_chars"), _if(tokens >= budget - 1).alias("hit_limit"), F.avg(boxed.cast("int")).alias("boxed_rate")
    )


def output_analysis(df: DataFrame, boxed: Column, strict: Column, tolerant: Column, present: Column, length: Column, by: list[str]) -> DataFrame:
    return df.withColumn("_length", length).groupBy(*by).agg(
        F.count("*").alias("total"), _if(boxed).alias("has_boxed"), _if(strict).alias("correct_boxed"), _if(tolerant).alias("correct_tolerant"),
        _if(present).alias("gold_in_text"), F.avg("_length").alias("mean_length"), stats.upper_median("_length").cast("long").alias("upper_median"),
    )


def error_categories(df: DataFrame, boxed: Column, strict: Column, present: Column, by: list[str]) -> DataFrame:
    """Overlapping counts over rows whose boxed answer is wrong or missing."""
    wrong = df.filter(~F.coalesce(strict, F.lit(False)))
    return wrong.groupBy(*by).agg(
        _if(boxed).alias("boxed_wrong"), _if(present & ~boxed).alias("format_errors"), _if(~present).alias("reasoning_errors"),
        _if(~boxed & ~present).alias("no_boxed_no_answer"),
    )


def validity_gate(df: DataFrame, metrics: dict[str, float], slack: float = 0.03) -> DataFrame:
    """Adds ``issues`` (metrics that fell more than ``slack`` below their baseline) and ``valid``."""
    told = [F.when(F.col(m) < base - slack, F.lit(m)) for m, base in metrics.items()]
    out = df.withColumn("issues", F.array_compact(F.array(*told)))
    return out.withColumn("valid", F.size("issues") == 0)


def best_per(df: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """The row of greatest score in each group, the first of equals."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def significance(df: DataFrame, base_correct: int, base_total: int, z: float = 1.959963984540054) -> DataFrame:
    """Adds ``z`` against a baseline and the direction BETTER, WORSE or ~same."""
    out = df.withColumn("z", stats.two_proportion_z(F.col("correct"), F.col("total"), F.lit(base_correct), F.lit(base_total)))
    return out.withColumn("direction", F.when(F.col("z") > z, "BETTER").when(F.col("z") < -z, "WORSE").otherwise("~same"))


def pairwise_z(df: DataFrame, equal: str, order: str) -> DataFrame:
    """Every unordered pair with the same ``equal``: z statistic and p value of their proportions."""
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col(f"a.{equal}") == F.col(f"b.{equal}")) & (F.col(f"a.{order}") < F.col(f"b.{order}")))
    z = stats.two_proportion_z(F.col("a.correct"), F.col("a.total"), F.col("b.correct"), F.col("b.total"))
    return pairs.select(F.col(f"a.{equal}").alias(equal), F.col(f"a.{order}").alias("first"), F.col(f"b.{order}").alias("second"), z.alias("z"))


def rejection_stats(df: DataFrame, problem: str, attempt: str, correct: Column, attempts: int) -> DataFrame:
    """Per problem: the first correct attempt, and the generations a run that counts all attempts reports."""
    return df.groupBy(problem).agg(
        F.bool_or(F.coalesce(correct, F.lit(False))).alias("solved"), F.min(F.when(correct, F.col(attempt))).alias("first_correct"),
        F.count("*").alias("tried"), F.lit(attempts).alias("total_generations"),
    )


def judge_tally(df: DataFrame, process: str, final: str) -> DataFrame:
    yes = lambda c, v: _if(F.col(c) == v)
    return df.agg(
        *(yes(c, v).alias(f"{c}_{v.lower()}") for c in (process, final) for v in ("Yes", "No", "Uncertain")),
        _if((F.col(process) == "Yes") & (F.col(final) == "Yes")).alias("both_yes"), F.count("*").alias("total"),
    )
