"""Tool records: queries with their golden calls, API documents, parameters, agent traces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def tool_queries(tools: DataFrame) -> DataFrame:
    """A row for each instruction with the golden calls at its place, none past the end."""
    rows = tools.select("Name", "NLDocumentation", "Golden_Answers", F.posexplode("Instructions").alias("pos", "instruction"))
    kind = tools.schema["Golden_Answers"].dataType.elementType
    gold = F.coalesce(F.get("Golden_Answers", F.col("pos")), F.array().cast(kind))
    return rows.select("Name", "NLDocumentation", "pos", "instruction", gold.alias("golden"))


def zipped(a: DataFrame, b: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of equal place; the shorter side decides."""
    return a.join(b, order)


def missing_params(required: Column, given: Column) -> Column:
    return F.array_except(required, given)


def problem(text: str | None) -> str | None:
    """What keeps a text from being an API document, or None."""
    try:
        spec = json.loads(text or "")
    except ValueError:
        return "not JSON"
    if not isinstance(spec, dict):
        return "not an object"
    for key in ("openapi", "info", "paths"):
        if key not in spec:
            return f"lacks {key}"
    return None if isinstance(spec["paths"], dict) and spec["paths"] else "has no paths"


@F.pandas_udf(StringType())
def document_problem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(problem)


def with_server(text: str | None, url: str) -> str | None:
    """The document with its server set."""
    return text if problem(text) else json.dumps(json.loads(text) | {"servers": [{"url": url}]})


def trainable_traces(traces: DataFrame, most: int = 5) -> DataFrame:
    """Traces with one to ``most`` steps that use more than the look-up of details."""
    tools = F.array_distinct(F.transform("steps", lambda x: x["action"]))
    only = (F.size(tools) == 1) & (F.get(tools, F.lit(0)) == "getDetails")
    return traces.filter((F.size("steps") >= 1) & (F.size("steps") <= most) & ~only)


def trace_segments(traces: DataFrame) -> DataFrame:
    """Texts of a trace and which of them are trained on: the model's own, not the observations."""
    own = lambda s: F.concat(F.lit("Action: "), s["action"], F.lit("\nAction Input: "), s["input"])
    part = lambda text, flag: F.struct(text.alias("text"), F.lit(flag).alias("trainable"))
    steps = F.flatten(F.transform("steps", lambda s: F.array(part(own(s), True), part(s["observation"], False))))
    return traces.withColumn("segments", F.concat(F.array(part(F.col("input"), False)), steps, F.array(part(F.col("output"), True))))


def segment_histogram(df: DataFrame, segments: str = "segments") -> DataFrame:
    return df.groupBy(F.size(segments).alias("n_segments")).agg(F.count("*").alias("n"))
