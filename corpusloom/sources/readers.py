"""Scans: JSON arrays, corpora in two layouts, evaluation documents, weights, markdown."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

MESSAGES = "messages array<struct<role: string, content: string>>"
MATH = "problem string, solution string, source string"


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of one JSON array with their place ``ord`` in it, which prefixes and seeded samples need.

    One array can't be split; write it once as Parquet (``ingest``) and read that afterwards.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(kind)).alias("a"))
    return rows.select(F.posexplode("a").alias("ord", "r")).select(F.col("ord").cast("long").alias("ord"), "r.*")


def ingest(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Write a corpus as Parquet, so that filters and columns reach the scan."""
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)
    return df.sparkSession.read.parquet(path)


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, or no rows if there is no file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return json_array(spark, path, schema) if there else spark.createDataFrame([], f"ord long, {schema}")


def eval_problems(df: DataFrame, most: int | None = None) -> DataFrame:
    """Question and gold answer of problems keyed by digits; a prefix by place."""
    out = df.select("ord", F.col("`0`.value").alias("question"), F.col("`1`.ground_truth.value").alias("gold"))
    return out if most is None else out.filter(F.col("ord") < most)


def math_corpus(df: DataFrame, sources: str | None = None, boxed: bool = True) -> DataFrame:
    """Source filter (comma-separated names), then only solutions with a box."""
    out = df
    if sources:
        out = out.filter(F.coalesce("source", F.lit("")).isin(*[s.strip() for s in sources.split(",")]))
    return out.filter(text.has_boxed(F.col("solution"))) if boxed else out


def competition(df: DataFrame) -> DataFrame:
    return math_corpus(df, "olympiads, amc_aime, aops_forum, math")


def trace_corpus(df: DataFrame, min_messages: int = 0, sniff_first: bool = False) -> DataFrame:
    """Problem and solution from either layout: own columns, or the last message of each role.

    The layout is told row by row, and only boxed solutions stay. ``sniff_first`` decides by
    the columns alone and then takes rows with columns unfiltered.
    """
    names = df.columns
    get = lambda c: F.col(c) if c in names else F.lit(None).cast("string")
    if sniff_first and "problem" in names:
        return df.select("ord", "problem", "solution")
    if "messages" in names:
        by_role = lambda role: F.filter("messages", lambda m: m["role"] == role)
        last = lambda role: F.when(F.size(by_role(role)) > 0, F.element_at(by_role(role), -1)["content"])
        enough = F.size("messages") >= min_messages
        problem, solution = F.coalesce(get("problem"), F.when(enough, last("user"))), F.coalesce(get("solution"), F.when(enough, last("assistant")))
    else:
        problem, solution = get("problem"), get("solution")
    out = df.select("ord", problem.alias("problem"), solution.alias("solution"))
    return out.filter((F.coalesce("problem", F.lit("")) != "") & text.has_boxed(F.col("solution")))


def first_matches(df: DataFrame, condition, most: int = 50_000, order: str = "ord") -> DataFrame:
    """The first ``most`` matching rows by place: a top-k, not a full sort."""
    return df.filter(condition).orderBy(order).limit(most)


def eval_documents(spark: SparkSession, glob: str, suffix: str = "") -> DataFrame:
    """One row for each evaluation document with its file's name; three schemas meet under one glob, absent fields are null."""
    docs = spark.read.option("multiLine", True).json(glob).withColumn("file", F.col("_metadata.file_name"))
    return docs.filter(F.endswith("file", F.lit(f"{suffix}_eval.json"))) if suffix else docs


def with_suffix(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Names below a folder that end so, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.filter(F.endswith("path", F.lit(suffix)))


def budget_rows(docs: DataFrame, column: str) -> DataFrame:
    """A map keyed by token budgets as rows."""
    return docs.select("name", F.explode(column).alias("budget", "stats")).select("name", F.col("budget").cast("long").alias("budget"), "stats.*")


WEIGHTS = "exp string, layer string, side string, rows int, cols int, data array<float>"
_KINDS = {"F32": np.dtype("<f4"), "F64": np.dtype("<f8"), "F16": np.dtype("<f2")}


def adapter_weights(spark: SparkSession, glob: str) -> DataFrame:
    """Low-rank matrices of safetensors files: a row for each layer and side.

    The header is JSON and tensors are raw little-endian values. Pickled weights aren't read,
    as unpickling runs code.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                size = int.from_bytes(content[:8], "little")
                for name, t in json.loads(content[8 : 8 + size]).items():
                    m = re.fullmatch(r"(.*)\.lora_([AB])(?:\.default)?\.weight", name)
                    if not m:
                        continue
                    start, stop = (8 + size + x for x in t["data_offsets"])
                    raw = content[start:stop]
                    if t["dtype"] == "BF16":
                        data = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
                    else:
                        data = np.frombuffer(raw, _KINDS[t["dtype"]]).astype(np.float32)
                    rows.append((path.rstrip("/").split("/")[-2], m[1], m[2], *t["shape"], data))
            yield pd.DataFrame(rows, columns=["exp", "layer", "side", "rows", "cols", "data"])

    files = spark.read.format("binaryFile").load(glob)
    return files.select("path", "content").mapInPandas(run, WEIGHTS)


def catalogue(spark: SparkSession, records: list[dict], most: int) -> DataFrame:
    """The first entries of a fetched catalogue; fetching is the caller's."""
    rows = [(r.get("API"), r.get("Description"), r.get("Category"), r.get("Link")) for r in records[:most]]
    return spark.createDataFrame(rows, "api string, description string, category string, link string")


def markdown_elements(text_: str) -> list[tuple[str, str]]:
    """Headings, tables, bullets, code and paragraphs of a markdown text, in order."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    kind = "paragraph"

    def close() -> None:
        nonlocal held, kind
        if held:
            out.append((kind, "\n".join(held)))
        held, kind = [], "paragraph"

    fenced = False
    for line in text_.split("\n"):
        if line.startswith("```"):
            if fenced:
                out.append(("code", "\n".join(held)))
                held, kind = [], "paragraph"
            else:
                close()
            fenced = not fenced
        elif fenced:
            held.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            close()
            out.append((f"h{len(m[1])}", m[2].strip()))
        elif line.startswith("|"):
            if kind != "table":
                close()
            kind = "table"
            if not re.fullmatch(r"[|\s:-]+", line):
                held.append(line)
        elif m := re.match(r"\s*(?:[-*]|\d+\.)\s+(.*)", line):
            close()
            out.append(("bullet", m[1]))
        elif not line.strip():
            close()
        else:
            if kind == "table":
                close()
            held.append(line)
    if fenced:
        out.append(("code", "\n".join(held)))
    else:
        close()
    return out


def markdown(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, k, *e) for p, v in zip(b["path"], b["value"], strict=True) for k, e in enumerate(markdown_elements(v))],
                               columns=["path", "pos", "kind", "content"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, "path string, pos int, kind string, content string")
