"""Which tokens of a training example are learnt from: token ranges merged with segment ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable

#: Label of tokens that aren't learnt from.
IGNORED = -100


def plain_mask(lengths: np.ndarray, parts: np.ndarray, trainable: np.ndarray) -> np.ndarray:
    """Whether each token lies in trainable segments only, from the lengths of both; what no segment covers isn't trainable."""
    ends = np.cumsum(lengths)
    masked = np.append(0, np.cumsum(np.repeat(~trainable, parts)))
    covered = len(masked) - 1
    at = lambda x: masked[np.minimum(x, covered)] + np.maximum(x - covered, 0)
    return (at(ends) - at(ends - lengths)) == 0


def span_mask(lengths: Column, segments: Column) -> Column:
    """A flag for each token of an example's joined text.

    ``lengths`` are the tokens' numbers of characters, which cover the text in order; ``segments`` have
    ``text, trainable``. A token that reaches into a segment that isn't trained on isn't
    either, nor one past the last segment; an empty token has the place where it stands. Nulls give null;
    a null text counts as empty and a null flag as not trainable.
    """

    @F.pandas_udf("array<boolean>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([
                None if n is None or p is None else plain_mask(np.asarray(n, np.int64), np.asarray(p, np.int64), np.asarray(t, bool)).tolist()
                for n, p, t in zip(*batch, strict=True)
            ], dtype=object)

    parts = F.transform(segments, lambda s: F.length(F.coalesce(s["text"], F.lit(""))))
    return run(lengths, parts, F.transform(segments, lambda s: F.coalesce(s["trainable"], F.lit(False))))


def joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: F.coalesce(s["text"], F.lit(""))), "")


def pattern_tokens(text: Column, pattern: str = r"[A-Za-z0-9]+|[ \t\n\r\f]+|[^A-Za-z0-9 \t\n\r\f]") -> Column:
    """Tokens of a pattern that covers every text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def vocabulary_tokens(df: DataFrame, text: str, path: str) -> DataFrame:
    """``df`` with ``tokens``: ``id, length`` of each token by a vocabulary file of the tokenizers library.

    Lengths are in characters and cover the text: a character whose bytes fall to several tokens counts for the
    first of them, and white space that a vocabulary drops for the token after it.
    """
    ensure_importable(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<struct<id: int, length: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            out = []
            for found in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False):
                ends = np.maximum.accumulate(np.array([end for _, end in found.offsets], np.int64)) if found.ids else np.zeros(0, np.int64)
                out.append([{"id": i, "length": n} for i, n in zip(found.ids, np.diff(ends, prepend=0).tolist(), strict=True)])
            yield pd.Series(out, dtype=object)

    return df.withColumn("tokens", run(text))


def labels(ids: Column, mask: Column) -> Column:
    """Ids that are learnt from, ``IGNORED`` for the others."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m, i).otherwise(IGNORED))


def conversation_examples(turns: DataFrame, most: int = 8) -> DataFrame:
    """Examples of at most ``most`` turns: ``conv_id, part, segments``; the assistant's texts are trained on, roles and other texts not.

    Turns are cut by their number, so that no conversation is one task's. Rows without a conversation or turn
    are left out; of equal turns the lesser role and text come first.
    """
    rows = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("part", F.expr(f"turn div {most}"))
    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("trainable"))
    both = F.array(segment(F.concat("role", F.lit(":")), F.lit(False)), segment(F.col("text"), F.col("role") == "assistant"))
    grouped = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", both.alias("both")))).alias("x"))
    return grouped.select("conv_id", "part", F.flatten(F.transform("x", lambda r: r["both"])).alias("segments"))
