"""Profiles of text corpora and distances between them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, StringType, StructField, StructType

from ..functions import stats, text
from ..session import ensure_importable

#: Different tokens that a task holds.
HELD = 500_000
#: Tokens whose grams a task makes at once, and rows of a batch it passes on.
HELD_TOKENS, BATCH_ROWS = 2_000_000, 50_000
#: Between digests of tokens, so that their order counts.
ODD = np.uint64(0x9E3779B97F4A7C15)


def length_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, median, population deviation, extremes and quartiles."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, 0.25).alias("p25"), F.percentile(v, 0.75).alias("p75"),
    )


def token_counts(df: DataFrame, text_col: str, by: list[str]) -> DataFrame:
    """``by``, token and its count: summed on the map side, so hot tokens stay cheap."""
    return df.select(*by, F.explode(text.tokens(F.col(text_col))).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, text_col: str, by: list[str]) -> DataFrame:
    counts = token_counts(df, text_col, by).groupBy(*by).agg(F.sum("n").alias("total_tokens"), F.count("*").alias("unique_tokens"))
    return counts.withColumn("type_token_ratio", stats.ratio(F.col("unique_tokens"), F.col("total_tokens")))


def partial_token_counts(df: DataFrame, text_col: str, by: list[str]) -> DataFrame:
    """``by``, token, its count ``tf`` and the number of texts ``df`` that hold it, summed within tasks alone.

    A task passes on what it holds after ``HELD`` different tokens, so a token can have several rows.
    """

    def gathered(texts: Iterator[tuple[tuple, list[str]]]) -> Iterator[tuple[tuple, list[pa.Array]]]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def told() -> Iterator[tuple[tuple, list[pa.Array]]]:
            for key, (tf, df) in held.items():
                yield key, [pa.array(tf, pa.string()), pa.array(tf.values(), pa.int64()), pa.array(map(df.__getitem__, tf), pa.int64())]
            held.clear()

        size = 0
        for key, words in texts:
            tf, df = held[key]
            size -= len(tf)
            tf.update(words)
            df.update(set(words))
            size += len(tf)
            if size > HELD:
                yield from told()
                size = 0
        yield from told()

    return _by_task(df, text_col, by, gathered, {"token": StringType(), "tf": LongType(), "df": LongType()})


def _by_task(df: DataFrame, text_col: str, by: list[str], gathered: Callable, schema: dict[str, DataType]) -> DataFrame:
    """``by`` and the columns that ``gathered`` makes of each key's tokens, over the texts of a task."""
    ensure_importable(df.sparkSession)
    find = re.compile(text.TOKEN).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def texts() -> Iterator[tuple[tuple, list[str]]]:
            for b in batches:
                kinds[:] = [c.type for c in b.columns[:-1]]
                for at in range(0, b.num_rows, 250):
                    for *key, low in zip(*(c.slice(at, 250).to_pylist() for c in b.columns), strict=True):
                        if words := find(low or ""):
                            yield tuple(key), words

        for key, columns in gathered(texts()):
            for at in range(0, len(columns[0]), BATCH_ROWS):
                some = [c.slice(at, BATCH_ROWS) for c in columns]
                keys = [pa.array([v], k).take(pa.array(np.zeros(len(some[0]), np.int32))) for v, k in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*keys, *some], names=[*by, *schema])

    rows = df.select(*by, F.lower(text_col).alias("_low"))  # by Spark, whose rules for letters hold
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *(StructField(*x) for x in schema.items())]))


class Digests(dict):
    """A number for each token met, and its 128-bit digest under that number."""

    def __init__(self) -> None:
        self.raw = bytearray()

    def __missing__(self, token: str) -> int:
        self.raw += hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self[token] = len(self)
        return len(self) - 1


def _hashed(digests: np.ndarray, texts: list[np.ndarray], n: int) -> pa.Array:
    """Different grams of ``n`` tokens, none across texts, as 16 bytes each."""
    ids, text_of = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    tokens, many = digests[ids], len(ids) - n + 1
    grams = np.zeros((max(0, many), 2), np.uint64)
    for k in range(n):
        grams = grams * ODD + tokens[k : k + many]
    grams = grams[text_of[:many] == text_of[n - 1 :]]
    grams = grams[np.argsort(grams[:, 0])]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]).any(1)
    grams = np.ascontiguousarray(grams[first])
    ends = np.arange(0, 16 * len(grams) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer(ends), pa.py_buffer(grams)])


def gram_set(df: DataFrame, text_col: str, n: int, by: list[str]) -> DataFrame:
    """Different grams of each group: tokens as they are; longer ones as 128 bits that tokens' digests are summed to.

    Two of a billion grams would agree by chance once in 10^20 corpora; a task passes on each but once among ``HELD_TOKENS`` tokens.
    """
    if n == 1:
        return partial_token_counts(df, text_col, by).select(*by, F.col("token").alias("gram")).distinct()

    def gathered(texts: Iterator[tuple[tuple, list[str]]]) -> Iterator[tuple[tuple, list[pa.Array]]]:
        number, size = Digests(), 0
        held: dict[tuple, list[np.ndarray]] = defaultdict(list)

        def told() -> Iterator[tuple[tuple, list[pa.Array]]]:
            digests = np.frombuffer(bytes(number.raw), "<u8").reshape(-1, 2)
            for key, ids in held.items():
                yield key, [_hashed(digests, ids, n)]
            held.clear()

        for key, words in texts:
            if len(words) < n:
                continue
            held[key].append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            size += len(words)
            if size > HELD_TOKENS:
                yield from told()
                size = 0
                if len(number) > HELD:
                    number = Digests()
        yield from told()

    return _by_task(df, text_col, by, gathered, {"gram": BinaryType()}).distinct()


def jaccard_to(grams: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """Shared and united grams of each group and the target; 0 for an empty union.

    Both hold a gram once. A null group shares none, as its key joins with nothing.
    """
    hit = F.col("_hit")
    for name in by:
        hit = F.when(F.col(name).isNotNull(), hit)
    found = grams.join(target.select("gram", F.lit(1).alias("_hit")), "gram", "left")  # one pass counts both
    total = F.broadcast(target.agg(F.count("*").alias("other")))  # one row
    out = found.groupBy(*by).agg(F.count("*").alias("own"), F.count(hit).alias("shared")).join(total)
    return out.select(*by, "own", "shared", stats.ratio(F.col("shared"), F.col("own") + F.col("other") - F.col("shared")).alias("jaccard"))


def histogram(df: DataFrame, value: str, most: float, bins: int, by: list[str]) -> DataFrame:
    return df.groupBy(*by, stats.histogram_bin(F.col(value), most, bins).alias("bin")).agg(F.count("*").alias("n"))


def js_divergence(a: DataFrame, b: DataFrame, key: str, by: list[str], smooth: float = 1.0, keys: DataFrame | None = None) -> DataFrame:
    """Jensen-Shannon divergence of each group of ``a`` from ``b``: counts ``n`` by ``key``, smoothed and normalised."""
    keys = (a.select(key).unionAll(b.select(key)).distinct()) if keys is None else keys
    grid = a.select(*by).distinct().join(F.broadcast(keys))  # every bin of every group: bounded by bins
    both = grid.join(a.withColumnRenamed("n", "p"), [*by, key], "left").join(b.select(key, F.col("n").alias("q")), key, "left")
    both = both.select(*by, key, (F.coalesce("p", F.lit(0)) + smooth).alias("p"), (F.coalesce("q", F.lit(0)) + smooth).alias("q"))
    w = Window.partitionBy(*by)
    shares = both.select(*by, (F.col("p") / F.sum("p").over(w)).alias("p"), (F.col("q") / F.sum("q").over(w)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = (stats.kl_divergence(F.col("p"), m) + stats.kl_divergence(F.col("q"), m)) / 2
    return shares.groupBy(*by).agg(F.sum(term).alias("js"))


def kl_between(a: DataFrame, b: DataFrame, key: str, by: list[str], smooth: float = 1.0) -> DataFrame:
    """Kullback-Leibler divergence of each group of ``a`` from ``b`` over their united keys."""
    keys = a.select(key).unionAll(b.select(key)).distinct()
    grid = a.select(*by).distinct().join(F.broadcast(keys))
    both = grid.join(a.withColumnRenamed("n", "p"), [*by, key], "left").join(b.select(key, F.col("n").alias("q")), key, "left")
    both = both.select(*by, (F.coalesce("p", F.lit(0)) + smooth).alias("p"), (F.coalesce("q", F.lit(0)) + smooth).alias("q"))
    w = Window.partitionBy(*by)
    shares = both.select(*by, (F.col("p") / F.sum("p").over(w)).alias("p"), (F.col("q") / F.sum("q").over(w)).alias("q"))
    return shares.groupBy(*by).agg(F.sum(stats.kl_divergence(F.col("p"), F.col("q"))).alias("kl"))


def tfidf_to(df: DataFrame, target: DataFrame, text_col: str, by: list[str], top: int = 5000) -> DataFrame:
    """Cosine of corpus-level TF-IDF vectors of each group and the target.

    The vocabulary is the ``top`` tokens by document frequency over both, ties by token.
    A corpus's tf is a token's count over its number of texts and its idf is ln(n/(df+1))+1.
    """

    def weights(x: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        per = partial_token_counts(x, text_col, keys).groupBy(*keys, "token").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        return per, x.groupBy(*keys).agg(F.count("*").alias("docs"))

    a, na = weights(df, by)
    b, nb = weights(target, [])
    # The target's vocabulary beside each of the few groups.
    beside = F.broadcast(df.select(*by).distinct()).join(b)
    every = a.select(*by, "token", "tf", "df", F.lit(0).alias("tf2"), F.lit(0).alias("df2")).unionByName(
        beside.select(*by, "token", F.lit(0).alias("tf"), F.lit(0).alias("df"), F.col("tf").alias("tf2"), F.col("df").alias("df2"))
    )
    every = every.groupBy(*by, "token").agg(*(F.sum(c).alias(c) for c in ("tf", "df", "tf2", "df2")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("df") + F.col("df2")), "token"))
    kept = every.withColumn("r", rank).filter(F.col("r") <= top).join(F.broadcast(na), by).join(F.broadcast(nb.withColumnRenamed("docs", "docs2")))
    w1 = F.col("tf") / F.col("docs") * (F.log(F.col("docs") / (F.col("df") + 1)) + 1)
    w2 = F.col("tf2") / F.col("docs2") * (F.log(F.col("docs2") / (F.col("df2") + 1)) + 1)
    out = kept.groupBy(*by).agg(F.sum(w1 * w2).alias("d"), F.sqrt(F.sum(w1 * w1)).alias("n1"), F.sqrt(F.sum(w2 * w2)).alias("n2"))
    return out.select(*by, F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("d") / (F.col("n1") * F.col("n2"))).otherwise(0.0).alias("tfidf_cosine"))


def topic_rates(df: DataFrame, text_col: str, by: list[str]) -> DataFrame:
    rates = [F.avg(text.mentions(F.col(text_col), words).cast("int")).alias(name) for name, words in text.TOPICS.items()]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *rates)


def composite(unigram: Column, bigram: Column, tfidf: Column, topic_js: Column) -> Column:
    """Mean of one minus each similarity and the topic divergence."""
    return ((1 - unigram) + (1 - bigram) + (1 - tfidf) + topic_js) / 4
