"""Shared pieces: scratch storage, worker caches, what workers remember, connected components."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_importable

_written: list[tuple[SparkSession, str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where none is set and all runs in this process (tests)."""
    ensure_importable(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path is None and known.isDefined():
        path = known.get()
    if path is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("executors share no folder with the driver: set spark.checkpoint.dir")
    if path is None:
        path = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    if known.isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's default, as texts can be long; a session's own setting stays."""
    ensure_importable(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder: safe when executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def scratch_paths() -> list[str]:
    return [path for _, path in _written]


def drop_scratch(paths: list[str] | None = None) -> None:
    """Delete scratch tables, all or those given, once all results built on them are written."""
    for entry in [e for e in _written if paths is None or e[1] in paths]:
        _written.remove(entry)
        spark, path = entry
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before the interpreter
            pass


atexit.register(drop_scratch)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    home = sys.modules.setdefault("_corpusloom_worker_cache", types.ModuleType("_corpusloom_worker_cache"))
    return home.__dict__.setdefault(name, {})


class Remembered:
    """Values of the different strings met so far, in Arrow arrays: some tens of bytes each, where objects take hundreds.

    Past so many strings or bytes, those used least go; what is gone is worked out anew.
    """

    def __init__(self, *kinds: pa.DataType, strings: int = 500_000, size: int = 64 << 20):
        self.kinds, self.strings, self.size = kinds, strings, size
        self.forget()

    def forget(self) -> None:
        self.keys, self.values = pa.array([], pa.string()), [pa.array([], k) for k in self.kinds]
        self.uses = np.zeros(0, np.int64)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, *self.values, self.uses))

    def found(self, strings: pa.Array, make: Callable[[list[str]], list[pa.Array]]) -> tuple[pa.Array, list[pa.Array]]:
        """The place of each string in arrays of values, and these; ``make`` gives the values of strings not held."""
        held = len(self.keys)
        coded = pa.concat_arrays([self.keys, strings]).dictionary_encode()  # those held come first and keep their places
        places = coded.indices.slice(held)
        fresh = coded.dictionary.slice(held)
        if len(fresh):
            made = make(fresh.to_numpy(zero_copy_only=False).tolist())
            self.values = [pa.concat_arrays([old, new]) for old, new in zip(self.values, made, strict=True)]
            self.keys = coded.dictionary
        values = self.values
        uses = np.bincount(places.to_numpy(), minlength=len(self.keys))
        uses[:held] += self.uses
        self.uses = uses
        if len(self.keys) > self.strings or self.nbytes > self.size:
            most = pa.array(np.sort(np.argsort(-uses, kind="stable")[: min(len(uses), self.strings) // 2]))
            self.keys, self.values, self.uses = self.keys.take(most), [x.take(most) for x in values], uses[most.to_numpy()] // 2
            if self.nbytes > self.size:
                self.forget()
        return places, values


def byte_offsets(binary: pa.Array) -> np.ndarray:
    """Where each entry of a string or binary array begins in its buffer of bytes, and where the last ends."""
    if not len(binary):
        return np.zeros(1, np.int32)
    return np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1]


def sized(batches: Iterable[pa.RecordBatch], size: int = 4 << 20, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes in the second column: small batches together, large ones in parts."""
    held, n, weight = [], 0, 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = min(int(np.searchsorted(ends, before + size - weight)) + 1, b.num_rows, at + rows - n)
            held.append(b.slice(at, upto - at))
            n, weight, at = n + upto - at, weight + int(ends[upto - 1]) - before, upto
            if weight >= size or n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n, weight = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def rejoin_key(c: str | Column) -> Column:
    """An equi-join key that hides how its side is already partitioned.

    Both join inputs then get an exchange of their own, which adaptive execution
    can split when one key is hot; a join that reuses the aggregate's partitioning
    can't be split.
    """
    return F.bitwise_not(F.col(c) if isinstance(c, str) else c)


def connected_components(edges: DataFrame) -> DataFrame:
    """Label of every node that has a link: the least id in its component.

    ``edges`` has longs ``src`` and ``dst``. Alternates large-star and small-star
    steps (Kiveris et al., 2014) until the links no longer change, so the state
    stays distributed. Null ends and self links are ignored. Returns ``node``
    and ``component``.
    """
    none = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links = checkpointed(none.filter("u <> v").distinct())
    seen = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(rejoin_key("u").alias("k"), F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").withColumn("k", rejoin_key("u")).join(low, "k")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.withColumn("k", rejoin_key("u")).join(low.select(rejoin_key("u").alias("k"), "m"), "k")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            .unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        )
        links = checkpointed(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
