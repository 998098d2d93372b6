"""Token ids in training order: fixed-stride shards, each sequence at a permuted slot.

A shard is a file of records of one size, in slot order, so slot s is record
``s % shard_rows`` of shard ``s // shard_rows`` and a reader goes on from any
step by seeking. A record is little-endian: slot (8 bytes), document id (8),
number of the sequence in its document (4), ids in use (4), the ids (2 each), and a
line feed, which lets Spark's text writer and its committer write the files.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, byte_offsets, sized
from .pieces import in_parts, packed, pieces_of, read_model

LENGTH = 256
SHARD_ROWS = 8192
KEY = 20240229
#: Shards are written in so many turns, each from the stored tokens, so that only a part is in a shuffle at once.
TURNS = 4
END_ID, PAD_ID = 2, 0
ROUNDS = 6
NO_ID = -(1 << 63)
HEADER = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("seq", "<i4"), ("n", "<i4")])
_MASK = (1 << 64) - 1


def record_type(length: int) -> np.dtype:
    return np.dtype([*((n, HEADER[n]) for n in HEADER.names), ("ids", "<u2", (length,)), ("feed", "u1")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        tweak = np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) & _MASK)
        if back:
            left, right = right ^ (_mix(left + tweak) & mask), left
        else:
            left, right = right, left ^ (_mix(right + tweak) & mask)
    return (left << np.uint64(half)) | right


def permute(index: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slot of each index below ``n``, or with ``back`` the index of each slot.

    A Feistel network permutes the least even power of two that holds ``n``; what
    lands beyond ``n`` goes through it again (cycle-walking), under four times on average.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    x = _network(np.asarray(index).astype(np.uint64), half, key, back)
    out = np.flatnonzero(x >= np.uint64(n))
    while len(out):
        x[out] = _network(x[out], half, key, back)
        out = out[x[out] >= np.uint64(n)]
    return x.astype(np.int64)


def sequences(docs: DataFrame, model_path: str, length: int = LENGTH) -> DataFrame:
    """Every text's ids and an end id, cut into sequences: ``part, row, doc_id, seq, n, ids``.

    ``part`` and ``row`` number the sequences of each task. Null texts count as
    empty: one sequence with the end id alone.
    """
    model = read_model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, row = pieces_of(model), TaskContext.get().partitionId(), 0
        known = pieces.kept.setdefault("ids", Remembered(pa.binary(), strings=200_000))
        for b in sized(batches, 1 << 20):
            units = pieces.listed(b.column(1))
            places, (values,) = known.found(units.flatten(), lambda keys: [packed(in_parts(pieces.known, keys), "<u2")[0]])
            ids = values.take(places)
            at = byte_offsets(ids)[np.append(0, np.cumsum(pc.list_value_length(units).to_numpy()))] // 2
            sizes = np.diff(at) + 1  # with the end id
            ends = np.cumsum(sizes)
            flat, inner = np.full(int(ends[-1]), END_ID, "<u2"), np.ones(int(ends[-1]), bool)
            inner[ends - 1] = False
            flat[inner] = np.frombuffer(ids.buffers()[2] or b"", "<u2")[: int(at[-1])]
            count = -(-sizes // length)
            of = np.repeat(np.arange(len(sizes)), count)
            seq = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            starts = np.append((ends - sizes)[of] + seq * length, ends[-1])
            cut = [None, pa.py_buffer((2 * starts).astype(np.int32)), pa.py_buffer(flat)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(of), part, np.int32)), pa.array(np.arange(row, row + len(of))), b.column(0).take(pa.array(of)),
                    pa.array(seq.astype(np.int32)), pa.array(np.diff(starts).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(of), cut),
                ],
                names=["part", "row", "doc_id", "seq", "n", "ids"],
            )
            row += len(of)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    return rows.mapInArrow(run, "part int, row long, doc_id long, seq int, n int, ids binary")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_training_order(
    docs: DataFrame, model_path: str, path: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY, turns: int = TURNS
) -> int:
    """Write all sequences in training order below ``path``; returns their number.

    Tokens are stored once; then the number of sequences is known, and each gets its
    slot. A range of shards is written in each turn, dealt to tasks by shard. Turns
    and the token store that an earlier call has finished are not done again, so a
    call that failed is resumed by repeating it. Only the number of sequences
    of each task comes to the driver. Nothing is written for an empty table.
    """
    spark = docs.sparkSession
    held = f"{path}/_tokens"
    if not _exists(spark, f"{held}/_SUCCESS"):
        sequences(docs, model_path, length).write.mode("overwrite").option("compression", "zstd").parquet(held)
    tokens = spark.read.schema("part int, row long, doc_id long, seq int, n int, ids binary").parquet(held)
    counts = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    if not total:
        return 0
    base = F.broadcast(spark.createDataFrame(starts, "part int, base long"))

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), total, key))

    kind = record_type(length)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, kind)
            out["ids"], out["feed"] = PAD_ID, 10
            for name in ("slot", "seq", "n"):
                out[name] = b.column(name).to_numpy(zero_copy_only=False)
            out["doc_id"] = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for k, ids in enumerate(b.column("ids").to_pylist()):
                out["ids"][k, : len(ids) // 2] = np.frombuffer(ids, "<u2")
            flat, size = out.tobytes(), kind.itemsize
            rows = pa.array([flat[k * size : (k + 1) * size - 1] for k in range(b.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("slot"), rows], names=["shard", "slot", "record"])

    placed = tokens.join(base, "part").withColumn("slot", slot_of(F.col("base") + F.col("row")))
    placed = placed.withColumn("shard", F.expr(f"cast(slot div {shard_rows} as int)"))
    shards = -(-total // shard_rows)
    each = -(-shards // turns)
    for turn, low in enumerate(range(0, shards, each)):
        if _exists(spark, f"{path}/turn={turn}/_SUCCESS"):
            continue
        high = min(shards, low + each)
        some = placed.filter(F.col("shard").between(low, high - 1)).select("shard", "slot", "doc_id", "seq", "n", "ids")
        (
            some.mapInArrow(records, "shard int, slot long, record binary")
            .repartitionById(high - low, F.col("shard") - low)
            .sortWithinPartitions("shard", "slot")
            .select(F.col("record").cast("string").alias("record"), "shard")
            .write.mode("overwrite").partitionBy("shard").text(f"{path}/turn={turn}")
        )
        # The turn's shuffle files go once the driver has forgotten its frames.
        del some
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return total


def read_training_order(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """All records of written shards: ``slot, doc_id, seq, n, ids_sha256``.

    The digest is the SHA-256 of the ids in use, two little-endian bytes each.
    """
    kind = record_type(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                got = np.frombuffer(content.as_py(), kind)
                sha = [hashlib.sha256(r["ids"][: r["n"]].tobytes()).hexdigest() for r in got]
                ids = pa.array(got["doc_id"], pa.int64(), mask=got["doc_id"] == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got["slot"], pa.int64()), ids, pa.array(got["seq"], pa.int32()), pa.array(got["n"], pa.int32()), pa.array(sha)],
                    names=["slot", "doc_id", "seq", "n", "ids_sha256"],
                )

    files = spark.read.format("binaryFile").load(f"{path}/turn=*/shard=*/*.txt").select("content")
    return files.mapInArrow(run, "slot long, doc_id long, seq int, n int, ids_sha256 string")
