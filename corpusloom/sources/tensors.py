"""Adapter weights in safetensors files as a data source: ranged reads, and filters that skip tensors."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..session import ensure_importable

SCHEMA = "exp string, layer string, side string, rows int, cols int, data array<float>, path string, error string"
WEIGHTS = ["exp", "layer", "side", "rows", "cols", "data"]
#: Tensors that lie next to each other are read together up to so many bytes.
RANGE_BYTES = 16 << 20
#: A file of more ranges than this is read in parts of ``RANGE_BYTES``, in which tensors that filters skip may lie between.
RANGES = 16
#: Within a part, what lies between wanted tensors is read along up to so many bytes: less than another read costs.
GAP_BYTES = 64 << 10
#: Longer headers are read by the tasks, so that the driver holds no long lists of tensors.
PLANNED_BYTES = 64 << 10
#: Rows of a batch that a task gives to Spark.
BATCH_ROWS = 1000
#: Tensors of a written file, about; more shards than asked for are written for more.
FILE_TENSORS = 16_384
#: No header is larger; a length beyond it is a broken file.
HEADER_BYTES = 100 << 20
_KINDS = {"F32": np.dtype("<f4"), "F64": np.dtype("<f8"), "F16": np.dtype("<f2"), "BF16": np.dtype("<u2")}
#: What a broken file raises.
_BROKEN = (ValueError, KeyError, TypeError, AttributeError, OSError)
_NAME = re.compile(r"(.*)\.lora_([AB])(?:\.default)?\.weight")


def file_system(path: str):
    """The pyarrow file system of a path or address, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def experiment_of(path: str) -> str:
    """The folder that names the experiment: the file's, or the one above ``final_adapter``."""
    parts = path.strip("/").split("/")[:-1]
    return ([p for p in parts if p != "final_adapter"] or [""])[-1]


@dataclass
class Tensor:
    layer: str
    side: str
    rows: int
    cols: int
    kind: str
    start: int
    stop: int


@dataclass
class TensorRange(InputPartition):
    """Tensors of a file; or where those begin that a task finds in the header itself; or what is wrong with the file."""

    path: str
    tensors: list[Tensor]
    error: str | None = None
    begin: tuple[int, int] | None = None

    def __init__(self, path: str, tensors: list[Tensor], error: str | None = None, begin: tuple[int, int] | None = None):
        super().__init__(None)
        self.path, self.tensors, self.error, self.begin = path, tensors, error, begin


def header(source, size: int) -> list[Tensor]:
    """Matrices that a file's header lists, by place; ValueError if it can't be so."""
    length = int.from_bytes(source.read_at(8, 0), "little") if size >= 8 else HEADER_BYTES + 1
    if length > min(HEADER_BYTES, size - 8):
        raise ValueError("the header is longer than the file")
    out = []
    for name, t in json.loads(source.read_at(length, 8)).items():
        m = _NAME.fullmatch(name)
        if not m:
            continue
        start, stop = (8 + length + x for x in t["data_offsets"])
        shape = [int(n) for n in t["shape"]]
        if t["dtype"] not in _KINDS or len(shape) != 2 or stop > size or stop - start != shape[0] * shape[1] * _KINDS[t["dtype"]].itemsize:
            raise ValueError(f"tensor {name} doesn't fit its type, its shape or the file")
        out.append(Tensor(m[1], m[2], *shape, t["dtype"], start, stop))
    return sorted(out, key=lambda t: t.start)


def runs(tensors: list[Tensor], most: int, gap: float = 0) -> Iterator[list[Tensor]]:
    """Tensors in order of place, parted at gaps of more than ``gap`` bytes and where a run would exceed ``most``."""
    run: list[Tensor] = []
    for t in tensors:
        if run and not (0 <= t.start - run[-1].stop <= gap and t.stop - run[0].start <= most):
            yield run
            run = []
        run.append(t)
    if run:
        yield run


class TensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.most = int(options.get("rangeBytes", RANGE_BYTES))
        self.wanted: list[tuple[str, set[str] | str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality, lists and beginnings of exp, layer and side skip tensors; Spark still applies all filters."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 else ""
            if name in ("exp", "layer", "side"):
                value = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else f.value
                self.wanted.append((name, value))
            yield f

    def _keeps(self, **values: str) -> bool:
        fits = lambda has, want: has.startswith(want) if isinstance(want, str) else has in want
        return all(fits(values[name], want) for name, want in self.wanted if name in values)

    def _found(self, source, size: int) -> list[Tensor]:
        return [t for t in header(source, size) if self._keeps(layer=t.layer, side=t.side)]

    def partitions(self) -> list[InputPartition]:
        """Ranges of the tensors wanted; only short headers are read here, of files of wanted experiments."""
        from pyarrow import fs

        system, base = file_system(self.path)
        files = [i for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file]
        known = {i.path.rpartition("/")[0] for i in files if i.path.endswith(".safetensors")}
        wanted = [i for i in files if experiment_of(i.path).endswith(self.suffix) and self._keeps(exp=experiment_of(i.path))]

        def plan(info) -> list[TensorRange]:
            if info.path.endswith("adapter_model.bin") and info.path.rpartition("/")[0] not in known:
                return [TensorRange(info.path, [], "pickled weights aren't read, as that runs code")]
            if not info.path.endswith(".safetensors"):
                return []
            try:
                with system.open_input_file(info.path) as source:
                    if info.size > PLANNED_BYTES and PLANNED_BYTES < int.from_bytes(source.read_at(8, 0), "little") <= min(HEADER_BYTES, info.size - 8):
                        return [TensorRange(info.path, [], begin=(at, at + self.most)) for at in range(0, info.size, self.most)]
                    found = self._found(source, info.size)
            except _BROKEN as error:
                return [TensorRange(info.path, [], f"{type(error).__name__}: {error}")]
            parts = list(runs(found, self.most))
            return [TensorRange(info.path, p) for p in (parts if len(parts) <= RANGES else runs(found, self.most, math.inf))]

        with ThreadPoolExecutor(16) as pool:
            return [r for ranges in pool.map(plan, sorted(wanted, key=lambda i: i.path)) for r in ranges]

    def read(self, partition: TensorRange) -> Iterator[pa.RecordBatch]:
        exp, error, tensors = experiment_of(partition.path), partition.error, partition.tensors
        system, _ = file_system(self.path)
        if partition.begin:
            low, high = partition.begin
            try:
                with system.open_input_file(partition.path) as source:
                    tensors = [t for t in self._found(source, source.size()) if low <= t.start < high]
            except _BROKEN as broken:  # said once for a file
                error = None if low else f"{type(broken).__name__}: {broken}"
        if error:
            yield _batch([(exp, None, None, None, None, None, partition.path, error)])
        if not tensors:
            return
        with system.open_input_file(partition.path) as source:
            for run in runs(tensors, self.most, GAP_BYTES):
                first = run[0].start
                raw = source.read_at(max(t.stop for t in run) - first, first)
                for at in range(0, len(run), BATCH_ROWS):
                    yield _batch([(exp, t.layer, t.side, t.rows, t.cols, _values(raw, t, first), partition.path, None) for t in run[at : at + BATCH_ROWS]])


def _values(raw: bytes, t: Tensor, first: int) -> np.ndarray:
    data = np.frombuffer(raw, _KINDS[t.kind], t.rows * t.cols, t.start - first)
    return (data.astype(np.uint32) << 16).view(np.float32) if t.kind == "BF16" else data.astype(np.float32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class TensorSource(DataSource):
    """Format ``tensors``: a row for each low-rank matrix of the files below ``path``.

    Options: ``suffix`` of the experiments' names, ``rangeBytes`` of a partition. A file whose header
    is broken, or pickled weights beside none, give a row with an ``error`` and no data.
    """

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(dict(self.options))


def tensors(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Matrices of all experiments below ``path``, with ``path`` and ``error``; filters on exp, layer and side skip tensors."""
    ensure_importable(spark)
    spark.dataSource.register(TensorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tensors").option("suffix", suffix).load(path)


def write_tensors(weights: DataFrame, path: str, shards: int = 1) -> DataFrame:
    """Write ``exp, layer, side, rows, cols, data`` as ``shards`` files for each experiment, more if they'd hold over ``FILE_TENSORS``: ``exp, file, bytes``.

    Both matrices of a layer are in one file, chosen by a hash of the layer; a task holds one
    file's. A file appears as a whole under a name that a repeated task uses again. The
    plan writes when it is run; the rows are counted before.
    """
    ensure_importable(weights.sparkSession)
    largest = weights.groupBy("exp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shards = max(shards, -(-largest // FILE_TENSORS))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        system, base = file_system(path)
        exp, shard = str(frame["exp"].iloc[0]), int(frame["shard"].iloc[0])
        frame = frame.sort_values(["layer", "side"])
        data = [np.asarray(x, "<f4").tobytes() for x in frame["data"]]
        ends = np.cumsum([0, *map(len, data)]).tolist()
        told = json.dumps({
            f"{r.layer}.lora_{r.side}.weight": {"dtype": "F32", "shape": [int(r.rows), int(r.cols)], "data_offsets": [ends[k], ends[k + 1]]}
            for k, r in enumerate(frame.itertuples())
        }).encode()
        name = f"{base}/{exp}/adapter-{shard:05d}.safetensors"
        part = f"{name}.{uuid.uuid4().hex}.part"
        system.create_dir(f"{base}/{exp}")
        with system.open_output_stream(part) as out:
            out.write(len(told).to_bytes(8, "little") + told + b"".join(data))
        system.move(part, name)
        return pd.DataFrame({"exp": [exp], "file": [name], "bytes": [8 + len(told) + ends[-1]]})

    dealt = weights.select(*WEIGHTS).withColumn("shard", F.pmod(F.xxhash64("layer"), F.lit(shards)))
    return dealt.groupBy("exp", "shard").applyInPandas(run, "exp string, file string, bytes long")
