"""One JSON document as a sink: written as a whole or not at all, with statistics from the tasks' commits."""

from __future__ import annotations

import datetime
import decimal
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import ensure_importable
from .tensors import file_system

CHUNK = 1 << 20


def plain(value):
    """A value as JSON has it: NaN and infinities as null, whatever numpy, times and decimals hold as numbers or text."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, np.ndarray)):
        return [plain(v) for v in value]
    if isinstance(value, np.generic):
        return plain(value.item())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, (datetime.date, datetime.datetime, datetime.timedelta)):
        return str(value)
    return value.hex() if isinstance(value, (bytes, bytearray)) else value


@dataclass
class Part(WriterCommitMessage):
    """A task's file, and what it adds to the statistics: a count, and sums of number and truth columns."""

    place: int
    path: str
    rows: int = 0
    sums: dict[str, float] = field(default_factory=dict)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str], summed: list[str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.columns, self.summed = columns, summed
        system, path = file_system(self.path)
        # A folder of its own: where it is gone, a task that outlives a failed job can't leave a file.
        self.folder = f"{path}.{uuid.uuid4().hex}"
        system.create_dir(self.folder)

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        system, _ = file_system(self.path)
        part = Part(place, f"{self.folder}/{place}-{uuid.uuid4().hex}", 0, dict.fromkeys(self.summed, 0.0))
        with system.open_output_stream(part.path) as out:
            for row in iterator:
                values = {c: plain(row[c]) for c in self.columns}
                out.write((",\n" if part.rows else "").encode() + json.dumps(values, ensure_ascii=False, allow_nan=False).encode())
                part.rows += 1
                for c in self.summed:
                    part.sums[c] += values[c] or 0
        return part

    def commit(self, messages: list[Part | None]) -> None:
        """Join the tasks' files, a chunk at a time, beside the document, then put it in its place."""
        system, path = file_system(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        stats = {"rows": sum(p.rows for p in parts)} | {c: sum(p.sums[c] for p in parts) for c in self.summed}
        whole = f"{self.folder}/whole"
        with system.open_output_stream(whole) as out:
            out.write(b'{"stats": ' + json.dumps(plain(stats)).encode() + b', "results": [')
            some = False
            for p in parts:
                if p.rows:
                    out.write(b",\n" if some else b"\n")
                    some = True
                    with system.open_input_stream(p.path) as source:
                        while chunk := source.read(CHUNK):
                            out.write(chunk)
            out.write(b"]}\n")
        system.move(whole, path)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, _ = file_system(self.path)
        for _ in range(5):  # a task may add a file meanwhile
            try:
                return system.delete_dir(self.folder)
            except FileNotFoundError:
                return None
            except OSError:
                continue


class DocumentSink(DataSource):
    """Format ``json_document``, written with mode ``overwrite``: ``{"stats": {...}, "results": [...]}`` in one file at ``path``."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if not overwrite:
            raise ValueError("a document is replaced as a whole: use mode overwrite")
        summed = [f.name for f in schema.fields if f.dataType.typeName() in ("boolean", "byte", "short", "integer", "long", "float", "double")]
        return DocumentWriter(dict(self.options), schema.fieldNames(), summed, overwrite)


def write_document(df: DataFrame, path: str) -> dict:
    """Write rows as one JSON document and return its statistics.

    ``stats`` has ``rows`` and the sum of every number and truth column, merged from what each task
    committed; rows stand in the order of ``df``'s partitions. Until all tasks have succeeded an older
    document stays as it is; a failed job leaves no files of its own. Nulls, NaN and infinities are null and add nothing.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    spark.dataSource.register(DocumentSink)
    df.write.format("json_document").mode("overwrite").option("path", path).save()
    return document_stats(path)


def document_stats(path: str) -> dict:
    """Statistics at the head of a document; zero rows where there is none yet."""
    system, inside = file_system(path)
    if not system.get_file_info(inside).is_file:
        return {"rows": 0}
    with system.open_input_stream(inside) as source:
        head = b""
        while b', "results": [' not in head and (chunk := source.read(CHUNK)):
            head += chunk
    return json.loads(head.partition(b', "results": [')[0] + b"}")["stats"]
