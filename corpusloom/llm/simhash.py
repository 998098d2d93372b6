"""Near duplicates by SimHash and meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, rejoin_key, small_batches

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once, which bounds the memory of a long text.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included.

    A-Z count as a-z and words are runs of bytes other than ASCII white space.
    A text of fewer words than ``size`` is one shingle; none at all gives 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    last = max(1, len(words) - size + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, last, BLOCK):
        part = words[at : min(at + BLOCK, last) + size - 1]
        if len(part) <= size:
            shingles: Iterator[bytes] = iter([b" ".join(part)])
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row (id, ``fp`` signed long) for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def ball(fp: str, half: int) -> F.Column:
    """Array of all values within ``half`` bit flips of the long ``fp``."""
    masks = [0]
    for _ in range(half):
        masks = sorted({m ^ (1 << b) for m in masks for b in range(BITS)} | set(masks))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.lit(signed).cast("array<bigint>"), lambda m: F.col(fp).bitwiseXOR(m))


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (``src``, ``dst``) that connect all fingerprints within ``radius`` bits.

    Every distinct ``fp`` emits the values within half the radius; two
    fingerprints are within the radius exactly when they emit a common one. Those
    that meet at a value are all within the radius of each other, so linking each
    to the least of them loses no connection, and a value gathers no more
    fingerprints than a ball has members. Links are deduplicated and verified.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    from pyspark.sql import Window

    variants = fps.select("fp").distinct().select("fp", F.explode(ball("fp", radius // 2)).alias("variant"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).filter("fp <> least")
    links = met.select(F.col("fp").alias("src"), F.col("least").alias("dst")).distinct()
    return links.filter(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2
) -> DataFrame:
    """Near-duplicate classes: ``doc_id``, ``fingerprint`` (hex), ``component_id``, ``n_star_links``.

    ``component_id`` is the least id reachable over fingerprints that differ in at
    most ``radius`` bits; ``n_star_links`` counts the links by which a class
    was found (stars around least fingerprints, not all pairs within ``radius``), 0 for one fingerprint. Equal texts
    share a fingerprint and collapse before anything is linked, so large groups
    of copies cost one fingerprint. Empty and null texts have fingerprint 0 and
    link like any other. A row whose id is null is returned with a null
    component. Rows repeated under one id are each returned. Extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, size))
    nodes = rows.filter("id is not null").groupBy("fp").agg(F.min("id").alias("first_id"))
    nodes = checkpointed(nodes)
    links = checkpointed(fingerprint_links(nodes, radius))
    label = connected_components(links)
    linked = nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    stars = links.join(label.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("n_star_links"))
    classes = linked.join(least, "component").join(stars, "component", "left")
    classes = classes.select(rejoin_key("fp").alias("k"), "component_id", F.coalesce("n_star_links", F.lit(0)).alias("n_star_links"))
    return (
        rows.withColumn("k", rejoin_key("fp"))
        .join(classes, "k", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
            F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
            F.when(F.col("id").isNotNull(), F.col("n_star_links")).alias("n_star_links"),
        )
    )
