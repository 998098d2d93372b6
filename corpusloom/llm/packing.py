"""Variable-capacity best-fit packing of texts into training sequences."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Permitted sequence lengths in tokens.
CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces that one task packs together, about; more pieces only make more groups.
GROUP = 20_000


def sequence_cost(capacity: int) -> float:
    """Cost of training on one sequence: linear layers, and attention that grows with its square."""
    return capacity * (1 + capacity / 16384)


def pack(
    lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost
) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and every bin's final capacity.

    Pieces go longest first, ties as given, to the open bin that they leave
    with least room; ties to the bin opened first. If none has room, one is
    opened: of the capacities that hold the piece, the one whose cost for each
    token is least if it fills up with what is left of shorter pieces; ties to the smaller.
    When all are placed, each bin shrinks to the least capacity that holds its
    contents. No piece may be longer than the largest capacity; a
    piece of length 0 takes no room.
    """
    caps = sorted(set(capacities))
    size = np.asarray(lengths, np.int64)
    if len(size) and size.max() > caps[-1]:
        raise ValueError("a piece is longer than the largest capacity")
    order = np.lexsort((np.arange(len(size)), -size))
    down = size[order]
    left = np.append(np.cumsum(down[::-1])[::-1], 0)  # tokens of this piece and all after it
    up = -down
    bins, offsets = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]  # bins by room, as heaps
    some = 0  # bit r is set if a bin has room r
    used: list[int] = []
    limit: list[int] = []
    for k, i in enumerate(order.tolist()):
        n = int(down[k])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = heapq.heappop(room[r])
            if not room[r]:
                some &= ~(1 << r)
        else:
            best = None
            for c in caps:
                if c >= n:
                    shorter = max(k + 1, int(np.searchsorted(up, -(c - n))))
                    filled = n + min(c - n, int(left[shorter]))
                    per_token = cost(c) / max(1, filled)
                    if best is None or per_token < best[0] - 1e-12:
                        best = (per_token, c)
            b, r = len(used), best[1]
            used.append(0)
            limit.append(r)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        r -= n
        heapq.heappush(room[r], b)
        some |= 1 << r
    return bins, offsets, [next(c for c in caps if c >= u) for u in used]


def measured(docs: DataFrame, length: Column) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row, kept in the shared folder so that texts are counted once."""
    return stored(docs.select("doc_id", length.cast("long").alias("n_tokens")), "lengths")


def pieces(docs: DataFrame, length: Column, largest: int) -> DataFrame:
    """Texts cut to at most ``largest`` tokens: ``doc_id, piece, piece_start, length``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    count = F.greatest(F.ceil(F.col("n") / largest), F.lit(1)).cast("int")
    cut = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return cut.select("doc_id", "piece", start.alias("piece_start"), F.least(F.lit(largest), F.col("n") - start).cast("int").alias("length"))


def best_fit_packing(
    docs: DataFrame, length: Column, capacities: Sequence[int] = CAPACITIES, group: int = GROUP
) -> DataFrame:
    """Packs every text: ``doc_id, piece, piece_start, length, bin_id, bin_offset, bin_capacity``.

    ``length`` gives a text's tokens. Texts longer than the largest capacity are cut
    into full pieces and a rest. Pieces are dealt by a hash of id and piece to groups
    of about ``group`` and each is packed by ``pack``; a bin's id is its group's
    number times 2^32 plus its number there. Nothing about a group depends on
    a text's source or length, so groups stay even. Null and empty texts are
    pieces of length 0 and take no room. Rows with a null id are packed too; repeated
    rows are each packed.
    """
    largest = max(capacities)
    cut = pieces(docs, length, largest)
    spread = F.xxhash64("doc_id", "piece", "length")
    number = max(1, -(-cut.count() // group))

    def run(table: pa.Table) -> pa.Table:  # Arrow, as a null id would turn a pandas column into floats
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "length")])
        bins, offsets, finals = pack(table["length"].to_numpy(), capacities)
        made = {
            "bin_id": pa.array((table["g"][0].as_py() << 32) + bins), "bin_offset": pa.array(offsets, pa.int32()),
            "bin_capacity": pa.array(np.asarray(finals, np.int32)[bins]),
        }
        kept = ["doc_id", "piece", "piece_start", "length"]
        return pa.table([*(table[c] for c in kept), *made.values()], names=[*kept, *made])

    shape = "doc_id long, piece int, piece_start long, length int, bin_id long, bin_offset int, bin_capacity int"
    return cut.withColumn("g", F.pmod(spread, F.lit(number)).cast("int")).groupBy("g").applyInArrow(run, shape)
