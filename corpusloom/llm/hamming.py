"""Exact top-k search of binary codes by incremental multi-index hashing."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann import valid
from .common import checkpointed

BITS = 64


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``code``: a bit for each positive component of a vector of 64; others take no part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("v") == BITS) & valid("v"))
    bits = F.transform("v", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")).alias("b"))
    code = F.lit(0).cast("long")
    for i in range(BITS):
        code = code.bitwiseOR(F.shiftleft(F.get("bits", F.lit(i)), i))
    return rows.withColumn("bits", bits).select("id", code.alias("code"))


def _segments(count: int) -> list[tuple[int, int]]:
    """Start and width of each segment: as many values as there are codes, about."""
    number = max(1, math.ceil(BITS / min(16, max(8, round(math.log2(max(2, count)))))))
    cuts = [BITS * k // number for k in range(number + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def _part(code: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << width) - 1))


def _ball_edge(seg: int, start: int, width: int, radius: int) -> Column:
    """The values at exactly ``radius`` bits from a query's own in one segment."""
    masks = [sum(1 << b for b in bits) for bits in itertools.combinations(range(width), radius)]
    own = _part(F.col("q"), start, width)
    values = F.transform(F.lit(masks).cast("array<bigint>"), lambda m: own.bitwiseXOR(m))
    return F.struct(F.lit(seg).alias("seg"), values.alias("values"))


def nearest_codes(codes: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The ``k`` nearest other rows of each query by Hamming distance: ``query_id, rank, vec_id, distance``.

    ``codes`` has ``id`` and a 64-bit ``code``; ``is_query`` is a condition on ``id``.
    Codes are cut into m segments, each indexed. In round r a query probes every
    segment with all values at exactly r bits from its own. After round r every code
    within m(r+1)-1 is found, since one farther than r in all segments is farther in
    all. A query is answered when its k-th distance is covered so; the others
    go on. A pair comes up once: in the round of its nearest segment, by the
    first such segment.

    Equal codes collapse to their k + 1 smallest ids, and so do queries. Ties go to
    the smaller id. Fewer candidates give fewer rows. Rows with a null id or code take
    no part; rows repeated under one id and code count once.
    """
    rows = codes.filter("id is not null and code is not null").select("id", "code").distinct()
    near = Window.partitionBy("code", "salt").orderBy("id")
    thin = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    thin = thin.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k + 1)
    ids = thin.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    index = checkpointed(ids)
    asked = checkpointed(rows.filter(is_query))
    count = index.count()
    total = rows.select("id").distinct().count()
    segments = _segments(count)
    parts = [F.struct(F.lit(s).alias("seg"), _part(F.col("code"), a, w).alias("value")) for s, (a, w) in enumerate(segments)]
    cells = checkpointed(index.select("code", "ids", F.explode(F.array(*parts)).alias("c")).select("code", "ids", "c.seg", "c.value"))
    # A query's state: the distance that a candidate must not exceed, and its k + 1 best (distance, id).
    state = asked.select(F.col("code").alias("q")).distinct().select(
        "q", F.lit(BITS).alias("bound"), F.array().cast("array<struct<d:int,id:bigint>>").alias("best")
    )
    state = checkpointed(state)
    finished = []
    for r in range(max(w for _, w in segments) + 1):
        probes = [_ball_edge(s, a, w, r) for s, (a, w) in enumerate(segments) if r <= w]
        asks = state.select("q", "bound", F.explode(F.array(*probes)).alias("p")).select("q", "bound", "p.seg", F.explode("p.values").alias("value"))
        apart = F.col("q").bitwiseXOR(F.col("code"))
        distance = F.bit_count(apart)
        gaps = [F.bit_count(_part(apart, a, w)) for a, w in segments]
        once = F.lit(True)
        for s, gap in enumerate(gaps):
            once = once & (gap > F.when(F.col("asks.seg") > s, F.lit(r)).otherwise(F.lit(r - 1)))
        found = asks.alias("asks").join(
            cells.alias("cells"),
            (F.col("asks.seg") == F.col("cells.seg")) & (F.col("asks.value") == F.col("cells.value")) & (distance <= F.col("bound")) & once,
        ).select("q", F.explode("ids").alias("id"), distance.cast("int").alias("d"))
        top = Window.partitionBy("q").orderBy("d", "id")
        found = found.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1)
        new = found.groupBy("q").agg(F.collect_list(F.struct("d", "id")).alias("new"))
        covered = sum(1 for _, w in segments) * (r + 1) - 1
        merged = F.slice(F.sort_array(F.concat("best", F.coalesce("new", F.expr("cast(array() as array<struct<d:int,id:bigint>>)")))), 1, k + 1)
        state = state.join(new, "q", "left").select("q", merged.alias("best"))
        full = F.size("best") >= min(k + 1, total)
        kth = F.element_at("best", -1)["d"]
        state = checkpointed(state.select("q", F.when(full, kth).otherwise(F.lit(BITS)).alias("bound"), "best", (full & (kth <= covered)).alias("done")))
        finished.append(state.filter("done").select("q", "best"))
        state = state.filter("not done").select("q", "bound", "best")
        if state.isEmpty():
            break
    answers = finished[0]
    for more in finished[1:]:
        answers = answers.unionAll(more)
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)
    every = asked.join(answers, asked["code"] == answers["q"])
    return every.select(F.col("id").alias("query_id"), F.posexplode(own).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.d").alias("distance")
    )
