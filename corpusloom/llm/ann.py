"""Approximate nearest neighbours by a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_importable
from .common import stored

#: Vectors that the tree is fitted on, at most; every vector is indexed.
SAMPLE = 20_000
BRANCHES = 8
#: A node with at most so many sample vectors is a leaf; the largest nodes of at most so many are cells.
LEAF = 16
CELL = 1_000
#: Queries that calibrate the number of leaf visits, at most.
PROBES = 200
RECALL = 0.95
#: Vectors of one cell, and queries, that one task scores together, about.
BLOCK = 10_000
QUERY_BLOCK = 1_000


@dataclass
class Tree:
    """Nodes by number; ``children[k]`` are the nodes below k, none for a leaf.

    Leaves are what a search visits; ``cells[leaf]`` is the subtree that a leaf is scored
    with, so that a query goes once to each cell and not to each leaf.
    """

    centers: np.ndarray
    children: list[list[int]]
    leaves: dict[int, int]
    cells: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 11) -> Tree:
        rng = np.random.default_rng(seed)
        centers, children, leaves, cells = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]], {}, []
        todo, made = [(0, np.arange(len(x)), -1)], 0
        while todo:
            node, rows, cell = todo.pop()
            parts = _kmeans(x[rows], min(BRANCHES, len(rows)), rng) if len(rows) > LEAF else []
            if cell < 0 and (len(rows) <= CELL or len(parts) < 2):
                cell, made = made, made + 1
            if len(parts) < 2:
                leaves[node] = len(leaves)
                cells.append(cell)
                continue
            for center, members in parts:
                children[node].append(len(centers))
                todo.append((len(centers), rows[members], cell))
                centers.append(center)
                children.append([])
        return cls(np.array(centers), children, leaves, np.array(cells))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf reached by going to the nearest child at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaves[node]
                continue
            near = _distances(x[rows], self.centers[kids]).argmin(1)
            todo += [(kid, rows[near == j]) for j, kid in enumerate(kids) if (near == j).any()]
        return out

    def best_bins(self, q: np.ndarray, most: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves by a queue of nodes, nearest first, and more until they hold ``least`` ids by ``held``."""
        queue, out, ids = [(0.0, 0)], [], 0
        while queue and (len(out) < most or (held is not None and ids < least)):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            while kids:
                d = _distances(q[None], self.centers[kids])[0]
                for v, kid in sorted(zip(d.tolist(), kids, strict=True))[1:]:
                    heapq.heappush(queue, (v, kid))
                node = kids[int(d.argmin())]
                kids = self.children[node]
            out.append(self.leaves[node])
            ids += held.get(out[-1], 0) if held is not None else 0
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1) - 2 * x @ c.T


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centers with their members; fewer than k if vectors coincide."""
    centers = x[[rng.integers(len(x))]]
    far = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < k and far.max() > 1e-12:
        centers = np.vstack([centers, x[rng.choice(len(x), p=far / far.sum())]])
        far = np.minimum(far, ((x - centers[-1]) ** 2).sum(1))
    for _ in range(steps):
        near = _distances(x, centers).argmin(1)
        used = [j for j in range(len(centers)) if (near == j).any()]
        moved = np.array([x[near == j].mean(0) for j in used])
        if len(moved) == len(centers) and np.allclose(moved, centers):
            break
        centers = moved
    near = _distances(x, centers).argmin(1)
    return [(centers[j], np.flatnonzero(near == j)) for j in range(len(centers)) if (near == j).any()]


def valid(name: str | Column) -> Column:
    """Vectors that take part: not null or zero, and without null or non-finite components."""
    c = F.col(name) if isinstance(name, str) else name
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return c.isNotNull() & ~odd & F.exists(c, lambda v: v != 0)


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(vectors.tolist(), np.float64)
    return x, x / np.sqrt((x * x).sum(1))[:, None]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision."""
    return (q @ x.T) / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None]


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """The ``k`` nearest other ids of every query by cosine: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on a column ``id``. The tree is fitted on a bounded
    sample of unit vectors, chosen by a hash of the id, and every row is put in its
    leaf. For at most ``PROBES`` queries the true neighbours among all rows are
    found by brute force, block by block; the rank in best-bin-first order of the
    leaves that hold them gives the recall for each number of visits, and the least
    number that reaches ``recall`` holds for all queries; one whose leaves hold fewer
    than ``k + 1`` ids goes on until they do.

    An id is one query and one candidate: if rows with different vectors share it, it gets
    one list, and two ids are as near as the nearest of their vectors. Rows repeated
    under one id with one vector count once. Equal vectors collapse: each keeps its
    ``k + 1`` smallest ids, which are all that can be among the nearest, and is searched
    once, so groups of copies stay small. A cell with many vectors is cut into blocks, as
    are its queries. Vectors null, zero, or with null or non-finite components take no
    part, nor rows with a null id or another dimension than the most common. Ties go
    to the smaller id. Fewer candidates give fewer rows; an empty table gives none. Other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    ensure_importable(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & valid("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    shape = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], shape)
    rows = rows.filter(F.size("v") == sizes.d)
    # One row for each different vector; its ids beyond the first k + 1 are only needed if they are queries.
    keyed = rows.select("id", "v").distinct().withColumn("h", F.xxhash64("v"))
    distinct = stored(_least_ids(keyed, k + 1), "vectors")
    asked = stored(keyed.filter(is_query).select("id", "h", "v"), "queries")
    sample = distinct.orderBy(F.xxhash64("key"), "key", "v").limit(SAMPLE).select("v").toPandas()
    tree = Tree.fit(_unit(sample["v"])[1])
    shared = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("long")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaf_of(_unit(v)[1]) if len(v) else [], dtype="int64")

    cell_of = F.pandas_udf(lambda leaf: pd.Series(shared.value.cells[leaf.to_numpy()], dtype="int64"), "long")
    index = stored(distinct.withColumn("leaf", leaf_of("v")).withColumn("cell", cell_of("leaf")), "index")
    visits = _calibrated(asked, index, tree, k, recall)
    # Ids that a leaf holds, each in one leaf only and more than k + 1 of a vector aside: a number for each leaf of the tree.
    homes = index.select(F.explode("ids").alias("id"), "leaf").groupBy("id").agg(F.min("leaf").alias("leaf"))
    full = {r.leaf: r.n for r in homes.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    # Each different vector is one question; its number is kept in a table.
    questions = stored(asked.select("h", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "questions")

    @F.pandas_udf("array<array<long>>")
    def bins_of(v: pd.Series) -> pd.Series:
        return pd.Series([_by_cell(shared.value, shared.value.best_bins(x, visits, full, k + 1)) for x in _unit(v)[1]] if len(v) else [], dtype=object)

    posed = questions.select("q", F.col("v").alias("qv"), F.explode(bins_of("v")).alias("bins"))
    posed = posed.select("q", "qv", F.col("bins")[0].alias("cell"), F.expr("slice(bins, 2, size(bins) - 1)").alias("leaves"))
    held = index.groupBy("cell").agg(F.count("*").alias("n"))
    asks = posed.groupBy("cell").agg(F.count("*").alias("m"))
    # A row for each cell of the tree: bounded, whatever the data.
    grid = F.broadcast(held.join(asks, "cell").select(
        "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("mb")
    ))
    left = posed.join(grid, "cell").withColumn("qb", F.pmod(F.xxhash64("q"), "mb").cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    right = index.join(grid, "cell").withColumn("vb", F.pmod(F.xxhash64("v"), "nb").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
    keep = k + 1

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "vec_id": [], "score": []})
        q, v = np.array(a["qv"].tolist()), np.array(b["v"].tolist())
        s = np.full((len(q), len(v)), -np.inf)
        wants: dict[int, list[int]] = {}
        for i, leaves in enumerate(a["leaves"]):
            for leaf in leaves.tolist():
                wants.setdefault(leaf, []).append(i)
        for leaf, at in b.groupby("leaf").indices.items():
            if leaf in wants:
                s[np.ix_(wants[leaf], at)] = _scores(q[wants[leaf]], v[at])
        return _top(a["q"].tolist(), s, b["ids"].tolist(), keep)[["q", "vec_id", "score"]]

    some = left.select("cell", "qb", "vb", "q", "qv", "leaves").groupBy("cell", "qb", "vb").cogroup(
        right.select("cell", "qb", "vb", "v", "ids", "leaf").groupBy("cell", "qb", "vb")
    ).applyInPandas(score, "q long, vec_id long, score double")
    some = some.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    top = some.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= keep)
    lists = top.groupBy("q").agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))
    # All ids of a query vector get its list, and an id of several vectors the best of theirs, without themselves.
    every = asked.join(questions, ["h", "v"]).select("id", "q").join(lists, "q").select("id", F.explode("found").alias("hit"))
    every = every.filter("hit.vec_id <> id").groupBy(F.col("id").alias("query_id"), F.col("hit.vec_id").alias("vec_id")).agg(F.max("hit.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_cell(tree: Tree, leaves: list[int]) -> list[list[int]]:
    """Leaves with the cell they are scored in first."""
    out: dict[int, list[int]] = {}
    for leaf in leaves:
        out.setdefault(int(tree.cells[leaf]), []).append(leaf)
    return [[cell, *found] for cell, found in out.items()]


def _least_ids(keyed: DataFrame, most: int) -> DataFrame:
    """Each vector with its ``most`` smallest ids; copies are thinned in salted groups first."""
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["h", "v", "salt"], ["h", "v"]):
        near = Window.partitionBy(*by).orderBy("id")
        salted = salted.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= most)
    return salted.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", "ids", F.col("ids")[0].alias("key"))


def _top(q: list[int], s: np.ndarray, ids: list, keep: int, own: list[int] | None = None) -> pd.DataFrame:
    """The ``keep`` best ids (score, then id) of every query, without its own; ``row`` is the vector. Scores of minus infinity don't count."""
    out = []
    for i, name in enumerate(q):
        row, most = s[i], keep
        while True:
            most = min(most, len(row))
            floor = max(np.partition(row, len(row) - most)[len(row) - most], -1e300)
            best: dict[int, tuple[float, int]] = {}
            for x, j in sorted((-row[j], j) for j in np.flatnonzero(row >= floor).tolist()):
                for at in ids[j]:
                    if own is None or at != own[i]:
                        best.setdefault(int(at), (x, j))
            if len(best) >= keep or most == len(row):
                break
            most *= 4  # several of these vectors share ids
        hits = sorted((x, at, j) for at, (x, j) in best.items())[:keep]
        out += [(name, at, -x, j) for x, at, j in hits]
    return pd.DataFrame(out, columns=["q", "vec_id", "score", "row"])


def _calibrated(asked: DataFrame, index: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaf visits that reach the recall on a bounded number of queries, answered by brute force over all rows."""
    probes = asked.orderBy(F.xxhash64("id", F.lit(3)), "id", "v").limit(PROBES).toPandas()
    leaves = len(tree.leaves)
    if not len(probes) or leaves == 1:
        return 1
    own, v = probes["id"].tolist(), np.array(probes["v"].tolist())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                found = _top(list(range(len(own))), _scores(v, np.array(b["v"].tolist())), b["ids"].tolist(), k, own)
                yield found.assign(leaf=b["leaf"].to_numpy()[found["row"].to_numpy(int)]).drop(columns="row")

    every = index.select("v", "ids", "leaf").mapInPandas(run, "q long, vec_id long, score double, leaf long")
    every = every.groupBy("q", "vec_id").agg(F.max_by("leaf", F.struct("score", "leaf")).alias("leaf"), F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    truth = every.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("q", "leaf").toPandas()
    order = [{leaf: n for n, leaf in enumerate(tree.best_bins(x / np.sqrt((x * x).sum()), leaves))} for x in v]
    ranks = np.sort([order[i][leaf] for i, leaf in zip(truth["q"].tolist(), truth["leaf"].tolist(), strict=True)])
    if not len(ranks):
        return 1
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1
