"""What each of several filters removes, for every order of applying them."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rejoin_key

#: White space that parts words, and how Spark's expressions see a null text.
SPACES = "\t\n\x0b\x0c\r"


def quality_filters(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails, by letter; a null text counts as empty.

    A: under 200 words; B: under half of its words are different; C: over 3 % of its code
    points are ``[A-Z]``; D: it holds any of ``#$%&*|``. Words are maximal runs of
    ``[^\\x20\\x09-\\x0D]``, case-sensitive.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each document: ``part, mask, good, toxic``; bit k of ``mask`` is set if it fails the k-th filter of ABCDE.

    E: the text is that of any smaller id, removed or not. A document without an id fails no E
    and makes none fail; rows of one id aren't copies of each other. Texts are told apart by
    a 128-bit digest. A null part becomes the empty string. ``good`` and ``toxic`` say whether
    any label of the id is ``quality=1`` or ``toxic=1``; labels repeated under an id count once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    flags = list(quality_filters(F.col(text_col)).values())
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(flags)), F.lit(0))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        mask.alias("four"), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    )
    # Both sides of each join are dealt anew, so that adaptive execution can split a hot text or id.
    keyed = rows.withColumn("k", F.xxhash64("digest"))
    first = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1 AND first IS NOT NULL")
    first = first.select(F.xxhash64("digest").alias("of"), F.col("digest").alias("same"), "first")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    rows = keyed.join(first, (F.col("k") == F.col("of")) & (F.col("digest") == F.col("same")), "left").select(
        "id", "k", "part", F.when(copy, F.col("four") + (1 << len(flags))).otherwise(F.col("four")).alias("mask")
    )
    known = labels.select(F.col(id_col).cast("long").alias("of"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    known = known.filter("of IS NOT NULL").groupBy("of").agg(F.bool_or("q").alias("q"), F.bool_or("t").alias("t"))
    known = known.select(rejoin_key("of").alias("of"), "q", "t")
    has = F.col("id").isNotNull()
    keyed = rows.withColumn("k", F.coalesce(rejoin_key("id"), "k"))
    return keyed.join(known, F.col("k") == F.col("of"), "left").select(
        "part", "mask", (F.coalesce("q", F.lit(False)) & has).alias("good"), (F.coalesce("t", F.lit(False)) & has).alias("toxic")
    )


def order_audit(failed: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """What each step of every order of the filters keeps and removes, for each part.

    ``failed`` is as ``failures`` returns it. Documents alike in part, mask and labels are
    counted together, then add to the edges of the lattice of filter sets: one for every set
    already applied and next filter, 80 for five filters. A step of an order is the edge
    from the set of the letters before it, so each order is a path, and its steps are
    joined to the edges. Returns ``part, filter_order, step`` with ``kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley``; ``shapley`` sums what
    the step's filter removes over all orders. A part without failures has zeros; no
    documents, no rows.
    """
    spark, n = failed.sparkSession, len(letters)
    cells = failed.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("docs"))
    # Orders that go through an edge: those of the letters before it times those of the letters after.
    edges = [
        (applied, k, math.factorial(applied.bit_count()) * math.factorial(n - 1 - applied.bit_count()))
        for applied in range(1 << n) for k in range(n) if not applied >> k & 1
    ]
    grid = F.array(*(F.struct(F.lit(a).alias("applied"), F.lit(k).alias("k"), F.lit(1 << k).alias("own"), F.lit(w).cast("long").alias("paths")) for a, k, w in edges))
    each = cells.select("*", F.explode(grid).alias("e")).select("part", "mask", "good", "toxic", "docs", "e.*")
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    reached = F.col("mask").bitwiseAND(F.col("applied")) == 0
    count = lambda when: F.sum(F.when(when, F.col("docs")).otherwise(0))
    lattice = each.groupBy("part", "applied", "k", "paths").agg(
        count(reached & ~fails).alias("kept"), count(reached & fails).alias("removed"), count(~reached & fails).alias("redundant"),
        count(F.col("mask") == F.col("own")).alias("unique_fails"), count(reached & fails & F.col("good")).alias("good_lost"),
        count(reached & fails & F.col("toxic")).alias("toxic_lost"),
    )
    total = lattice.groupBy("part", "k").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    steps = [
        ("".join(letters[k] for k in order), place + 1, sum(1 << k for k in order[:place]), order[place])
        for order in itertools.permutations(range(n)) for place in range(n)
    ]
    paths = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, applied int, k int"))  # n * n! rows, whatever the data
    return lattice.join(total, ["part", "k"]).join(paths, ["applied", "k"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``order_audit`` of the five filters over whole documents by language."""
    return order_audit(failures(docs, labels))
