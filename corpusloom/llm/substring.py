"""Substring dedup: units of lines are hashed, grouped globally, and later occurrences removed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rejoin_key, small_batches, stored

#: A unit ends after a word whose own and predecessor's hash has its lowest bits zero: one word in 8.
ANCHOR_MASK = np.uint64(7)
#: Words of consecutive repeated units that are removed; below this a repeat is common language.
MIN_WORDS = 24
#: Words of a window that is hashed, and neighbouring windows of which the least is taken: any MIN_WORDS words hold one taken.
WINDOW, CHOICE = 13, 12
#: Words compared one by one on either side of a matched window.
CONTEXT = 24
#: Whole lines have their words and offsets; windows have zeros there.
PLACES = "id long, at int, words int, start int, stop int, digest long"
LINE_SEED = 1
EDGES = "id long, left boolean, at int, hashes array<int>, chars array<int>"
UNITS = "id long, unit int, start int, stop int, words int, digest long"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def units_of(text: bytes) -> tuple[np.ndarray, ...]:
    """Units of a UTF-8 text: start and stop in characters, number of words, digest.

    Words are runs of bytes other than ASCII white space, A-Z as a-z. A unit ends at
    the end of its line, or inside a line after a word that is an anchor, which only
    this word and the one before it decide. So a passage has the same units wherever
    it stands, spliced into the middle of another line too. The digest is the XXH64
    of the unit's words joined by single spaces.
    """
    raw = np.frombuffer(text, np.uint8)
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    joined = text.lower().split()
    words = np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64, len(joined))
    mixed = words * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    pair = (mixed + np.roll(mixed, 1) * np.uint64(3)) * np.uint64(0x165667B19E3779F9)
    feeds = np.flatnonzero(raw == 10)
    last = np.ones(len(begin), bool)
    last[:-1] = (((pair >> np.uint64(40)) & ANCHOR_MASK) == 0)[:-1] | (np.searchsorted(feeds, end[:-1]) != np.searchsorted(feeds, begin[1:]))
    stop = np.flatnonzero(last)
    start = np.append(0, stop[:-1] + 1)
    sizes = np.cumsum([0, *(len(w) + 1 for w in joined)])
    joined = b" ".join(joined)
    digests = np.fromiter(
        (xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(sizes[start].tolist(), (sizes[stop + 1] - 1).tolist(), strict=True)), np.uint64, len(stop)
    )
    inside = np.flatnonzero((raw & 0xC0) == 0x80)
    first, past = begin[start], end[stop]
    return first - np.searchsorted(inside, first), past - np.searchsorted(inside, past), stop - start + 1, digests.view(np.int64)


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each unit of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, parts = [], []
                for i, t in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256), strict=True):
                    got = units_of(t.as_py())
                    ids.append(np.full(len(got[0]), i, np.int64))
                    parts.append((np.arange(len(got[0])), *got))
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                kinds = [pa.int32()] * 4 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["id", "unit", "start", "stop", "words", "digest"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.filter("id is not null and t is not null and length(t) > 0").mapInArrow(run, UNITS)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """Spans of texts that repeat an earlier occurrence: ``doc_id, start, stop, words, kept_doc_id, kept_start``.

    Offsets are in characters of the original text, ``stop`` exclusive. Occurrences
    rank by (doc_id, place in the text); the first of each unit stays. Consecutive
    repeated units make one span, which counts if it has ``min_words`` words. A kept
    occurrence is named by the span's first unit. Empty, null and blank texts and
    rows without an id have no spans. Rows repeated under one id count as one text
    where they agree: rows with the same id and place don't repeat each other. A hot
    unit is summed before the shuffle and joined by a join that adaptive execution
    splits; spans are built within a text only.
    """
    every = stored(units(docs, id_col, text_col), "units")
    first = every.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "unit", "start")).alias("first"))
    first = first.filter("n > 1").select(rejoin_key("digest").alias("k"), "first")
    again = (
        every.withColumn("k", rejoin_key("digest"))
        .join(first, "k")
        .filter("not (id = first.id and unit = first.unit)")
        .select("id", "unit", "start", "stop", "words", "first")
        .distinct()
    )
    runs = again.withColumn("run", F.col("unit") - F.dense_rank().over(Window.partitionBy("id").orderBy("unit")))
    spans = runs.groupBy("id", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").cast("long").alias("words"),
        F.min_by("first", "unit").alias("first"),
    )
    return spans.filter(F.col("words") >= min_words).select(
        F.col("id").alias("doc_id"), "start", "stop", "words",
        F.col("first.id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"),
    )


def _split(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Bytes of a text, first and past byte of each word, and the words, A-Z as a-z."""
    raw = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]])))
    return raw, edge[::2], edge[1::2], text.lower().split()


def lines_of(text: bytes) -> tuple[np.ndarray, ...]:
    """Whole lines of a UTF-8 text: index of the first word, words, start, stop, digest; blank lines are none."""
    raw, begin, end, words = _split(text)
    if not len(begin):
        return (np.zeros(0, np.int64),) * 5
    feeds = np.flatnonzero(raw == 10)
    last = np.append(np.flatnonzero(np.searchsorted(feeds, end[:-1]) != np.searchsorted(feeds, begin[1:])), len(begin) - 1)
    at = np.append(0, last[:-1] + 1)
    digests = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[a : b + 1]), LINE_SEED) for a, b in zip(at.tolist(), last.tolist(), strict=True)), np.uint64, len(at))
    inside = np.flatnonzero((raw & 0xC0) == 0x80)
    first, past = begin[at], end[last]
    return at, last - at + 1, first - np.searchsorted(inside, first), past - np.searchsorted(inside, past), digests.view(np.int64)


def places_of(text: bytes) -> tuple[np.ndarray, ...]:
    """Lines of a UTF-8 text, and its windows with zeros for what only lines have."""
    at, digests = windows_of(text)
    none = np.zeros(len(at), np.int64)
    return tuple(np.concatenate(x) for x in zip(lines_of(text), (at, none, none, none, digests), strict=True))


def windows_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a UTF-8 text that stand for its passages: index of the first word, digest.

    Of each ``CHOICE`` neighbouring windows of ``WINDOW`` words the one of least digest
    is taken (winnowing). Only words of a passage decide about windows inside it, none
    is further than ``CHOICE`` words from the next, and a text of one repeated word has some.
    """
    words = text.lower().split()
    m = len(words) - WINDOW + 1
    if m < CHOICE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    digests = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        digests = digests * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
    for shift in (29, 32):
        digests = (digests ^ (digests >> np.uint64(shift))) * np.uint64(0xC2B2AE3D27D4EB4F)
    near = np.lib.stride_tricks.sliding_window_view(digests, CHOICE)
    at = np.unique(near.argmin(1) + np.arange(len(near)))
    same = digests[at[1:]] == digests[at[:-1]]
    if same.any():  # inside a run of equal windows, as in one word over and over, one in CHOICE words is enough
        kept, last, places = [], -CHOICE, at.tolist()
        inner = np.concatenate([[False], same[:-1] & same[1:], [False]]).tolist()
        for k, x in enumerate(places):
            if not inner[k] or places[k + 1] - last > CHOICE:
                kept.append(x)
                last = x
        at = np.array(kept)
    return at, digests[at].view(np.int64)


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each place of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, parts = [], []
                for i, t in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256), strict=True):
                    got = places_of(t.as_py())
                    ids.append(np.full(len(got[0]), i, np.int64))
                    parts.append(got)
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                kinds = [pa.int32()] * 4 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["id", "at", "words", "start", "stop", "digest"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.filter("id is not null and t is not null and length(t) > 0").mapInArrow(run, PLACES)


def _edges(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Words before (``left``) or after a window, nearest first, with the offset a passage has that takes so many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 64):
                out = []
                for i, t, asked in zip(*(b.column(c).slice(low, 64).to_pylist() for c in range(3)), strict=True):
                    raw, begin, end, words = _split(t)
                    inside = np.flatnonzero((raw & 0xC0) == 0x80)
                    for q in asked:
                        at = q["at"]
                        if at + WINDOW > len(words):  # another row of this id
                            continue
                        if q["left"]:
                            near = words[max(0, at - CONTEXT) : at][::-1]
                            chars = begin[at - len(near) : at + 1][::-1]
                        else:
                            near = words[at + WINDOW : at + WINDOW + CONTEXT]
                            chars = end[at + WINDOW - 1 : at + WINDOW + len(near)]
                        hashes = np.fromiter(map(xxhash.xxh64_intdigest, near), np.uint64, len(near)).astype(np.uint32).view(np.int32)
                        out.append((i, q["left"], at, hashes, (chars - np.searchsorted(inside, chars)).astype(np.int32)))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "left", "at", "hashes", "chars"])

    asked = wanted.groupBy("id").agg(F.collect_set(F.struct("left", "at")).alias("asked")).withColumnRenamed("id", "_asked_id")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).filter("t is not null")
    return rows.join(asked, F.col("id") == F.col("_asked_id")).select("id", "t", "asked").mapInArrow(run, EDGES)


def _repeated(every: DataFrame) -> DataFrame:
    """Places whose digest an earlier place has, with the earliest as ``first``."""
    first = every.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "at", "start")).alias("first"))
    first = first.filter("n > 1").select(rejoin_key("digest").alias("k"), "first")
    return every.withColumn("k", rejoin_key("digest")).join(first, "k").filter("not (id = first.id and at = first.at)").drop("k", "digest").distinct()


def _matches(docs: DataFrame, again: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Repeated windows joined where they follow each other in both texts, and extended word by word to both sides."""
    apart = again.select("id", "at", F.col("first.id").alias("kept_id"), (F.col("at") - F.col("first.at")).alias("shift"))
    # a text that repeats itself within min_words keeps its first min_words words
    apart = apart.filter((F.col("id") != F.col("kept_id")) | (F.col("shift") >= min_words))
    w = Window.partitionBy("id", "kept_id", "shift").orderBy("at")
    runs = apart.withColumn("run", F.when(F.col("at") - F.lag("at").over(w) <= WINDOW, 0).otherwise(1)).withColumn("run", F.sum("run").over(w))
    runs = runs.groupBy("id", "kept_id", "shift", "run").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    ends = F.explode(F.array(*(F.struct(F.lit(left).alias("left"), F.col(c).alias("at")) for left, c in ((True, "low"), (False, "high")))))
    ends = stored(runs.select("id", "kept_id", "shift", "run", ends.alias("end")).select("id", "kept_id", "shift", "run", "end.*"), "ends")
    wanted = ends.select("id", "left", "at").unionAll(ends.select("kept_id", "left", F.col("at") - F.col("shift"))).distinct()
    edges = stored(_edges(docs, wanted, id_col, text_col), "edges")
    own, kept = (edges.select(*(F.col(c).alias(f"{side}_{c}") for c in edges.columns)) for side in ("own", "first"))
    both = ends.join(own, (F.col("id") == F.col("own_id")) & (F.col("left") == F.col("own_left")) & (F.col("at") == F.col("own_at")))
    both = both.join(kept, (F.col("kept_id") == F.col("first_id")) & (F.col("left") == F.col("first_left")) & (F.col("at") - F.col("shift") == F.col("first_at")))
    same = F.zip_with("own_hashes", "first_hashes", lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    both = both.withColumn("more", F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int"))
    # rows that share an id may differ: the least extension holds
    left = lambda c: F.max(F.when(F.col("left"), c))
    right = lambda c: F.min(F.when(~F.col("left"), c))
    more = F.col("more")
    return both.groupBy("id", "kept_id", "shift", "run").agg(
        left(F.col("at") - more).alias("a"), right(F.col("at") + WINDOW + more).alias("b"),
        left(F.get("own_chars", more)).alias("start"), right(F.get("own_chars", more)).alias("stop"), left(F.get("first_chars", more)).alias("kept_start"),
    ).select("id", "a", "b", "start", "stop", "kept_id", "kept_start")


def _islands(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``island``, the number within the text of those that touch or overlap."""
    w = Window.partitionBy("id").orderBy("a", "b", "start", "stop", "kept_id", "kept_start")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = pieces.withColumn("island", F.when(F.col("a") <= reach, 0).otherwise(1))
    return new.withColumn("island", F.sum("island").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Spans to remove, with the columns of ``repeated_spans``: whole lines, and passages of at least ``min_words`` words, that stand earlier.

    Every later occurrence of a line is removed, whatever its length; lines are equal by
    their words, A-Z as a-z. Unlike the units of ``repeated_spans``, a passage begins and ends at any
    word: windows that repeat are extended word by word in both texts. Repeats that
    touch or overlap are one span, named by the kept occurrence of its first.
    """
    if min_words < WINDOW + CHOICE - 1:
        raise ValueError("a shorter passage may hold no window")
    again = stored(_repeated(stored(places(docs, id_col, text_col), "places")), "again")
    pieces = _matches(docs, again.filter("words = 0"), id_col, text_col, min_words).withColumn("line", F.lit(False))
    lines = again.filter("words > 0").select(
        "id", F.col("at").alias("a"), (F.col("at") + F.col("words")).alias("b"), "start", "stop",
        F.col("first.id").alias("kept_id"), F.col("first.start").alias("kept_start"), F.lit(True).alias("line"),
    )
    whole = Window.partitionBy("id", "island")
    pieces = _islands(pieces.unionByName(lines)).withColumn("words", F.max("b").over(whole) - F.min("a").over(whole))
    spans = _islands(pieces.filter((F.col("words") >= min_words) | F.col("line"))).groupBy("id", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("b") - F.min("a")).cast("long").alias("words"),
        F.min_by(F.struct("kept_id", "kept_start"), F.struct("a", "b", "kept_id", "kept_start")).alias("kept"),
    )
    digest = F.coalesce(F.xxhash64(text_col), F.lit(0))
    texts = docs.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    spans = spans.join(texts.filter("low <> high"), F.col("id") == F.col("_id"), "left_anti")
    return spans.select(
        F.col("id").alias("doc_id"), "start", "stop", "words", F.col("kept.kept_id").alias("kept_doc_id"), F.col("kept.kept_start").alias("kept_start")
    )


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with their spans cut out of ``text``, all other columns as they were.

    ``n_chars``, where there is one, becomes the new text's length. A text that
    loses every word becomes empty but its row stays.
    """
    name = f"_cuts_{uuid.uuid4().hex}"  # clashes with no column
    cuts = spans.groupBy(F.col("doc_id").alias(f"{name}_id")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(name))
    joined = docs.join(cuts, F.col("doc_id") == F.col(f"{name}_id"), "left")
    starts = F.concat(F.array(F.lit(0)), F.col(f"{name}.stop"))
    ends = F.concat(F.col(f"{name}.start"), F.array(F.length("text")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, F.greatest(b - a, F.lit(0))))
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
