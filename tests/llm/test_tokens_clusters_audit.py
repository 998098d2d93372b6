"""Byte-level merges, centroid clustering and the filter audit against plain versions."""

import hashlib
import itertools
import math
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.llm import audit, bytebpe, centroids
from corpusloom.llm.common import Remembered, sized

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def merges():
    return bytebpe.Merges(bytebpe.read_ranks(RANKS), public_tokenizers.PATTERN, bytebpe.class_differences())


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def unsplit():
    return tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


# --- 12 ------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_any_text_as_the_library(merges, library, text):
    got = merges.packed(text, {})
    assert memoryview(got).cast("I").tolist() == library.encode_ordinary(text) if got else not text
    assert merges.decoded(got) == text.encode()


def test_units_without_splits_as_the_library(merges, unsplit):
    rng = random.Random(4)
    names = list(merges.ranks)
    for _ in range(3000):
        joined = b"".join(rng.choices(names, k=rng.randint(1, 8))).decode("utf-8", "ignore")
        repeated = rng.choice(["a", "ab", " ", "-", "00", "aaab", "é"]) * rng.randint(1, 90)
        for unit in (joined, repeated, "".join(rng.choices("ab \nthe", k=rng.randint(1, 50)))):
            if unit:
                assert merges.merged(unit.encode()) == unsplit.encode_ordinary(unit), unit


def test_classes_of_new_code_points_are_the_librarys(merges, library):
    rng = random.Random(5)
    odd = list(merges.stand_ins) or [0x558]
    for _ in range(100):
        text = "".join(chr(rng.choice(odd)) + rng.choice(["a", "1", " ", "!", "'s", "", "\n"]) for _ in range(50))
        assert memoryview(merges.packed(text, {})).cast("I").tolist() == library.encode_ordinary(text)


def test_a_vocabulary_with_tokens_that_no_merge_reaches():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259, b"aa": 260, b"aaa": 261}
    own = bytebpe.Merges(ranks, "(?s:.+)", {})
    known = tiktoken.Encoding("tiny", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    for n in range(1, 8):
        for unit in map("".join, itertools.product("abcx", repeat=n) if n < 7 else [("a",) * 7, tuple("xyzxyza")]):
            assert own.merged(unit.encode()) == known.encode_ordinary(unit), unit
    assert own.merged(b"xyz") == [259]
    with pytest.raises(ValueError, match="lacks single bytes"):
        bytebpe.Merges({b"a": 0}, ".", {})


def test_what_a_worker_remembers_is_small(merges, library):
    rng = random.Random(6)
    words = ["".join(rng.choices("bcdfghklmnprstvw", k=9)) for _ in range(20_000)]
    text, known = " ".join(words), {}
    merges.packed("a", known)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    got = merges.packed(text, known)
    after = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    tracemalloc.stop()
    assert after - before - len(got) < 150 * len(words)
    assert memoryview(got).cast("I").tolist() == library.encode_ordinary(text)


def test_strings_used_least_are_forgotten():
    known, made = Remembered(pa.int64(), strings=10), []

    def sizes(new):
        made.extend(new)
        return [pa.array(map(len, new), pa.int64())]

    for k in range(1, 40):
        strings = ["often", "a" * k, "often", ""]
        places, (values,) = known.found(pa.array(strings), sizes)
        assert values.take(places).to_pylist() == [len(s) for s in strings] and len(known.keys) <= 10
    assert made.count("often") == 1


def test_rows_stay_in_sized_batches():
    batches = [pa.record_batch([pa.array(range(n)), pa.array(t)], names=["a", "t"]) for n, t in ((3, ["x" * 9, None, ""]), (2, ["y" * 40, "z"]), (0, pa.array([], pa.string())))]
    got = list(sized(batches, size=20, rows=4))
    assert [b.num_rows for b in got] == [4, 1]
    assert [r for b in got for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]


def test_long_units_take_linear_time(merges):
    assert len(merges.merged(b"ab" * 200_000)) > 1000  # a quadratic way would not end


def test_encoded_table(spark, merges, library):
    rng = random.Random(6)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "don't 123 été 你好 👍🏽"), (4, "other text, same id"), (None, "no id"), (5, "word " * 300_000)]
    texts += [(10 + k, "".join(rng.choice(["tha", "ing ", "1", "é", "\n", "  ", "!"]) for _ in range(300))) for k in range(40)] + [(9, "word"), (9, "word")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, ids="clash", decoded=1) for i, t in texts], "doc_id long, text string, ids string, decoded long")
    out = bytebpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    plain = [(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in texts]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out.collect()), key=key) == sorted(plain, key=key)
    assert bytebpe.encoded(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    again = bytebpe.decoded(out.select("doc_id", "ids"), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted(p[2] for p in plain)


# --- 11 ------------------------------------------------------------------------


def plain_kmeans(rows, k, rounds):
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in rows)[:k]
    centers = [list(q) for _, q in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        found = [min(range(len(centers)), key=lambda c: (square(q, centers[c]), c)) for _, q in rows]
        if step < rounds:
            for c in range(len(centers)):
                members = [q for (_, q), at in zip(rows, found, strict=True) if at == c]
                if members:
                    centers[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    return found, [square(q, centers[c]) for (_, q), c in zip(rows, found, strict=True)], centers


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_against_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    # Few different values, so that many distances tie and clusters empty; some clusters far apart.
    spread = [1, 3, 40][seed - 1]
    base = rng.integers(-spread, spread + 1, (12, 4)) * 5
    rows = [(int(i), (base[rng.integers(12)] + rng.integers(-1, 2, 4)).tolist()) for i in range(400)]
    rows += [(0, rows[0][1]), (0, [7, 7, 7, 7]), (None, [1, 2, 3, 4]), (None, [1, 2, 3, 4])]
    frame = spark.createDataFrame(rows, "vec_id long, q array<int>").repartition(3)
    start = centroids.least_hashes(frame, 16)
    out, centers = centroids.yinyang(frame, start, 3)
    found, distance, plain = plain_kmeans(rows, 16, 3)
    assert centers.tolist() == plain
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.q, r.cluster, r.distance) for r in out.collect()), key=key) == sorted(
        ((i, q, c, d) for (i, q), c, d in zip(rows, found, distance, strict=True)), key=key
    )


def test_bounds_save_distances(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-2000, 2000, (16, 8))
    rows = [(i, (base[i % 16] + rng.integers(-20, 21, 8)).tolist()) for i in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id long, q array<int>")
    out, _ = centroids.yinyang(frame, base + 30, 3)
    # Of 4 x 16 distances a vector, 16 are of the first step; the others drop out by their bounds.
    assert out.agg(F.avg("measured")).first()[0] < 24


def test_vectors_that_take_part(spark):
    ok = [0.5 + k / 100 for k in range(64)]
    odd = [None, [], ok[:63], [*ok, 1.0], [None, *ok[1:]], [float("nan"), *ok[1:]], [float("inf"), *ok[1:]]]
    vectors = spark.createDataFrame([Row(vec_id=i, embedding=v, cluster="x", q=1) for i, v in enumerate([ok, *odd, [-x for x in ok]])], "vec_id long, embedding array<float>, cluster string, q long")
    rows = centroids.quantised(vectors)
    kept = {r.vec_id: r.q for r in rows.collect()}
    assert set(kept) == {0, 8}
    assert kept[8] == [math.floor(64 * float(np.float32(-x))) for x in ok]
    out = centroids.clustered(rows, centroids.least_hashes(rows, 16), 3).collect()
    assert {(r.distance, r.cluster_inertia, r.inertia) for r in out} == {(0, 0, 0)} and len({r.cluster for r in out}) == 2
    none = rows.limit(0)
    assert centroids.clustered(none, centroids.least_hashes(none, 16), 3).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.quantised(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()


# --- 13 ------------------------------------------------------------------------


def plain_audit(docs, labels):
    words = [[w for w in (t or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w] for _, t, _ in docs]
    out = {}
    fails = []
    for (i, t, _), w in zip(docs, words, strict=True):
        t = t or ""
        f = {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        f |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            f.add("E")
        fails.append(f)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for part in {p or "" for _, _, p in docs}:
        here = [(i, f) for (i, _, p), f in zip(docs, fails, strict=True) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(range(len(here)))
            for step, letter in enumerate(order, 1):
                gone = [k for k in left if letter in here[k][1]]
                redundant = sum(letter in f for _, f in here) - len(gone)
                left = [k for k in left if k not in set(gone)]
                shapley[letter] += len(gone)
                ids = [here[k][0] for k in gone]
                out[part, "".join(order), step] = [
                    len(left), len(gone), redundant, sum(f == {letter} for _, f in here), sum(i in good for i in ids), sum(i in toxic for i in ids),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_plain_orders(spark):
    rng = random.Random(3)
    docs = [(1, None, "en"), (2, "", "en"), (3, "", None), (None, "", ""), (None, "x $", None), (4, "x $", "de"), (4, "x $", "de"), (5, "x $", "fr")]
    pool = [" ".join(rng.choice(["aa", "bb", "Cc", "ét", "DD", "d%"][: rng.randint(1, 6)]) + str(rng.randint(0, rng.choice([1, 500]))) for _ in range(rng.choice([150, 199, 200, 260]))) for _ in range(25)]
    docs += [(10 + k, rng.choice(pool) + rng.choice(["", "\x0b", " "]), rng.choice(["en", "de", None])) for k in range(80)]
    docs += [(200, "long\t" * 300_000, "en")]
    labels = [(1, 1, 0), (1, 0, 1), (4, None, 1), (None, 1, 1), (999, 1, 1)] + [(10 + k, rng.choice([0, 1]), rng.choice([0, 1])) for k in range(0, 80, 2)]
    frame = spark.createDataFrame([Row(doc_id=i, text=t, lang=p, mask=3, part="clash") for i, t, p in docs], "doc_id long, text string, lang string, mask long, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = audit.filter_audit(frame, marks)
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in out.collect()}
    assert got == plain_audit(docs, labels)
    assert audit.filter_audit(frame.limit(0), marks).count() == 0
    bare = audit.filter_audit(frame, marks.limit(0))
    assert bare.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0 and bare.count() == out.count()
