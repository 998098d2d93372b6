"""Span masks against a plain loop over characters, and the one-document sink through failures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import spans
from corpusloom.sources import documents


def loop_mask(lengths, segments):
    flags = [t for text, t in segments for _ in text or ""]
    out, at = [], 0
    for n in lengths:
        out.append(all(at + k < len(flags) and flags[at + k] for k in range(n)))
        at += n
    return out


def test_masks_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(0, [], []), (1, [3], [("ab", True)]), (2, [1, 0, 1], [("a", True), ("", False), (None, None), ("b", True)]), (3, None, [("a", True)]), (4, [1], None)]
    for k in range(5, 300):
        segments = [("é你a b"[: rng.randint(0, 5)] * rng.randint(0, 3), rng.random() < 0.5) for _ in range(rng.randint(0, 6))]
        left, lengths = sum(len(t) for t, _ in segments), []
        while left > 0:
            lengths.append(rng.randint(0, min(4, left)))
            left -= lengths[-1]
        rows.append((k, lengths, segments))
    df = spark.createDataFrame(rows, "k int, n array<int>, s array<struct<text: string, trainable: boolean>>")
    got = {r.k: r.m for r in df.select("k", spans.span_mask(F.col("n"), F.col("s")).alias("m")).collect()}
    assert got == {k: None if n is None or s is None else loop_mask(n, [(t, bool(f)) for t, f in s]) for k, n, s in rows}


def test_masks_of_a_vocabularys_tokens(spark):
    import public_tokenizers

    texts = [("Hello wor", False), ("ld, 你好 👍🏽 and", True), ("more", True), (" x", False)]
    df = spark.createDataFrame([(1, texts), (2, []), (3, [(None, True)])], "k int, s array<struct<text: string, trainable: boolean>>").withColumn("text", spans.joined(F.col("s")))
    out = spans.vocabulary_tokens(df, "text", public_tokenizers.path("byte_bpe_50k.json"))
    out = out.withColumn("m", spans.span_mask(F.transform("tokens", lambda t: t["length"]), F.col("s"))).withColumn("l", spans.labels(F.transform("tokens", lambda t: t["id"]), F.col("m")))
    got = {r.k: r for r in out.collect()}
    lengths = [t.length for t in got[1].tokens]
    assert sum(lengths) == len(got[1].text) and got[1].m == loop_mask(lengths, texts)
    assert [x == spans.IGNORED for x in got[1].l] == [not m for m in got[1].m] and any(got[1].m)
    assert " world" in got[1].text and not got[1].m[1]  # a token over the border isn't learnt from
    assert got[2].m == got[3].m == []


def test_examples_of_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(11)] + [(2, 0, "assistant", None), (None, 0, "user", "x"), (3, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part): [tuple(s) for s in r.segments] for r in spans.conversation_examples(df, 4).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0)}
    assert got[1, 2] == [("user:", False), ("t8", False), ("assistant:", False), ("t9", True), ("user:", False), ("t10", False)]
    assert got[2, 0] == [("assistant:", False), (None, True)]


def test_a_document_is_written_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "out.json")
    assert documents.document_stats(path) == {"rows": 0}
    rows = [(k, k % 3 == 0, float("nan") if k == 5 else float("inf") if k == 6 else k / 2, f"ü{k}", [1.5, float("nan")], None) for k in range(100)]
    df = spark.createDataFrame(rows, "k long, ok boolean, x double, s string, v array<double>, none int").repartitionByRange(5, "k")
    stats = documents.write_document(df, path)
    assert stats == {"rows": 100, "k": 4950, "ok": 34, "x": sum(k / 2 for k in range(100) if k not in (5, 6)), "none": 0}
    whole = json.loads((tmp_path / "out.json").read_text())
    assert whole["stats"] == stats and [r["k"] for r in whole["results"]] == list(range(100))
    assert whole["results"][5] == {"k": 5, "ok": False, "x": None, "s": "ü5", "v": [1.5, None], "none": None} and whole["results"][6]["x"] is None
    before = (tmp_path / "out.json").read_bytes()
    broken = df.withColumn("s", F.when(F.col("k") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("s")))
    with pytest.raises(Exception, match="lost"):
        documents.write_document(broken, path)
    assert (tmp_path / "out.json").read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["out.json"]
    assert documents.write_document(df.limit(0), f"file://{path}") == {"rows": 0, "k": 0, "ok": 0, "x": 0, "none": 0}
    assert json.loads((tmp_path / "out.json").read_text())["results"] == []
    with pytest.raises(Exception, match="overwrite"):
        df.write.format("json_document").mode("append").option("path", path).save()


def test_plain_values():
    import datetime
    import decimal

    import numpy as np

    value = {"a": np.float32(1.5), 2: np.array([1, 2]), "b": np.bool_(True), "c": decimal.Decimal("1.25"), "d": datetime.date(2020, 1, 2), "e": (float("-inf"), b"\x01")}
    assert documents.plain(value) == {"a": 1.5, "2": [1, 2], "b": True, "c": 1.25, "d": "2020-01-02", "e": [None, "01"]}
