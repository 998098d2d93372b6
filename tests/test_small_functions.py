"""Columns and operators that no query of their own applies, on literal rows with answers derived by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats, text
from corpusloom.operators import experiments, metrics, sampling, tools, vectors
from corpusloom.sources import readers, sinks
from corpusloom.streaming import sessions


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def pairs(spark, values, f):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("a"), F.col("b")).alias("x")).collect()]


def test_text_columns(spark):
    assert column(spark, ["\\frac{1}{2} \\pi a \\", ""], text.latex_commands) == [["frac", "pi"], []]
    assert pairs(spark, [(" b ", "x"), (None, "c"), ("", " d"), (None, None)], text.gold_choice) == ["B", "C", "D", ""]
    assert pairs(spark, [("do", "x"), ("do", " "), ("do", None)], text.code_prompt) == ["do\n\nInput:\nx", "do", "do"]
    assert column(spark, ["7"], text.answer_sentence) == ["The answer is \\boxed{7}."]
    choices = spark.createDataFrame([("q", ["w", "x", "y", "z", "extra"]), ("r", ["only"])], "q string, c array<string>")
    assert [r[0] for r in choices.select(text.mcq_prompt(F.col("q"), F.col("c"))).collect()] == ["q\nA. w\nB. x\nC. y\nD. z", "r\nA. only"]
    call = spark.createDataFrame([("http://a", "post", {"k": "v"}, "{}"), ("http://b", "get", {}, None)], "u string, m string, h map<string,string>, b string")
    assert [r[0] for r in call.select(text.request_text(*map(F.col, "umhb"))).collect()] == ['curl -X POST http://a -H "k: v" -d \'{}\'', "curl -X GET http://b"]
    assert column(spark, ["a", "a.", " ", ""], text.sentence_end) == ["a.", "a.", " ", ""]
    assert column(spark, ["{a}}"], text.braces_doubled) == ["{{a}}}}"]
    parts = column(spark, ["Status Code: 200. Response: {\"a\": 1} Explanation: fine", "nothing"], text.response_parts)
    assert tuple(parts[0]) == (200, '{"a": 1}', "fine") and parts[1]["status"] is None


def test_readers_and_sinks(spark, tmp_path):
    path = str(tmp_path / "a.json")
    schema = "problem string, solution string, source string"
    rows = [{"problem": "p", "solution": "\\boxed{1}", "source": "olympiads"}, {"problem": "q", "solution": "none", "source": "math"}, {"problem": "r", "solution": "\\boxed{2}", "source": None}, {"problem": "s", "solution": "\\boxed{3}", "source": "other"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    corpus = readers.or_empty(spark, path, schema)
    assert [r.ord for r in corpus.orderBy("ord").collect()] == [0, 1, 2, 3] and readers.or_empty(spark, path + "x", schema).count() == 0
    assert [r.problem for r in readers.math_corpus(corpus).orderBy("ord").collect()] == ["p", "r", "s"]
    assert [r.problem for r in readers.math_corpus(corpus, "math, other", boxed=False).orderBy("ord").collect()] == ["q", "s"]
    assert [r.problem for r in readers.competition(corpus).collect()] == ["p"]
    assert [r.problem for r in readers.first_matches(corpus, F.col("solution").contains("boxed"), 2).collect()] == ["p", "r"]
    stored = readers.ingest(corpus, str(tmp_path / "corpus"), ["source"])
    assert stored.filter("source = 'math'").count() == 1 and (tmp_path / "corpus" / "source=math").is_dir()
    (tmp_path / "x_7b").mkdir()
    (tmp_path / "x_7b" / "one.md").write_text("# T\n\ntext\nmore\n- b\n1. c\n|a|b|\n|-|-|\n|1|2|\n```\ncode\n```\n")
    assert [r.path.split("/")[-1] for r in readers.with_suffix(spark, str(tmp_path), ".md").collect()] == ["one.md"]
    found = [(r.pos, r.kind, r.content) for r in readers.markdown(spark, str(tmp_path / "x_7b")).orderBy("pos").collect()]
    assert found == [(0, "h1", "T"), (1, "paragraph", "text\nmore"), (2, "bullet", "b"), (3, "bullet", "c"), (4, "table", "|a|b|\n|1|2|"), (5, "code", "code")]
    docs = spark.createDataFrame([("m", {"256": (1, 0.5), "1024": (3, 0.25)})], "name string, orz map<string, struct<correct: int, accuracy: double>>")
    assert sorted(map(tuple, readers.budget_rows(docs, "orz").collect())) == [("m", 256, 1, 0.5), ("m", 1024, 3, 0.25)]
    records = [{"API": "a", "Link": "l"}, {"API": "b", "Description": "d"}, {"API": "c"}]
    assert [tuple(r) for r in readers.catalogue(spark, records, 2).collect()] == [("a", None, None, "l"), ("b", "d", None, None)]
    log = str(tmp_path / "log")
    sinks.overwrite_json(corpus.limit(3), log)
    sinks.append_log(corpus.limit(1), log)
    assert spark.read.json(log).count() == 4
    sinks.overwrite_json(corpus.limit(2), log)
    assert spark.read.json(log).count() == 2


def test_experiment_frames(spark):
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x int")
    log = spark.createDataFrame([("a", 0.5), ("c", 0.7)], "name string, accuracy double")
    assert {(r.name, r.accuracy) for r in experiments.with_log(runs, log).collect()} == {("a", 0.5), ("b", None)}
    assert [r.name for r in experiments.with_log(runs, log, required=True).collect()] == ["a"]
    first = experiments.first_present([runs, spark.createDataFrame([("b", 9), ("c", 3)], "name string, x int")], "name")
    assert sorted((r.name, r.x) for r in first.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    one = spark.range(1)
    assert one.select(experiments.efficiency(F.lit(0.2), 0.3, F.lit(0.5))).first()[0] == pytest.approx(0.2)
    assert one.select(experiments.efficiency(F.lit(0.2), 0.3, F.lit(0.0))).first()[0] == pytest.approx(10.0)
    split = one.select(experiments.loss_split(F.lit(0.5), F.lit(0.7), 0.8).alias("l")).first().l
    assert tuple(map(pytest.approx, (0.2, 0.1, 2 / 3))) == tuple(split)
    assert one.select(experiments.loss_split(F.lit(0.5), F.lit(0.5), 0.5).alias("l")).first().l.format_share is None
    square = experiments.cosine_matrix(spark.createDataFrame([("a", "b", 1.1), ("a", "c", 0.5)], "first string, second string, cosine double"), ["a", "b", "c"])
    assert {r["first"]: (r.a, r.b, r.c) for r in square.collect()} == {"a": (1.0, 1.0, 0.5), "b": (1.0, 1.0, None), "c": (0.5, None, 1.0)}
    bars = experiments.bar_frame([("z", runs), ("y", runs)], "name", "x", 3)
    assert [(r.category, r.label, r.value) for r in bars.collect()] == [("z", "a", 1), ("z", "b", 2), ("y", "a", 1)]


def test_tool_rows(spark):
    a, b = (spark.createDataFrame([(k, f"{s}{k}") for k in range(n)], f"ord int, {s} string") for s, n in (("l", 3), ("r", 2)))
    assert sorted((r.l, r.r) for r in tools.zipped(a, b).collect()) == [("l0", "r0"), ("l1", "r1")]
    assert spark.range(1).select(tools.missing_params(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))).first()[0] == ["a"]
    spec = {"openapi": "3", "info": {}, "paths": {"/a": {}}}
    assert json.loads(tools.with_server(json.dumps(spec), "http://s"))["servers"] == [{"url": "http://s"}] and tools.with_server("no", "u") == "no" and tools.with_server(None, "u") is None
    step = lambda n, o: (n, "{}", o)
    rows = [("ask", "bye", [step("getDetails", "d"), step("f", "o")]), ("ask", "bye", [step("getDetails", "d")]), ("ask", "bye", []), ("ask", "bye", [step("f", "o")] * 6)]
    traces = spark.createDataFrame(rows, "input string, output string, steps array<struct<action: string, input: string, observation: string>>")
    kept = tools.trainable_traces(traces)
    assert kept.count() == 1
    cut = tools.trace_segments(kept)
    assert [tuple(s) for s in cut.first().segments] == [
        ("ask", False), ("Action: getDetails\nAction Input: {}", True), ("d", False), ("Action: f\nAction Input: {}", True), ("o", False), ("bye", True),
    ]
    assert [tuple(r) for r in tools.segment_histogram(cut).collect()] == [(6, 1)]


def test_metrics_samples_vectors_and_windows(spark):
    rows = spark.createDataFrame([("s", True, True, True, False, n) for n in (5, 1, 3, 9)] + [("s", False, False, True, True, 2), ("t", False, False, False, False, 4)], "g string, b boolean, s boolean, t boolean, p boolean, n int")
    out = {r.g: tuple(r)[1:] for r in metrics.output_analysis(rows, *(F.col(c) for c in "bstpn"), ["g"]).collect()}
    assert out == {"s": (5, 4, 4, 5, 1, 4.0, 3), "t": (1, 0, 0, 0, 0, 4.0, 4)}
    parts = [spark.createDataFrame([(k,)], "x int") for k in (7, 5)]
    assert [tuple(r) for r in sampling.merged(parts).collect()] == [(7, 0), (5, 1)]
    one = spark.range(1)
    meets = lambda *v: one.select(stats.overlap(*map(F.lit, v))).first()[0]
    assert meets(0.0, 0.5, 0.5, 1.0) and meets(0.0, 1.0, 0.2, 0.3) and not meets(0.0, 0.4, 0.5, 1.0)
    p, q = [math.log(x) for x in (0.5, 0.25, 0.9)], [math.log(x) for x in (0.25, 0.5, 0.1)]
    frame = spark.createDataFrame([(p, q, [1, 1, 0], [7, -100, 8]), (p, q, [0, 0, 0], [1, 1, 1])], "p array<double>, q array<double>, a array<int>, l array<int>")
    kl = [r.kl for r in vectors.masked_kl(frame, "p", "q", "a", "l").collect()]
    assert kl[0] == pytest.approx(0.5 * math.log(2)) and kl[1] == 0
    events = spark.createDataFrame([("2024-01-01 00:00:10", 1.0), ("2024-01-01 00:00:50", 2.0), ("2024-01-01 00:01:10", 4.0)], "t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted((r.n, r.total) for r in sessions.tumbling(events, "t", "1 minute", "1 minute", "v").collect()) == [(1, 4.0), (2, 3.0)]
