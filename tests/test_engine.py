"""Column functions, graders, operators, sources and sinks on literal rows with answers derived by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import grading, stats, text
from corpusloom.operators import experiments, metrics, ordered, regression, resampling, sampling, tools, vectors
from corpusloom.plans import catalog
from corpusloom.sources import readers, sinks
from corpusloom.streaming import sessions


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_tokens_and_grams(spark):
    assert column(spark, ["Ab 12\\frac{x} !", None], text.tokens)[0] == ["ab", "12", "\\frac", "{", "x", "}", "!"]
    assert column(spark, [["a", "b", "c"], ["a"], []], lambda c: text.ngrams(c, 2), "array<string>") == [["a b", "b c"], [], []]


def test_boxes():
    got = [text.balanced_answer(x) for x in ("x \\boxed{\\frac{1}{2}} y", "\\boxed{1} \\boxed{2}", "\\boxed{1", "\\boxed{1 <answer>7</answer>", "plain", None)]
    assert got == ["\\frac{1}{2}", "1", None, "7", None, None]


def test_numbers_choices_and_types(spark):
    assert column(spark, ["costs 1,234 now", "none", "3."], text.last_number) == ["1234", None, "3."]
    assert column(spark, ["costs 1,234 now", "none"], text.last_number_plain) == ["234", ""]
    assert column(spark, ["Answer: b", "Answer: A ... answer: C", "", "so it is d"], text.mcq_choice) == ["B", "C", "", "D"]
    kinds = column(spark, ["", "12", "1.5", "1/2", "\\frac{1", "x+1", "\\pi", "+-", None], text.answer_type)
    assert kinds == ["empty", "integer", "decimal", "fraction", "fraction", "symbolic", "latex_expression", "other", "empty"]
    assert column(spark, ["a #### 1\n#### 2 "], text.marked_gold) == ["2"] and column(spark, ["a #### 1\n#### 2 "], text.marked_gold_line) == ["1"]


def test_calls_and_prompts(spark):
    a = column(spark, ["Thought\nAction: get_x\nAction Input: {\"a\": 1}\n\nrest", "none"], text.action)
    assert tuple(a[0])[:2] == ("get_x", '{"a": 1}') and a[0]["parsed"].toPython() == {"a": 1} and tuple(a[1]) == (None, None, None)
    assert column(spark, ["Final Answer: 5"], lambda c: text.agent_step(c)["status"]) == ["finish"]
    assert column(spark, ['noise {"a": [1]} end', "x"], text.json_part) == ['{"a": [1]}', None]
    assert column(spark, ['1. "say it"\n\n 2. go '], text.instruction_list) == [["say it", "go"]]
    assert column(spark, ["a X b X c", "none"], lambda c: text.rightmost_replaced(c, "X", F.lit("Y"))) == ["a X b Y c", "none"]
    assert column(spark, ["x" * 10, "short"], lambda c: text.cut_and_answer(c, F.lit("7"), 5)) == ["xxxxx\n\nTherefore, the answer is \\boxed{7}.", "short"]
    assert column(spark, ["a"], lambda c: text.filled("$name is $n", {"name": c, "n": F.lit(3)})) == ["a is 3"]


@pytest.mark.parametrize(("pred", "gold", "equal"), [
    ("50", "0.5", True), ("1,000", "1000", True), ("3", "4", False), ("", "4", False), ("(1,2)", "(1,2)", True), ("(1, 2)", "(1,3)", False), (None, "1", False),
    ("\\frac12", "\\frac{1}{2}", True), ("0.5", "\\frac{1}{2}", True), ("$12", "12", True), ("12\\%", "12", True), ("5 \\text{ cm}", "5", True), ("3 meters", "3", True),
    ("1 1/2", "1+1/2", True), ("2,1", "1,2", False), ("Interval(1,2)", "[1,2]", True), ("x \\in [1,2]", "[1,2]", True), ("2 million", "2*10^6", True), ("10.0", "10", True),
    ("\\left(1,2\\right)", "(1,2)", True), ("Monday", "monday", True), ("7 days", "7", True), ("(1,2,3)", "(1,2)", False), ("(1,2)", "[1,2]", False), ("[0,1)", "(0,1]", False), ("(1)", "1", True), ("__import__('os')", "1", False),
])
def test_full_grader(pred, gold, equal):
    assert grading.full_equal(pred, gold) is equal


def test_simple_grader_and_tool_match(spark):
    rows = spark.createDataFrame([("0.5", "\\frac{1}{2}"), ("50%", "0.5"), (None, "1"), ("2", "3"), (" $4$ ", "4")], "p string, g string")
    assert [r[0] for r in rows.select(grading.simple_equal(F.col("p"), F.col("g"))).collect()] == [True, True, False, False, True]
    calls = [("get_user", '{"a":1,"b":2}', "Get-User", '{"A":5}'), ("get_user", None, "get user", '{"A":5}'), ("x", "{}", "y", "{}"), ("x", "raw", "x", '{"a":1}'), ("x", "{}", "x", '{"a":1}')]
    df = spark.createDataFrame(calls, "pf string, pp string, gf string, gp string")
    m, p = grading.tool_match(*map(F.col, ("pf", "pp", "gf", "gp")))
    assert [tuple(r) for r in df.select(m, p).collect()] == [(True, True), (True, True), (False, False), (True, True), (True, False)]
    gold = spark.createDataFrame([("it is 1,000 or so", "1000"), ("none", "4"), ("abc", "b")], "t string, g string")
    assert [r[0] for r in gold.select(grading.gold_in_text("t", "g")).collect()] == [True, False, True]


def test_statistics(spark):
    one = spark.range(1)
    w = one.select(stats.wilson(F.lit(0), F.lit(0)).alias("a"), stats.wilson(F.lit(5), F.lit(10)).alias("b")).first()
    assert tuple(w.a) == (0.0, 0.0) and 0.236 < w.b.low < 0.237 and abs(w.b.low + w.b.high - 1) < 1e-12
    assert one.select(stats.two_proportion_z(F.lit(0), F.lit(10), F.lit(0), F.lit(10))).first()[0] == 0
    assert one.select(stats.two_sided_p(F.lit(0.0))).first()[0] == 1
    assert [spark.createDataFrame([(x,) for x in v], "x int").agg(stats.upper_median("x")).first()[0] for v in ([4, 1, 3, 2], [5, 1, 3], [7], [2, 2, 9, 9])] == [3, 3, 7, 9]
    assert column(spark, [5000, 9999, 0], lambda c: stats.histogram_bin(c, 5000, 50), "int") == [50, 50, 1]
    v = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    cos = [r[0] for r in v.select(stats.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(cos[0] - 1) < 1e-12 and cos[1] == 0


def test_regression(spark):
    rng = np.random.default_rng(1)
    points = [("g", float(x), float(2 * x + rng.normal())) for x in rng.normal(size=12)] + [("flat", 1.0, 3.0), ("flat", 2.0, 3.0), ("one", 1.0, 1.0)]
    df = spark.createDataFrame(points, "k string, x double, y double")
    fit = {r.k: r for r in regression.fit_linear(df, "x", "y", ["k"]).collect()}
    assert fit["flat"].r2 == 0 and (fit["one"].a, fit["one"].b, fit["one"].mae) == (0, 0, math.inf)
    own = [p for p in points if p[0] == "g"]
    errors = []
    for k in range(12):
        rest = [p for i, p in enumerate(own) if i != k]
        a, b = np.polyfit([p[1] for p in rest], [p[2] for p in rest], 1)
        errors.append(abs(own[k][2] - a * own[k][1] - b))
    loo = {r.k: r.loo_mae for r in regression.leave_one_out(df, "x", "y", ["k"]).filter("k <> 'one'").collect()}
    assert abs(loo["g"] - np.mean(errors)) < 1e-9 and loo["flat"] == math.inf


def test_published_slope(spark):
    """A straight line over ln(size) gives its slope back."""
    df = spark.createDataFrame([("s", n, 0.3 - 0.02 * math.log(n)) for n in (100, 200, 500, 1000)], "k string, n int, acc double")
    got = regression.slope_by_log(df, "n", "acc", ["k"]).first()
    assert abs(got.slope + 0.02) < 1e-12


def test_slope_of_odd_sizes_as_in_sql(spark, tmp_path):
    """Sizes of 0, below 0, null and of one value alone give what the query's SQL gives: NaN, or null without any pair."""
    duckdb = pytest.importorskip("duckdb")
    odd = {"zero": (0, 5, 9), "zeros": (0, 0), "below": (-3, 5, 50), "same": (7,) * 40, "pair": (None, 8), "none": (None, None), "fine": (5, 50, None, 500), "single": (5,)}
    rows = [(lang, 7 * k + k * k, size) for lang, sizes in odd.items() for k, size in enumerate(sizes)]
    rows += [(None, 3, 4), (None, 5, 9), ("no id", None, 4), ("no id", None, 9)]
    spark.createDataFrame(rows, "lang string, doc_id long, n_chars long").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.lang: tuple(r) for r in catalog.slope_vs_logn(spark, str(tmp_path)).collect()}
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r for r in base.execute(catalog.ORACLES["slope_vs_logn"]).fetchall()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    assert all(math.isnan(got[k][2]) for k in ("zero", "zeros", "below", "same", "pair")) and got["none"][2] is got["no id"][2] is None and "single" not in got


def test_samples_and_shards(spark):
    import random

    rows = ordered.numbered(spark.createDataFrame([(f"d{i:02d}",) for i in range(10)], "name string"), ["name"], "ord")
    order = list(range(10))
    random.Random(42).shuffle(order)
    assert [r.ord for r in sampling.shuffled_take(rows, 4).collect()] == order[:4]
    assert {r.ord for r in sampling.seeded_sample(rows, 3).collect()} == set(random.Random(42).sample(range(10), 3))
    sizes = lambda n, k: [r["count"] for r in sampling.shard(rows.filter(F.col("ord") < n), k, total=n).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes(10, 4) == [3, 3, 3, 1] and sizes(5, 4) == [2, 2, 1]
    assert sampling.span(rows, 3, -1).count() == 7 and sampling.span(rows, 3, 2).count() == 2 and sampling.prefix(rows, 4).count() == 4
    assert sampling.mixed(rows, rows, 4, 0.5).count() == 4


def test_experiment_names(spark):
    names = ["sft_numinamath_n100_r8_lr5e-5_ep1", "sft_numinamath_n100_r8_lr5e-5_ep1_seed1", "sft_openr1trunc_n1000_r8_lr5e-5_ep1", "sft_mixed25nm_75or_n2000_r8_lr5e-5_ep1_kl0p1", "baseline_7b"]
    parse = lambda d: column(spark, names, lambda c: experiments.parse_experiment(c, d))
    assert [p.source for p in parse("compile")] == ["numinamath", "numinamath", "openr1", None, None] and [p.epochs for p in parse("compile")] == [1, None, 1, None, None]
    assert [p.source for p in parse("directions")] == ["numinamath", "numinamath", "openr1trunc", "mixed25nm_75or", None] and parse("directions")[4].n == 0
    assert parse("bootstrap")[3].source == "mixed25nm_75or" and parse("norms")[1].seed == 1 and parse("norms")[3].kl == 0.1
    assert column(spark, names, experiments.standard_config) == [True, False, True, False, False]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 3)), rng.normal(size=(4, 2))
    rows = [("e", "l", "A", 2, 3, a.ravel().tolist()), ("e", "l", "B", 4, 2, b.ravel().tolist()), ("e", "alone", "A", 2, 3, a.ravel().tolist())]
    got = vectors.low_rank_norms(spark.createDataFrame(rows, readers.WEIGHTS)).collect()
    s = np.linalg.svd(b @ a, compute_uv=False)
    assert len(got) == 1 and abs(got[0].norm_ba - np.linalg.norm(b @ a)) < 1e-6 and abs(got[0].sigma_max - s[0]) < 1e-6
    blocks = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [2.0]), (2, 0, [1.0, 0.0]), (2, 1, [2.0]), (3, 0, [0.0, 0.0]), (3, 1, [0.0])], "o int, block int, v array<float>")
    cos = {(r["first"], r["second"]): r.cosine for r in vectors.block_cosines(blocks, "o", "block", "v").collect()}
    assert abs(cos[1, 2] - 1) < 1e-12 and cos[1, 3] == 0


def test_bootstrap_is_order_free(spark):
    df = spark.createDataFrame([("a", 30, 100), ("b", 0, 0)], "k string, c int, n int")
    one, two = ({r.key: r.low for r in resampling.bootstrap(d, "k", "c", "n").collect()} for d in (df, df.orderBy(F.desc("k"))))
    assert one == two and 0.19 < one["a"] < 0.24


def test_tools(spark):
    spec = {"openapi": "3", "info": {}, "paths": {"/p": {}}}
    df = spark.createDataFrame([("t", json.dumps(spec)), ("bad", "{"), ("none", None)], "name string, doc string")
    assert [r[0] for r in df.select(tools.document_problem("doc")).collect()] == [None, "not JSON", "not JSON"]
    rows = spark.createDataFrame([("t", "d", ["i", "j"], [[("A", "{}")]])], "Name string, NLDocumentation string, Instructions array<string>, Golden_Answers array<array<struct<Action: string, Action_Input: string>>>")
    assert [len(r.golden) for r in tools.tool_queries(rows).orderBy("pos").collect()] == [1, 0]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"0": {"value": "q1"}, "1": {"ground_truth": {"value": "1"}}}, {"0": {"value": "q2"}, "1": {"ground_truth": {"value": "2"}}}]))
    rows = readers.json_array(spark, str(tmp_path / "p.json"), "`0` struct<value: string>, `1` struct<ground_truth: struct<value: string>>")
    assert [tuple(r) for r in readers.eval_problems(rows, 1).collect()] == [(0, "q1", "1")]
    traces = spark.createDataFrame([(0, "p", "\\boxed{1}", None), (1, None, None, [("user", "u"), ("assistant", "no"), ("assistant", "\\boxed{2}")]), (2, None, None, [("user", "u")])], f"ord long, problem string, solution string, {readers.MESSAGES}")
    assert [tuple(r) for r in readers.trace_corpus(traces, 2).orderBy("ord").collect()] == [(0, "p", "\\boxed{1}"), (1, "u", "\\boxed{2}")]
    for name, doc in (("a_eval.json", {"experiment_name": "sft_openr1_n10_r8_lr5e-5_ep1", "orz": {"accuracy": 0.5, "correct": 1, "total": 2}, "valid": True}), ("b_eval.json", {"model": "m"})):
        (tmp_path / name).write_text(json.dumps(doc))
    log = experiments.experiment_log(readers.eval_documents(spark, str(tmp_path / "*_eval.json"))).collect()
    assert [(r.name, r.data_source, r.orz_correct) for r in log] == [("b", None, None), ("sft_openr1_n10_r8_lr5e-5_ep1", "openr1", 1)]
    out = f"file://{tmp_path}/done"
    todo = spark.createDataFrame([(i, i * i) for i in range(5)], "k long, v long")
    assert sinks.checkpointed_write(todo.filter("k < 3"), out, "k", "k long, v long").count() == 3
    assert [r.k for r in sinks.resume(todo, out, "k", "k long, v long").orderBy("k").collect()] == [3, 4]
    assert sinks.checkpointed_write(todo, out, "k", "k long, v long").count() == 5
    assert sinks.merge_shards(spark, [out, f"file://{tmp_path}/gone"])[1] == [1]
    assert [e[0] for e in readers.markdown_elements("# T\n\npara\nmore\n- a\n\n| x |\n|---|\n| 1 |\n```\ncode\n```")] == ["h1", "paragraph", "bullet", "table", "code"]


def test_safetensors(spark, tmp_path):
    data = np.arange(6, dtype="<f4")
    header = json.dumps({"m.lora_A.weight": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "other": {"dtype": "F32", "shape": [1], "data_offsets": [0, 4]}}).encode()
    (tmp_path / "exp1").mkdir()
    (tmp_path / "exp1" / "adapter.safetensors").write_bytes(len(header).to_bytes(8, "little") + header + data.tobytes())
    got = readers.adapter_weights(spark, str(tmp_path / "*" / "*.safetensors")).collect()
    assert [(r.exp, r.layer, r.side, r.rows, r.cols, r.data) for r in got] == [("exp1", "m", "A", 2, 3, data.tolist())]


def test_metrics_gate_and_retries(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "n string, m double")
    assert [(r.n, r.issues, r.valid) for r in metrics.validity_gate(df, {"m": 0.8}).orderBy("n").collect()] == [("a", ["m"], False), ("b", [], True)]
    tries = spark.createDataFrame([(1, 0, 500), (1, 1, 500), (1, 2, 200), (2, 0, 503), (2, 1, 200), (3, 0, 400)], "request int, attempt int, status int")
    assert [tuple(r) for r in sessions.retry_outcome(tries).orderBy("request").collect()] == [(1, 500, 2), (2, 200, 2), (3, 400, 1)]


def test_session_stream(spark, tmp_path):
    rows = [(1, 0, "user", "a b c"), (1, 1, "assistant", "d e"), (1, 2, "clear", ""), (1, 3, "user", "f"), (2, 0, "user", "x " * 7)]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.session_history(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 4)
    q = stream.writeStream.format("memory").queryName("history").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("history").collect())
    assert got == [(1, 0, 1, 3), (1, 1, 1, 2), (1, 2, 0, 0), (1, 3, 1, 1), (2, 0, 0, 0)]


def test_every_query_is_registered(spark):
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 50
    assert entry.entry(spark).columns == ["lang", "n_docs", "mean_chars", "total_tokens", "unique_tokens", "type_token_ratio", "jaccard"]
