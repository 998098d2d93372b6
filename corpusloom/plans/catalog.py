"""Every registered query of the engine and its SQL.

Corpora are ``documents``, the target corpus is ``benchmark``, graded rows are
``labels``, update vectors are ``embeddings``, tool parameters are ``events.props``. Boxes and
tool calls, which the tables lack, are put together the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grading, stats, text
from ..operators import apidocs, corpora, experiments, figures, lowrank, metrics, ordered, regression, resampling, sampling, spans, vectors
from ..session import shared_folder, table
from ..sources import documents, tensors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def long(c: str) -> Column:
    return F.col(c).cast("long")


# --- corpora ---------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(text), '[a-z]+|[0-9]+|\\[a-z]+|[^\s]')"
_WORDS = f"SELECT lang, unnest({_TOKENS}) AS token FROM documents"
_TARGET = f"SELECT unnest({_TOKENS}) AS token FROM benchmark"


@query(f"""
WITH w AS ({_WORDS}), t AS (SELECT DISTINCT token FROM ({_TARGET})),
v AS (SELECT lang, count(*) AS total_tokens, count(DISTINCT token) AS unique_tokens FROM w GROUP BY lang),
s AS (SELECT lang, count(*) AS shared FROM (SELECT DISTINCT lang, token FROM w) JOIN t USING (token) GROUP BY lang),
l AS (SELECT lang, count(*) AS n_docs, avg(length(text)) AS mean_chars FROM documents GROUP BY lang)
SELECT lang, n_docs, round(mean_chars, 6) AS mean_chars, total_tokens, unique_tokens,
       round(unique_tokens / total_tokens, 6) AS type_token_ratio,
       round(coalesce(shared, 0) / (unique_tokens + (SELECT count(*) FROM t) - coalesce(shared, 0)), 6) AS jaccard
FROM l JOIN v USING (lang) LEFT JOIN s USING (lang)""")
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: sizes, vocabulary and overlap with the target, from one count of tokens."""
    docs, target = table(spark, d, "documents"), table(spark, d, "benchmark")
    counts = corpora.token_counts(docs, "text", ["lang"])
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("total_tokens"), F.count("*").alias("unique_tokens"))
    grams = corpora.gram_set(target, "text", 1, []).select("gram")
    shared = corpora.jaccard_to(counts.select("lang", F.col("token").alias("gram")), grams, ["lang"])
    lengths = docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.avg(F.length("text")).alias("m"))
    out = lengths.join(sizes, "lang").join(shared, "lang")
    ratio = stats.ratio(F.col("unique_tokens"), F.col("total_tokens"))
    return out.select("lang", "n_docs", r("m").alias("mean_chars"), "total_tokens", "unique_tokens", r(ratio).alias("type_token_ratio"), r("jaccard").alias("jaccard"))


@query("""
SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(stddev_pop(n_chars), 6) AS std,
       min(n_chars) AS min, max(n_chars) AS max, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.75), 6) AS p75
FROM documents GROUP BY lang""")
def length_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    out = corpora.length_stats(table(spark, d, "documents"), "n_chars", ["lang"])
    return out.select("lang", "n", r("mean").alias("mean"), r("median").alias("median"), r("std").alias("std"), "min", "max", r("p25").alias("p25"), r("p75").alias("p75"))


@query(f"""
SELECT source, count(*) AS total_tokens, count(DISTINCT token) AS unique_tokens, round(count(DISTINCT token) / count(*), 6) AS type_token_ratio
FROM (SELECT source, unnest({_TOKENS}) AS token FROM documents) GROUP BY source""")
def vocab_stats_by_source(spark: SparkSession, d: str) -> DataFrame:
    out = corpora.vocabulary(table(spark, d, "documents"), "text", ["source"])
    return out.withColumn("type_token_ratio", r("type_token_ratio"))


@query(f"""
SELECT token, count(*) AS n FROM ({_TARGET}) GROUP BY token ORDER BY n DESC, token LIMIT 50""")
def top_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The fifty most frequent tokens of the target."""
    return corpora.token_counts(table(spark, d, "benchmark"), "text", []).orderBy(F.desc("n"), "token").limit(50)


def _grams_sql(n: int) -> str:
    gram = "array_to_string(list_slice(w, i, i + {k}), ' ')".format(k=n - 1)
    return f"""
WITH d AS (SELECT lang, {_TOKENS} AS w FROM documents), b AS (SELECT {_TOKENS} AS w FROM benchmark),
g AS (SELECT DISTINCT lang, {gram} AS gram FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n})),
t AS (SELECT DISTINCT {gram} AS gram FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM b WHERE len(w) >= {n})),
s AS (SELECT lang, count(*) AS shared FROM g JOIN t USING (gram) GROUP BY lang)
SELECT lang, own, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (own + (SELECT count(*) FROM t) - coalesce(shared, 0)), 6) AS jaccard
FROM (SELECT lang, count(*) AS own FROM g GROUP BY lang) LEFT JOIN s USING (lang)"""


def _gram_query(n: int) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        grams = corpora.gram_set(table(spark, d, "documents"), "text", n, ["lang"])
        out = corpora.jaccard_to(grams, corpora.gram_set(table(spark, d, "benchmark"), "text", n, []), ["lang"])
        return out.withColumn("jaccard", r("jaccard"))

    run.__name__ = f"ngram_jaccard_{n}"
    return run


for _n in (1, 2, 3):
    query(_grams_sql(_n))(_gram_query(_n))

_BIN = "CAST(least(floor(least(n_chars, 5000) * 50.0 / 5000) + 1, 50) AS INTEGER)"
_BIN_B = "CAST(least(floor(least(length(text), 5000) * 50.0 / 5000) + 1, 50) AS INTEGER)"


@query(f"SELECT lang, {_BIN} AS bin, count(*) AS n FROM documents GROUP BY ALL")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return corpora.histogram(table(spark, d, "documents"), "n_chars", 5000, 50, ["lang"])


def _shares_sql(result: str) -> str:
    return f"""
WITH a AS (SELECT lang, {_BIN} AS bin, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT {_BIN_B} AS bin, count(*) AS n FROM benchmark GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT lang FROM a), (SELECT unnest(range(1, 51)) AS bin)),
c AS (SELECT lang, coalesce(a.n, 0) + 1 AS p, coalesce(b.n, 0) + 1 AS q FROM grid LEFT JOIN a USING (lang, bin) LEFT JOIN b USING (bin)),
s AS (SELECT lang, p / sum(p) OVER (PARTITION BY lang) AS p, q / sum(q) OVER (PARTITION BY lang) AS q FROM c)
SELECT lang, {result} FROM s GROUP BY lang"""


def _bins(spark: SparkSession) -> DataFrame:
    return spark.range(1, 51).select(F.col("id").cast("int").alias("bin"))


@query(_shares_sql("round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 6) AS js"))
def length_js_divergence(spark: SparkSession, d: str) -> DataFrame:
    a = corpora.histogram(table(spark, d, "documents"), "n_chars", 5000, 50, ["lang"])
    b = corpora.histogram(table(spark, d, "benchmark").withColumn("n_chars", F.length("text")), "n_chars", 5000, 50, [])
    return corpora.js_divergence(a, b, "bin", ["lang"], keys=_bins(spark)).select("lang", r("js").alias("js"))


@query("""
WITH a AS (SELECT lang, source AS k, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT source AS k, count(*) AS n FROM documents GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT lang FROM a), (SELECT k FROM b)),
c AS (SELECT lang, coalesce(a.n, 0) + 1 AS p, b.n + 1 AS q FROM grid LEFT JOIN a USING (lang, k) JOIN b USING (k)),
s AS (SELECT lang, p / sum(p) OVER (PARTITION BY lang) AS p, q / sum(q) OVER (PARTITION BY lang) AS q FROM c)
SELECT lang, round(sum(p * ln(p / q)), 6) AS kl FROM s GROUP BY lang""")
def source_kl_divergence(spark: SparkSession, d: str) -> DataFrame:
    """How each language's sources differ from all documents'."""
    docs = table(spark, d, "documents")
    a = docs.groupBy("lang", F.col("source").alias("k")).agg(F.count("*").alias("n"))
    return corpora.kl_between(a, docs.groupBy(F.col("source").alias("k")).agg(F.count("*").alias("n")), "k", ["lang"]).select("lang", r("kl").alias("kl"))


def _topic(words: list[str]) -> str:
    return "round(avg(CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + " THEN 1 ELSE 0 END), 6)"


@query("SELECT lang, count(*) AS n, " + ", ".join(f"{_topic(w)} AS {k}" for k, w in text.TOPICS.items()) + " FROM documents GROUP BY lang")
def topic_rates(spark: SparkSession, d: str) -> DataFrame:
    out = corpora.topic_rates(table(spark, d, "documents"), "text", ["lang"])
    return out.select("lang", "n", *(r(k).alias(k) for k in text.TOPICS))


_TFIDF = f"""
a AS (SELECT lang, token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT lang, doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL),
b AS (SELECT token, count(*) AS tf, count(DISTINCT item_id) AS df FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang), nb AS (SELECT count(*) AS docs2 FROM benchmark),
e AS (
    SELECT lang, token, sum(tf) AS tf, sum(df) AS df, sum(tf2) AS tf2, sum(df2) AS df2 FROM (
        SELECT lang, token, tf, df, 0 AS tf2, 0 AS df2 FROM a UNION ALL SELECT lang, token, 0, 0, tf, df FROM langs, b
    ) GROUP BY ALL
),
k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang ORDER BY df + df2 DESC, token) <= 5000),
w AS (
    SELECT lang, tf / docs * (ln(docs / (df + 1)) + 1) AS w1, tf2 / docs2 * (ln(docs2 / (df2 + 1)) + 1) AS w2 FROM k JOIN langs USING (lang), nb
),
f AS (
    SELECT lang, CASE WHEN sum(w1 * w1) > 0 AND sum(w2 * w2) > 0 THEN sum(w1 * w2) / (sqrt(sum(w1 * w1)) * sqrt(sum(w2 * w2))) ELSE 0 END AS tfidf
    FROM w GROUP BY lang
)"""


@query(f"WITH {_TFIDF} SELECT lang, round(tfidf, 6) AS tfidf_cosine FROM f")
def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    out = corpora.tfidf_to(table(spark, d, "documents"), table(spark, d, "benchmark"), "text", ["lang"])
    return out.select("lang", r("tfidf_cosine").alias("tfidf_cosine"))


@query()
def composite_distance(spark: SparkSession, d: str) -> DataFrame:
    """Mean of what three similarities lack and the topics' divergence; its parts have SQL of their own."""
    docs, target = table(spark, d, "documents"), table(spark, d, "benchmark")
    jac = [corpora.jaccard_to(corpora.gram_set(docs, "text", n, ["lang"]), corpora.gram_set(target, "text", n, []), ["lang"]).select("lang", F.col("jaccard").alias(f"j{n}")) for n in (1, 2)]
    unpivot = lambda f, by: corpora.topic_rates(f, "text", by).unpivot(by, list(text.TOPICS), "topic", "n")
    topic = corpora.js_divergence(unpivot(docs, ["lang"]), unpivot(target.withColumn("g", F.lit(1)), ["g"]).drop("g"), "topic", ["lang"], smooth=1e-6)
    out = jac[0].join(jac[1], "lang").join(corpora.tfidf_to(docs, target, "text", ["lang"]), "lang").join(topic, "lang")
    return out.select("lang", r(corpora.composite(F.col("j1"), F.col("j2"), F.col("tfidf_cosine"), F.col("js"))).alias("composite"))


# --- extraction and grading ------------------------------------------------

_BOX = "text || ' \\boxed{' || CASE doc_id % 7 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN n_chars || '.5' WHEN 2 THEN n_chars || '/3' WHEN 3 THEN '' WHEN 4 THEN 'x+' || n_chars WHEN 5 THEN '\\pi' ELSE '+-' END || '}'"


def _boxed(docs: DataFrame) -> DataFrame:
    kinds = [F.col("n_chars").cast("string"), F.concat("n_chars", F.lit(".5")), F.concat("n_chars", F.lit("/3")), F.lit(""), F.concat(F.lit("x+"), "n_chars"), F.lit("\\pi"), F.lit("+-")]
    answer = F.get(F.array(*kinds), (F.col("doc_id") % 7).cast("int"))
    return docs.withColumn("solution", F.concat("text", F.lit(" \\boxed{"), answer, F.lit("}")))


_NAIVE = r"nullif(regexp_extract(s, '\\boxed\{([^}]+)\}', 1), '')"
_TYPE = r"""CASE WHEN coalesce(a, '') = '' THEN 'empty' WHEN regexp_matches(a, '^\s*-?\d+\s*$') THEN 'integer' WHEN regexp_matches(a, '^\s*-?\d+\.\d+\s*$') THEN 'decimal'
WHEN regexp_matches(a, '^\s*-?\d+/\d+\s*$') OR contains(a, '\frac') THEN 'fraction' WHEN regexp_matches(lower(a), '[a-z]') AND NOT starts_with(a, '\') THEN 'symbolic'
WHEN contains(a, '\') THEN 'latex_expression' ELSE 'other' END"""


@query(f"SELECT source, kind, count(*) AS n FROM (SELECT source, {_TYPE} AS kind FROM (SELECT source, {_NAIVE} AS a FROM (SELECT source, {_BOX} AS s FROM documents))) GROUP BY ALL")
def answer_type_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = _boxed(table(spark, d, "documents"))
    kind = text.answer_type(text.boxed_naive(F.col("solution")))
    return docs.groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {_NAIVE} AS answer FROM (SELECT doc_id, {_BOX} AS s FROM documents)")
def boxed_extract_simple(spark: SparkSession, d: str) -> DataFrame:
    return _boxed(table(spark, d, "documents")).select("doc_id", text.boxed_naive(F.col("solution")).alias("answer"))


@query(f"SELECT doc_id, {_NAIVE} AS answer FROM (SELECT doc_id, {_BOX} AS s FROM documents) WHERE doc_id % 7 <> 3 UNION ALL SELECT doc_id, '' FROM documents WHERE doc_id % 7 = 3")
def boxed_extract_balanced(spark: SparkSession, d: str) -> DataFrame:
    return _boxed(table(spark, d, "documents")).select("doc_id", text.boxed_answer("solution").alias("answer"))


@query(r"SELECT doc_id, replace(list_extract(regexp_extract_all(text, '-?\d[\d,]*\.?\d*'), -1), ',', '') AS number FROM documents")
def last_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.last_number(F.col("text")).alias("number"))


@query(r"SELECT doc_id, coalesce(list_extract(regexp_extract_all(text, '[-+]?\d*\.?\d+'), -1), '') AS number FROM documents")
def last_number_plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.last_number_plain(F.col("text")).alias("number"))


@query(r"""
SELECT doc_id, upper(coalesce(list_extract(regexp_extract_all(s, '[Aa]nswer\s*:\s*([A-Da-d])\b', 1), -1), list_extract(regexp_extract_all(s, '\b([A-Da-d])\b', 1), -1), s[1:1])) AS choice
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Answer: b or answer: ' || chr(CAST(65 + doc_id % 4 AS INTEGER)) WHEN doc_id % 3 = 1 THEN 'it is c, so ' || lang ELSE lang END AS s FROM documents)""")
def mcq_extract(spark: SparkSession, d: str) -> DataFrame:
    three = F.col("doc_id") % 3
    said = F.when(three == 0, F.concat(F.lit("Answer: b or answer: "), F.char(F.lit(65) + F.col("doc_id") % 4))).when(three == 1, F.concat(F.lit("it is c, so "), "lang")).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", text.mcq_choice(said).alias("choice"))


@query("""
SELECT doc_id, trim(list_extract(string_split(a, '####'), -1)) AS gold, trim(regexp_extract(a, '####\\s*(.+)', 1)) AS gold_line
FROM (SELECT doc_id, lang || ' #### ' || CAST(n_chars AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '#### 7 ' ELSE '' END AS a FROM documents)""")
def marked_golds(spark: SparkSession, d: str) -> DataFrame:
    a = F.concat("lang", F.lit(" #### "), F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 2 == 0, "\n#### 7 ").otherwise(""))
    return table(spark, d, "documents").select("doc_id", text.marked_gold(a).alias("gold"), text.marked_gold_line(a).alias("gold_line"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 1500 THEN regexp_replace(text[1:1500], '\\s+$', '') || chr(10) || chr(10) || 'Therefore, the answer is \\boxed{' || n_chars || '}.' ELSE text END AS solution FROM documents""")
def truncate_splice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.cut_and_answer(F.col("text"), F.col("n_chars").cast("string")).alias("solution"))


@query("""
SELECT c.conv_id, c.turn, c.text AS user_text, n.text AS reply FROM conversations c JOIN conversations n ON c.conv_id = n.conv_id AND n.turn = c.turn + 1
WHERE c.role = 'user' AND n.role = 'assistant'""")
def messages_to_example(spark: SparkSession, d: str) -> DataFrame:
    """A training example for each user message with its reply, through the messages array."""
    conv = table(spark, d, "conversations")
    reply = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = conv.filter("role = 'user'").join(reply, ["conv_id", "turn"]).select("conv_id", "turn", text.chat(F.lit("Be brief."), F.col("text"), F.col("reply")).alias("messages"))
    return pairs.select("conv_id", "turn", F.col("messages")[1]["content"].alias("user_text"), F.col("messages")[2]["content"].alias("reply"))


_CALL = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Get_' ELSE 'get-' END || event_type AS pred, 'get ' || CASE WHEN event_id % 3 = 0 THEN 'other' ELSE event_type END AS gold, props FROM events"


@query(f"SELECT event_id, replace(replace(replace(lower(pred), '_', ''), '-', ''), ' ', '') = replace(replace(replace(lower(gold), '_', ''), '-', ''), ' ', '') AS matched FROM ({_CALL})")
def func_name_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    pred = F.concat(F.when(F.col("event_id") % 2 == 0, "Get_").otherwise("get-"), "event_type")
    gold = F.concat(F.lit("get "), F.when(F.col("event_id") % 3 == 0, "other").otherwise(F.col("event_type")))
    return e.select("event_id", grading.tool_match(pred, F.col("props"), gold, F.col("props"))[0].alias("matched"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN false WHEN event_id % 4 = 0 THEN list_contains(list_transform(json_keys(props), lambda x: lower(x)), 'z') ELSE true END AS passed FROM events""")
def param_key_subset(spark: SparkSession, d: str) -> DataFrame:
    """Calls pass if their function matches and they have the gold keys, in any case."""
    gold = F.when(F.col("event_id") % 4 == 0, '{"Z": 1}').otherwise(F.upper("props"))
    name = F.when(F.col("event_id") % 5 == 0, "x").otherwise("y")
    return table(spark, d, "events").select("event_id", grading.tool_match(name, F.col("props"), F.lit("Y"), gold)[1].alias("passed"))


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN n_chars = 1000 WHEN 3 THEN true ELSE false END AS equal FROM documents""")
def grade_simple(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    pred = F.get(F.array(F.concat(F.lit(" $"), n, F.lit("$")), F.concat(n, F.lit("%")), n, F.concat(F.lit("\\frac{"), n, F.lit("}{4}")), F.lit(None).cast("string")), (F.col("doc_id") % 5).cast("int"))
    gold = F.get(F.array(n, (F.col("n_chars") / 100).cast("string"), F.lit("1,000"), (F.col("n_chars") / 4).cast("string"), n), (F.col("doc_id") % 5).cast("int"))
    return table(spark, d, "documents").select("doc_id", grading.simple_equal(pred, gold).alias("equal"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS equal FROM documents")
def grade_full(spark: SparkSession, d: str) -> DataFrame:
    """The full grader: scaled numbers, tuples, wrong numbers, units."""
    n = F.col("n_chars").cast("string")
    pred = F.get(F.array((F.col("n_chars") / 100).cast("string"), F.concat(F.lit("("), n, F.lit(", 2)")), F.lit("-3"), F.concat(n, F.lit(" \\text{ cm}"))), (F.col("doc_id") % 4).cast("int"))
    gold = F.get(F.array(n, F.concat(F.lit("("), n, F.lit(",2)")), F.lit("4"), n), (F.col("doc_id") % 4).cast("int"))
    return table(spark, d, "documents").select("doc_id", grading.full_equal_udf(pred, gold).alias("equal"))


#: Two answers for each line item, made of its numbers: fractions, powers, roots, and a quadratic in two forms.
_PAIRS = """
SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS form, l_linenumber AS a, CAST(l_quantity AS BIGINT) % 6 + 1 AS b, l_suppkey % 9 AS c, l_partkey % 13 + 1 AS d FROM lineitem"""


@query(f"""
SELECT l_orderkey, l_linenumber, CASE form
    WHEN 0 THEN abs(a / b - (c + 1) / d) <= 0.0001 * greatest(a / b, (c + 1) / d)
    WHEN 1 THEN pow(a, b) = c * d
    WHEN 2 THEN a * a * b = c * c * d
    WHEN 3 THEN a + b = c AND a * b = d
    ELSE a + 2 * b = c + 2 * d AND c + 2 * d > 0 END AS equal
FROM ({_PAIRS})""")
def grade_symbolic(spark: SparkSession, d: str) -> DataFrame:
    """The full grader on fractions, powers, roots, quadratics and fractions of unknowns whose equality arithmetic decides."""
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey % 5 AS form", "l_linenumber AS a", "CAST(l_quantity AS LONG) % 6 + 1 AS b", "l_suppkey % 9 AS c", "l_partkey % 13 + 1 AS d")
    pred = ["\\frac{%s}{%s}", "%s^{%s}", "%1$s\\sqrt{%2$s}", "(x+%s)(x+%s)", "\\frac{%1$s+2\\cdot %2$s}{x+1}"]
    gold = ["%3$s/%4$s", "%1$s*%2$s", "\\sqrt{%1$s^2\\cdot %2$s}", "x^2+%1$sx+%2$s", "\\frac{(%1$s+2*%2$s)(x-1)}{x^{2}-1}"]
    told = lambda forms, *c: F.get(F.array(*(F.format_string(f, *(x.cast("string") for x in c)) for f in forms)), F.col("form").cast("int"))
    plus = F.when(F.col("form") == 0, F.col("c") + 1).otherwise(F.col("c"))
    right = told([gold[0].replace("3$", "1$").replace("4$", "2$"), *gold[1:]], plus, F.col("d"))
    return rows.select("l_orderkey", "l_linenumber", grading.full_equal_udf(told(pred, F.col("a"), F.col("b")), right).alias("equal"))


_NEST = """'\\boxed{' || CASE doc_id % 6 WHEN 0 THEN '\\frac{' || n_chars || '}{x^{' || n_chars % 7 || '}}}' WHEN 1 THEN ' {{' || lang || '}{}} }' WHEN 2 THEN 'a{b}'
 WHEN 3 THEN '}' WHEN 4 THEN '{ <answer> ' || n_chars || ' </answer>}' ELSE 'x}{y}' END || text"""


@query(f"""
WITH s AS (SELECT doc_id, {_NEST} AS s FROM documents),
steps AS (
    SELECT doc_id, i, c FROM (SELECT doc_id, unnest(range(1, length(s) + 1)) AS i, unnest(string_split(s, '')) AS c FROM s) WHERE i > 7 AND c IN ('{{', '}}')
),
deep AS (SELECT doc_id, i, 1 + sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM steps),
ends AS (SELECT doc_id, min(i) AS e FROM deep WHERE depth = 0 GROUP BY doc_id)
SELECT doc_id, CASE WHEN e IS NOT NULL THEN trim(s[8:e - 1]) WHEN contains(s, '<answer>') THEN trim(regexp_extract(s, '<answer>(.*?)</answer>', 1)) END AS answer
FROM s LEFT JOIN ends USING (doc_id)""")
def boxed_extract_nested(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with nested, early closed and unclosed braces before whole texts."""
    return table(spark, d, "documents").selectExpr("doc_id", f"{_NEST.replace(chr(92), chr(92) * 2)} AS s").select("doc_id", text.boxed_answer("s").alias("answer"))


_RESPONSE = """'Thought: x' || chr(10) || 'Action: Get_' || event_type || ' ' || chr(10) || 'Action Input: ' || CASE event_id % 4 WHEN 0 THEN 'k is ' || value WHEN 1 THEN props || chr(10) || chr(10) || 'more'
 WHEN 2 THEN '[' || props || ', 1]' || chr(10) || 'Action: again' ELSE props END"""


@query(f"""
SELECT event_id, trim('Get_' || event_type) AS function, CASE event_id % 4 WHEN 0 THEN 'k is ' || value WHEN 2 THEN '[' || props || ', 1]' ELSE props END AS params,
       CASE event_id % 4 WHEN 0 THEN NULL WHEN 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k
FROM events""")
def action_calls(spark: SparkSession, d: str) -> DataFrame:
    """Function, parameters and a value of the parsed parameters of a tool call's text."""
    call = table(spark, d, "events").selectExpr("event_id", f"{_RESPONSE} AS s").select("event_id", text.action(F.col("s")).alias("a"))
    k = F.coalesce(F.try_variant_get("a.parsed", "$.k", "long"), F.try_variant_get("a.parsed", "$[0].k", "long"))
    return call.select("event_id", "a.function", "a.params", k.alias("k"))


# --- spans ----------------------------------------------------------------------

_TOKEN_PATTERN = r"[A-Za-z0-9]+|[ \t\n\r\f]+|[^A-Za-z0-9 \t\n\r\f]"


@query(rf"""
WITH p AS (SELECT conv_id, turn // 8 AS part, turn, role, text, [role || ':', text] AS t, [false, role = 'assistant'] AS f FROM conversations),
s AS (SELECT conv_id, part, flatten(list(t ORDER BY turn, role, text)) AS t, flatten(list(f ORDER BY turn, role, text)) AS f FROM p GROUP BY conv_id, part),
m AS (
    SELECT conv_id, part, regexp_extract_all(array_to_string(t, ''), '{_TOKEN_PATTERN}') AS tokens,
           array_to_string(list_transform(range(1, len(t) + 1), lambda i: repeat(CASE WHEN f[i] THEN '1' ELSE '0' END, length(t[i]))), '') AS chars FROM s
),
k AS (SELECT conv_id, part, unnest(range(1, len(tokens) + 1)) AS i, unnest(tokens) AS token, chars FROM m),
e AS (SELECT conv_id, part, i, length(token) AS n, chars, sum(length(token)) OVER (PARTITION BY conv_id, part ORDER BY i) AS stop FROM k)
SELECT conv_id, part, count(*) AS n_tokens, count(CASE WHEN NOT contains(chars[stop - n + 1:stop], '0') THEN 1 END) AS n_trained,
       md5(string_agg(CASE WHEN contains(chars[stop - n + 1:stop], '0') THEN '0' ELSE '1' END, '' ORDER BY i)) AS mask FROM e GROUP BY conv_id, part""")
def span_masks(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of conversations that are learnt from; one that reaches over a border isn't."""
    examples = spans.conversation_examples(table(spark, d, "conversations"))
    tokens = F.transform(spans.pattern_tokens(spans.joined(F.col("segments")), _TOKEN_PATTERN), lambda t: F.length(t))
    out = examples.withColumn("mask", spans.span_mask(tokens, F.col("segments")))
    told = F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "")
    trained = F.size(F.filter("mask", lambda m: m)).cast("long")
    return out.select("conv_id", "part", F.size("mask").cast("long").alias("n_tokens"), trained.alias("n_trained"), F.md5(told.cast("binary")).alias("mask"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(CASE WHEN length(text) = n_chars THEN 1 END) AS whole FROM documents")
def document_sink(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of one JSON document that holds a row for each text, told by the commits and read back from its rows."""
    path = f"{shared_folder(spark, 'document')}/all.json"
    rows = table(spark, d, "documents").select("doc_id", "n_chars", (F.length("text") == F.col("n_chars")).alias("whole"))
    told = documents.write_document(rows, path)
    back = json_lines(spark, path).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("n_chars"), F.sum(F.col("whole").cast("long")).alias("whole"))
    return back.filter(" AND ".join(f"{name} = {int(told[name])}" for name in ("rows", "n_chars", "whole")))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a document that this library wrote: each has a line of its own."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"(,|\]\}|\"results\": \[)$", "").alias("v"))
    return lines.select(F.from_json("v", "doc_id long, n_chars long, whole boolean").alias("r")).filter("r.doc_id IS NOT NULL").select("r.*")


# --- API documents -----------------------------------------------------------

_DOCUMENT = """'{"paths": {"/parts/{id}/' || p_type || '": {"parameters": [{"name": "id", "required": true, "description": "' || p_name || '", "schema": {"type": "integer"}}],
 "get": {"summary": "' || p_brand || '", "parameters": [{"name": "size", "schema": {"type": "string", "enum": ["' || p_size || '", 7]}}], "responses": {"404": {}, "200": {"description": "ok",
 "content": {"application/json": {"schema": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number"}, "of": {"$ref": "#/components/schemas/' || p_type || '"}}}}}}}}}}}}'"""


@query("""
SELECT p_partkey, 'parts_id_' || p_type || '_get' AS function, p_brand || chr(10) || 'Parameters: {"size": "string. One of: [' || p_size || ', 7]. ", "id": "Required. integer. ' || p_name || '."}' || chr(10) ||
       'Output: ok.' || chr(10) || ' - Format: application/json' || chr(10) || ' - Structure: Array[Object{n, of: #' || p_type || '}]' || chr(10) AS text FROM part""")
def api_function_texts(spark: SparkSession, d: str) -> DataFrame:
    """Names and wording of the functions of API documents, one for each part."""
    docs = table(spark, d, "part").selectExpr("p_partkey", f"{_DOCUMENT} AS document")
    return apidocs.functions(docs, "p_partkey").select(F.col("tool").alias("p_partkey"), "function", "text")


_MEDIA = "array('application/json', 'text/csv', 'image/png')[CAST(p_size {} AS INT)]"


@query("""
SELECT p_partkey, a = 'image/png' OR b <> 'image/png' AS input, a <> 'image/png' AND c <> 'image/png' AS output FROM (
    SELECT p_partkey, list_extract(m, p_size % 3 + 1) AS a, list_extract(m, p_size // 3 % 3 + 1) AS b, list_extract(m, p_size // 9 % 3 + 1) AS c
    FROM (SELECT *, ['application/json', 'text/csv', 'image/png'] AS m FROM part))""")
def api_media_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether APIs take and give texts: the first operation that doesn't decides, else the last."""
    kinds = [_MEDIA.format(part) for part in ("% 3", "div 3 % 3", "div 9 % 3")]
    told = "concat('{\"paths\": {\"/a\": {\"get\": {\"responses\": {\"200\": {\"content\": {\"', a, '\": {}}}}}}, \"/b\": {\"x\": 1, \"post\": {\"requestBody\": {\"content\": {\"', b, '\": {}}}, \"responses\": {\"200\": {\"content\": {\"', c, '\": {}}}, \"201\": {}}}}}}')"
    docs = table(spark, d, "part").selectExpr("p_partkey", *(f"{k} AS {n}" for k, n in zip(kinds, "abc", strict=True))).selectExpr("p_partkey", f"{told} AS document")
    return docs.select("p_partkey", apidocs.media_flags(F.col("document")).alias("f")).select("p_partkey", "f.input", "f.output")


_PARAMS = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"k": "' || k || '"}' WHEN 2 THEN '{"k": [' || k || ']}' ELSE '{"j": ' || k || '}' END"""
_RETRY = ". You need to change the input and try again."


@query(f"""
WITH p AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
e AS (SELECT event_id, event_id % 4 AS form, k, '"' || CASE WHEN event_id % 4 = 2 THEN '[' || k || ']' ELSE CAST(k AS VARCHAR) END || '"' AS got FROM p)
SELECT event_id, CASE form WHEN 3 THEN 0 WHEN 2 THEN 2 ELSE CASE WHEN k < 50 THEN 0 ELSE 1 END END AS errors, CASE form WHEN 3 THEN 1 ELSE 0 END AS missing,
       CASE WHEN form = 3 THEN 'Missing required parameters: "k"{_RETRY}'
            WHEN form = 2 THEN 'Parameter type error: "k", expected integer, but got array{_RETRY}' || chr(10) || 'Parameter type error: "k", expected one of ' || l || ', but got ' || got || '{_RETRY}'
            WHEN k >= 50 THEN 'Parameter type error: "k", expected one of ' || l || ', but got ' || got || '{_RETRY}' END AS message
FROM e, (SELECT '[' || array_to_string(range(0, 50), ',') || ']' AS l)""")
def call_checks(spark: SparkSession, d: str) -> DataFrame:
    """Types, allowed values and required parameters of calls."""
    calls = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).selectExpr("event_id", f"{_PARAMS} AS params")
    allowed = "[" + ",".join(map(str, range(50))) + "]"
    wanted = F.array(F.struct(F.lit("k").alias("name"), F.lit("integer").alias("kind"), F.lit(allowed).alias("enum"), F.lit(True).alias("required")))
    out = apidocs.checked_calls(calls.withColumn("wanted", wanted), ["event_id"], "params", "wanted")
    return out.select("event_id", F.size("errors").alias("errors"), F.size("missing").alias("missing"), "message")


# --- metrics -----------------------------------------------------------------


def _graded(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id")


_G = "(SELECT d.doc_id, source, lang, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_ACC = f"SELECT source, count(*) AS total, CAST(sum(quality) AS BIGINT) AS correct, sum(quality) / count(*) AS accuracy FROM {_G} GROUP BY source"


def _accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy(_graded(spark, d), F.col("quality") == 1, ["source"])


@query(f"SELECT source, total, correct, round(accuracy, 6) AS accuracy FROM ({_ACC})")
def accuracy_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _accuracy(spark, d).withColumn("accuracy", r("accuracy"))


@query("""
SELECT event_type, round(avg(value), 6) AS avg_tokens, round(max(value), 6) AS max_tokens, count(CASE WHEN value >= 50 THEN 1 END) AS hit_limit, count(value) AS with_stats
FROM events GROUP BY event_type""")
def token_limit_stats(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.token_stats(table(spark, d, "events"), F.col("value"), ["event_type"], 50)
    return out.withColumns({"avg_tokens": r("avg_tokens"), "max_tokens": r("max_tokens")})


@query(f"""
SELECT source, count(*) AS total, count(CASE WHEN quality = 1 THEN 1 END) AS func_correct, count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS pass_count,
       round(count(CASE WHEN quality = 1 THEN 1 END) / count(*), 6) AS func_accuracy, round(count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) / count(*), 6) AS pass_rate
FROM {_G} GROUP BY source""")
def tool_metrics(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("quality") == 1
    out = metrics.tool_metrics(_graded(spark, d), ok, ok & (F.col("toxic") == 0), ["source"])
    return out.withColumns({"func_accuracy": r("func_accuracy"), "pass_rate": r("pass_rate")})


@query(f"""
SELECT lang, count(*) AS total, count(CASE WHEN toxic = 0 THEN 1 END) AS boxed_found, count(CASE WHEN toxic = 1 THEN 1 END) AS fallback_used,
       count(CASE WHEN toxic = 0 AND quality = 1 THEN 1 END) AS strict_correct, count(CASE WHEN quality = 1 THEN 1 END) AS tolerant_correct,
       round(count(CASE WHEN toxic = 0 AND quality = 1 THEN 1 END) / count(*), 6) AS strict, round(count(CASE WHEN quality = 1 THEN 1 END) / count(*), 6) AS tolerant
FROM {_G} GROUP BY lang""")
def strict_tolerant(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.fallback_metrics(_graded(spark, d), F.col("toxic") == 0, F.col("quality") == 1, ["lang"])
    return out.withColumns({"strict": r("strict"), "tolerant": r("tolerant")})


@query(f"""
SELECT budget, round(avg(n_chars), 6) AS avg_tokens, round(avg(n_chars), 6) AS avg_chars, count(CASE WHEN n_chars >= budget - 1 THEN 1 END) AS hit_limit,
       round(avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 6) AS boxed_rate FROM {_G}, (SELECT unnest([1024, 2048]) AS budget) GROUP BY budget""")
def token_budgets(spark: SparkSession, d: str) -> DataFrame:
    rows = _graded(spark, d).withColumn("budget", F.explode(F.array(F.lit(1024), F.lit(2048))))
    out = metrics.budget_metrics(rows, F.col("budget"), F.col("n_chars"), F.col("n_chars"), F.col("quality") == 1, ["budget"])
    return out.withColumns({"avg_tokens": r("avg_tokens"), "avg_chars": r("avg_chars"), "boxed_rate": r("boxed_rate")})


@query("""
SELECT lang, list_extract(list_sort(list(n_chars)), CAST(len(list(n_chars)) // 2 + 1 AS BIGINT)) AS upper_median FROM documents GROUP BY lang""")
def upper_median_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(stats.upper_median("n_chars").cast("long").alias("upper_median"))


@query(f"""
SELECT source, count(CASE WHEN toxic = 1 THEN 1 END) AS boxed_wrong, count(CASE WHEN n_chars > 1000 AND toxic = 0 THEN 1 END) AS format_errors,
       count(CASE WHEN n_chars <= 1000 THEN 1 END) AS reasoning_errors, count(CASE WHEN toxic = 0 AND n_chars <= 1000 THEN 1 END) AS no_boxed_no_answer
FROM {_G} WHERE quality = 0 GROUP BY source""")
def error_categories(spark: SparkSession, d: str) -> DataFrame:
    return metrics.error_categories(_graded(spark, d), F.col("toxic") == 1, F.col("quality") == 1, F.col("n_chars") > 1000, ["source"])


_Z = "1.959963984540054"


@query(f"""
SELECT source, total, round(greatest((p + z2 / (2 * total)) / (1 + z2 / total) - h, 0), 6) AS low, round(least((p + z2 / (2 * total)) / (1 + z2 / total) + h, 1), 6) AS high
FROM (SELECT source, total, accuracy AS p, {_Z} * {_Z} AS z2,
      {_Z} * sqrt(accuracy * (1 - accuracy) / total + {_Z} * {_Z} / (4.0 * total * total)) / (1 + {_Z} * {_Z} / total) AS h FROM ({_ACC}))""")
def wilson_by_source(spark: SparkSession, d: str) -> DataFrame:
    w = stats.wilson(F.col("correct"), F.col("total"))
    return _accuracy(spark, d).withColumn("w", w).select("source", "total", r("w.low").alias("low"), r("w.high").alias("high"))


_PZ = """CASE WHEN e > 0 THEN (xa / na - xb / nb) / e ELSE 0 END"""
_PAIRS = f"""
WITH a AS (SELECT source, lang, count(*) AS total, CAST(sum(quality) AS DOUBLE) AS correct FROM {_G} GROUP BY ALL),
p AS (SELECT a.lang, a.source AS first, b.source AS second, a.correct AS xa, a.total AS na, b.correct AS xb, b.total AS nb,
             sqrt(greatest((a.correct + b.correct) / (a.total + b.total) * (1 - (a.correct + b.correct) / (a.total + b.total)) * (1.0 / a.total + 1.0 / b.total), 0)) AS e
      FROM a JOIN a b ON a.lang = b.lang AND a.source < b.source)"""


@query(f"{_PAIRS} SELECT lang, first, second, round({_PZ}, 6) AS z FROM p")
def ztest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of sources within a language: a row for each pair of groups, not of documents."""
    rows = metrics.accuracy(_graded(spark, d), F.col("quality") == 1, ["source", "lang"])
    return metrics.pairwise_z(rows, "lang", "source").withColumn("z", r("z"))


_ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * pow({x}, 2 * i + 1) / gamma(i + 1) / (2 * i + 1)))"


@query(f"""{_PAIRS}, q AS (SELECT lang, first, second, round({_PZ}, 6) AS z FROM p), v AS (SELECT *, round(CASE WHEN abs(z) > 6 THEN 0 ELSE 1 - ({_ERF.format(x='(abs(z) / sqrt(2))')}) END, 6) AS p FROM q)
SELECT lang, first, second, z, p, p < 0.05 AS significant FROM v""")
def ztest_p_values(spark: SparkSession, d: str) -> DataFrame:
    pairs = ztest_pairs(spark, d)
    return pairs.withColumn("p", r(stats.two_sided_p("z"))).withColumn("significant", F.col("p") < 0.05)


@query(f"""
SELECT direction, count(*) AS n FROM (SELECT CASE WHEN z > {_Z} THEN 'BETTER' WHEN z < -{_Z} THEN 'WORSE' ELSE '~same' END AS direction FROM (
    SELECT (correct / total - 0.85) / sqrt((correct + 850) / (total + 1000.0) * (1 - (correct + 850) / (total + 1000.0)) * (1.0 / total + 0.001)) AS z FROM ({_ACC}))) GROUP BY direction""")
def significance_tally(spark: SparkSession, d: str) -> DataFrame:
    return metrics.significance(_accuracy(spark, d), 850, 1000).groupBy("direction").agg(F.count("*").alias("n"))


@query(f"""
SELECT lang, source, round(accuracy, 6) AS accuracy FROM (SELECT lang, source, sum(quality) / count(*) AS accuracy FROM {_G} GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY accuracy DESC, source) = 1""")
def best_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.accuracy(_graded(spark, d), F.col("quality") == 1, ["lang", "source"])
    return metrics.best_per(rows, ["lang"], "accuracy", "source").select("lang", "source", r("accuracy").alias("accuracy"))


@query(f"""
SELECT source, round(accuracy - 0.85, 6) AS delta, array_to_string(list_filter([CASE WHEN accuracy < 0.85 - 0.03 THEN 'accuracy' END, CASE WHEN share < 0.12 - 0.03 THEN 'share' END], lambda x: x IS NOT NULL), ',') AS issues,
       accuracy >= 0.85 - 0.03 AND share >= 0.12 - 0.03 AS valid FROM (SELECT source, sum(quality) / count(*) AS accuracy, sum(toxic) / count(*) AS share FROM {_G} GROUP BY source)""")
def validity_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = _graded(spark, d).groupBy("source").agg((F.sum("quality") / F.count("*")).alias("accuracy"), (F.sum("toxic") / F.count("*")).alias("share"))
    gated = metrics.validity_gate(rows, {"accuracy": 0.85, "share": 0.12})
    return gated.select("source", r(F.col("accuracy") - 0.85).alias("delta"), F.array_join("issues", ",").alias("issues"), "valid")


@query("""
SELECT user_id, bool_or(value > 20) AS solved, min(CASE WHEN value > 20 THEN event_id END) AS first_correct, count(*) AS tried, 8 AS total_generations FROM events GROUP BY user_id""")
def rejection_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rejection_stats(table(spark, d, "events"), "user_id", "event_id", F.col("value") > 20, 8)


@query("""
SELECT count(CASE WHEN p = 'Yes' THEN 1 END) AS process_yes, count(CASE WHEN p = 'No' THEN 1 END) AS process_no, count(CASE WHEN p = 'Uncertain' THEN 1 END) AS process_uncertain,
       count(CASE WHEN f = 'Yes' THEN 1 END) AS final_yes, count(CASE WHEN f = 'No' THEN 1 END) AS final_no, count(CASE WHEN f = 'Uncertain' THEN 1 END) AS final_uncertain,
       count(CASE WHEN p = 'Yes' AND f = 'Yes' THEN 1 END) AS both_yes, count(*) AS total
FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Uncertain' END AS p, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS f FROM labels)""")
def judge_tally(spark: SparkSession, d: str) -> DataFrame:
    word = F.get(F.array(F.lit("Yes"), F.lit("No"), F.lit("Uncertain")), (F.col("doc_id") % 3).cast("int"))
    said = F.concat(F.lit("x\n## Results\nProcess Correctness: "), word, F.lit("\nFinal Response Correctness: "), F.when(F.col("quality") == 1, "Yes").otherwise("No"))
    j = text.judgement(said)
    return metrics.judge_tally(table(spark, d, "labels").select(j["process"].alias("process"), j["final"].alias("final")), "process", "final")


@query(f"""
WITH a AS (SELECT source AS key, total, correct, correct / total AS p FROM ({_ACC})),
b AS (SELECT *, 9 * sqrt(total * p * (1 - p)) + 9 AS spread FROM a),
r AS (
    SELECT key, total, p, CAST(CASE WHEN p <= 0 OR p >= 1 THEN round(total * p) ELSE greatest(0, floor(total * p - spread)) END AS BIGINT) AS low,
           CAST(CASE WHEN p <= 0 OR p >= 1 THEN round(total * p) ELSE least(total, ceil(total * p + spread)) END AS BIGINT) AS high FROM b
),
k AS (SELECT key, total, p, low, unnest(range(low, high + 1)) AS k FROM r),
l AS (SELECT key, k, sum(CASE WHEN k > low THEN ln((total - k + 1) / k * (p / (1 - p))) ELSE 0.0 END) OVER (PARTITION BY key ORDER BY k) AS lw FROM k),
w AS (SELECT key, k, exp(lw - max(lw) OVER (PARTITION BY key)) AS w FROM l),
f AS (SELECT key, k, sum(w) OVER (PARTITION BY key ORDER BY k) / sum(w) OVER (PARTITION BY key) AS v FROM w),
u AS (SELECT key, draw, (CAST('0x' || md5('42:' || key || ':' || draw)[1:13] AS BIGINT) + 0.5) / 4503599627370496.0 AS v FROM (SELECT key, unnest(range(1, 10001)) AS draw FROM r)),
e AS (SELECT key, v, 1 AS cell FROM f UNION ALL SELECT key, v, 0 FROM u),
n AS (SELECT key, cell, sum(cell) OVER (PARTITION BY key ORDER BY v, cell ROWS UNBOUNDED PRECEDING) AS passed FROM e),
s AS (SELECT key, least(low + passed, high) / total AS share FROM n JOIN r USING (key) WHERE cell = 0)
SELECT key AS source, round(quantile_cont(share, 0.025), 6) AS low, round(quantile_cont(share, 0.975), 6) AS high, round(stddev_samp(share), 6) AS se FROM s GROUP BY key""")
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals by resampling, whose draws follow from key and number."""
    out = resampling.bootstrap(_accuracy(spark, d), "source", "correct", "total")
    return out.select(F.col("key").alias("source"), r("low").alias("low"), r("high").alias("high"), r("se").alias("se"))


# --- vectors -----------------------------------------------------------------

_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_V = f"v AS (SELECT vec_id, label, embedding AS e, sqrt({_COS.format(a='embedding', b='embedding')}) AS norm FROM embeddings)"
_EXP = f"""WITH s AS (SELECT label * 5 + vec_id % 5 AS exp, label, i, sum(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL),
v AS (SELECT exp, label, list(x ORDER BY i) AS e FROM s GROUP BY exp, label), c AS (SELECT *, sqrt({_COS.format(a='e', b='e')}) AS norm FROM v),
p AS (SELECT a.exp AS exp_a, b.exp AS exp_b, a.label AS label_a, b.label AS label_b, {_COS.format(a='a.e', b='b.e')} / (a.norm * b.norm) AS cosine FROM c a JOIN c b ON a.exp < b.exp)"""


def _experiments(spark: SparkSession, d: str) -> DataFrame:
    """Five experiments a label, each the sum of a fifth of all its vectors: pairs are of experiments, few by nature."""
    cells = table(spark, d, "embeddings").select((F.col("label") * 5 + F.col("vec_id") % 5).alias("exp"), "label", F.posexplode("embedding"))
    sums = cells.groupBy("exp", "label", "pos").agg(F.sum(F.col("col").cast("double")).alias("x"))
    row = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return sums.groupBy("exp", "label").agg(F.transform(row, lambda c: c["x"]).alias("embedding"))


@query(f"{_EXP} SELECT exp_a, exp_b, label_a, label_b, round(cosine, 6) AS cosine FROM p")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return vectors.pair_cosines(_experiments(spark, d), "exp", "embedding", ["label"]).withColumn("cosine", r("cosine"))


@query(f"""{_EXP} SELECT least(label_a, label_b) AS label_1, greatest(label_a, label_b) AS label_2, round(avg(cosine), 6) AS mean, round(stddev_pop(cosine), 6) AS std,
round(min(cosine), 6) AS min, round(max(cosine), 6) AS max, count(*) AS n FROM p GROUP BY ALL""")
def source_pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.pair_summary(vectors.pair_cosines(_experiments(spark, d), "exp", "embedding", ["label"]), "label")
    return out.select("label_1", "label_2", r("mean").alias("mean"), r("std").alias("std"), r("min").alias("min"), r("max").alias("max"), "n")


@query(f"""WITH {_V}, l AS (SELECT label, vec_id, e, norm, lag(vec_id) OVER w AS previous, lag(e) OVER w AS pe, lag(norm) OVER w AS pn FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, previous, vec_id, round({_COS.format(a='e', b='pe')} / (norm * pn), 6) AS cosine FROM l WHERE previous IS NOT NULL""")
def consecutive_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vectors.consecutive_cosines(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding").withColumn("cosine", r("cosine"))


@query(f"""WITH {_V}, one AS (SELECT e AS re, norm AS rn FROM v WHERE vec_id = 0)
SELECT vec_id, label, round(norm, 6) AS norm, round({_COS.format(a='e', b='re')} / (norm * rn), 6) AS cosine, round({_COS.format(a='e', b='re')} / rn, 6) AS effective FROM v, one""")
def effective_perturbation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    out = vectors.effective_perturbation(e, e.filter("vec_id = 0"), "embedding")
    return out.select("vec_id", "label", r("norm").alias("norm"), r("cosine").alias("cosine"), r("effective").alias("effective"))


@query(f"""WITH {_V} SELECT label, round(sqrt(sum(norm * norm)), 6) AS rss, round(avg(norm), 6) AS mean, round(max(norm), 6) AS max, round(stddev_pop(norm), 6) AS std FROM v GROUP BY label""")
def rss_by_group(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.root_sum_squares(vectors.with_norm(table(spark, d, "embeddings"), "embedding"), F.col("norm"), ["label"])
    return out.select("label", *(r(c).alias(c) for c in ("rss", "mean", "max", "std")))


@query()
def low_rank_norms(spark: SparkSession, d: str) -> DataFrame:
    """Norms of products of low-rank matrices, made of each vector's halves; singular values have no SQL."""
    e = table(spark, d, "embeddings").withColumn("exp", F.col("label").cast("string")).withColumn("layer", F.col("vec_id").cast("string"))
    half = lambda side, at, n, m: e.select("exp", "layer", F.lit(side).alias("side"), F.lit(n).alias("rows"), F.lit(m).alias("cols"), F.slice("embedding", at, 32).alias("data"))
    out = vectors.low_rank_norms(half("A", 1, 2, 16).unionAll(half("B", 33, 16, 2)))
    return out.select("exp", "layer", *(r(c).alias(c) for c in ("norm_ba", "sigma_max", "nuclear", "effective_rank", "stable_rank")))


# --- low-rank updates -----------------------------------------------------------

#: Twenty experiments of three sources and two sizes, whose layers are the vectors: halves as matrices of rank 2.
_RUN = """concat('sft_', array('numinamath', 'openr1', 'codealpaca')[CAST(vec_id % 20 % 3 AS INT)], '_n', array(100, 500)[CAST(vec_id % 20 div 3 % 2 AS INT)],
 '_r8_lr5e-5_ep1_seed', vec_id % 20)"""


def _weights(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").selectExpr(f"{_RUN} AS exp", "concat('model.layers.', vec_id div 20, '.q_proj') AS layer", "embedding")
    half = lambda side, at, n, m: e.select("exp", "layer", F.lit(side).alias("side"), F.lit(n).alias("rows"), F.lit(m).alias("cols"), F.slice("embedding", at, 32).alias("data"))
    return half("A", 1, 2, 16).unionAll(half("B", 33, 16, 2))


_UPDATES = """w AS (
    SELECT 'sft_' || list_extract(['numinamath', 'openr1', 'codealpaca'], k % 3 + 1) || '_n' || list_extract([100, 500], k // 3 % 2 + 1) || '_r8_lr5e-5_ep1_seed' || k AS exp,
           list_extract(['numinamath', 'openr1', 'codealpaca'], k % 3 + 1) AS source, list_extract([100, 500], k // 3 % 2 + 1) AS n, layer,
           list_transform(range(0, 256), lambda i: e[33 + 2 * (i // 16)] * e[1 + i % 16] + e[34 + 2 * (i // 16)] * e[17 + i % 16]) AS w
    FROM (SELECT vec_id % 20 AS k, vec_id // 20 AS layer, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
), p AS (
    SELECT a.exp AS exp_1, b.exp AS exp_2, a.source AS source_1, b.source AS source_2, a.n AS n_1, b.n AS n_2, a.layer, list_dot_product(a.w, b.w) AS dot,
           list_dot_product(a.w, a.w) AS s1, list_dot_product(b.w, b.w) AS s2 FROM w a JOIN w b ON a.layer = b.layer AND a.exp < b.exp
), c AS (
    SELECT exp_1, exp_2, any_value(source_1) AS source_1, any_value(source_2) AS source_2, any_value(n_1) AS n_1, any_value(n_2) AS n_2,
           count(*) AS layers, round(sum(dot) / sqrt(sum(s1)) / sqrt(sum(s2)), 6) AS cosine FROM p GROUP BY exp_1, exp_2
)"""


@query(f"WITH {_UPDATES} SELECT exp_1, exp_2, layers, cosine FROM c")
def update_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of whole updates, whose products are never built."""
    return lowrank.update_cosines(lowrank.layer_products(_weights(spark, d))).withColumn("cosine", r("cosine"))


@query(f"WITH {_UPDATES} SELECT CAST(layer AS INTEGER) AS number, 'q_proj' AS module, count(*) AS n, round(avg(dot / sqrt(s1) / sqrt(s2)), 6) AS mean FROM p GROUP BY layer")
def layer_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of each layer over the pairs of experiments that share it."""
    found = lowrank.layer_cosines(lowrank.layer_products(_weights(spark, d)))
    return found.groupBy("number", "module").agg(F.count("*").alias("n"), r(F.avg("cosine")).alias("mean"))


@query(f"WITH {_UPDATES} SELECT exp_1, exp_2, 'N=' || n_1 || ': ' || source_1 || ' vs ' || source_2 AS label, cosine FROM c WHERE n_1 = n_2 AND source_1 <> source_2")
def equal_size_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Experiments of equal size and different sources."""
    found = lowrank.update_cosines(lowrank.layer_products(_weights(spark, d))).withColumn("cosine", r("cosine"))
    return lowrank.equal_size_pairs(found).select("exp_1", "exp_2", "label", "cosine")


@query(f"""WITH {_UPDATES}
SELECT exp_1 AS exp, n_1 AS n, exp_2 AS other, source_2 AS other_source, n_2 AS other_n, cosine FROM c WHERE source_1 = 'codealpaca' AND source_2 <> 'codealpaca'
UNION ALL SELECT exp_2, n_2, exp_1, source_1, n_1, cosine FROM c WHERE source_2 = 'codealpaca' AND source_1 <> 'codealpaca'""")
def family_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Code experiments against all mathematical ones."""
    found = lowrank.update_cosines(lowrank.layer_products(_weights(spark, d))).withColumn("cosine", r("cosine"))
    return lowrank.family_pairs(found, ["codealpaca"])


@query(f"""WITH {_UPDATES.split(', p AS')[0]}, x AS (
    SELECT exp, source, n, norm, accuracy FROM (SELECT exp, source, n, sqrt(sum(list_dot_product(w, w))) AS norm FROM w GROUP BY exp, source, n) e
    JOIN (SELECT doc_id % 20 AS k, avg(quality) AS accuracy FROM labels GROUP BY 1) l ON e.exp LIKE '%seed' || l.k
)
SELECT exp, source, n, round(norm, 6) AS norm, round(accuracy, 6) AS accuracy, round(regr_slope(accuracy, norm) OVER s * norm + regr_intercept(accuracy, norm) OVER s, 6) AS predicted,
       round(regr_r2(accuracy, norm) OVER s, 6) AS r2_within, round(regr_r2(accuracy, norm) OVER (), 6) AS r2_pooled, round((0.5 - accuracy) / greatest(norm, 0.01), 6) AS efficiency
FROM x WINDOW s AS (PARTITION BY source)""")
def norm_accuracy_figure(spark: SparkSession, d: str) -> DataFrame:
    """Norm and accuracy of each experiment with its source's line, the fit within and over all sources, and what a unit of norm costs."""
    norms = vectors.low_rank_norms(_weights(spark, d)).groupBy("exp").agg(F.sqrt(F.sum(F.col("norm_ba") * F.col("norm_ba"))).alias("norm"))
    graded = table(spark, d, "labels").groupBy((F.col("doc_id") % 20).cast("string").alias("k")).agg(F.avg("quality").alias("accuracy"))
    named = norms.withColumn("k", F.regexp_extract("exp", r"seed(\d+)$", 1)).withColumn("p", experiments.parse_experiment(F.col("exp")))
    rows = named.join(graded, "k").select("exp", F.col("p.source").alias("source"), F.col("p.n").alias("n"), "norm", "accuracy")
    out = figures.norm_accuracy(rows, 0.5)
    return out.select("exp", "source", "n", *(r(c).alias(c) for c in ("norm", "accuracy", "predicted", "r2_within", "r2_pooled", "efficiency")))


@query(f"""WITH {_UPDATES.split(', p AS')[0]} SELECT source, CAST(layer AS INTEGER) AS number, 'q_proj' AS module, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS n
FROM (SELECT source, layer, sqrt(list_dot_product(w, w)) AS x FROM w) GROUP BY source, layer""")
def layer_profile_figure(spark: SparkSession, d: str) -> DataFrame:
    """Norms of updates by source and layer."""
    out = figures.layer_profile(vectors.low_rank_norms(_weights(spark, d)))
    return out.select("source", "number", "module", r("mean").alias("mean"), r("std").alias("std"), "n")


@query(f"""WITH {_UPDATES} SELECT n_1 AS n, least(source_1, source_2) AS source_a, greatest(source_1, source_2) AS source_b, round(avg(cosine), 12) AS mean, count(*) AS pairs
FROM c WHERE n_1 = n_2 GROUP BY ALL""")
def pair_cosines_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosines of experiments of equal size by pair of sources."""
    found = lowrank.update_cosines(lowrank.layer_products(_weights(spark, d))).withColumn("cosine", r("cosine"))
    return figures.cosines_by_size(found).withColumn("mean", r("mean", 12))


@query(f"""WITH {_UPDATES} SELECT least(source_1, source_2) AS source_a, greatest(source_1, source_2) AS source_b, CASE WHEN source_1 = source_2 THEN 'within' ELSE 'cross' END AS kind,
round(avg(cosine), 12) AS mean, round(stddev_pop(cosine), 12) AS std, min(cosine) AS min, max(cosine) AS max, count(*) AS n FROM c GROUP BY ALL""")
def source_pair_classes(spark: SparkSession, d: str) -> DataFrame:
    """Spread of cosines within and across sources."""
    found = lowrank.update_cosines(lowrank.layer_products(_weights(spark, d))).withColumn("cosine", r("cosine"))
    return figures.pair_classes(found).withColumns({"mean": r("mean", 12), "std": r("std", 12)})


@query(f"""WITH {_UPDATES.split(', p AS')[0]} SELECT w.exp, 'model.layers.' || layer || '.q_proj' AS layer, 2 AS rows, 16 AS cols, round(sqrt(x), 5) AS norm FROM w JOIN (
    SELECT vec_id, list_dot_product(e[1:32], e[1:32]) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
) t ON t.vec_id // 20 = layer AND w.exp LIKE '%seed' || t.vec_id % 20 WHERE source = 'numinamath'""")
def tensor_scan(spark: SparkSession, d: str) -> DataFrame:
    """Norms of one side's matrices of one source, read back from weight files by ranges."""
    path = shared_folder(spark, "weights")
    tensors.write_tensors(_weights(spark, d), path, shards=4).write.format("noop").mode("overwrite").save()
    found = tensors.tensors(spark, path).filter((F.col("side") == "A") & F.col("exp").startswith("sft_numinamath"))
    return found.select("exp", "layer", "rows", "cols", F.round(stats.norm(F.col("data")), 5).alias("norm"))


# --- regression --------------------------------------------------------------


def _prices(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))


_XY = "(SELECT l_returnflag, l_linestatus, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem)"
_MODEL = f"(SELECT l_returnflag, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, regr_r2(y, x) AS r2, avg(x) AS mx, var_pop(x) * count(*) AS sxx FROM {_XY} GROUP BY l_returnflag)"


@query(f"""SELECT l_returnflag, m.n, round(m.a, 4) AS a, round(m.b, 3) AS b, round(m.r2, 6) AS r2, round(avg(abs(y - a * x - b)), 3) AS mae
FROM {_XY} JOIN {_MODEL} m USING (l_returnflag) GROUP BY ALL""")
def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    out = regression.fit_linear(_prices(spark, d), "x", "y", ["l_returnflag"])
    return out.select("l_returnflag", "n", r("a", 4).alias("a"), r("b", 3).alias("b"), r("r2").alias("r2"), r("mae", 3).alias("mae"))


@query(f"SELECT l_returnflag, m.n, round(avg(abs(y - a * x - b) / (1 - (1.0 / m.n + (x - mx) ** 2 / sxx))), 3) AS loo_mae FROM {_XY} JOIN {_MODEL} m USING (l_returnflag) GROUP BY ALL")
def loo_mae(spark: SparkSession, d: str) -> DataFrame:
    return regression.leave_one_out(_prices(spark, d), "x", "y", ["l_returnflag"]).withColumn("loo_mae", r("loo_mae", 3))


@query(f"""WITH m AS (SELECT l_returnflag, count(*) AS n_train, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM {_XY} WHERE x <= 25 GROUP BY l_returnflag)
SELECT l_returnflag, n_train, count(*) AS n_test, round(avg(abs(y - a * x - b)), 3) AS test_mae FROM {_XY} JOIN m USING (l_returnflag) WHERE x > 25 GROUP BY ALL""")
def train_test_mae(spark: SparkSession, d: str) -> DataFrame:
    out = regression.train_test(_prices(spark, d), "x", "y", F.col("x") <= 25, ["l_returnflag"])
    return out.withColumn("test_mae", r("test_mae", 3))


@query(f"""WITH m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM {_XY} WHERE l_returnflag = 'N')
SELECT l_returnflag, count(*) AS n, round(avg(abs(y - a * x - b)), 3) AS mae FROM {_XY}, m WHERE l_returnflag <> 'N' GROUP BY l_returnflag""")
def cross_group_mae(spark: SparkSession, d: str) -> DataFrame:
    return regression.cross_group(_prices(spark, d), "x", "y", "l_returnflag", "N").withColumn("mae", r("mae", 3))


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(corr(x, y), 6) AS r FROM {_XY} GROUP BY ALL")
def pearson_by_group(spark: SparkSession, d: str) -> DataFrame:
    return regression.pearson(_prices(spark, d), "x", "y", ["l_returnflag", "l_linestatus"]).withColumn("r", r("r"))


@query("""SELECT lang, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (
SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rx,
       rank() OVER (PARTITION BY lang ORDER BY w) + (count(*) OVER (PARTITION BY lang, w) - 1) / 2.0 AS ry
FROM (SELECT lang, n_chars, length(text) - length(replace(text, ' ', '')) AS w FROM documents)) GROUP BY lang""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("w"))
    return regression.spearman(docs, "n_chars", "w", ["lang"]).select("lang", "n", r("rho").alias("rho"))


@query("""WITH r AS (
    SELECT lang, count(*) AS n, corr(rx, ry) AS rho FROM (
        SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY lang ORDER BY w) + (count(*) OVER (PARTITION BY lang, w) - 1) / 2.0 AS ry
        FROM (SELECT lang, n_chars, doc_id % 1000 AS w FROM documents)) GROUP BY lang
), t AS (SELECT lang, n, rho, n - 2 AS v, atan(abs(rho) * sqrt((n - 2) / (1 - rho * rho)) / sqrt(n - 2)) AS top FROM r)
SELECT lang, n, round(rho, 6) AS rho, round(1 - 2 / sqrt(pi()) * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) * top / 6000 *
    list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(top * i / 2000), v - 1))), 6) AS p_value FROM t""")
def spearman_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of length and number with its p value, which the SQL integrates."""
    docs = table(spark, d, "documents").select("lang", "n_chars", (F.col("doc_id") % 1000).alias("w"))
    out = regression.spearman(docs, "n_chars", "w", ["lang"])
    return out.select("lang", "n", r("rho").alias("rho"), r("p_value").alias("p_value"))


@query("""SELECT doc_id, row_number() OVER w - 1 AS idx, coalesce(source <> lag(source) OVER w, false) AS border, lag(doc_id) OVER w AS previous
FROM documents WINDOW w AS (ORDER BY source, n_chars DESC, doc_id)""")
def row_index(spark: SparkSession, d: str) -> DataFrame:
    """Number, predecessor and block border of every document in one order of all."""
    docs = table(spark, d, "documents").select("doc_id", "source", (-F.col("n_chars")).alias("size"))
    order = ["source", "size", "doc_id"]
    flags = ordered.border_flags(docs, order, "source").select("doc_id", "idx", "border")
    before = ordered.with_previous(docs, order, ["doc_id"]).select("doc_id", F.col("previous.doc_id").alias("previous"))
    return flags.join(before, "doc_id")


@query("SELECT lang, count(*) AS n, round(regr_slope(doc_id % 100, ln(n_chars)), 6) AS slope, max(doc_id % 100) - min(doc_id % 100) AS range FROM documents GROUP BY lang HAVING count(*) >= 2")
def slope_vs_logn(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "n_chars", (F.col("doc_id") % 100).alias("y"))
    return regression.slope_by_log(docs, "n_chars", "y", ["lang"]).withColumn("slope", r("slope"))


# --- samples, shards, experiments --------------------------------------------


@query("""SELECT doc_id // CAST(ceil((SELECT count(*) FROM documents) / 4) AS BIGINT) AS shard, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY ALL""")
def shard_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sampling.shard(docs, 4, "doc_id").groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return sampling.remaining(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30")
def hard_pool(spark: SparkSession, d: str) -> DataFrame:
    """The longest texts, three times as many as the ten wanted."""
    return sampling.hard_pool(table(spark, d, "documents"), "text", 10, order="doc_id").select("doc_id", "n_chars")


@query()
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred documents of the seeded shuffle; its generator has no SQL."""
    rows = ordered.numbered(table(spark, d, "documents").select("doc_id"), ["doc_id"], "ord")
    return sampling.shuffled_take(rows, 100).select("pos", "doc_id")


@query()
def mixed_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.mixed(docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"), 200, 0.25, order="doc_id")


_NAME = "'sft_' || CASE WHEN doc_id % 3 = 0 THEN 'numinamath' WHEN doc_id % 3 = 1 THEN 'openr1trunc' ELSE 'mixed25nm_75or' END || '_n' || n_chars || '_r' || CASE WHEN doc_id % 2 = 0 THEN '8' ELSE '16' END || '_lr5e-5_ep1' || CASE WHEN doc_id % 5 = 0 THEN '_seed1' ELSE '' END"


def _named(spark: SparkSession, d: str) -> DataFrame:
    three = F.col("doc_id") % 3
    source = F.when(three == 0, "numinamath").when(three == 1, "openr1trunc").otherwise("mixed25nm_75or")
    name = F.concat(F.lit("sft_"), source, F.lit("_n"), "n_chars", F.lit("_r"), F.when(F.col("doc_id") % 2 == 0, "8").otherwise("16"), F.lit("_lr5e-5_ep1"), F.when(F.col("doc_id") % 5 == 0, "_seed1").otherwise(""))
    return table(spark, d, "documents").select("doc_id", "n_chars", name.alias("name"))


@query(f"""SELECT doc_id, CASE WHEN contains(name, 'sft_numinamath') THEN 'numinamath' WHEN contains(name, 'sft_openr1') THEN 'openr1' END AS compile_source,
CAST(nullif(regexp_extract(name, '_ep(\\d+)$', 1), '') AS BIGINT) AS compile_epochs, regexp_extract(name, '^sft_(.+?)_n\\d', 1) AS bootstrap_source,
regexp_extract(name, 'sft_(\\w+?)_n', 1) AS direction_source, CAST(regexp_extract(name, '_n(\\d+)_', 1) AS BIGINT) AS n, CAST(nullif(regexp_extract(name, '_seed(\\d+)', 1), '') AS BIGINT) AS seed,
contains(name, '_r8_') AND NOT contains(name, 'seed') AS standard FROM (SELECT doc_id, {_NAME} AS name FROM documents)""")
def experiment_names(spark: SparkSession, d: str) -> DataFrame:
    p = {k: experiments.parse_experiment(F.col("name"), k) for k in experiments.DIALECTS}
    return _named(spark, d).select(
        "doc_id", p["compile"]["source"].alias("compile_source"), p["compile"]["epochs"].alias("compile_epochs"), p["bootstrap"]["source"].alias("bootstrap_source"),
        p["directions"]["source"].alias("direction_source"), p["directions"]["n"].alias("n"), p["norms"]["seed"].alias("seed"), experiments.standard_config(F.col("name")).alias("standard"),
    )


@query(f"""SELECT name, accuracy, valid FROM (SELECT {_NAME} AS name, n_chars / 100000.0 AS accuracy, doc_id % 2 = 0 AS valid, doc_id FROM documents)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id DESC) = 1""")
def experiment_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of experiments, the last of one name holding."""
    rows = _named(spark, d).select("doc_id", "name", (F.col("n_chars") / 100000.0).alias("accuracy"), (F.col("doc_id") % 2 == 0).alias("valid"))
    return experiments.last_wins(rows, "name", "doc_id").select("name", "accuracy", "valid")


@query("""SELECT doc_id, n_chars, 'labelled' AS origin FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, n_chars, 'rest' FROM documents ANTI JOIN labels USING (doc_id)""")
def fallback_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    first = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("origin", F.lit("labelled"))
    return experiments.filled_up(first, docs.withColumn("origin", F.lit("rest")), "doc_id")


@query("""SELECT lang, min_by(doc_id, n_chars * 1000000 + doc_id) AS first, max_by(doc_id, n_chars * 1000000 + doc_id) AS last,
max_by(doc_id, n_chars * 1000000 + doc_id) - min_by(doc_id, n_chars * 1000000 + doc_id) AS delta FROM documents GROUP BY lang""")
def endpoint_delta(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("size", F.col("n_chars") * 1000000 + F.col("doc_id"))
    return experiments.endpoint_delta(docs, ["lang"], "size", "doc_id")


@query(f"SELECT lang, count(*) AS n, round(avg(quality), 6) AS mean, round(stddev_pop(quality), 6) AS std FROM {_G} GROUP BY lang")
def seed_spread(spark: SparkSession, d: str) -> DataFrame:
    out = experiments.seed_spread(_graded(spark, d), ["lang"], "quality")
    return out.select("lang", "n", r("mean").alias("mean"), r("std").alias("std"))
