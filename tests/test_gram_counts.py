"""N-grams and tokens counted within tasks, against brute force in plain Python."""

import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import corpora
from corpusloom.plans import catalog

TEXTS = [
    ("a", "The cat sat on the mat. The cat sat!"), ("a", "on the mat the\x85cat \\frac12 x\x1cy"), ("a", ""), ("a", None), ("a", "one"),
    ("b", "Größe ÉTÉ été 12ab34 [x] 😀😀 ok"), ("b", "the cat sat on the mat"), (None, "the cat sat on nothing"), ("c", "two words"),
]
TARGET = [("the cat sat on a mat",), (None,), ("été 12ab34 [x]",)]


def tokens(t):
    return re.findall(r"[a-z]+|[0-9]+|\\[a-z]+|[^\t-\r \x85\xa0 ]", (t or "").lower())


def grams(t, n):
    w = tokens(t)
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]


def test_sets_of_grams_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS * 3, "lang string, t string").repartition(2)
    target = spark.createDataFrame(TARGET, "t string")
    for held in (1, 30, 2_000_000):  # tasks pass on what they hold many times, seldom, once
        monkeypatch.setattr(corpora, "HELD_TOKENS", held)
        monkeypatch.setattr(corpora, "HELD", held)
        for n in (1, 2, 3):
            got = corpora.jaccard_to(corpora.gram_set(docs, "t", n, ["lang"]), corpora.gram_set(target, "t", n, []), ["lang"])
            other = {g for (t,) in TARGET for g in grams(t, n)}
            want = {}
            for lang in ("a", "b", "c", None):
                own = {g for name, t in TEXTS if name == lang for g in grams(t, n)}
                shared = 0 if lang is None else len(own & other)
                if own:
                    want[lang] = (len(own), shared, round(shared / (len(own) + len(other) - shared), 9))
            assert {r.lang: (r.own, r.shared, round(r.jaccard, 9)) for r in got.collect()} == want
        counts = corpora.partial_token_counts(docs, "t", ["lang"]).groupBy("lang", "token").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).collect()
        tf, df = Counter(), Counter()
        for lang, t in TEXTS * 3:
            tf.update((lang, w) for w in tokens(t))
            df.update({(lang, w) for w in tokens(t)})
        assert {(r.lang, r.token): (r.tf, r.df) for r in counts} == {k: (tf[k], df[k]) for k in tf}


def test_order_and_place_of_tokens_enter_a_gram(spark):
    rows = spark.createDataFrame([("x y z",), ("y x z",), ("z y x",), ("x y",), ("z",)], "t string")
    assert corpora.gram_set(rows, "t", 3, []).count() == 3 and corpora.gram_set(rows, "t", 2, []).count() == 5


def test_white_space_as_with_javas_flag(spark):
    points = [*range(1, 0xD800), *range(0xE000, 0x11000)]
    rows = spark.createDataFrame([(chr(p),) for p in points], "t string").repartition(4)
    old = F.regexp_extract_all(F.lower("t"), F.lit(r"(?U)[a-z]+|[0-9]+|\\[a-z]+|[^\s]"), F.lit(0))
    assert rows.filter(old != text.tokens(F.col("t"))).count() == 0
    assert rows.filter(F.size(text.tokens(F.col("t"))) == 0).count() == 25


def test_jaccard_reads_the_texts_once(spark, tmp_path):
    spark.createDataFrame(TEXTS, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TARGET, "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plan = catalog.QUERIES["ngram_jaccard_3"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("struct<lang:string,text:string>") == 1 and "Generate" not in plan
