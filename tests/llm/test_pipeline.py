"""The pipeline against brute force, stage by stage."""

import random
from pathlib import Path

import corpus_pipeline
import test_operators as T
from pyspark.sql import functions as F

from corpusloom.llm import pieces, substring


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    toxic = T.toxic_fixture()
    passage = " ".join(T.words(rng, 70))
    texts = [(i, t) for i, t, _ in toxic]
    copied = " ".join(T.words(rng, 120))
    texts += [(500 + k, copied) for k in range(3)] + [(510 + k, " ".join(T.words(rng, 30)) + " " + passage + " " + " ".join(T.words(rng, 30))) for k in range(3)]
    texts += [(520, None), (None, "a text without an id"), (530, " ".join(T.words(rng, 6000)))]
    docs = T.docs_frame(spark, texts).drop("fingerprint", "k").withColumn("_score_note", F.lit("extra"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in toxic], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{k}"))
        ids[name] = {r.doc_id for r in kept.select("doc_id").collect()}
    bad = {i for i, _, y in toxic if y}
    assert not bad & ids["toxicity"] and {i for i, _, y in toxic if not y} <= ids["toxicity"] and {None, 520, 530} <= ids["toxicity"]
    prints = {i: T.plain_fingerprint(t) for i, t in texts if i in ids["toxicity"] and i is not None}
    root = T.components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert ids["near_duplicates"] == {i for i in root if root[i] == i} | {None} and 501 not in ids["near_duplicates"]
    after = {r.doc_id: r.text for r in kept.collect()}
    assert ids["substring_dedup"] == ids["near_duplicates"] and passage in after[510] and passage not in after[511] and passage not in after[512]
    assert len(after[511].split()) < 60 + 3 * 20 and substring.repeated_spans(kept).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    sp = pieces.Pieces(open(T.MODEL, "rb").read()).library
    length = {}
    for r in packed:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {i: len(sp.encode(t or "")) + 1 for i, t in after.items()}
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, packed))


def test_a_copy_takes_no_other_text_of_its_id_away(spark, tmp_path):
    rng = random.Random(13)
    copied, own = (" ".join(T.words(rng, 80)) for _ in range(2))
    docs = T.docs_frame(spark, [(1, copied), (2, copied), (2, own), (3, copied), (None, copied)])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, [(1, copied), (2, copied), (2, own), (None, copied)]))
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_without_labels_and_on_an_empty_table(spark, tmp_path):
    from corpusloom.llm import common

    rng = random.Random(14)
    docs = T.docs_frame(spark, [(k, " ".join(T.words(rng, 20 + k))) for k in range(6)] + [(7, None), (None, "x")]).drop("fingerprint", "k")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (("some", docs), ("empty", docs.limit(0))):
        folder = tmp_path / name
        rows.write.parquet(str(folder / "documents.parquet"))
        none.write.parquet(str(folder / "labels.parquet"))
        packed = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in rows.collect()}
    common.drop_scratch()
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [p for p in Path(shared).iterdir() if p.name.startswith("pipeline-")]
