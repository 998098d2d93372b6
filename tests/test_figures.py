"""Data sets of figures on rows worked out by hand."""

import pytest

from corpusloom.operators import figures


def test_lines_and_efficiency(spark):
    rows = [("a", 1.0, 0.4), ("a", 2.0, 0.3), ("a", 3.0, 0.2), ("b", 1.0, 0.1), ("b", 2.0, 0.5), ("c", 0.0, 0.2)]
    frame = spark.createDataFrame(rows, "source string, norm double, accuracy double")
    got = {(r.source, r.norm): r for r in figures.norm_accuracy(frame, 0.5).collect()}
    assert got["a", 2.0].predicted == pytest.approx(0.3) and got["a", 2.0].r2_within == pytest.approx(1.0) and got["a", 2.0].efficiency == pytest.approx(0.1)
    assert got["b", 1.0].predicted == pytest.approx(0.1) and got["c", 0.0].efficiency == pytest.approx(30.0) and len({round(r.r2_pooled, 12) for r in got.values()}) == 1
    assert got["a", 1.0].r2_pooled < 0.5  # the sources' lines fit, one for all doesn't
    assert figures.norm_accuracy(frame.limit(0), 0.5).count() == 0


def test_profiles_and_pairs(spark):
    name = "sft_{}_n{}_r8_lr5e-5_ep1".format
    norms = spark.createDataFrame([(name("x", 1), "model.layers.3.mlp.up", 1.0), (name("x", 2), "model.layers.3.mlp.up", 3.0), (name("y", 1), "head", 2.0)], "exp string, layer string, norm_ba double")
    assert {tuple(r) for r in figures.layer_profile(norms).collect()} == {("x", 3, "mlp.up", 2.0, 1.0, 2), ("y", None, None, 2.0, 0.0, 1)}
    pairs = [(name("x", 1), name("y", 1), 0.5), (name("y", 1) + "_b", name("x", 1), 0.1), (name("x", 1), name("x", 2), 0.9)]
    cosines = spark.createDataFrame(pairs, "exp_1 string, exp_2 string, cosine double")
    by_size = {(r.n, r.source_a, r.source_b): (r["mean"], r.pairs) for r in figures.cosines_by_size(cosines).collect()}
    assert by_size == {(1, "x", "y"): (pytest.approx(0.3), 2)}
    kinds = {(r.source_a, r.source_b, r.kind): (r["mean"], r["min"], r["max"], r.n) for r in figures.pair_classes(cosines).collect()}
    assert kinds == {("x", "y", "cross"): (pytest.approx(0.3), 0.1, 0.5, 2), ("x", "x", "within"): (0.9, 0.9, 0.9, 1)}
