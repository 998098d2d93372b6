"""Low-rank cosines against flattened products, and the tensor source against files made by hand."""

import itertools
import json

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from corpusloom.operators import lowrank
from corpusloom.sources import tensors

SHAPE = "exp string, layer string, side string, rows int, cols int, data array<float>"


def weights(rng, names, layers, missing=()):
    rows, whole = [], {}
    for k, e in enumerate(names):
        for n in layers:
            rank = 1 + (k + n) % 3
            a, b = rng.normal(size=(rank, 5)).astype(np.float32), rng.normal(size=(4, rank)).astype(np.float32)
            if e.endswith("zero"):
                b *= 0
            layer = f"model.layers.{n}.mlp.up_proj"
            sides = [("A", a), ("B", b)]
            if (k, n) in missing:
                sides = sides[:1]
            else:
                whole[e, layer] = (b.astype(float) @ a.astype(float)).ravel()
            rows += [(e, layer, s, *m.shape, m.ravel().tolist()) for s, m in sides]
    return rows, whole


def cos(u, v):
    return 0.0 if min(np.linalg.norm(u), np.linalg.norm(v)) < 1e-10 else float(u @ v / np.linalg.norm(u) / np.linalg.norm(v))


def test_cosines_against_flattened_products(spark):
    names = [f"sft_{s}_n{n}_r8_lr5e-5_ep1_{k}" for k, (s, n) in enumerate(itertools.product(["numinamath", "openr1", "codealpaca"], [100, 500]))]
    names += ["other", "sft_openr1_n100_r8_lr5e-5_ep1_zero"]
    rows, whole = weights(np.random.default_rng(3), names, range(4), missing={(0, 1), (2, 3)})
    rows += [("other", "x", "A", 1, 9, [1.0] * 9), ("other", "x", "B", 2, 1, [1.0] * 2), (names[0], "x", "A", 1, 3, [1.0] * 3), (names[0], "x", "B", 2, 1, [1.0] * 2)]  # shapes differ
    rows += [(None, "model.layers.0.mlp.up_proj", "A", 1, 5, [1.0] * 5), ("null", None, "A", 1, 5, [1.0] * 5), ("empty", "x", "A", 1, 5, None)]
    frame = spark.createDataFrame(rows, SHAPE).withColumn("own", F.lit("clash")).withColumn("i", F.lit(5)).repartition(3)
    for block in (3, 16):
        products = lowrank.layer_products(frame, block)
        got = {(r.exp_1, r.exp_2): (r.layers, r.cosine) for r in lowrank.update_cosines(products).collect()}
        want = {}
        for a, b in itertools.combinations(sorted(names), 2):
            shared = sorted({layer for e, layer in whole if e == a} & {layer for e, layer in whole if e == b})
            want[a, b] = (len(shared), cos(np.concatenate([whole[a, n] for n in shared]), np.concatenate([whole[b, n] for n in shared])))
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
        by_layer = {(r.exp_1, r.exp_2, r.number, r.module): r.cosine for r in lowrank.layer_cosines(products).collect()}
        assert abs(by_layer[min(names[:2]), max(names[:2]), 2, "mlp.up_proj"] - cos(*(whole[e, "model.layers.2.mlp.up_proj"] for e in names[:2]))) < 1e-9
    cosines = lowrank.update_cosines(products)
    equal = lowrank.equal_size_pairs(cosines).collect()
    assert len(equal) == 8 and {r.label.split(":")[0] for r in equal} == {"N=100", "N=500"} and all(r.source_1 != r.source_2 for r in equal)
    assert lowrank.equal_size_pairs(cosines, across=False).count() == 9
    family = lowrank.family_pairs(cosines, ["codealpaca"]).collect()
    assert len(family) == 12 and all("codealpaca" in r.exp and r.other_source != "codealpaca" for r in family)
    assert lowrank.update_cosines(lowrank.layer_products(frame.limit(0))).count() == 0


def tensor_file(path, entries, header=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    about, at, data = {"__metadata__": {"format": "pt"}}, 0, b""
    for name, kind, array in entries:
        raw = array.tobytes()
        about[name] = {"dtype": kind, "shape": list(array.shape), "data_offsets": [at, at + len(raw)]}
        at, data = at + len(raw), data + raw
    told = json.dumps(about).encode() if header is None else header
    path.write_bytes(len(told).to_bytes(8, "little") + told + data)


def test_source_reads_only_what_filters_want(spark, tmp_path):
    a = np.arange(6, dtype="<f4").reshape(2, 3)
    kinds = [("F32", a), ("F64", a.astype("<f8")), ("F16", a.astype("<f2")), ("BF16", (a.view("<u4") >> 16).astype("<u2"))]
    tensor_file(tmp_path / "one_7b" / "final_adapter" / "m.safetensors", [(f"l.{k}.lora_{s}.weight", kind, x) for k, (kind, x) in enumerate(kinds) for s in "AB"])
    tensor_file(tmp_path / "two" / "m.safetensors", [("l.0.lora_A.default.weight", "F32", a), ("bias", "F32", a), ("l.0.lora_B.weight", "F32", a.T.copy())])
    tensor_file(tmp_path / "bad" / "m.safetensors", [], header=b"{broken")
    tensor_file(tmp_path / "odd" / "m.safetensors", [], header=json.dumps({"l.0.lora_A.weight": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 9000]}}).encode())
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "m.safetensors").write_bytes(b"xx")
    (tmp_path / "pickled").mkdir()
    (tmp_path / "pickled" / "adapter_model.bin").write_bytes(b"\x80\x04.")
    (tmp_path / "two" / "adapter_model.bin").write_bytes(b"not read beside safetensors")
    (tmp_path / "two" / "notes.txt").write_text("x")
    every = tensors.tensors(spark, str(tmp_path)).collect()
    good = {(r.exp, r.layer, r.side): (r.rows, r.cols, r.data) for r in every if r.error is None}
    assert {k[0] for k in good} == {"one_7b", "two"} and len(good) == 10
    assert all(v == (2, 3, a.ravel().tolist()) for k, v in good.items() if k != ("two", "l.0", "B"))
    assert good["two", "l.0", "B"] == (3, 2, a.T.ravel().tolist())
    assert {r.exp for r in every if r.error} == {"bad", "odd", "short", "pickled"} and all(r.data is None for r in every if r.error)
    found = tensors.tensors(spark, f"file://{tmp_path}").filter("exp = 'one_7b' AND layer IN ('l.1', 'l.3') AND side = 'B'")
    assert sorted(r.layer for r in found.collect()) == ["l.1", "l.3"]
    assert "PushedFilters" in found._jdf.queryExecution().toString() or found.count() == 2
    assert {r.exp for r in tensors.tensors(spark, str(tmp_path), suffix="_7b").collect()} == {"one_7b"}

    def read(*filters, **options):
        reader = tensors.TensorReader({"path": str(tmp_path), **options})
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies them all again
        parts = reader.partitions()
        return parts, sum(p.tensors[-1].stop - p.tensors[0].start for p in parts if p.tensors)

    parts, size = read()
    assert size == 2 * (24 + 48 + 12 + 12) + 48 and len([p for p in parts if not p.error]) == 3  # the bias parts two of them
    assert read(EqualTo(("exp",), "two"), EqualTo(("side",), "A"))[1] == 24
    parts, size = read(StringStartsWith(("exp",), "one"), In(("layer",), ("l.0", "l.2")))
    assert size == 48 + 24 and len(parts) == 2
    assert read(EqualTo(("exp",), "none"))[0] == []
    assert len(read(EqualTo(("exp",), "one_7b"), rangeBytes="50")[0]) > 2


def test_written_weights_come_back(spark, tmp_path):
    rows, _ = weights(np.random.default_rng(1), ["e1", "e2"], range(9), missing={(1, 4)})
    frame = spark.createDataFrame(rows, SHAPE)
    for _ in range(2):  # the same files again
        files = tensors.write_tensors(frame, str(tmp_path), shards=3).collect()
    assert len(files) <= 6 and not list(tmp_path.rglob("*.part")) and len(list(tmp_path.rglob("*.safetensors"))) == len(files)
    back = tensors.tensors(spark, str(tmp_path)).select(*SHAPE.replace(" string", "").replace(" int", "").replace(" array<float>", "").split(", "))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frame.collect()))


def test_many_tensors_make_few_partitions(spark, tmp_path, monkeypatch):
    n = 300  # side A is wanted of every layer, and B lies between
    entries = [(f"l.{k}.lora_{s}.weight", "F32", np.full((2, 3), k + (s == "B") / 2, "<f4")) for k in range(n) for s in "AB"]
    tensor_file(tmp_path / "e" / "m.safetensors", entries)
    side = EqualTo(("side",), "A")

    def read(**options):
        reader = tensors.TensorReader({"path": str(tmp_path), **options})
        list(reader.pushFilters([side]))
        parts = reader.partitions()
        batches = [b for p in parts for b in reader.read(p)]
        rows = [r for b in batches for r in b.to_pylist()]
        assert sorted((r["layer"], r["side"], r["data"]) for r in rows) == sorted((f"l.{k}", "A", [float(k)] * 6) for k in range(n))
        return len(parts), len(batches)

    assert read() == (1, 1)
    assert 10 <= read(rangeBytes="1000")[0] <= 30
    monkeypatch.setattr(tensors, "GAP_BYTES", 10)
    assert read()[0] == 1  # read by its ranges
    monkeypatch.setattr(tensors, "PLANNED_BYTES", 100)  # tasks read the header
    assert read()[0] == 1
    assert read(rangeBytes="1000")[0] > 10
    reader = tensors.TensorReader({"path": str(tmp_path), "rangeBytes": "1000"})
    assert all(not p.tensors for p in reader.partitions())
    tensor_file(tmp_path / "e" / "m.safetensors", entries, header=b"{broken" + b" " * 200)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 1 and rows[0]["error"] and rows[0]["exp"] == "e"


def test_files_of_many_tensors_are_parted(spark, tmp_path, monkeypatch):
    rows, _ = weights(np.random.default_rng(1), ["e1"], range(40))
    monkeypatch.setattr(tensors, "FILE_TENSORS", 10)
    files = tensors.write_tensors(spark.createDataFrame(rows, SHAPE), str(tmp_path)).collect()
    assert 4 <= len(files) <= 8 and tensors.tensors(spark, str(tmp_path)).count() == len(rows)
