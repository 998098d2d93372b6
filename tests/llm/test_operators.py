"""Operators against brute force on small fixtures with nulls, empty and long texts, ties and copies."""

import hashlib
import itertools
import os
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.llm import ann, common, hamming, licenses, packing, pieces, simhash, substring, tokenids, toxicity, unigram

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    syllables = ["tha", "ing", "er", "on", "ou", "sh", "le", "an", "ti", "re", "ka", "mo"]
    return ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]


def docs_frame(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).withColumn("fingerprint", F.lit("clash")).withColumn("k", F.lit(1))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


# --- 2 -------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rng = random.Random(1)
    base = words(rng, 150)
    texts = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "One"), (None, "no id"), (10, " ".join(words(rng, 70_000)))]
    texts += [(20 + k, " ".join([*base[:k], "zz", *base[k + 1 :]])) for k in range(30)] + [(60, " ".join(base)), (61, " ".join(base)), (61, " ".join(base))]
    texts += [(100 + k, " ".join(words(rng, 60))) for k in range(30)]
    got = simhash.near_duplicates(docs_frame(spark, texts)).collect()
    assert len(got) == len(texts)
    prints = {i: plain_fingerprint(t) for i, t in texts if i is not None}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    assert len({want[i] for i, _ in texts if i is not None and 20 <= i < 62}) < 40


def test_simhash_ball_and_empty(spark):
    values = [(x,) for x in (0, 1, 3, 7, -1, 1 << 62)]
    fps = spark.createDataFrame(values, "fp long")
    links = {frozenset((r.src, r.dst)) for r in simhash.fingerprint_links(fps).collect()}
    for a, b in itertools.combinations([v[0] for v in values], 2):
        if frozenset((a, b)) in links:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    label = {r.node: r.component for r in common.connected_components(simhash.fingerprint_links(fps)).collect()}
    assert len({label[x] for x in (0, 1, 3, 7)}) == 1 and -1 not in label
    assert simhash.near_duplicates(docs_frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_links(fps, 3)


def test_components_of_long_paths(spark):
    rng = random.Random(3)
    order = list(range(200))
    rng.shuffle(order)
    edges = list(zip(order, order[1:], strict=False)) + [(1000, 1001), (5, 5)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{k: 0 for k in range(200)}, 1000: 1000, 1001: 1000}


# --- 3 and 9 -------------------------------------------------------------------


def vectors_frame(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 64))
    rows = [(i, (centers[i % 8] + 0.4 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(700 + i, rows[0][1]) for i in range(40)]  # copies of a query's vector
    rows += [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] + [1.0] * 63), (904, [1.0, 2.0]), (None, rows[3][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), [r for r in rows if r[0] is not None and r[0] < 900]


def test_nearest_recall_and_scores(spark):
    df, rows = vectors_frame(spark)
    got = ann.nearest(df, F.col("id") % 50 == 0).collect()
    x = {i: np.array(v, float) for i, v in rows}
    hits = total = 0
    for q in [i for i in x if i % 50 == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in mine]
        score = {i: float(x[q] @ x[i] / np.sqrt(x[q] @ x[q]) / np.sqrt(x[i] @ x[i])) for i in x if i != q}
        assert all(abs(score[r.vec_id] - r.score) < 1e-12 for r in mine)
        want = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        hits += len(set(want) & {r.vec_id for r in mine})
        total += 5
    assert hits / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, F.col("id") == 0).collect()] == [(0, 1)]
    assert ann.nearest(few.limit(0), F.col("id") == 0).count() == 0


def test_queries_of_small_leaves_find_k(spark):
    rng = np.random.default_rng(9)
    heart = rng.normal(size=(40, 16)) * 8
    x = np.vstack([np.repeat(heart, 50, 0) + rng.normal(size=(2000, 16)) * 0.01, rng.normal(size=(60, 16)) * 8])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.nearest(df, (F.col("id") % 50 == 0) | (F.col("id") >= 2000), recall=0.5).groupBy("query_id").count().collect()
    assert len(found) == 100 and {r["count"] for r in found} == {5}
    tree = ann.Tree.fit(x / np.linalg.norm(x, axis=1)[:, None])
    leaf = tree.leaf_of(x / np.linalg.norm(x, axis=1)[:, None])
    sizes = dict(zip(*(a.tolist() for a in np.unique(leaf, return_counts=True)), strict=True))
    for row in x[2000:]:
        bins = tree.best_bins(row / np.linalg.norm(row), 1, sizes, 6)
        assert sum(sizes.get(b, 0) for b in bins) >= 6 and bins == tree.best_bins(row / np.linalg.norm(row), len(bins))


@pytest.mark.parametrize("many", [2, 6, 10])
def test_ids_of_several_vectors_get_one_list(spark, many):
    rng = np.random.default_rng(many)
    rows = [(0, rng.normal(size=8).tolist()) for _ in range(many)] + [(i, rng.normal(size=8).tolist()) for i in range(1, 30)]
    rows += [(7, rng.normal(size=8).tolist()) for _ in range(many)] + [(50, rows[0][1]), (50, rows[0][1])]
    frame = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "vec_id long, embedding array<double>, q int, leaf int, score double")
    got = ann.nearest(frame, F.col("id") % 50 == 0, recall=1.0).collect()
    unit = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows]
    for query in (0, 50):
        best = {}
        for i, x in unit:
            if i != query:
                best[i] = max(best.get(i, -2), *(float(x @ y) for j, y in unit if j == query))
        want = sorted(best, key=lambda i: (-round(best[i], 12), i))[:5]
        mine = sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])
        assert [(r["rank"], r.vec_id) for r in mine] == list(enumerate(want, 1))
        assert all(abs(r.score - best[r.vec_id]) < 1e-12 for r in mine)
    assert len(got) == 10


def test_search_of_clustered_vectors_reads_few_rows(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(100, 32)) * 4, 40, 0) + rng.normal(size=(4000, 32))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = frame.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    tree = ann.Tree.fit(u)
    leaf = tree.leaf_of(u)
    size = np.bincount(leaf, minlength=len(tree.leaves))
    index = spark.createDataFrame([([i], v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, leaf, strict=True))], "ids array<long>, v array<double>, leaf long")
    visits = ann._calibrated(rows.filter("id % 50 = 0"), index, tree, 5, ann.RECALL)
    queries = np.arange(0, 4000, 50)
    read = [size[tree.best_bins(u[q], visits)].sum() for q in queries]
    assert np.mean(read) < 0.2 * len(x)
    true = np.argsort(-(u[queries] @ u.T - 9 * (queries[:, None] == np.arange(4000))), axis=1, kind="stable")[:, :5]
    got = {}
    for r in ann.nearest(frame, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & set(t)) / 5 for q, t in zip(queries.tolist(), true.tolist(), strict=True)]) >= 0.9


def test_hamming_is_exact(spark):
    df, rows = vectors_frame(spark)
    got = hamming.nearest_codes(hamming.sign_codes(df), F.col("id") % 100 == 0, 10).collect()
    code = {i: sum(1 << b for b, v in enumerate(x) if v > 0) for i, x in rows}
    for q in [i for i in code if i % 100 == 0]:
        want = sorted(((code[q] ^ code[i]).bit_count(), i) for i in code if i != q)[:10]
        mine = sorted((r["rank"], r.distance, r.vec_id) for r in got if r.query_id == q)
        assert [(d, i) for _, d, i in mine] == want


# --- 4, 6 and 8 ----------------------------------------------------------------

ODD = ["", None, " ", "  a  b ", "a\n\nb\t c", "▁x", "x▁ y", "日本語 テスト 🤗🤗 x", "a" * 700, "\x00 a\x01", "é́ nbsp x", "word " * 3 + "日本" * 200, "<s> <0x41>"]


def test_pieces_equal_the_library(spark):
    rng = random.Random(2)
    texts = list(enumerate([*ODD, *(" ".join(words(rng, 200)) for _ in range(20)), " ".join(words(rng, 30_000)), "".join(words(rng, 3000))]))
    texts += [texts[-1], texts[-1], (None, "no id here"), (None, None)]
    docs = docs_frame(spark, texts)
    got = sorted(map(str, pieces.encoded(docs, MODEL).collect()))
    own = pieces.Pieces(open(MODEL, "rb").read())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in texts:
        ids = own.library.encode(t or "")
        units = own.split(t or "")
        assert [x for unit in own.ids([pieces.MARK + u for u in units]) for x in unit] == ids, repr((t or "")[:30])
        want.append(Row(doc_id=i, n_tokens=len(ids), ids_sha256=sha(",".join(map(str, ids))), decoded_sha256=sha(own.library.decode(ids) if ids else "")))
    assert got == sorted(map(str, want))
    assert pieces.encoded(docs.limit(0), MODEL).count() == 0
    unit = pieces.MARK + "thereforeabcanon" * 6
    assert own.agenda(unit) == own.symbols([unit])[0].tolist()


def test_pieces_are_the_agendas():
    own = pieces.Pieces(open(MODEL, "rb").read())
    assert own.checked(["there", "", "fore"]) == own.ids([pieces.MARK + k for k in ("there", "", "fore")])
    own.ids = lambda units: [[1, 2, 3] for _ in units]
    with pytest.raises(ValueError, match="the library has"):
        own.checked(["there"])


def test_units_in_arrow_are_the_texts_own():
    own = pieces.Pieces(open(MODEL, "rb").read())
    texts = [*ODD, "plain words here", "a ", " a", "one", "  "]
    assert own.listed(pa.array(texts, pa.string())).to_pylist() == [own.split(t or "") for t in texts]
    plain = pa.array(["a b", "c"])
    assert own.listed(plain).to_pylist() == [["a", "b"], ["c"]] and own.listed(plain[:0]).to_pylist() == []


def test_few_words_are_encoded_again(spark):
    """Frequent words stay known when rare ones come in more than a worker remembers."""
    own, asked = pieces.Pieces(open(MODEL, "rb").read()), []
    known = common.Remembered(pa.binary(), strings=1000)
    rng = random.Random(7)
    usual = ["".join(rng.choices("aeioubcd", k=6)) for _ in range(100)]

    def made(keys):
        asked.extend(keys)
        return [pieces.packed(pieces.in_parts(own.checked, keys), "<u2")[0]]

    for _ in range(30):
        keys = [*usual * 2, *("".join(rng.choices("fghklmnp", k=9)) for _ in range(300))]
        places, (ids,) = known.found(pa.array(keys), made)
        got = [np.frombuffer(x, "<u2").tolist() for x in ids.take(places).to_pylist()[:250]]
        assert got == own.ids([pieces.MARK + k for k in keys[:250]])
    assert sum(k in set(usual) for k in asked) == len(set(usual)) and known.nbytes < 100_000


def test_a_space_at_the_end_has_its_id(spark, tmp_path):
    texts = [(1, "a "), (2, "a  "), (3, " "), (4, "a b "), (5, "")]
    docs, path = docs_frame(spark, texts), f"file://{tmp_path}/order"
    own = pieces.Pieces(open(MODEL, "rb").read()).library
    want = {i: len(own.encode(t)) for i, t in texts}
    tokenids.write_training_order(docs, MODEL, path, length=32)
    assert {r.doc_id: r.n - 1 for r in tokenids.read_training_order(spark, path, 32).collect()} == want
    assert {r.doc_id: r.n for r in docs.select("doc_id", pieces.token_counter(docs, MODEL)("text").alias("n")).collect()} == want


def test_unigram_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    u = unigram.Unigram.of_model(open(MODEL, "rb").read())
    sp = pieces.Pieces(open(MODEL, "rb").read()).library
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
    vocabulary = [(sp.id_to_piece(i), -1e3 if special(i) else sp.get_score(i)) for i in range(sp.get_piece_size())]
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(4)
    texts = list(enumerate([x for x in ODD if x is None or "<" not in x] + [" ".join(words(rng, 100)) for _ in range(20)]))
    got = {r.doc_id: r.n_tokens for r in unigram.unigram_counts(docs_frame(spark, texts), MODEL).collect()}
    for i, x in texts:
        assert got[i] == len(t.encode(x or "", add_special_tokens=False).ids), repr(x)
    ties = unigram.Unigram({"ab": -2.0, "a": -1.0, "b": -1.0, "abc": -3.0, "c": -1.0}, False)
    assert ties.count("ab") == (-2.0, 1) and ties.count("abc") == (-3.0, 1) and ties.count("xx")[1] == 1


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutation(n):
    slots = tokenids.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n)) and tokenids.permute(slots, n, back=True).tolist() == list(range(n))


def test_training_order_round_trip_and_resume(spark, tmp_path):
    rng = random.Random(6)
    texts = [(i, " ".join(words(rng, rng.randint(1, 300)))) for i in range(40)] + [(90, None), (91, ""), (None, "no id here")]
    docs, path = docs_frame(spark, texts), f"file://{tmp_path}/order"
    total = tokenids.write_training_order(docs, MODEL, path, length=32, shard_rows=16, turns=3)
    sp = pieces.Pieces(open(MODEL, "rb").read()).library
    rows = tokenids.read_training_order(spark, path, 32).collect()
    assert sorted(r.slot for r in rows) == list(range(total))
    back = {(r.doc_id, r.seq): r for r in rows}
    for i, t in texts:
        ids = [*sp.encode(t or ""), tokenids.END_ID]
        for k in range(0, len(ids), 32):
            part = ids[k : k + 32]
            assert back.pop((i, k // 32)).ids_sha256 == hashlib.sha256(np.array(part, "<u2").tobytes()).hexdigest()
    assert not back
    files = sorted((tmp_path / "order").rglob("shard=*/*.txt"), key=lambda f: int(f.parent.name[6:]))
    kind = tokenids.record_type(32)
    assert all(f.stat().st_size % kind.itemsize == 0 for f in files)
    assert np.concatenate([np.fromfile(f, kind)["slot"] for f in files]).tolist() == list(range(total))
    gone = next((tmp_path / "order").glob("turn=1"))
    for f in gone.rglob("*"):
        if f.is_file():
            f.unlink()
    tokenids.write_training_order(docs, MODEL, path, length=32, shard_rows=16, turns=3)
    assert tokenids.read_training_order(spark, path, 32).count() == total
    assert tokenids.write_training_order(docs.limit(0), MODEL, f"file://{tmp_path}/none") == 0


# --- 5 -------------------------------------------------------------------------


def toxic_fixture():
    rng = random.Random(8)
    rows = []
    for i in range(400):
        w = words(rng, 40)
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["zquidiot", "grumblix", "bl*ckhead"])
        rows.append((i, " ".join(w), toxic))
    return rows


def test_toxicity_is_learnt_and_held_out(spark):
    import zlib

    rows = toxic_fixture()
    docs = docs_frame(spark, [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "a zq-uidiot b"), (1003, "z q u i d i o t"), (None, "x")])
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows] + [(None, 1, 1), (3000, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 405
    held = [(y, got[i]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for _, r in held) and all(r.predicted == y for y, r in held)
    assert got[1002].predicted == got[1003].predicted == 1 and got[1000].predicted == got[1001].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_without_seeds_gives_the_share_of_all_labels(spark):
    rng = random.Random(31)
    docs = docs_frame(spark, [(i, " ".join(words(rng, 5))) for i in range(200)])
    labels = spark.createDataFrame([(i, 1, int(i < 20)) for i in range(200)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, labels, each=15).collect()} == {0}


def test_toxicity_rejects_nothing_where_nothing_is_learnt(spark):
    docs = docs_frame(spark, [(i, f"some words {i}") for i in range(8)])
    shape = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], shape)
    one = spark.createDataFrame([(i, 1, 1) for i in range(8)], shape)
    unmet = spark.createDataFrame([(100 + i, 1, i % 2) for i in range(8)], shape)
    for labels in (none, one, unmet):
        got = toxicity.toxicity(docs, labels).collect()
        assert len(got) == 8 and {r.predicted for r in got} == {0} and all(0 < r.score < 0.5 for r in got)
    assert toxicity.toxicity(docs.limit(0), one).count() == 0


def test_folding_landmarks_changes_nothing():
    some = ["stupid", "moron", "hello", "thing", "a", "averyveryverylongwordindeed"[:24]]
    beta = np.array([0.5, -1.0, 2.0])
    direct = toxicity.gram_matrix(some, some[:3]) @ beta
    model = toxicity.Model(toxicity._collapsed(some[:3], beta), 0.0, 1.0, 0.0)
    codes, n, whole = toxicity.Kernel.codes(some)
    folded = sum(w * model.weights[g].sum(1) for w, g in toxicity.Kernel.grams(codes)) / n + toxicity.WHOLE * model.weights[whole]
    assert np.allclose(direct, folded, atol=1e-4)
    assert toxicity.fit([(["a"], 0), (["b"], 0)]).scores(np.array([0.0]))[0] < 0.5


def test_kernel_against_a_plain_double_sum():
    some = ["stupid", "st*upid", "idiot", "дурак", "дур-ак", "aaaaaa", "ab", "愚か者め", "x" * 24]

    def subsequences(word):
        v = toxicity.EDGE + word + toxicity.EDGE
        out = []
        for p in toxicity.ORDERS:
            for at in itertools.combinations(range(len(v)), p):
                span = at[-1] - at[0] + 1
                if span <= p + toxicity.SLACK:
                    out.append(("".join(v[i] for i in at), toxicity.DECAY**span))
        return out

    def root(word):  # as if no subsequence came up twice
        return np.sqrt(max(sum(w * w for _, w in subsequences(word)), toxicity.DECAY ** (2.0 * toxicity.ORDERS[0])))

    def kernel(u, v):
        return sum(a * b for s, a in subsequences(u) for t, b in subsequences(v) if s == t) / root(u) / root(v) + (toxicity.WHOLE**2 if u == v else 0)

    got = toxicity.gram_matrix(some, some)
    for i, u in enumerate(some):
        for j, v in enumerate(some):
            assert abs(got[i, j] - kernel(u, v)) < 1e-5 * max(1, kernel(u, v)), (u, v)


def noisy_fixture(seed, n, wrong):
    rng, out = random.Random(seed), []
    for i in range(n):
        w, insult = words(rng, 40), None
        if i % 8 == 0:
            insult = rng.choice(["zquidiot", "grumblix", "bl*ckhead", "дуракус"])
            at = rng.randrange(1, len(insult))
            w[rng.randrange(40)] = rng.choice([insult, insult, insult[:at] + rng.choice("*.-x") + insult[at:]])
        out.append((" ".join(w), int(insult is not None) ^ (rng.random() < wrong), insult is not None))
    return out


@pytest.mark.parametrize("wrong", [0.005, 0.02])
def test_wrong_labels_cost_no_insults(wrong):
    model = toxicity.fit([(sorted(toxicity.words_of(t)), y) for t, y, _ in noisy_fixture(1, 2000, wrong)])
    taken = [(model.scores(np.array([model.margins(sorted(toxicity.words_of(t))).max()]))[0] >= 0.5, bad) for t, _, bad in noisy_fixture(50, 800, 0)]
    assert all(got for got, bad in taken if bad)
    assert sum(got for got, bad in taken if not bad) < 0.01 * sum(not bad for _, bad in taken)
    for form in ("zquidiot", "zq*uidiot", "zqu-idiot", "gru.mblix", "дуракус", "дур*акус"):
        assert model.scores(model.margins([form]))[0] >= 0.5, form


def test_toxicity_of_odd_rows(spark):
    rows = toxic_fixture()
    long = "harmless words here " * 100_000
    extra = [(2000, long + " zquidiot"), (2001, long), (2002, "zquidiot"), (2002, "zquidiot"), (2002, "tha ing")]
    docs = docs_frame(spark, [(i, t) for i, t, _ in rows] + extra).withColumn("toxic", F.lit(1)).withColumn("score", F.lit(0.9)).withColumn("predicted", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).filter("doc_id >= 2000").collect()
    assert sorted((r.doc_id, r.predicted) for r in got) == [(2000, 1), (2001, 0), (2002, 0), (2002, 1), (2002, 1)]


# --- 7 -------------------------------------------------------------------------


def slow_pack(lengths, caps):
    """The same rules, by looking at every bin."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    down = [lengths[i] for i in order]
    bins, where = [], {}
    for k, i in enumerate(order):
        n = down[k]
        fit = [(c - u - n, b) for b, (c, u) in enumerate(bins) if c - u >= n]
        if fit:
            b = min(fit)[1]
        else:
            best = None
            for c in caps:
                if c >= n:
                    rest = sum(x for x in down[k + 1 :] if x <= c - n)
                    per = packing.sequence_cost(c) / max(1, n + min(c - n, rest))
                    if best is None or per < best[0] - 1e-12:
                        best = (per, c)
            bins.append([best[1], 0])
            b = len(bins) - 1
        where[i] = (b, bins[b][1])
        bins[b][1] += n
    return where, [min(c for c in caps if c >= u) for _, u in bins]


@pytest.mark.parametrize("seed", range(5))
def test_packing_against_brute_force(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 5, 30, 64, rng.randint(0, 64)]) for _ in range(120)]
    bins, offsets, finals = packing.pack(lengths, (16, 32, 64))
    where, want = slow_pack(lengths, (16, 32, 64))
    assert [(b, o) for b, o in zip(bins, offsets, strict=True)] == [where[i] for i in range(120)] and finals == want


def test_packing_places_everything(spark):
    docs = spark.createDataFrame([(i, i * 7 % 300) for i in range(200)] + [(None, 5), (7, 9000), (8, None), (7, 9000)], "doc_id long, n long")
    got = packing.best_fit_packing(docs, F.col("n"), (64, 128, 256), group=50).collect()
    assert sum(r.length for r in got) == sum(i * 7 % 300 for i in range(200)) + 18005
    held = {}
    for r in got:
        held.setdefault((r.bin_id, r.bin_capacity), []).append((r.bin_offset, r.length))
    assert len(held) == len({b for b, _ in held})
    for (_, cap), parts in held.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at or n == 0
            at += n
        assert at <= cap and all(c < at for c in (64, 128, 256) if c < cap)
    assert packing.best_fit_packing(docs.limit(0), F.col("n")).count() == 0
    odd = [2**53 + 1, 2**62 + 3, None, None]
    wide = spark.createDataFrame([(i, 10) for i in odd], "doc_id long, n long")
    assert sorted(str(r.doc_id) for r in packing.best_fit_packing(wide, F.col("n"), (64,)).collect()) == sorted(map(str, odd))
    one = spark.createDataFrame([(1, 256 * 500)], "doc_id long, n long")  # groups go by pieces, not by texts
    groups = {r.bin_id >> 32 for r in packing.best_fit_packing(one, F.col("n"), (64, 128, 256), group=50).collect()}
    assert len(groups) == 10


# --- 10 ------------------------------------------------------------------------


def test_substring_spans_against_brute_force(spark):
    rng = random.Random(9)
    passage = " ".join(words(rng, 60))
    texts = [(i, " ".join(words(rng, 80))) for i in range(20)]
    texts += [(30 + i, " ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 40))) for i in range(5)]
    texts += [(50, passage), (51, "same\n" * 3), (52, None), (53, ""), (54, " \n "), (None, passage), (55, "é " + passage.upper().replace(" ", "\t"))]
    texts += [(60, texts[0][1]), (61, " ".join(words(rng, 20_000))), (62, texts[0][1]), (62, texts[0][1])]
    docs = docs_frame(spark, texts)
    spans = substring.repeated_spans(docs)
    seen, want = {}, set()
    for i, t in sorted((i, t) for i, t in texts if i is not None and t):
        u = [list(map(int, x)) for x in zip(*substring.units_of(t.encode()), strict=True)]
        again = [seen.setdefault(x[3], (i, k)) != (i, k) for k, x in enumerate(u)]
        for flag, run in itertools.groupby(range(len(u)), key=lambda k: again[k]):
            run = list(run)
            if flag and sum(u[k][2] for k in run) >= substring.MIN_WORDS:
                want.add((i, u[run[0]][0], u[run[-1]][1]))
    got = {(r.doc_id, r.start, r.stop) for r in spans.collect()}
    assert got == want
    assert {i for i, _, _ in got} >= {31, 32, 33, 34, 50, 55, 60} and not {i for i, _, _ in got} & set(range(20))
    out = {r.doc_id: r for r in substring.without_spans(docs, spans).collect()}
    assert out[60].text == "" and out[60].n_chars == 0 and out[3].text == texts[3][1] and out[52].text is None and out[30].text == dict(texts)[30]
    assert passage not in out[31].text and substring.repeated_spans(docs.limit(0)).count() == 0
    assert out[61].fingerprint == "clash"


def test_units_keep_offsets():
    text = "Ab  c\td\n\nÉé ñ x\r\n last"
    a, b, n, _ = substring.units_of(text.encode())
    assert " ".join(text[i:j] for i, j in zip(a, b, strict=True)).split() == text.split() and n.sum() == len(text.split())
    other = substring.units_of(("zz " * 5 + "\n" + text.upper().replace("É", "É")).encode())
    assert len(other[0]) >= 1


def passage_marks(texts, least):
    """Words of each text that lie in ``least`` words which stand earlier, in a text itself not overlapping."""
    seen, marks = {}, {}
    for i, t in sorted(texts):
        w = t.lower().split()
        marks[i] = [False] * len(w)
        for k in range(len(w) - least + 1):
            first = seen.setdefault(tuple(w[k : k + least]), (i, k))
            if first != (i, k) and (first[0] != i or k - first[1] >= least):
                marks[i][k : k + least] = [True] * least
    return marks


def test_passages_that_begin_and_end_at_any_word(spark):
    rng = random.Random(21)
    passages = [words(rng, n) for n in (24, 25, 30, 51, 55, 60, 80) for _ in range(6)]
    texts = []
    for k, p in enumerate(passages):
        for copy in range(2):
            texts.append((2 * k + copy, "é " + " ".join([*words(rng, 30 + k), *(p if copy else [x.upper() for x in p]), *words(rng, 20)])))
    texts += [(200, "and " * 300), (201, "zz " + "And\t" * 80), (202, ""), (203, " \n"), (204, "one two three " * 30), (205, " ".join(words(rng, 23)))]
    docs = docs_frame(spark, texts)
    spans = substring.repeated_passages(docs).collect()
    assert all(texts_[r.start : r.stop].lower().split()[:1] == dict(texts)[r.kept_doc_id][r.kept_start :].lower().split()[:1] for r in spans for texts_ in [dict(texts)[r.doc_id]])
    got = {i: [False] * len(t.split()) for i, t in texts}
    for r in spans:
        t = dict(texts)[r.doc_id]
        low, n = len(t[: r.start].split()), len(t[r.start : r.stop].split())
        assert n == r.words and t[: r.start].split() + t[r.start : r.stop].split() + t[r.stop :].split() == t.split()
        got[r.doc_id][low : low + n] = [True] * n
    assert got == passage_marks(texts, substring.MIN_WORDS)
    assert substring.repeated_passages(docs.limit(0)).count() == 0


def test_every_later_whole_line_goes(spark):
    rng = random.Random(22)
    line = [" ".join(words(rng, n)) for n in (1, 3, 9, 15, 23, 40)]
    fresh = lambda: " ".join(words(rng, 12))
    texts = [(k, "\n".join(x for one in line for x in (fresh(), one if k else one.upper(), "", fresh()))) for k in range(3)]
    texts += [(10, "same\n" * 3), (11, "x y\r\n\n" + line[2].replace(" ", "\t") + " \né fin"), (12, line[3] + "\n" + line[4]), (13, "  \n\n"), (14, "a " + line[2] + " z")]
    docs = docs_frame(spark, texts)
    seen, want = set(), {}
    for i, t in sorted(texts):
        for row in t.split("\n"):
            key = " ".join(row.lower().split())
            if key and key not in seen:
                want.setdefault(i, []).extend(row.split())
            seen.add(key)
    out = substring.without_spans(docs, substring.repeated_passages(docs)).collect()
    assert {r.doc_id: r.text.split() for r in out} == {i: want.get(i, []) for i, _ in texts}


# --- 1 -------------------------------------------------------------------------


def test_rows_of_one_id_with_different_texts_stay_whole(spark):
    rng = random.Random(31)
    line, other = (" ".join(words(rng, 60)) for _ in range(2))
    docs = docs_frame(spark, [(1, line), (2, line), (2, other), (3, line), (3, line)])
    spans = substring.repeated_passages(docs)
    assert {r.doc_id for r in spans.collect()} == {3}
    kept = sorted((r.doc_id, r.text) for r in substring.without_spans(docs, spans).collect())
    assert kept == sorted([(1, line), (2, line), (2, other), (3, ""), (3, "")])


def test_license_inheritance(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code"), ("a/b/LICENSE.txt", "x\nLicensed under the Apache License, Version 2.0.\n"),
        ("a/y.py", None), ("z/q.py", ""), ("a/b/own.py", "# Licensed under CC BY-NC 4.0.\ncode"), ("top.py", "code"), (None, "All rights reserved."), (None, "x"),
        ("a/b/c/x.py", "code"), ("w/long.txt", "licence to fill " + "word " * 50_000),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumn("licence", F.lit("clash"))
    got = [(r.path, r.licence, r.origin, r.origin_path) for r in licenses.license_scan(df).collect()]
    want = [
        ("a/LICENSE", "MIT", "own", "a/LICENSE"), ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b/LICENSE.txt"), ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b/LICENSE.txt"),
        ("a/b/LICENSE.txt", "Apache-2.0", "own", "a/b/LICENSE.txt"), ("a/y.py", "MIT", "inherited", "a/LICENSE"), ("z/q.py", None, "none", None),
        ("a/b/own.py", "CC-BY-NC-4.0", "own", "a/b/own.py"), ("top.py", None, "none", None), (None, "Proprietary", "own", None), (None, None, "none", None), ("w/long.txt", None, "none", None),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_whole_licences_of_the_system(spark):
    folder = Path("/usr/share/common-licenses")
    known = {"Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "GFDL": "GFDL-1.3", "GPL": "GPL-3.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL": "LGPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}
    names = sorted(p.name for p in folder.iterdir()) if folder.is_dir() else []
    if not names:
        pytest.skip("no licences here")
    texts = [(f"{n}/LICENSE", (folder / n).read_text(errors="replace")) for n in names]
    got = {r.path.split("/")[0]: r.licence for r in licenses.license_scan(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert got == {n: known.get(n, n) for n in names}


def test_licence_headers_blocks_and_whole_files(spark):
    import textwrap

    body = {}
    for name, text in licenses.TEMPLATES:
        body[name] = max(body.get(name, ""), text, key=len)
    wrapped = lambda name, mark="", width=60: "\n".join(mark + x for x in textwrap.wrap(body[name], width))
    files = [
        ("m/LICENSE", "Copyright (c) 2020 Some One\n\n" + wrapped("MIT"), "MIT"), ("b/COPYING", "Copyright 2021, Any One\n\n" + wrapped("BSD-2-Clause"), "BSD-2-Clause"),
        ("b3/LICENSE.md", wrapped("BSD-3-Clause"), "BSD-3-Clause"), ("m/sub/x.py", "code", "MIT"),
        ("h/a.c", "/*\n" + wrapped("MPL-2.0", " * ") + "\n */\nint main() {}\n" + "int x;\n" * 300, "MPL-2.0"),
        ("h/a.py", wrapped("Apache-2.0", "# ") + "\nimport os\n" + "x = y + z\n" * 300, "Apache-2.0"),
        ("h/b.py", "#!/bin/sh\n#\n" + wrapped("GPL-3.0", "# ") + "\n\n" + "x = 1\n" * 300, "GPL-3.0"), ("h/c.py", wrapped("AGPL-3.0", "// ", 40) + "\ncode", "AGPL-3.0"),
        ("s/a.c", "// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("s/b.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;", "GPL-2.0"),
        ("s/c.c", "# SPDX-License-Identifier: Zlib\n", None), ("s/f.c", "# SPDX-License-Identifier: ISC\n", "ISC"), ("s/d.c", "# SPDX-License-Identifier:", None), ("s/e.c", "# spdx-license-identifier: Apache-2.0", "Apache-2.0"),
        ("t/LICENSE", "", None), ("t/LICENSE.b", None, None), ("t/x", "the licence of poets\nand other\nlines " + "word " * 30_000, None),
    ]
    df = spark.createDataFrame([f[:2] for f in files], "path string, text string").withColumn("key", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {r.path: r.licence for r in licenses.license_scan(df).collect()}
    assert got == {path: name for path, _, name in files}
    notice = "Licensed under the Apache License, Version 2.0."
    more = [
        ("one/x.py", "some other prose here " * 60 + notice + " and more of the same prose" * 60, "Apache-2.0"), ("two/x.js", "var a; " * 90 + body["MPL-1.1"] + " b(); c(); d();" * 40, "MPL-1.1"),
        ("g2/a.c", wrapped("GPL-2.0", " * "), "GPL-2.0"), ("g1/a.c", wrapped("GPL-1.0", " * "), "GPL-1.0"), ("l2/a.c", wrapped("LGPL-2.0", "# "), "LGPL-2.0"), ("l21/a.c", wrapped("LGPL-2.1", "# "), "LGPL-2.1"),
        ("i/LICENSE", "Copyright (c) 2020 Some One\n\n" + wrapped("ISC"), "ISC"), ("u/LICENSE", "Own Licence\nVersion 7\n\nYou may read this and do nothing else, says the licence.\n" * 20, None),
    ]
    titles = [(f"t{k}/COPYING", "    " + text.replace(" Version", "\n   Version") + "\n\nPreamble\n\n" + "The licences for most software say this and that. " * 50 + "\n\n" + wrapped("LGPL-2.1"), name)
              for k, (name, text) in enumerate(licenses.TITLES)]
    df = spark.createDataFrame([f[:2] for f in more + titles], "path string, text string")
    assert {r.path: r.licence for r in licenses.license_scan(df).collect()} == {path: name for path, _, name in more + titles}
    # What else is scanned doesn't change a score.
    alone = {r.path: r.score for path, text, _ in more[:2] for r in licenses.license_scan(spark.createDataFrame([(path, text)], "path string, text string")).collect()}
    assert alone == {r.path: r.score for r in licenses.license_scan(df).collect() if r.path in alone}
    tied = spark.createDataFrame([("d/LICENSE.b", body["MIT"]), ("d/LICENSE.a", body["MIT"]), ("d/x", "code")], "path string, text string")
    assert {r.origin_path for r in licenses.license_scan(tied).collect() if r.path == "d/x"} == {"d/LICENSE.a"}


def test_a_task_trains_the_toxicity_model(spark, monkeypatch, tmp_path):
    rows = [(k, f"plain words number {k} here" + (" zzqqxx" if k % 3 == 0 else "")) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    real = toxicity.fit

    def seen(rows, prior):
        Path(tmp_path, str(os.getpid())).touch()
        return real(rows, prior=prior)

    monkeypatch.setattr(toxicity, "fit", seen)
    model = toxicity.trained(docs, labels)
    assert isinstance(model, toxicity.Model)
    assert toxicity.trained(docs, labels.limit(0)).scores(np.array([0.0]))[0] < 0.5
    assert list(tmp_path.iterdir()) and not Path(tmp_path, str(os.getpid())).exists()
