"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel.

A text is scored by its worst word. The kernel of two words sums, over every
common subsequence of four or five symbols with at most two more in between, the
product of ``DECAY`` to the two spans; a word's ends count as symbols. An insult
with inserted characters still shares most of its subsequences. Runs of
one-character words are joined, so that spelled-out insults count too.

The machine works on Nystroem features of bounded landmarks. As it is linear in
them, its landmarks fold into one weight for each subsequence, and scoring a word
is a sum of table look-ups with exactly the same value.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, worker_cache

#: Subsequences have these numbers of symbols and span at most SLACK symbols more.
ORDERS = (4, 5)
SLACK = 2
DECAY = 0.7
#: Weight of the longest subsequence, the whole word, whatever its length.
WHOLE = 0.7
#: Subsequences are hashed to so many bits; a symbol is its code point, so any script counts, and 0 is none.
HASH_BITS = 22
EDGE = "\x01"
#: Words the machine is trained on, at most: seeds, words of label-0 texts drawn at random, and those of each round near the boundary.
SEEDS, NEGATIVES, HARD = 3_000, 12_000, 3_000
#: Words with which wrong labels are counted: expected so often in label-0 texts by chance, and seen at most at this share of it.
EXPECTED, RARE = 30, 0.1
#: Longer words are scored by overlapping windows of so many characters.
WIDTH = 24
TRIM = ".,;:!?*#%&$\"'()[]{}<>-_~|/\\"
#: Margin of a text without words.
NOTHING = -1.0
#: Largest score where nothing was learnt that tells texts apart.
UNLEARNT = 0.49
#: Words that a worker remembers.
REMEMBERED = 300_000
SPELLED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")
#: Every way to choose a subsequence: offsets from its first symbol.
PATTERNS = [
    (0, *mid, span - 1) for p in ORDERS for span in range(p, p + SLACK + 1) for mid in itertools.combinations(range(1, span - 1), p - 2)
]


def norm(lengths: np.ndarray) -> np.ndarray:
    """Root of the kernel of a word with itself if no subsequence repeats."""
    total = np.zeros(len(lengths))
    for p in PATTERNS:
        total += np.maximum(lengths - p[-1], 0) * DECAY ** (2.0 * (p[-1] + 1))
    return np.sqrt(np.maximum(total, DECAY ** (2.0 * ORDERS[0])))


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words, and runs of one-character words joined."""
    low = (text or "").lower()
    return set(low.split()) | {re.sub(r"\s", "", m) for m in SPELLED.findall(low)}


def windows(word: str) -> list[str]:
    """The forms of a word that are scored: trimmed, without marks inside, and in pieces if long."""
    w = word.strip(TRIM) or word
    bare = w if w.isalnum() else "".join(c for c in w if c not in TRIM)
    forms = [w, bare] if bare and bare != w else [w]
    if len(w) <= WIDTH:
        return forms
    return [f[i : i + WIDTH] for f in forms for i in range(0, max(1, len(f) - WIDTH // 2), WIDTH // 2)]


class Kernel:
    """Hashes of the subsequences of words."""

    @staticmethod
    def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of symbols, a norm and the hash of the whole, for each word of at most WIDTH characters."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        most = int(lengths.max(initial=3))
        wide = np.array([EDGE + w + EDGE for w in words], f"<U{most}")
        points = wide.view(np.uint32).reshape(len(words), most)
        powers = np.multiply.accumulate(np.full(most, 2654435761, np.uint32), dtype=np.uint32)
        whole = (points * powers).sum(1, dtype=np.uint32) * np.uint32(2246822519)
        return points, norm(lengths), (whole >> np.uint32(32 - HASH_BITS)) | np.uint32(1)

    @staticmethod
    def grams(codes: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """For every pattern its weight and the hashes of the subsequences; 0 where none is."""
        n = codes.shape[1]
        for p in PATTERNS:
            if p[-1] >= n:
                continue
            parts = [codes[:, k : n - p[-1] + k] for k in p]
            value, seen = parts[0].copy(), parts[0] > 0
            for x in parts[1:]:
                value = value * np.uint32(0x9E3779B1) + x
                seen &= x > 0
            value = ((value ^ (value >> np.uint32(15))) + np.uint32(len(p))) * np.uint32(2654435761)
            yield DECAY ** (p[-1] + 1), np.where(seen, (value >> np.uint32(32 - HASH_BITS)) | np.uint32(1), 0)


def _collapsed(words: list[str], weights: np.ndarray) -> np.ndarray:
    codes, n, whole = Kernel.codes(words)
    out = np.zeros(1 << HASH_BITS)
    np.add.at(out, whole, WHOLE * weights)
    for w, g in Kernel.grams(codes):
        np.add.at(out, g, w * (weights / n)[:, None])
    out[0] = 0
    return out.astype(np.float32)


def gram_matrix(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark."""
    codes, n, whole = Kernel.codes(landmarks)
    grams = list(Kernel.grams(codes))
    known = np.unique(np.concatenate([np.zeros(1, np.uint32), whole, *(g.ravel() for _, g in grams)]))
    at = np.zeros(1 << HASH_BITS, np.int32)
    at[known] = np.arange(len(known))
    table = np.zeros((len(known), len(landmarks)), np.float32)
    for w, g in grams:
        np.add.at(table, (at[g], np.arange(len(landmarks))[:, None]), (w / n)[:, None])
    table[0] = 0
    np.add.at(table, (at[whole], np.arange(len(landmarks))), WHOLE)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for start in range(0, len(words), 4096):
        codes, n, whole = Kernel.codes(words[start : start + 4096])
        part = out[start : start + 4096]
        for w, g in Kernel.grams(codes):
            rows = at[g]
            for column in rows.T:
                some = np.flatnonzero(column)
                part[some] += w * table[column[some]]
        part /= n[:, None]
        part += WHOLE * table[at[whole]]
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def __getstate__(self) -> tuple:
        some = np.flatnonzero(self.weights)
        return some, self.weights[some], self.bias, self.slope, self.offset

    def __setstate__(self, state: tuple) -> None:
        some, values, self.bias, self.slope, self.offset = state
        self.weights = np.zeros(1 << HASH_BITS, np.float32)
        self.weights[some] = values

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's output for each word; the largest over a long word's windows."""
        out = np.full(len(words), -np.inf)
        for at in range(0, len(words), 1 << 14):  # in blocks, for memory
            some = [(i, p) for i, w in enumerate(words[at : at + (1 << 14)], at) for p in windows(w)]
            codes, n, whole = Kernel.codes([p for _, p in some])
            total = n * WHOLE * self.weights[whole]
            for w, g in Kernel.grams(codes):
                total += w * self.weights[g].sum(1, dtype=np.float64)
            np.maximum.at(out, [i for i, _ in some], total / n + self.bias)
        return out

    def scores(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -60, 60)))


def _svm(x: np.ndarray, y: np.ndarray, ridge: float = 3e-3, steps: int = 40) -> np.ndarray:
    """Weights and bias (last) of the least squared hinge; label -1 weighs three times as much in all."""
    c = np.where(y > 0, 1 / max(1, (y > 0).sum()), 3 / max(1, (y < 0).sum()))
    size = x.shape[1] + 1
    w, active = np.zeros(size), np.ones(len(x), bool)
    for _ in range(steps):
        lhs, rhs = ridge / size * np.eye(size), np.zeros(size)
        for at in range(0, len(x), 4096):  # in blocks, for memory
            rows = at + np.flatnonzero(active[at : at + 4096])
            a = np.hstack([x[rows], np.ones((len(rows), 1))]).astype(float)
            lhs += (a * c[rows, None]).T @ a
            rhs += a.T @ (c[rows] * y[rows])
        w = np.linalg.solve(lhs, rhs)
        now = y * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1
        if (now == active).all():
            break
        active = now
    return w


def _sigmoid(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset, with his smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, 0.5 / max(1, pos), 0.5 / max(1, neg)) * len(y)
    x, w = np.stack([s, np.ones_like(s)], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - t)) + 1e-3 * w * [1, 0])
        w = w - step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _pieces(word: str) -> set[str]:
    v = EDGE + word + EDGE
    return {v} | {v[i : i + k] for k in (4, 5, 7) for i in range(len(v) - k + 1)}


def _noise(clean: np.ndarray, suspect: np.ndarray, n0: int, n1: int) -> float:
    """Rate at which what belongs to label-1 texts comes up in label-0 texts, by the words that surely do; 0 if none does.

    Such a word would be in ``EXPECTED`` label-0 texts or more by chance, and is in ``RARE`` of them at most.
    """
    chance = suspect * (n0 / n1)
    sure = (chance >= EXPECTED) & (clean <= RARE * chance)
    return float(clean[sure].sum() / max(1e-9, chance[sure].sum()))


def _borne(noise: float, k1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Label-0 texts that may hold, by wrong labels, what so many label-1 texts hold: the mean and three deviations, but a few of what chance gives."""
    chance = np.asarray(k1) * (n0 / n1)
    mean = noise * chance
    return np.floor(np.minimum(mean + 3 * np.sqrt(mean), RARE / 2 * chance)).astype(np.int64)


def fit(rows: Iterable[tuple[list[str], int]], landmarks: int = 512, negatives: int = NEGATIVES, prior: float | None = None) -> Model:
    """Train on (words, label) of labelled texts; the texts' order doesn't matter.

    Only texts are labelled, not words. Seeds are words that hold a piece which
    occurs in too many label-1 texts for chance, and word and piece in no more label-0
    texts than wrong labels explain, at a rate told by the words themselves: in none, if no
    label is wrong. Of near copies among the label-1 texts one counts. The machine
    separates at most ``SEEDS`` of them, and variants with a character inserted, from
    ``negatives`` words of label-0 texts; then, three times, at most ``HARD`` words of
    label-0 texts near its boundary join the others. With one
    label only, or no seeds, nothing is learnt that tells texts apart: every score is ``prior``,
    or if that isn't given the smoothed share of label 1 among the rows, which a balanced
    sample distorts, and at most ``UNLEARNT``, so that no text is rejected.
    """
    known: dict[str, int] = {}
    texts: list[np.ndarray] = []
    marks: list[int] = []
    for words, label in rows:
        texts.append(np.array(sorted({known.setdefault(p, len(known)) for w in words for p in windows(w)}), np.int32))
        marks.append(int(label))
    names, label = list(known), np.array(marks)
    del known
    n1 = int(label.sum())
    share = (n1 + 1) / (len(texts) + 2)
    prior = share if prior is None else prior
    unlearnt = min(prior, UNLEARNT)
    constant = Model(np.zeros(1 << HASH_BITS, np.float32), 0.0, 0.0, math.log(unlearnt / (1 - unlearnt)))
    if not 0 < n1 < len(texts):
        return constant
    clean, suspect = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for ids, mark in zip(texts, marks, strict=True):
        (suspect if mark else clean)[ids] += 1
    # Of near copies with one label one counts: texts that agree in a band of four min-hashes with an earlier one are copies.
    base_hash = np.array([zlib.crc32(w.encode()) for w in names], np.uint64)
    mixers = np.random.default_rng(5).integers(1, 1 << 62, (16, 2), dtype=np.uint64) | np.uint64(1)
    met: set[tuple] = set()
    first = np.zeros(len(texts), bool)
    for k, (ids, mark) in enumerate(zip(texts, marks, strict=True)):
        least = [int(((base_hash[ids] * m + c) >> np.uint64(20)).min(initial=1 << 44)) for m, c in mixers]
        bands = {(mark, j, *least[j : j + 4]) for j in range(0, 16, 4)}
        first[k] = not met & bands
        met |= bands
    del base_hash
    counted = [np.zeros(len(names), np.int64) for _ in range(2)]
    for k in np.flatnonzero(first):
        counted[marks[k]][texts[k]] += 1
    kept0, kept1 = (int((first & (label == m)).sum()) for m in (0, 1))
    noise = _noise(*counted, kept0, kept1)
    suspect[(clean > 0) & (np.maximum(counted[0], 1) > _borne(noise, counted[1], kept0, kept1))] = 0
    different = [texts[k][suspect[texts[k]] > 0] for k in np.flatnonzero(first & (label == 1))]
    enough = max(3.0, math.log(1e6) / -math.log(share))
    # Counted by hash first, then exactly for those that may be frequent.
    rough = np.zeros(1 << 22, np.int32)
    slot = lambda p: zlib.crc32(p.encode()) >> 10
    for odd in different:
        rough[list({slot(p) for i in odd for p in _pieces(names[i])})] += 1
    held = Counter(p for odd in different for p in {p for i in odd for p in _pieces(names[i]) if rough[slot(p)] >= enough})
    telling = {p for p, k in held.items() if k >= enough}
    of_word = {int(i): told for i in np.flatnonzero(clean) if (told := telling & _pieces(names[i]))}
    seen: Counter = Counter()
    for k in np.flatnonzero(label == 0):
        # A copy counts as one that is seen at least once.
        for piece in set().union(*(of_word.get(i, ()) for i in texts[k].tolist())):
            seen[piece] = max(1, seen[piece] + int(first[k]))
    telling -= {p for p, k in seen.items() if k > _borne(noise, held[p], kept0, kept1)}
    del held, rough
    seeds = [names[i] for i in np.flatnonzero(suspect) if telling & _pieces(names[i])]
    if not seeds:
        return constant
    number = dict(zip(names, suspect.tolist(), strict=True))
    seeds.sort(key=lambda w: (-number[w], w))
    del number
    # What wrong labels put among the others, seeds and words with their pieces, is no counterexample.
    plain = [names[i] for i in sorted(np.flatnonzero(clean), key=lambda i: (-clean[i], names[i])) if not telling & of_word.get(int(i), set())]
    rng = np.random.default_rng(7)

    def variants(words: list[str]) -> list[str]:
        spots = [(k, w, 1 + int(rng.integers(len(w) - 1))) for k, w in enumerate(words) if 4 <= len(w) < WIDTH]
        return [w[:i] + "*.-x"[k % 4] + w[i:] for k, w, i in spots]

    half = 3 * landmarks // 4
    spread = [seeds[int(i)] for i in np.unique(np.geomspace(1, len(seeds), half).astype(int) - 1)]
    base = list(dict.fromkeys([*spread, *seeds[:half]]))[:half]
    base += plain[: landmarks - len(base)]
    square = gram_matrix(base, base).astype(float)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    good = seeds[:SEEDS]
    good = good + variants(good)
    bad = [plain[i] for i in sorted(rng.permutation(len(plain))[:negatives])]
    for _ in range(3):
        x = gram_matrix(good + bad, base)
        for at in range(0, len(x), 4096):  # in place, for memory
            x[at : at + 4096] = x[at : at + 4096] @ root.astype(np.float32)
        w = _svm(x, np.r_[np.ones(len(good)), -np.ones(len(bad))])
        del x
        model = Model(_collapsed(base, root @ w[:-1]), float(w[-1]), 1.0, 0.0)
        near = model.margins(plain)
        bad = sorted({*bad, *(plain[i] for i in np.argsort(-near, kind="stable")[:HARD] if near[i] > -0.8)})
    margin = model.margins(names)
    worst = np.array([margin[ids].max(initial=-np.inf) if len(ids) else NOTHING for ids in texts])
    # No text is predicted toxic if the machine accepts none of its words.
    model.slope, offset = _sigmoid(worst, label)
    model.offset = min(offset, 0.0)
    return model


def _learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from, one an id."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("id is not null and toxic in (0, 1)")
        .filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, each: int = 2500) -> DataFrame:
    """``id, toxic, words`` of at most ``each`` texts of either label, the same every time.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 5 isn't 0.
    Rows with a null id or label are left out; of several labels of one id the
    largest holds. The ids of the sample are chosen from the labels alone and,
    being at most twice ``each``, are broadcast to one scan of the texts.
    """
    marks = _learnable(labels)
    take = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(each) for k in (0, 1)]
    few = take[0].unionAll(take[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(few), "id")
    words = F.pandas_udf(lambda s: s.map(lambda t: sorted(words_of(t))), "array<string>")
    return checkpointed(texts.select("id", "toxic", words("text").alias("words")))


def scorer(model: Model, name: str) -> Column:
    """A column function that scores whole texts; null texts count as empty."""
    import uuid

    key = f"toxicity-{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = worker_cache("toxicity")
        if held.get("key") != key:
            held.clear()
            held.update(key=key, margin={})
        margin = held["margin"]
        for texts in batches:
            worst = np.empty(len(texts))
            for at in range(0, len(texts), 500):
                some = [words_of(t) for t in texts.iloc[at : at + 500]]
                if len(margin) > REMEMBERED:
                    margin.clear()
                new = list(set().union(*some).difference(margin))
                margin.update(zip(new, model.margins(new).tolist(), strict=True))
                worst[at : at + len(some)] = [max(map(margin.__getitem__, words), default=NOTHING) for words in some]
            yield pd.Series(model.scores(worst))

    return F.pandas_udf(run, "double")(F.col(name))


def trained(docs: DataFrame, labels: DataFrame, each: int = 2500) -> Model:
    """The model, trained by a task on the sample, which is bounded; only the model comes to the driver."""
    small_batches(docs.sparkSession)
    n, n1 = _learnable(labels).agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (n1 + 1) / (n + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity").clear()  # what another model's scorer kept
        rows = ((r["words"], r["toxic"]) for b in batches for r in b.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows, prior=prior))], pa.binary())], names=["model"])

    sample = labelled_sample(docs, labels, each).coalesce(1).sortWithinPartitions("id", F.size("words"))
    found = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(found.model)) if found else fit([], prior=prior)


def toxicity(docs: DataFrame, labels: DataFrame, each: int = 2500) -> DataFrame:
    """Score of every whole text: ``doc_id, held_out, score, predicted``.

    ``held_out`` marks rows whose labels are never learnt from. ``score`` is the
    probability of label 1 and ``predicted`` 1 from 0.5 on. Empty and null texts
    get the score of a text without any suspicious word. Repeated rows are each
    scored; a null id gives a null ``held_out``. Without labels of both kinds
    every score is the smoothed share of label 1, at most ``UNLEARNT``: without any
    label, or with one kind only, no text is rejected. Other columns, labels included,
    never enter a score.
    """
    return toxicity_with(docs, trained(docs, labels, each))


def toxicity_with(docs: DataFrame, model: Model) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    scored = rows.select("doc_id", scorer(model, "t").alias("score"))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
