"""Encoding and decoding with SentencePiece vocabularies of the merge type."""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, byte_offsets, sized, small_batches, worker_cache

MARK = "▁"
#: Units that a worker remembers.
REMEMBERED = 200_000
#: Longer units have an agenda of their own; shorter ones share one, step by step.
LONG = 64
_NONE = np.int32(2**31 - 1)
SLOT_BITS = 19


def _slots(keys: np.ndarray) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Pieces:
    """A merge vocabulary: symbols, the merges of adjacent symbols, and their scores.

    A text is the mark, then the text with spaces as marks. No piece goes on past a
    mark that follows another character, so the runs of marks with the characters
    up to the next mark, called units, are encoded on their own.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.size = n
        normal = {
            sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.names = dict(normal)
        for p in normal:
            for c in p:
                self.names.setdefault(c, len(self.names) + n)
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in self.names.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.string = {i: p for p, i in self.names.items()}
        self.told = pa.array([f"{i}," for i in range(n)], pa.string())
        #: What a worker remembers of units, by purpose.
        self.kept: dict[str, Remembered] = {}
        # Merges by rank: the best score first.
        ranked = sorted((-sp.get_score(i), p, i) for p, i in normal.items() if len(p) > 1)
        rank, last = {}, None
        for score, p, _ in ranked:
            rank[p] = rank[last[1]] + (last[0] != score) if last else 0
            last = (score, p)
        keys, ranks, made = [], [], []
        for _, p, i in ranked:
            for k in range(1, len(p)):
                a, b = self.names.get(p[:k]), self.names.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank[p])
                    made.append(i)
        keys, ranks, made = np.array(keys, np.int64), np.array(ranks, np.int32), np.array(made, np.int32)
        # A hash table with open addressing: the place of a pair, or the next free one.
        self.keys = np.full(1 << SLOT_BITS, -1, np.int64)
        self.ranks, self.made = np.full(1 << SLOT_BITS, _NONE, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        for key, rank_, made_, at in zip(keys.tolist(), ranks.tolist(), made.tolist(), _slots(keys).tolist(), strict=True):
            while self.keys[at] != -1:
                at = (at + 1) & ((1 << SLOT_BITS) - 1)
            self.keys[at], self.ranks[at], self.made[at] = key, rank_, made_

    def merges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; rank ``_NONE`` where they don't merge."""
        key = ((a.astype(np.int64) & 0x7FFFFFFF) << 32) | (b.astype(np.int64) & 0x7FFFFFFF)
        at = _slots(key)
        held = self.keys[at]
        astray = np.flatnonzero((held != key) & (held != -1))
        while len(astray):
            at[astray] = (at[astray] + 1) & ((1 << SLOT_BITS) - 1)
            held = self.keys[at[astray]]
            astray = astray[(held != key[astray]) & (held != -1)]
        return self.ranks[at], self.made[at]

    def agenda(self, unit: str) -> list[int]:
        """Symbols of one unit: a queue of adjacent pairs, best score first, then leftmost."""
        sym = self.symbol[np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)]
        rank, made = self.merges(sym[:-1], sym[1:])
        queue = [(int(r), k, int(sym[k]), int(sym[k + 1]), int(m)) for k, (r, m) in enumerate(zip(rank, made, strict=True)) if r != _NONE]
        heapq.heapify(queue)
        at: list[int | None] = sym.tolist()
        after, before = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))

        def offer(k: int, j: int) -> None:
            if k >= 0 and j < len(at):
                r, m = self.merges(np.array([at[k]]), np.array([at[j]]))
                if r[0] != _NONE:
                    heapq.heappush(queue, (int(r[0]), k, at[k], at[j], int(m[0])))

        while queue:
            _, k, left, right, m = heapq.heappop(queue)
            j = after[k]
            if at[k] != left or j >= len(at) or at[j] != right:
                continue
            at[k], at[j] = m, None
            after[k] = after[j]
            if after[j] < len(at):
                before[after[j]] = k
            offer(before[k], k)
            offer(k, after[k])
        return [s for s in at if s is not None]

    def symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of many units, and the unit of each: all agendas take a step at once."""
        text = "".join(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        sym = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        of = np.repeat(np.arange(len(units)), sizes)
        self_chars = np.arange(len(sym))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), _NONE, np.int32)
        made = np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            r, m = self.merges(sym[:-1], sym[1:])
            rank[:-1], made[:-1] = np.where(of[:-1] == of[1:], r, _NONE), m
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            count = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            spread = np.repeat(best, count)
            over = spread == _NONE
            if over.any():
                done.append((of[over], self_chars[over], sym[over]))
                keep = ~over
                sym, of, rank, made, self_chars, spread = (x[keep] for x in (sym, of, rank, made, self_chars, spread))
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == spread)
            hits = hits[np.concatenate([[True], of[hits[1:]] != of[hits[:-1]]])]
            sym[hits] = made[hits]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            moved = np.cumsum(keep) - 1
            sym, of, rank, made, self_chars = (x[keep] for x in (sym, of, rank, made, self_chars))
            hits = moved[hits]
            for k in (hits, hits[hits > 0] - 1):
                right = np.minimum(k + 1, len(sym) - 1)
                r, m = self.merges(sym[k], sym[right])
                rank[k] = np.where((of[k] == of[right]) & (right > k), r, _NONE)
                made[k] = m
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        of, place, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        return sym[order], of[order]

    def ids(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit; characters outside the vocabulary become bytes."""
        short = [k for k, u in enumerate(units) if len(u) <= LONG]
        out: list[list[int]] = [[] for _ in units]
        sym, of = self.symbols([units[k] for k in short])
        bounds = np.append(0, np.cumsum(np.bincount(of, minlength=len(short))))
        flat, bounds = sym.tolist(), bounds.tolist()
        for k, a, b in zip(short, bounds, bounds[1:], strict=False):
            out[k] = flat[a:b]
        for k, u in enumerate(units):
            if len(u) > LONG:
                out[k] = self.agenda(u)
        odd = {short[j] for j in np.unique(of[(sym < 0) | (sym >= self.size)]).tolist()}
        for k in odd | {k for k, u in enumerate(units) if len(u) > LONG}:
            out[k] = self._with_bytes(units[k], out[k])
        return out

    def _with_bytes(self, unit: str, symbols: list[int]) -> list[int]:
        ids, at = [], 0
        for s in symbols:
            piece = self.string.get(s) or unit[at]
            at += len(piece)
            ids += [s] if 0 <= s < self.size else self.bytes[list(piece.encode())].tolist()
        return ids

    def split(self, text: str) -> list[str]:
        """A text's units, each without its first mark."""
        if not text:
            return []
        if self.whole:
            return [text.replace(" ", MARK)]
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def listed(self, texts: pa.Array) -> pa.Array:
        """A list of units for each text, as ``split`` gives them; null texts count as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.equal(texts, ""), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = pc.or_(odd, pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)))
        at = np.arange(len(texts)) if self.whole else np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.split_pattern(texts, " ")
        if not len(at):
            return plain
        own = pa.array(list(map(self.split, texts.take(pa.array(at)).to_pylist())), plain.type)
        order = np.arange(len(texts))
        order[at] = len(texts) + np.arange(len(at))
        return pa.concat_arrays([plain, own]).take(pa.array(order))

    def known(self, keys: list[str]) -> list[list[int]]:
        """The library's ids of units without their first mark. It has none for a bare mark alone; those are the agenda's."""
        ids = self.library.encode(list(map(_spaced, keys)), num_threads=1)
        return [i if k else self.ids([MARK])[0] for k, i in zip(keys, ids, strict=True)]

    def checked(self, keys: list[str]) -> list[list[int]]:
        """The agenda's ids of units without their first mark, held against the library's for the same units.

        Raises ValueError at a difference. The library has no ids for a bare mark, which only stands inside a text.
        """
        ids = self.ids([MARK + k for k in keys])
        for k, own, known in zip(keys, ids, self.library.encode(list(map(_spaced, keys)), num_threads=1), strict=True):
            if k and own != known:
                raise ValueError(f"unit {k[:80]!r}: ids {own[:40]}, but the library has {known[:40]}")
        return ids


def pieces_of(model) -> Pieces:
    """The vocabulary, built once in a worker from the broadcast model."""
    held = worker_cache("pieces")
    key = hashlib.sha256(model.value).hexdigest()
    if key not in held:
        # Lists of ids come in millions and never form cycles; looking for some costs more than encoding.
        gc.set_threshold(200_000, 50, 50)
        held.clear()
        held[key] = Pieces(model.value)
    return held[key]


def read_model(df: DataFrame, path: str):
    """The model file's bytes, broadcast: a vocabulary of fixed size, whatever the data."""
    small_batches(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _spaced(key: str) -> str:
    return key.replace(MARK, " ")


def looked_up(known: dict, pieces: Pieces, texts: list[list[str]], value) -> list[list]:
    """``value(ids)`` for every unit of the texts, from ``known``, which stays bounded; the library encodes new units."""
    if len(known) > REMEMBERED:
        known.clear()
    got = [list(map(known.get, units)) for units in texts]
    gaps = [[k for k, v in enumerate(values) if v is None] for values in got]
    new = list({units[k] for units, at in zip(texts, gaps, strict=True) for k in at})
    fresh: dict = {}
    for at in range(0, len(new), 1 << 15):
        part = new[at : at + (1 << 15)]
        fresh.update(zip(part, map(value, pieces.known(part)), strict=True))
    for units, values, at in zip(texts, got, gaps, strict=True):
        for k in at:
            values[k] = fresh[units[k]]
    known.update(fresh)
    return got


def _binary(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def packed(ids: list[list[int]], kind: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lists of ids as numbers of a type one after another; also all ids, and where each list begins and the last ends."""
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(ends[-1]))
    if len(flat) and flat.max() > np.iinfo(kind).max:
        raise ValueError(f"id {flat.max()} doesn't fit into {np.dtype(kind).itemsize} bytes")
    return _binary(ends * np.dtype(kind).itemsize, flat.astype(kind)), flat, ends


def in_parts(encode, keys: list[str]) -> list[list[int]]:
    """``encode(keys)``, some at a time."""
    return [i for at in range(0, len(keys), 1 << 15) for i in encode(keys[at : at + (1 << 15)])]


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text encoded and decoded: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Ids are the agenda's, without begin or end ids; each new unit's are checked against
    the sentencepiece library's, and a difference fails the job. The library decodes
    the ids of each whole text. Null texts count as empty; an empty text has no ids
    and decodes to an empty text. Rows repeated under one id and null ids are each
    returned.
    """
    model = read_model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        known = pieces.kept.setdefault("text", Remembered(pa.binary(), pa.binary(), strings=300_000))

        def made(keys: list[str]) -> list[pa.Array]:
            ids, flat, ends = packed(in_parts(pieces.checked, keys), "<i4")
            told = pieces.told.take(pa.array(flat))
            return [ids, _binary(byte_offsets(told)[ends], told.buffers()[2] or b"")]

        for b in sized(batches, 2 << 20):
            units = pieces.listed(b.column(1))
            places, values = known.found(units.flatten(), made)
            ids, told = (x.take(places) for x in values)
            ends = np.append(0, np.cumsum(pc.list_value_length(units).to_numpy()))
            ids_at, told_at = byte_offsets(ids)[ends].tolist(), byte_offsets(told)[ends].tolist()
            flat, digits = np.frombuffer(ids.buffers()[2] or b"", "<i4"), memoryview(told.buffers()[2] or b"")
            ids_sha = [hashlib.sha256(digits[a : max(a, z - 1)]).hexdigest() for a, z in itertools.pairwise(told_at)]
            text_sha = []
            for at in range(0, b.num_rows, 250):
                some = [flat[a // 4 : z // 4].tolist() for a, z in itertools.pairwise(ids_at[at : at + 251])]
                full = [k for k, x in enumerate(some) if x]
                back = dict(zip(full, pieces.library.decode([some[k] for k in full], num_threads=1) if full else [], strict=True))
                text_sha += [hashlib.sha256(back.get(k, "").encode()).hexdigest() for k in range(len(some))]
            n = pa.array(np.diff(ids_at) // 4, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), n, pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counter(docs: DataFrame, model_path: str):
    """A column function: the number of ids of a text column; null texts have none."""
    model = read_model(docs, model_path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces, known = pieces_of(model), worker_cache("piece count")
        for texts in batches:
            n = []
            for at in range(0, len(texts), 250):
                split = [pieces.split(t or "") for t in texts.iloc[at : at + 250]]
                n += map(sum, looked_up(known, pieces, split, len))
            yield pd.Series(n, dtype="int64")

    return F.pandas_udf(run, "long")
