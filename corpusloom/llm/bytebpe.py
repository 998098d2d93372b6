"""Encoding and decoding with byte-level merge vocabularies given as ranks."""

from __future__ import annotations

import array
import base64
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable
from .common import Remembered, byte_offsets, sized, small_batches, worker_cache

#: Slots for adjacent pairs that a worker remembers, eight bytes each; a pair takes the slot of another.
PAIRS = 1 << 20
#: Units and characters that are looked up at once.
UNITS, CHARACTERS = 1 << 18, 4 << 20
#: Texts of more characters are matched piecemeal, and output batches close at so many bytes.
LONG = 1 << 20
BATCH_BYTES = 4 << 20
#: Stand-ins for a code point that the two pattern libraries class differently: none is part of a contraction.
_LETTER, _NUMBER, _MARK = "é", "0", "†"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def class_differences() -> dict[int, str]:
    """Code points that the tiktoken library classes otherwise than ``regex``, with a stand-in of the library's class.

    The two carry different versions of the Unicode tables. The library tells its classes
    itself: a pattern of one class drops all other characters.
    """
    import tiktoken

    everything = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}

    def held(pattern: str) -> tuple[set[str], set[str]]:
        known = tiktoken.Encoding("class", pat_str=f"{pattern}+", mergeable_ranks=single, special_tokens={})
        return set(known.decode(known.encode_ordinary(everything))), set("".join(regex.findall(f"{pattern}+", everything)))

    (letters, own_letters), (numbers, own_numbers) = held(r"\p{L}"), held(r"\p{N}")
    odd = (letters ^ own_letters) | (numbers ^ own_numbers)
    return {ord(c): _LETTER if c in letters else _NUMBER if c in numbers else _MARK for c in odd}


class Merges:
    """A vocabulary of byte strings that merges made, with the last merge of each.

    A sequence of tokens is what the merges give exactly if each two neighbours are what
    they give for the neighbours' bytes alone. Tokens that the merges can't reach from
    their own bytes only ever stand for a whole unit.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, stand_ins: dict[int, str]):
        import ahocorasick

        self.ranks = ranks
        self.names = {r: b for b, r in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        #: Order of merging; single bytes are there from the start.
        self.order = {r: r if len(b) > 1 else -1 for r, b in self.names.items()}
        self.last: dict[int, tuple[int, int]] = {}
        self.fitting = array.array("q", [-1]) * PAIRS
        made = {r for r, b in self.names.items() if len(b) == 1}
        for r, b in sorted(self.names.items()):
            for k in range(1, len(b)):
                left, right = ranks.get(b[:k]), ranks.get(b[k:])
                if left in made and right in made and max(self.order[left], self.order[right]) < r and self._meet(left, right, r):
                    self.last[r] = (left, right)
                    made.add(r)
                    break
        self.size = {r: len(self.names[r]) for r in made}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for r in made:
            b = self.names[r]
            self.shorter[r] = next((ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if ranks.get(b[:k]) in made), None)
            self.automaton.add_word(b.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        self.stand_ins = stand_ins
        self.odd = np.zeros(0x110000, bool)
        self.odd[list(stand_ins)] = True
        self.late = re.compile(f"[^\0-{chr(min(stand_ins) - 1)}]") if stand_ins else None

    def _meet(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether two tokens stay apart if only merges ranked under ``before`` happen.

        The merges of both sides are undone, latest first; at each point the two tokens at the
        border would have merged instead, had their merge come before the one just undone. Of
        equal merges the left comes first.
        """
        limit = before
        while True:
            joined = self.ranks.get(self.names[left] + self.names[right])
            if joined is not None and joined < limit:
                return False
            if max(self.order[left], self.order[right]) < 0:
                return True
            if self.order[left] > self.order[right]:
                limit, left = left, self.last[left][1]
            else:
                limit, right = right + 1, self.last[right][0]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens can stand next to each other; remembered."""
        slot, pair = (left * 31_321 + right) & (PAIRS - 1), left << 31 | right
        held = self.fitting[slot]
        if held >> 1 != pair:
            held = self.fitting[slot] = pair << 1 | self._meet(left, right)
        return bool(held & 1)

    def merged(self, unit: bytes) -> list[int]:
        """Ids of one unit: longest matches first, stepping back from where no token fits.

        The tokens up to a position are the same whatever follows, so a position that was
        left for want of a token is never tried again, and time is linear in the unit.
        """
        whole = self.ranks.get(unit)
        if whole is not None or not unit:
            return [] if whole is None else [whole]
        longest = [0] * len(unit)
        size, shorter, fits = self.size, self.shorter, self.fits
        for end, token in self.automaton.iter(unit.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # ends ascend, so the longest comes last
        n = len(unit)
        dead = bytearray(n + 1)
        at = size[longest[0]]
        out = [longest[0]]
        while at < n:
            token, last = longest[at], out[-1] if out else None
            while token is not None:
                if not dead[at + size[token]] and (last is None or fits(last, token)):
                    break
                token = shorter[token]
            while token is None:
                dead[at] = 1
                last = out.pop()
                at -= size[last]
                token = shorter[last]
                while token is not None and (dead[at + size[token]] or (out and not fits(out[-1], token))):
                    token = shorter[token]
            out.append(token)
            at += size[token]
        return out

    def units(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches in lists, each of which fits into memory."""
        same = text
        if self.late is not None and self.late.search(text) and self.odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            same = text.translate(self.stand_ins)
        if same is text and len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(same)
        while part := [text[m.start() : m.end()] for m in itertools.islice(found, 1 << 16)]:
            yield part

    def _made(self, units: list[str]) -> list[pa.Array]:
        return [pa.array([array.array("I", self.merged(unit.encode())).tobytes() for unit in units], pa.binary())]

    def all_packed(self, texts: Iterable[str], known: dict) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; ``known`` holds what is remembered of units."""
        held = known.setdefault("units", Remembered(pa.binary()))
        waiting: list[str] = []
        ends: list[int] = []  # of texts among the units that wait
        size, begun = 0, []  # begun: the ids so far of a text that goes on

        def flush() -> Iterator[bytes]:
            nonlocal size
            places, (values,) = held.found(pa.array(waiting, pa.string()), self._made)
            ids = values.take(places)
            at, flat, since = byte_offsets(ids), ids.buffers()[2] or b"", 0
            for end in ends:
                begun.append(flat[int(at[since]) : int(at[end])])
                yield b"".join(begun)
                begun.clear()
                since = end
            begun.append(flat[int(at[since]) : int(at[-1])])
            waiting.clear()
            ends.clear()
            size = 0

        for text in texts:
            for units in self.units(text):
                waiting += units
                size += sum(map(len, units))
                if len(waiting) >= UNITS or size >= CHARACTERS:
                    yield from flush()
            ends.append(len(waiting))
        yield from flush()

    def packed(self, text: str, known: dict) -> bytes:
        """One text's ids."""
        return next(self.all_packed([text], known))

    def decoded(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        return b"".join(map(self.names.__getitem__, memoryview(packed).cast("I").tolist() if packed else ()))


def _vocabulary(shared) -> Merges:
    """The vocabulary, built once in a worker from what was broadcast."""
    held = worker_cache("byte merges")
    ranks, pattern, stand_ins, key = shared.value
    if key not in held:
        held.clear()
        worker_cache("byte units").clear()
        held[key] = Merges(ranks, pattern, stand_ins)
    return held[key]


def _shared(docs: DataFrame, rank_path: str, pattern: str):
    """Ranks, pattern and stand-ins, broadcast: of fixed size, whatever the data."""
    ensure_importable(docs.sparkSession)
    small_batches(docs.sparkSession)
    with open(rank_path, "rb") as f:
        key = hashlib.sha256(f.read() + pattern.encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((read_ranks(rank_path), pattern, class_differences(), key))


def encoded(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text encoded and decoded again: ``doc_id, ids, decoded``.

    ``ids`` are little-endian unsigned 32-bit integers one after another, without special
    tokens, ``decoded`` the bytes that the ids stand for. The pattern's matches are encoded
    separately, as the tiktoken library does. Null texts count as empty; an empty text has no
    ids and decodes to no bytes. Rows repeated under one id and null ids are each returned;
    an empty table gives none. Other columns are not looked at.
    """
    shared = _shared(docs, rank_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, known = _vocabulary(shared), worker_cache("byte units")
        for b in sized(batches):
            since, ids, back, held = 0, [], [], 0
            texts = (text.as_py() or "" for text in b.column(1))
            for at, packed in enumerate(merges.all_packed(texts, known)):
                ids.append(packed)
                back.append(merges.decoded(packed))
                held += len(ids[-1]) + len(back[-1])
                if held > BATCH_BYTES or at + 1 == b.num_rows:
                    part = [b.column(0).slice(since, len(ids)), pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                    yield pa.RecordBatch.from_arrays(part, names=["doc_id", "ids", "decoded"])
                    since, ids, back, held = at + 1, [], [], 0

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def decoded(rows: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of packed ids, as ``encoded`` returns them: ``doc_id, decoded``; null ids give null, an unknown id fails the job."""
    shared = _shared(rows, rank_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _vocabulary(shared)
        for b in batches:
            back = [None if x is None else merges.decoded(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.binary())], names=["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("i")).mapInArrow(run, "doc_id long, decoded binary")
