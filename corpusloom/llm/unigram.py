"""Token counts of a unigram vocabulary by a Viterbi pass that keeps counts, not pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache
from .pieces import MARK, REMEMBERED, read_model

#: An unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0


class Unigram:
    """Pieces with scores. A word's best segmentation has the greatest sum of scores.

    Rules of the tokenizers library's Unigram model behind its Metaspace splitter:
    spaces become marks, a mark is put in front unless one is there, and each mark starts
    a word that is segmented on its own. Sums run from the word's start in double
    precision; of equal sums the one whose last piece starts earliest holds. A
    character that is no piece itself may be unknown, with a penalty below the worst score.
    Unknown characters become one piece for each of their bytes if the vocabulary has
    bytes, else a run of them is one piece.
    """

    def __init__(self, scores: dict[str, float], has_bytes: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.has_bytes = has_bytes
        self.empty = not scores

    @classmethod
    def of_model(cls, model: bytes) -> Unigram:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = range(sp.get_piece_size())
        normal = [i for i in n if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in normal}, any(map(sp.is_byte, n)))

    def count(self, word: str) -> tuple[float, int]:
        """Best score and its number of pieces."""
        n = len(word)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        lost = [False] * (n + 1)  # the best way here ends with an unknown character
        at, value, number, single = 0, None, 0, True

        def close(p: int) -> None:
            """All pieces that end at p are seen."""
            nonlocal value, number
            gone = False
            if not single:
                other = best[p - 1] + self.unknown
                if value is None or other > value:
                    value, gone = other, True
                    number = pieces[p - 1] + (len(word[p - 1].encode()) if self.has_bytes else int(not lost[p - 1]))
            best[p], pieces[p], lost[p] = value, number, gone

        for end, (length, score) in () if self.empty else self.automaton.iter(word):
            end += 1
            if end != at:
                if at:
                    close(at)
                for p in range(at + 1, end):
                    value, single = None, False
                    close(p)
                at, value, single = end, None, False
            start = end - length
            total = score + best[start]
            if value is None or total > value:
                value, number = total, pieces[start] + 1
            if length == 1:
                single = True
        if at:
            close(at)
        for p in range(at + 1, n + 1):
            value, single = None, False
            close(p)
        return best[n], pieces[n]


def words_of(text: str) -> list[str]:
    """Words without their mark."""
    if not text:
        return []
    if MARK not in text and text[0] != " ":
        return text.split(" ")
    marked = text.replace(" ", MARK)
    return (marked if marked[0] == MARK else MARK + marked).split(MARK)[1:]


def unigram_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text: ``doc_id, n_words, n_tokens, score``.

    ``score`` sums the words' best scores. Null texts count as empty and have no
    pieces. Repeated rows and null ids are each returned. Words recur, so a
    worker remembers those it met lately, in bounded memory.
    """
    model = read_model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = worker_cache("unigram"), hashlib.sha256(model.value).hexdigest()
        if held.get("key") != key:
            held.clear()
            held.update(key=key, model=Unigram.of_model(model.value), known={})
        unigram, known = held["model"], held["known"]
        for b in batches:
            n_words, n_tokens, scores = [], [], []
            for text in b.column(1):
                words = words_of(text.as_py() or "")
                if len(known) > REMEMBERED:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = unigram.count(MARK + w)
                got = [known[w] for w in words]
                n_words.append(len(words))
                n_tokens.append(sum([x[1] for x in got]))
                scores.append(float(sum([x[0] for x in got])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(scores, pa.float64())],
                names=["doc_id", "n_words", "n_tokens", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, score double")
