"""Token counts without tokens (operator 7): count-only Viterbi over a unigram vocabulary.

Pieces and scores are those of a public SentencePiece file. An Aho-Corasick automaton
enumerates all pieces that end at each character; dynamic programming carries only the best
score and its number of pieces, by the tokenizer's own rules:

* spaces become U+2581, and one is put before a text that doesn't start with it;
* a higher score wins, and among equal ones the piece that starts first;
* a character that is no piece by itself scores 10 less than the least score, and counts as
  its UTF-8 bytes (byte fallback).

No piece holds U+2581 after another character, so every segmentation has a cut there: texts are
split at these cuts and the results of the (mostly repeated) short parts remembered, up to a number
of bytes. A part of any length is streamed: only as many characters are held as the longest piece
has. Scores in the file are integers, so their sums are exact in any order.

Defined results: a null or empty text has no pieces and score 0; repeated rows are counted
each; other columns are ignored; an empty table gives no rows; a very long text, with or without
spaces, is counted in memory of a small multiple of its own bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import remembered, slices
from quern.llm.tokens import tokenizer_path

SPACE = "▁"
#: Fixed value of the public tokenizer.
UNKNOWN_PENALTY = 10.0
_PARTS = re.compile(" +[^ ]*|[^ ]+")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class PieceCounter:
    #: Bytes of remembered parts in one of two generations, and of the longest remembered part.
    LIMIT, LONGEST = 16 << 20, 64

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        if any(SPACE in piece.lstrip(SPACE) for piece, _ in pieces):
            raise ValueError("a piece goes on after a space, so texts can't be split there")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.longest = max((len(piece) for piece, _ in pieces), default=1)
        #: Parts, and the pieces and score of each.
        self.known = self.old = (pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0))

    def part(self, text: str) -> tuple[int, float]:
        """Count and score of the best segmentation of a part."""
        room = min(len(text), self.longest) + 1  # place k holds what is best up to character k, modulo this
        score, count = [0.0] * room, [0] * room
        at, best, pieces, size = 0, None, 0, 0
        for end, (length, value) in chain(self.automaton.iter(text), ((len(text), (0, 0.0)),)):
            while at < end:  # all pieces that end before this one have been seen
                if text[at] not in self.single:
                    other = score[at % room] + self.unknown
                    if best is None or other > best:
                        best, pieces = other, count[at % room] + len(text[at].encode())
                at += 1
                score[at % room], count[at % room] = best, pieces
                best, size = None, 0
            start = (end + 1 - length) % room
            value += score[start]
            if best is None or value > best or value == best and length > size:  # of equals the one that starts first
                best, pieces, size = value, count[start] + 1, length
        return count[at % room], score[at % room]

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and best score of each text."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0)
        plain = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        bare = pc.and_(pc.not_equal(plain, ""), pc.invert(pc.starts_with(plain, " ")))
        plain = pc.if_else(bare, pc.binary_join_element_wise(" ", plain, ""), plain)
        if pc.any(pc.match_substring(plain, "\0")).as_py():
            parts = pa.array([_PARTS.findall(x) for x in plain.to_pylist()], pa.list_(pa.string()))
        else:
            parts = pc.split_pattern(pc.replace_substring_regex(plain, " +", "\0\\0"), "\0")
        coded = parts.flatten().dictionary_encode()
        found, which = self._parts(coded.dictionary), coded.indices.to_numpy()
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        # scores are whole numbers, so differences of running sums are exact
        return tuple(np.diff(np.concatenate(([0], np.cumsum(x[which])))[offsets]) for x in found)

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of distinct parts."""
        if self.known[0].nbytes + 16 * len(self.known[0]) > self.LIMIT:
            self.old, self.known = self.known, (pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0))
        counts, scores, missing = np.zeros(len(parts), np.int64), np.zeros(len(parts)), np.arange(len(parts))
        for names, known_counts, known_scores in (self.known, self.old):
            places = pc.fill_null(pc.index_in(parts.take(pa.array(missing)), value_set=names), -1).to_numpy()
            there = places >= 0
            counts[missing[there]], scores[missing[there]] = known_counts[places[there]], known_scores[places[there]]
            if names is self.known[0]:
                new = missing = missing[~there]
            else:
                missing = missing[~there]
        for k, x in zip(missing.tolist(), parts.take(pa.array(missing)).to_pylist(), strict=True):
            counts[k], scores[k] = self.part(x.replace(" ", SPACE))
        short = new[pc.less_equal(pc.binary_length(parts.take(pa.array(new))), self.LONGEST).to_numpy(zero_copy_only=False)]
        self.known = (pa.concat_arrays([self.known[0], parts.take(pa.array(short))]), np.append(self.known[1], counts[short]), np.append(self.known[2], scores[short]))
        return counts, scores


def counter(path: str) -> PieceCounter:
    """One for each Python worker and vocabulary."""
    return remembered(("counter", path), lambda: PieceCounter(read_pieces(path)))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in slices(batches, "text", 8 << 20):
            counts, scores = count(batch.column("text"))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the best segmentation's score of each document. Nothing is shuffled."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_count(path), "doc_id long, n_tokens long, score double")
