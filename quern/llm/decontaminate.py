"""Benchmark decontamination (operator 5): seeds that miss no pair, then Smith-Waterman alignment.

1. *Seeds.* Two words matched one after the other are a good pair if at most one error (a word
   replaced, added or missing) is between them, so they are one or two places apart in the item
   and in the document. Where an item of L words scores L/2 with m matches, there are at most
   2m - L errors, thus at least ceil(L/2) - 1 good pairs, each with a first word of its own, and
   the passage has at most 2L words. One good pair at least is left when the ceil(L/2) - 2 places
   of the item whose pairs most items share are not looked up: the other places' pairs are the
   seeds. Items shorter than ``GRAM`` words have one seed, all their words.
2. *Join.* Where a document holds a seed, the places of all pairs of the item are counted, and
   ceil(L/2) - 1 of them within 2L words propose the stretch that a passage with them can cover;
   overlapping stretches of one item are joined.
3. *Alignment.* Smith-Waterman over words (match 1, mismatch and gap -1/2) scores each stretch.
   The score over the item's length, 1 for a verbatim copy, is that of the pair; pairs with
   ``THRESHOLD`` (half, which the counts above rest on) or more are contamination. For items of
   ``GRAM`` words or more, these are the pairs that aligning whole documents would find.

Seeds depend on the benchmark alone: how many documents hold a passage changes nothing.

The benchmark is the stated query set: it is taken in blocks of at most ``BLOCK_BYTES`` of text,
so what is broadcast has a proven bound whatever the benchmark's size, and each block meets all
documents where they lie. A document is never shuffled, and a passage that a third of all
documents hold costs each of them its own alignment.

Words are what lower case and ASCII punctuation leave. Defined results: null or empty texts
and items without words match nothing; of several stretches of one pair, the best counts, then
the first; repeated rows are reported each; other columns are ignored; empty tables give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import mix, slices, strings

GRAM = 5
THRESHOLD = 0.5
MISMATCH = GAP = 0.5
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 20

#: ASCII punctuation and control characters separate words.
_APART = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

_PAIRS = "doc_id long, item_id long, score double, first long, last long"


def plain_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_APART).split()


def good_pairs(length: int) -> int:
    """Good pairs that an item of so many words has at least in an alignment at the threshold."""
    return (length + 1) // 2 - 1


@dataclass
class Index:
    """The seeds of a block of benchmark items."""

    items: list[tuple[int, np.ndarray]]
    vocabulary: dict[bytes, int]
    whole: dict[int, dict[int, list[int]]]  # of short items: those of each hash, by size
    grams: np.ndarray  # sorted distinct hashes of the other items' pairs
    pairs: dict[int, np.ndarray]  # the distinct pairs of each of them
    starts: np.ndarray  # where the items of each pair that is a seed begin in ``seeded``
    seeded: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> "Index":
        vocabulary: dict[bytes, int] = {}
        coded = []
        for item, text in items:
            words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in plain_words(text)]
            if words:
                coded.append((item, np.array(words, np.int64)))
        whole: dict[int, dict[int, list[int]]] = {}
        hashes = {}
        for k, (_, codes) in enumerate(coded):
            if len(codes) < GRAM:
                whole.setdefault(len(codes), {}).setdefault(int(gram_hashes(codes, len(codes))[0]), []).append(k)
            else:
                hashes[k] = [pair_hashes(codes, gap) for gap in (1, 2)]
        grams = np.unique(np.concatenate([x for both in hashes.values() for x in both])) if hashes else np.zeros(0, np.uint64)
        near = {k: [np.searchsorted(grams, x) for x in both] for k, both in hashes.items()}
        pairs = {k: np.unique(np.concatenate(both)) for k, both in near.items()}
        shared = np.zeros(len(grams), np.int64)
        for own in pairs.values():
            shared[own] += 1
        gram, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (one, two) in near.items():
            most = shared[one]
            most[:-1] = np.maximum(most[:-1], shared[two])
            places = np.argsort(most, kind="stable")[: len(one) - max(0, good_pairs(len(one) + 1) - 1)]
            gram.append(np.unique(np.concatenate([one[places], two[places[places < len(two)]]])))
            item.append(np.full(len(gram[-1]), k))
        found, owner = np.concatenate(gram), np.concatenate(item)
        order = np.argsort(found, kind="stable")
        return cls(coded, vocabulary, whole, grams, pairs, np.searchsorted(found[order], np.arange(len(grams) + 1)), owner[order])

    def codes(self, text: str) -> np.ndarray:
        words = plain_words(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-word sequences; 0 for those with a word of no item."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        found = np.full(n, size, np.uint64)
        fine = np.ones(n, bool)
        for k in range(size):
            part = codes[k : k + n]
            found = mix(found * np.uint64(31) + part.astype(np.uint64))
            fine &= part != 0
        return np.where(fine, found | np.uint64(1), np.uint64(0))


def pair_hashes(codes: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of each word with the one ``gap`` places on; 0 for those with a word of no item."""
    a, b = codes[:-gap].astype(np.uint64), codes[gap:].astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.where((a != 0) & (b != 0), mix((a << np.uint64(32)) + b) | np.uint64(1), np.uint64(0))


class Lookup:
    """Positions of given hashes among many: a small bitmap first, then a binary search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bitmap = np.zeros(1 << _FILTER_BITS, bool)
        self.bitmap[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``x`` with a known hash, and its place among the known ones."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bitmap[(x >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, x[at]), len(self.hashes) - 1)
        good = self.hashes[place] == x[at]
        return at[good], place[good]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score, and the first and last matched word of the passage.

    Of equal alignments, the one that ends first in the item and passage counts.
    """
    n = len(passage)
    steps = GAP * np.arange(n + 1)
    above, above_from = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, -1)
    for word in item:
        fits = np.where(passage == word, 1.0, -MISMATCH)
        diagonal, up = above[:-1] + fits, above[1:] - GAP
        row, came = np.zeros(n + 1), np.arange(n + 1)
        take = diagonal >= up
        row[1:] = np.maximum(np.where(take, diagonal, up), 0.0)
        came[1:] = np.where(row[1:] > 0, np.where(take, above_from[:-1], above_from[1:]), came[1:])
        # gaps within the row: the running maximum of what each start would leave
        lifted = row + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= top, np.arange(n + 1), 0))
        row, came = top - steps, came[source]
        above, above_from = row, came
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (float(row[k]), int(came[k]), k - 1)
    return best


class Matcher:
    def __init__(self, index: Index):
        self.index, self.lookup = index, Lookup(index.grams)
        self.own = np.zeros(len(index.grams), bool)

    def stretches(self, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item, by its place in the block, the stretches that can hold it, in order."""
        found: dict[int, list[tuple[int, int]]] = {}
        for size, items in self.index.whole.items():
            hashes = gram_hashes(codes, size)
            for at in np.flatnonzero(hashes).tolist():
                for k in items.get(int(hashes[at]), ()):
                    found.setdefault(k, []).append((at, at + size))
        (at, gram), (at2, gram2) = (self.lookup.find(pair_hashes(codes, gap)) for gap in (1, 2))
        at, gram = np.concatenate([at, at2]), np.concatenate([gram, gram2])
        starts, seeded = self.index.starts, self.index.seeded
        seeds = np.unique(gram)
        seeds = seeds[starts[seeds] < starts[seeds + 1]]
        for k in sorted({k for a, b in zip(starts[seeds].tolist(), starts[seeds + 1].tolist(), strict=True) for k in seeded[a:b].tolist()}):
            length = len(self.index.items[k][1])
            least = good_pairs(length)
            self.own[self.index.pairs[k]] = True
            places = at[self.own[gram]]
            self.own[self.index.pairs[k]] = False
            if len(places) < least:
                continue
            places = np.unique(places)
            first, last = places[: len(places) - least + 1], places[least - 1 :]
            close = np.flatnonzero(last - first < 2 * length) if len(places) >= least else ()
            if len(close):
                ends = np.minimum(first[close] + 2 * length, len(codes)).tolist()
                found[k] = list(zip(np.maximum(last[close] - 2 * length + 1, 0).tolist(), ends, strict=True))
        return found

    def pairs(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, score, first, last word) of each item that the text holds."""
        codes = self.index.codes(text)
        found = []
        for item, ranges in sorted(self.stretches(codes).items()):
            name, words = self.index.items[item]
            merged: list[list[int]] = []
            for a, b in sorted(ranges):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            score, first, last = max(((s, a + f, a + e) for a, b in merged for s, f, e in [align(words, codes[a:b])]), key=lambda x: (x[0], -x[1]))
            if score / len(words) >= THRESHOLD:
                found.append((name, score / len(words), first, last))
        return found


def _match(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in slices(batches, "text"):
            found = [(doc, *pair) for doc, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text"), strict=True) for pair in matcher.pairs(text)]
            if found:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PAIRS.split(", ")])

    return run


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items with text in blocks of about ``most`` bytes."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + 2 * total // most
    for k in range(count if total else 0):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        if rows := some.orderBy("item_id", "text").collect():
            yield [(r.item_id, r.text) for r in rows]


def _prepared(benchmark: DataFrame, block_bytes: int) -> Iterator:
    """The broadcast index of each block."""
    for items in _blocks(benchmark, block_bytes):
        index = Index.build(items)
        if index.items:
            yield benchmark.sparkSession.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, first and last word of the passage for each pair."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    result = docs.sparkSession.createDataFrame([], _PAIRS)
    for shared in _prepared(benchmark, block_bytes):
        result = result.unionByName(rows.mapInArrow(_match(shared), _PAIRS))
    return result


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, filtered where they lie."""
    for shared in _prepared(benchmark, block_bytes):
        docs = docs.mapInArrow(_filter(shared), docs.schema)
    return docs


def _filter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([not matcher.pairs(x) for x in strings(batch, "text")], pa.bool_()))

    return run
