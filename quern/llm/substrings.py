r"""Removal of word passages that repeat across documents (operator 4), by recompression.

Words are ``[^\x20\x09-\x0D]+``. A window is ``width`` (50) consecutive words of a document; each
word that lies in a window whose word sequence also starts in a document with a smaller
doc_id is removed. Windows are judged on the input.

Rounds of recompression name runs of one symbol and then pairs of symbols (a pair is replaced
if its left symbol's name falls in one half of the names and its right one's in the other), so
equal passages get equal names inside, whatever stands around them. A name is a 64-bit hash of
what it replaces, which makes it global without any exchange. A name may replace 2 words in
the first round and 4 in the second; the two rounds can spoil at most 3 + 7 = ``MARGIN`` words
at either end of a passage, so all names that lie inside the middle 30 words of a window are
the same in every copy of that window.

The Spark rounds on top of these names:

1. The anchor of a window is the least-hashed sequence of ``GRAM`` names in its middle. Windows
   in a row with one anchor form a chunk, named by a 128-bit hash of all its words. Anchors are
   grouped: those of one document alone are done with (no other document has these windows).
2. Where all chunks of a shared anchor have one name, each is a copy of the first document's.
3. Else chunks are grouped by name: those with an equal chunk in a smaller document are copies,
   and of the rest, one document's windows for each name are compared window by window, by
   128-bit names.

All groupings are aggregations with a partial step and joins that Spark can split, so a passage
that a third of all documents share stays spread out. Rows grow with the words, never with
pairs of documents.

Defined results: null or empty text: no words, and the digest of the empty text. A document
with a null doc_id is kept whole and removes nothing elsewhere. Rows of one doc_id are one
document, in which the texts of the rows are judged each (windows don't cross rows). Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordCodes, Workspace, mix, raw_texts, remembered, slices, squeezed, unsqueezer

WIDTH = 50
#: Words that a name may replace, by round.
ROUNDS = (2, 4)
#: Words at either end of a passage in which names may depend on what stands around it: in each
#: round the run at the end (as many words as a name may replace) and one more name.
MARGIN = sum(most + most - 1 for most in ROUNDS)
#: Names in an anchor.
GRAM = 3
_BASE = 0x9E3779B97F4A7C15
_SECOND = np.uint64(0xD6E8FEB86659FD93)

_CHUNKS = "a long, c1 long, c2 long, doc_id long, h long, w0 int, w1 int"
_WINDOWS = "x1 long, x2 long, doc_id long, h long, w int"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _codes() -> WordCodes:
    return remembered(("words",), WordCodes)


def recompress(names: np.ndarray, text: np.ndarray, rounds: tuple[int, ...] = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and first word positions after the rounds. ``text``: the text that each word is of."""
    with np.errstate(over="ignore"):
        start, size = np.arange(len(names)), np.ones(len(names), np.int64)
        for k, most in enumerate(rounds):
            salt = mix(np.array([2 * k + 1, 2 * k + 2], np.uint64))
            # runs, unless they are longer than a name may be
            edge = np.ones(len(names), bool)
            edge[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(edge)
            times = np.diff(np.append(first, len(names)))
            fits = times * size[first] <= most
            merged = (fits & (times > 1))[np.cumsum(edge) - 1]
            keep = edge | ~merged
            run = np.where(merged, mix(names * salt[0] + np.repeat(times, times).astype(np.uint64)), names)
            size = np.where(merged, size * np.repeat(times, times), size)[keep]
            names, start, text = run[keep], start[keep], text[keep]
            # pairs of a name in the one half and a name in the other
            half = (mix(names ^ salt[1]) >> np.uint64(63)).astype(bool)
            joined = np.zeros(len(names), bool)
            joined[:-1] = ~half[:-1] & half[1:] & (text[:-1] == text[1:]) & (size[:-1] + size[1:] <= most)
            left = np.flatnonzero(joined)
            names = names.copy()
            names[left] = mix(mix(names[left] ^ salt[1]) + names[left + 1] * salt[0])
            size[left] += size[left + 1]
            keep = np.ones(len(names), bool)
            keep[left + 1] = False
            names, start, text, size = names[keep], start[keep], text[keep], size[keep]
    return names, start


class Hashes:
    """128-bit hashes of any ranges of a word sequence, from prefix sums."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(codes) + 1
            powers = np.full(n, _BASE, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            self.inverse = np.multiply.accumulate(inverse)
            self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * powers[:-1]))) for c in (codes, mix(codes ^ _SECOND))]

    def of(self, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            salt = mix((end - begin).astype(np.uint64))
            return [mix((s[end] - s[begin]) * self.inverse[begin] ^ salt).view(np.int64) for s in self.sums]


def chunks_of(codes: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Chunks of concatenated texts: text, first and last window (positions in the whole), anchor.

    ``ends``: where each text ends.
    """
    begins = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - begins)
    names, start = recompress(codes, text)
    with np.errstate(over="ignore"):
        value = names.copy()
        for k in range(1, GRAM):
            value[: len(names) - k] = mix(value[: len(names) - k] * np.uint64(_BASE) + names[k:])
    value = value[: max(0, len(names) - GRAM + 1)]
    finish = np.append(start, len(codes))[GRAM:]  # where each sequence of names ends
    counts = np.maximum(ends - begins - width + 1, 0)
    of = np.repeat(np.arange(len(ends)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[of]
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    low = np.searchsorted(start[: len(value)], window + MARGIN)
    high = np.searchsorted(finish, window + width - MARGIN, "right") - 1
    # the leftmost least value in each range, from ranges of powers of two
    best = [np.arange(len(value))]
    span = int((high - low + 1).max())
    while 2 << (len(best) - 1) <= span:
        b, by = best[-1], 1 << (len(best) - 1)
        right = np.append(b[by:], b[len(b) - by :])
        best.append(np.where(value[b] <= value[right], b, right))
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    anchor = np.empty(len(window), np.int64)
    for k, b in enumerate(best):
        at = np.flatnonzero(level == k)
        x, y = b[low[at]], b[high[at] - (1 << k) + 1]
        anchor[at] = np.where(value[x] <= value[y], x, y)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return of[first], window[first], window[last], value[anchor[first]]


def _texts(batch: pa.RecordBatch, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = [x.split() for x in found]  # of bytes, split() cuts at these six white-space bytes alone
    ends = np.cumsum([len(x) for x in words], dtype=np.int64)
    return np.concatenate([_codes().of(x) for x in words]) if len(words) else np.zeros(0, np.uint64), ends


def _chunk_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            codes, ends = _texts(batch, raw_texts(batch, "text"))
            of, w0, w1, a = chunks_of(codes, ends, width)
            c1, c2 = Hashes(codes).of(w0, w1 + width)
            base = np.concatenate(([0], ends[:-1]))[of]
            docs, h = batch.column("doc_id").take(pa.array(of)), batch.column("h").take(pa.array(of))
            columns = [pa.array(a.view(np.int64)), pa.array(c1), pa.array(c2), docs, h]
            columns += [pa.array((w - base).astype(np.int32)) for w in (w0, w1)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _CHUNKS.split(", ")])

    return run


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = unsqueezer()
        for batch in slices(batches, "z", 2 << 20):
            codes, ends = _texts(batch, [unpress(z) for z in batch.column("z").to_pylist()])
            hashes, begins = Hashes(codes), np.concatenate(([0], ends[:-1])).tolist()
            ranges = batch.column("ranges")
            counts = np.diff(ranges.offsets.to_numpy())
            w0, w1 = (ranges.flatten().field(k).to_numpy().astype(np.int64) for k in ("w0", "w1"))
            row = np.repeat(np.arange(len(counts)), counts)
            sizes = w1 - w0 + 1
            local = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(w0, sizes)
            row = np.repeat(row, sizes)
            at = local + np.array(begins)[row]
            for k in range(0, len(at), 200_000):
                some = slice(k, k + 200_000)
                x1, x2 = hashes.of(at[some], at[some] + width)
                take = pa.array(row[some])
                columns = [pa.array(x1), pa.array(x2), batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(local[some].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _WINDOWS.split(", ")])

    return run


def kept_words(words: list[bytes], ranges: list[dict] | None, width: int = WIDTH) -> list[bytes]:
    """The words outside all windows of the ranges (first and last window)."""
    if not ranges:
        return words
    delta = np.zeros(len(words) + 1, np.int64)
    first = np.array([r["w0"] for r in ranges])
    last = np.array([r["w1"] for r in ranges]) + width
    np.add.at(delta, first, 1)
    np.add.at(delta, last, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(delta[:-1]) == 0)]


def _digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = unsqueezer()
        for batch in slices(batches, "z", 2 << 20):
            total, removed, digest = [], [], []
            for z, ranges in zip(batch.column("z").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = unpress(z).split()
                kept = kept_words(words, ranges, width)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _RESULT.split(", ")])

    return run


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``h``, which tells texts of one doc_id apart; 0 where a doc_id has one row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    repeated = rows.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return rows.withColumn("h", F.lit(0).cast("long"))
    marked = rows.join(repeated.withColumn("more", F.lit(True)), "doc_id", "left")
    return marked.select("doc_id", "text", F.when(F.col("more"), F.xxhash64("text")).otherwise(0).alias("h"))


def repeated_ranges(docs: DataFrame, space: Workspace, width: int = WIDTH) -> DataFrame:
    """doc_id, h and all ranges of windows (w0, w1) that also start in a smaller document."""
    if width < 2 * MARGIN + GRAM * ROUNDS[-1] + ROUNDS[-1]:
        raise ValueError("the width is too small for the margins of the names")
    rows = _identified(docs.filter(F.col("doc_id").isNotNull()))
    chunks = space.table(rows.mapInArrow(_chunk_rows(width), _CHUNKS), "chunks")
    # groups are written before they are joined: beside an aggregation Spark wouldn't split a skewed join
    shared = (
        chunks.groupBy("a")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("c1").alias("c_least"), F.max("c1").alias("c_most"))
        .filter("least < most")
    )
    shared = space.table(shared.select("a", "least", F.expr("c_least = c_most").alias("one")), "shared")
    hits = space.table(chunks.join(shared, "a"), "hits")
    space.drop("chunks", "shared")
    copied = hits.filter("one AND doc_id > least").select("doc_id", "h", "w0", "w1")

    unclear = hits.filter("NOT one").drop("least", "one")
    first = space.table(unclear.groupBy("a", "c1", "c2").agg(F.min("doc_id").alias("first")), "first")
    unclear = space.table(unclear.join(first, ["a", "c1", "c2"]).select("doc_id", "h", "w0", "w1", "first"), "unclear")
    space.drop("first")
    copied = copied.unionByName(unclear.filter("doc_id > first").drop("first"))

    wanted = unclear.filter("doc_id = first").groupBy("doc_id", "h").agg(F.array_distinct(F.collect_list(F.struct("w0", "w1"))).alias("ranges"))
    texts = squeezed(rows, "doc_id", "h").join(wanted, ["doc_id", "h"])
    windows = space.table(texts.mapInArrow(_window_rows(width), _WINDOWS), "windows")
    earliest = windows.groupBy("x1", "x2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    earliest = space.table(earliest, "earliest")
    single = space.table(windows.join(earliest, ["x1", "x2"]).filter("doc_id > least").select("doc_id", "h", F.col("w").alias("w0"), F.col("w").alias("w1")), "single")
    space.drop("windows", "earliest")
    # sets, not lists: repeated rows have the same windows
    return copied.unionByName(single).groupBy("doc_id", "h").agg(F.array_distinct(F.collect_list(F.struct("w0", "w1"))).alias("ranges"))


def remove_repeats(docs: DataFrame, space: Workspace, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, joined by one space."""
    ranges = repeated_ranges(docs, space, width)
    texts = squeezed(_identified(docs), "doc_id", "h")
    return texts.join(ranges, ["doc_id", "h"], "left").select("doc_id", "z", "ranges").mapInArrow(_digests(width), _RESULT)
