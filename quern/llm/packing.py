"""Packing of documents into training sequences (operator 3).

A document's ids are cut into full windows of ``window`` ids and a rest. Full windows are
sequences of their own. Rests are packed by best-fit decreasing: in order of falling length,
each goes to the open window with the least remaining capacity that still holds it, which a
segment tree indexed by remaining capacity finds in ``log2(window)`` steps. What is then still
in windows filled to less than 7/8 is cut into full windows, and the end of that by powers of
two, which need no padding.

Packing is local to blocks of up to ``BLOCK_TOKENS`` ids of one input partition, so nothing
is shuffled, a block fits in memory at any input size, and a lost task is simply run again.

Defined results: a null or empty text has only the end id; repeated rows are packed each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc32, slices
from quern.llm.tokens import encoder, tokenizer_path

WINDOW = 2048
#: Ids that are packed together.
BLOCK_TOKENS = 8 << 20

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over capacities holds how many."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int) -> None:
        self.at[capacity].append(name)
        k = capacity + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least capacity of at least ``need``."""
        count, k = self.count, need + self.leaves
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up until a right neighbour has windows
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        name = self.at[capacity].pop()
        while k:
            count[k] -= 1
            k >>= 1
        return capacity, name


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Positions of the lengths (1 to ``window``) in each window."""
    tree, windows = OpenWindows(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        if (found := tree.tightest(need)) is None:
            capacity, name = window, len(windows)
            windows.append([])
        else:
            capacity, name = found
        windows[name].append(i)
        if capacity > need:
            tree.add(capacity - need, name)
    return windows


def pack_lengths(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) for documents of the given lengths."""
    full = [[(i, at, window)] for i, n in enumerate(lengths) for at in range(0, n - window + 1, window)]
    rests = [(i, n - n % window, n % window) for i, n in enumerate(lengths) if n % window]
    sequences, loose = [], []
    for some in best_fit_decreasing([r[2] for r in rests], window):
        pieces = [rests[k] for k in some]
        filled = sum(p[2] for p in pieces)
        if filled * 8 >= window * 7 or filled & (filled - 1) == 0:
            sequences.append(pieces)
        else:
            loose += pieces
    left, open_, room = sum(p[2] for p in loose), [], 0
    for doc, start, length in loose:
        while length:
            if not room:
                room = window if left >= window else 1 << (left.bit_length() - 1)
            take = min(room, length)
            open_.append((doc, start, take))
            start, length, room, left = start + take, length - take, room - take, left - take
            if not room:
                sequences.append(open_)
                open_ = []
    return full + sequences


def _pack(path: str, end: int, window: int, block_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaces=False)
        tail = np.array([end], "<u4").tobytes()
        base, used = TaskContext.get().partitionId() << 36, 0
        docs, ids, tokens = [], [], 0
        names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids

        def out():
            nonlocal docs, ids, tokens, used
            rows = []
            for sequence in pack_lengths([len(x) // 4 for x in ids], window):
                offset = 0
                for doc, start, length in sequence:
                    data = ids[doc][4 * start : 4 * (start + length)]
                    row = (docs[doc], start, length, crc32(data), len(ids[doc]) // 4, base + used, offset)
                    rows.append((*row, np.frombuffer(data, "<i4")) if with_ids else row)
                    offset += length
                used += 1
            docs, ids, tokens = [], [], 0
            for at in range(0, len(rows), 20_000):
                columns = list(zip(*rows[at : at + 20_000], strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
                if with_ids:
                    sizes = np.cumsum([0, *columns[2]]).astype("int32")
                    arrays.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(columns[7]))))
                yield pa.RecordBatch.from_arrays(arrays, names)

        for batch in slices(batches, "text"):
            for doc, data in zip(batch.column("doc_id").to_pylist(), encode.encode(batch.column("text")), strict=True):
                docs.append(doc)
                ids.append(data + tail)
                tokens += len(data) // 4 + 1
                if tokens >= block_tokens:
                    yield from out()
        if docs:
            yield from out()

    return run


def pack_documents(
    docs: DataFrame, path: str | None = None, end: int = 1, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    ``with_ids``, the piece's ids as an array. A sequence is its pieces in order of offset."""
    path = path or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_pack(path, end, window, block_tokens, with_ids), _PIECES + ", ids array<int>" * with_ids)
