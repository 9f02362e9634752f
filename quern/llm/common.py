"""What the training-data operators share: batching, hashing, words; tables in the shared folder are the library's."""

from __future__ import annotations

import ctypes
import gc
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.workspace import Workspace, finished_folders  # noqa: F401 for the operators

#: Largest number of text bytes that a Python step holds as one slice.
SLICE_BYTES = 4 << 20
_MEMORIES: dict[tuple, object] = {}


def remembered(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker remembers under ``key``.

    Workers outlive stages, so at a key's first use all others are forgotten, and what they
    took goes back to the system.
    """
    if key not in _MEMORIES:
        _MEMORIES.clear()
        give_back()
        _MEMORIES[key] = make()
    return _MEMORIES[key]


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library's
        if trim:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in pieces of about ``most`` bytes of ``column``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null is the empty text."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def split_words(texts: pa.Array, apart: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of lower-cased texts, the texts as numbers of words, and where each ends.

    ``apart`` maps the bytes of ASCII characters that separate words to spaces.
    """
    plain = pc.utf8_lower(pc.fill_null(texts, ""))
    _, offsets, data = plain.buffers()
    if data is not None:
        plain = pa.StringArray.from_buffers(len(plain), offsets, pa.py_buffer(data.to_pybytes().translate(apart)), offset=plain.offset)
    lists = pc.split_pattern(plain, " ")
    coded = lists.flatten().dictionary_encode()
    codes, ends = coded.indices.to_numpy(), lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        words = codes != empty
        codes, ends = codes[words], np.concatenate(([0], np.cumsum(words)))[ends]
    return coded.dictionary, codes, ends


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def lower_ascii(data: bytes) -> bytes:
    return data.lower()  # of bytes, it changes A-Z alone


class WordCodes(dict):
    """64-bit codes of words, remembered up to a bounded number of words of bounded length."""

    LIMIT, LONGEST = 150_000, 64

    def __init__(self, seed: int = 0):
        super().__init__()
        import xxhash

        self._hash, self._seed = xxhash.xxh3_64_intdigest, seed

    def __missing__(self, word: bytes) -> int:
        code = self._hash(word, self._seed)
        if len(word) <= self.LONGEST:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rows_of(docs: DataFrame) -> Column:
    """A whole row as one column, so that no column of it can clash with an operator's own; ``select("<name>.*")`` gives it back."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def squeezed(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys and each text as a zstandard frame ``z`` (null: the empty text).

    Texts that have to be shuffled take a good third less disk and network this way than
    under the shuffle's own codec.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text"):
            z = pa.array([press.compress(x) for x in raw_texts(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), z], [*keys, "z"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, z binary")


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null is the empty text."""
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


def unsqueezer():
    import zstandard

    return zstandard.ZstdDecompressor().decompress
