"""Token ids in compressed shards (operator 2).

File format. A table in the shared folder has one row per shard; a shard holds consecutive
documents in ascending ``doc_id`` order (null first) and is self-contained but for the
dictionary, which is named by its hash:

* ``part``, ``shard``: its range of doc_id and place there; ``before``: tokens of the shards before it there;
* ``first_doc``, ``last_doc``, ``n_docs``, ``n_tokens``: for pruning and prefix sums;
* ``dictionary``: the first 16 hex digits of the dictionary's SHA-256;
* ``index``: for each document, as little-endian int64: doc_id, 1 if doc_id is null, offset in
  ``blob``, size there, number of tokens;
* ``blob``: the documents' ids, each compressed on its own by zstandard with the shared
  dictionary. Ids are serialized as unsigned 16-bit integers where the vocabulary allows, else
  as unsigned 32-bit ones (``width``).

So one document is read from its row's index and a slice of the blob, without its neighbours.
The dictionary is trained on the serialized ids of a bounded sample (``SAMPLE_DOCS`` documents,
those of the least hashes of doc_id, and of each ``SAMPLE_CHARS`` characters from a hashed place
on) and affects sizes only.

Texts are encoded where they lie. Only their ids are shuffled, to ranges of doc_id whose bounds
come from the id column alone, and compressed there.

Defined results: a null or empty text has only the end id; rows of one doc_id are ordered by
text; other columns are ignored; an empty table gives no rows. A very long text is encoded in one
piece with its neighbours in a slice; it takes a small multiple of its own bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Workspace, crc32, slices
from quern.llm.tokens import encoder, tokenizer_path

SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 4000, 64 << 10
#: Bytes of ids (uncompressed) and documents in one shard, at least one document.
SHARD_BYTES, SHARD_DOCS = 4 << 20, 4096
LEVEL = 1
#: Least documents in a range of doc_id, on average.
RANGE_DOCS = 1000
#: Partitions whose totals are broadcast at most.
PARTS = 1_000_000
#: Text bytes that are encoded together: each distinct chunk among them is looked up once.
ENCODE_BYTES = 8 << 20

_SHARDS = (
    "part long, shard long, before long, first_doc long, last_doc long, n_docs long, n_tokens long, "
    "dictionary string, width int, index binary, blob binary"
)
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def serialize(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def deserialize(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; empty if the samples are too few for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        shared.precompute_compress(level=LEVEL)  # else each document would digest the dictionary anew
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def _encode_rows(path: str, end: int, width: int, bounds: np.ndarray):
    """Rows with their range of doc_id and serialized ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(path, spaces=True), np.dtype(f"<u{width}")
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids, ends = encode.flat(batch.column("text"))
            ids, ends = np.insert(ids.astype(kind), ends, end), ends + np.arange(1, len(ends) + 1)
            docs = batch.column("doc_id")
            # null is the first
            known = pc.fill_null(docs, 0).to_numpy().astype(np.float64)
            part = np.where(docs.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, known, "right"))
            offsets = pa.py_buffer(np.concatenate(([0], width * ends)).astype("<i4"))
            data = pa.BinaryArray.from_buffers(pa.binary(), len(docs), [None, offsets, pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), docs, batch.column("tie"), data], ["part", "doc_id", "tie", "ids"])

    return run


def _write(width: int, dictionary: bytes):
    name = hashlib.sha256(dictionary).hexdigest()[:16]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, _ = _codec(dictionary)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        index, blobs, size, raw = [], [], 0, 0

        def out():
            nonlocal index, blobs, size, raw, shard, before
            ids, tokens = [x[0] for x in index if not x[1]], sum(x[4] for x in index)
            row = [part, shard, before, min(ids, default=None), max(ids, default=None), len(index), tokens]
            row += [name, width, np.array(index, "<i8").tobytes(), b"".join(blobs)]
            shard, before, index, blobs, size, raw = shard + 1, before + tokens, [], [], 0, 0
            kinds = [pa.int64()] * 7 + [pa.string(), pa.int32(), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in _SHARDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in slices(batches, "ids"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                data = press.compress(ids)
                index.append((doc or 0, int(doc is None), size, len(data), len(ids) // width))
                blobs.append(data)
                size, raw = size + len(data), raw + len(ids)
                if raw >= SHARD_BYTES or len(index) >= SHARD_DOCS:
                    yield out()
        if index:
            yield out()

    return run


def _sample(docs: DataFrame) -> list[str]:
    """Slices of the sampled documents: hashes of ids alone first, then the texts of the least ones."""
    hashed = docs.withColumn("_hash", F.xxhash64("doc_id"))
    least = [r[0] for r in hashed.select("_hash").orderBy("_hash").limit(SAMPLE_DOCS).collect()]
    if not least:
        return []
    first = 1 + F.pmod(F.col("_hash"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS))
    some = hashed.filter(F.col("_hash") <= least[-1]).select(F.col("text").substr(first.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    return [r.text for r in some.filter("text <> ''").limit(2 * SAMPLE_DOCS).collect()]


def _ranges(docs: DataFrame) -> np.ndarray:
    """Bounds of ranges of doc_id with about equally many rows, from a sketch of the id column."""
    # twice the input's splits, which have a bounded size each
    most = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    parts = max(1, min(most, docs.count() // RANGE_DOCS))
    shares = [k / parts for k in range(1, parts)]
    return np.array(sorted(set(docs.approxQuantile("doc_id", shares, 0.2 / parts))) if shares else [], np.float64)


def _with_ties(docs: DataFrame) -> DataFrame:
    """Adds ``tie``, the text of rows whose doc_id others have too, by which these are ordered."""
    repeated = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again"))
    if repeated.isEmpty():
        return docs.withColumn("tie", F.lit(None).cast("string"))
    marked = docs.join(repeated.withColumn("_more", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("_again")), "left")
    return marked.select("doc_id", "text", F.when(F.col("_more"), F.coalesce("text", F.lit(""))).alias("tie"))


def write_store(docs: DataFrame, space: Workspace, path: str | None = None, end: int = 2) -> tuple[DataFrame, bytes]:
    """Encode all documents and write their shards; the shard table and the dictionary."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    encode = encoder(path, spaces=True)
    width = 2 if max(encode.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end) < 1 << 16 else 4
    dictionary = train_dictionary([serialize(x, width) for x in encode.encode(pa.array(_sample(docs), pa.string()))])
    bounds = _ranges(docs)
    rows = _with_ties(docs).mapInArrow(_encode_rows(path, end, width, bounds), "part int, doc_id long, tie string, ids binary")
    ordered = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "tie")
    return space.table(ordered.select("doc_id", "ids").mapInArrow(_write(width, dictionary), _SHARDS), "shards"), dictionary


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds ``start``: tokens of all shards before. Only totals by partition, of which there are few, are
    summed and joined; blobs stay where they are unless there are more of these than ``PARTS``."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("of_part"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if totals.count() <= PARTS else bases  # 16 bytes each
    return shards.join(bases, F.col("part") == F.col("of_part")).withColumn("start", F.col("base") + F.col("before")).drop("of_part", "base")


def documents_of(index: bytes, blob: bytes, width: int, unpress) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and ids (unsigned 32-bit) of each document of a shard."""
    for doc, null, at, size, _ in np.frombuffer(index, "<i8").reshape(-1, 5).tolist():
        yield None if null else doc, deserialize(unpress.decompress(blob[at : at + size]), width)


def read_document(shards: DataFrame, dictionary: bytes, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with that id), reading only its shards and slices."""
    _, unpress = _codec(dictionary)
    found = []
    rows = shards.filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    for row in rows.select("width", "index", "blob").toLocalIterator():
        for doc, null, at, size, _ in np.frombuffer(bytes(row["index"]), "<i8").reshape(-1, 5).tolist():
            if doc == doc_id and not null:
                ids = deserialize(unpress.decompress(bytes(row.blob)[at : at + size]), row.width)
                found.append(np.frombuffer(ids, "<u4").tolist())
    return found


def _read(dictionary: bytes):
    name = hashlib.sha256(dictionary).hexdigest()[:16]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpress = _codec(dictionary)
        for batch in slices(batches, "blob"):
            for hashed, width, index, blob, start in zip(*(batch.column(c).to_pylist() for c in ("dictionary", "width", "index", "blob", "start")), strict=True):
                if hashed != name:
                    raise ValueError(f"the shard needs dictionary {hashed}, not {name}")
                rows = [(doc, len(ids) // 4, crc32(ids)) for doc, ids in documents_of(index, blob, width, unpress)]
                docs, sizes, sums = zip(*rows, strict=True)
                starts = start + np.cumsum((0, *sizes[:-1]))
                columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_store(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """One row per document from the written shards: its start, tokens and the checksum of its ids."""
    return with_starts(shards).select("dictionary", "width", "index", "blob", "start").mapInArrow(_read(dictionary), _ROWS)
