r"""MinHash near-dedup (operator 9) with fast similarity sketches.

A document's set is its distinct ``size``-word shingles (words ``[^\x20\x09-\x0D]+`` after
lower-casing A-Z; with fewer words, the whole sequence as one), as 64-bit hashes.

* *Sketch.* In round i each element is put into one of ``T`` bins, with a value that grows with
  the round; a bin keeps its least value. The first T rounds place elements by hash, round
  T + j puts all into bin j, and the rounds end when each bin has a value. So every coordinate
  is filled, few rounds are needed for large sets, and estimates concentrate as for
  independent hashes.
* *Banding.* ``BANDS`` bands of ``ROWS`` coordinates: a pair at similarity 0.8 shares no band
  with probability 3e-6.
* *Copies.* Documents with one set are a class; classes are the nodes of all that follows.
* *Exact verification* on full sets, without listing all pairs of a group. First each class is
  verified against the first class of each of its bands, and linked classes are joined to
  components. A pair inside one component can't change the result, so only bands that still hold
  several components go on, with all pairs of classes from different ones. Before any text is
  fetched, sizes and bitmaps of the sets rule out pairs that can't be linked (and no other),
  inside the join, and a pair comes out of one band alone. So the join makes few rows even for a group whose members nearly reach the
  threshold, although within a band it compares them all by their bitmaps; a large band is dealt
  to parts of about ``SPREAD`` classes, so that tasks share it. No candidate is dropped.

A verification ships the member's text to its leader's; the members of one leader are dealt to
parts of ``PART`` at most, so a hot leader is spread.

Defined results: null or empty texts, and those without words, have the empty set and are
linked with nothing; rows with a null doc_id take part, and a component's id is the least doc_id
in it (null if all are); repeated rows are copies of each other; other columns are ignored; an
empty table gives no rows. Whole texts are compared; a very long one takes a small multiple of its
own bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordCodes, Workspace, lower_ascii, mix, raw_texts, remembered, rows_of, slices, squeezed, unsqueezer
from quern.llm.components import components

BANDS, ROWS = 32, 5
T = BANDS * ROWS
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 80
PART = 256
#: Classes of a band, on one side, that one task compares with the band's others.
SPREAD = 1024
#: Bits in which sets are compared before texts are.
BITS = 2048
_LEAST_ID = -(1 << 63)
_UNFILLED = np.uint64((1 << 64) - 1)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    codes = remembered(("words",), WordCodes).of(lower_ascii(text).split())  # of bytes, split() cuts at these six white-space bytes alone
    if not len(codes):
        return codes
    n = max(1, len(codes) - size + 1)
    with np.errstate(over="ignore"):
        found = np.full(n, min(size, len(codes)), np.uint64)
        for k in range(min(size, len(codes))):
            found = mix(found * np.uint64(31) + codes[k : k + n])
    return np.unique(found)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """T coordinates of each (non-empty) set."""
    count = len(sets)
    table = np.full(count * T, _UNFILLED)
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    for i in range(2 * T):
        with np.errstate(over="ignore"):
            h = mix(x + mix(np.array([i + 1], np.uint64))[0])
            value = (mix(h) >> np.uint64(9)) | np.uint64(i << 55)
        where = (h >> np.uint64(32)).astype(np.int64) % T if i < T else i - T
        np.minimum.at(table, owner * T + where, value)
        open_ = (table.reshape(count, T) == _UNFILLED).any(axis=1)
        if not open_.any():
            break
        keep = open_[owner]
        x, owner = x[keep], owner[keep]
    return table.reshape(count, T)


def bands(table: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(table), BANDS)).copy()
        for k in range(ROWS):
            keys = mix(keys * np.uint64(31) + table[:, k::ROWS])
    return keys.view(np.int64)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap of ``BITS`` hashed bits for each set, as longs."""
    table = np.zeros((len(sets), BITS), bool)
    for row, s in zip(table, sets, strict=True):
        row[(s >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(table, axis=1, bitorder="little").view("<i8")


def possible(a: str, b: str) -> str:
    """SQL: whether two sets can be linked, by their sizes and bitmaps. Elements of one set whose
    bit the other lacks aren't shared, so their number bounds the intersection from above; only
    pairs that can't be linked are ruled out."""
    lacks = lambda x, y: f"aggregate(zip_with(bits{x}, bits{y}, (p, q) -> bit_count(p & ~q)), 0, (t, c) -> t + c)"
    sizes = f"100 * least(n{a}, n{b}) >= {PERCENT} * greatest(n{a}, n{b})"
    return f"{sizes} AND {100 + PERCENT} * least(n{a} - {lacks(a, b)}, n{b} - {lacks(b, a)}) >= {PERCENT} * (n{a} + n{b})"


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = [shingle_set(x, size) for x in raw_texts(batch, "text")]
            some = [s for s in sets if len(s)]
            keys = bands(sketches(some)) if some else np.zeros((0, BANDS), np.int64)
            sizes = np.array([len(s) for s in sets])
            ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(sizes.astype(np.int64))]
            columns += [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())]
            columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))]
            maps = bitmaps(sets)
            columns += [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * maps.shape[1]), pa.array(maps.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "s", "bands", "bits"])

    return run


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = unsqueezer()
        leader, own = None, None
        for batch in slices(batches, "z", 2 << 20):
            u, v = [], []
            for b, a, z in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "z")), strict=True):
                if a is None:
                    leader, own = b, shingle_set(unpress(z), size)
                elif leader != b:
                    raise ValueError("a member came without its leader")
                elif linked(own, shingle_set(unpress(z), size)):
                    u.append(a)
                    v.append(b)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _identified(docs: DataFrame) -> DataFrame:
    """``key`` and ``h`` tell rows apart, but for rows of one doc_id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    return rows.withColumn("h", F.xxhash64("text")).withColumn("key", F.coalesce("doc_id", F.lit(_LEAST_ID)))


def _links(pairs: DataFrame, texts: DataFrame, size: int, space: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) that are linked, as (u, v)."""
    # written before it is joined: beside an aggregation Spark wouldn't split the members of a hot leader
    parts = space.table(pairs.groupBy("b").agg((1 + F.floor(F.count("a") / PART)).cast("int").alias("parts")), name)
    members = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).select("b", "part", "a")
    members = members.join(texts.withColumnRenamed("id", "a"), "a").select("b", "part", "a", "z")
    leaders = parts.join(texts.withColumnRenamed("id", "b"), "b")
    leaders = leaders.select("b", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(None).cast("long").alias("a"), "z")
    dealt = members.unionByName(leaders).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
    return dealt.select("b", "a", "z").mapInArrow(_verify(size), "u long, v long")


def _fitting(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that can be linked."""
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")), x)
    return pairs.filter(possible("a", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, space: Workspace, size: int = 5) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles and component_id of each row."""
    return _grouped(docs, space, size).drop("comp")


def _grouped(docs: DataFrame, space: Workspace, size: int) -> DataFrame:
    """``near_duplicates`` with ``comp``, which tells components apart whose ids are all null; null for empty sets."""
    rows = _identified(docs)
    sketch = rows.select("doc_id", "h", "text").mapInArrow(_sketch(size), "doc_id long, h long, n long, s binary, bands array<long>, bits array<long>")
    sketch = space.table(sketch, "sketch")
    key = F.struct(F.coalesce("doc_id", F.lit(_LEAST_ID)).alias("key"), "h")
    classes = sketch.filter("n > 0").groupBy("s").agg(F.min("doc_id").alias("least"), F.min(key).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = space.table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    banded = classes.select("id", "n", F.explode("bands").alias("band"))
    groups = space.table(banded.groupBy("band").agg(F.count("id").alias("members"), F.min("id").alias("b")).filter("members > 1").drop("members"), "groups")
    grouped = space.table(banded.join(groups, "band"), "grouped")  # id, n, band, b: classes that share a band
    texts = _texts(rows, classes.join(grouped.select("id").distinct(), "id", "left_semi"), space)
    first = space.table(_fitting(grouped.filter("id <> b").select(F.col("id").alias("a"), "b").distinct(), classes), "first")
    links = space.table(_links(first, texts, size, space, "first-parts"), "links")
    found = components(links, space, "near")

    # bands in which the first step left several components
    named = grouped.join(found.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "n", F.coalesce("comp", "id").alias("comp"))
    named = space.table(named, "named")
    several = named.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("id").alias("members")).filter("low < high")
    several = several.select("band", (1 + F.floor(F.col("members") / SPREAD)).cast("int").alias("parts"))
    rest = named.join(space.table(several, "several"), "band").join(classes.select("id", "bits", "bands"), "id")
    rest = space.table(rest, "rest")
    # one side of a band is dealt to its parts, the other meets each of them
    part = {"a": F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), "b": F.explode(F.expr("sequence(0, parts - 1)"))}
    left, right = (rest.select("band", part[x].alias("part"), *(F.col(c).alias(x if c == "id" else f"{c}{x}") for c in ("id", "n", "comp", "bits", "bands"))) for x in "ab")
    # a pair that shares several bands comes out of the least one
    once = "array_min(array_intersect(bandsa, bandsb)) = band"
    pairs = left.join(right, ["band", "part"]).filter(f"a > b AND compa <> compb AND {possible('a', 'b')} AND {once}").select("a", "b").distinct()
    second = space.table(pairs, "second")
    if not second.isEmpty():
        more = space.table(_links(second, texts, size, space, "second-parts"), "more-links")
        found = components(links.unionByName(more), space, "all")

    of_class = classes.select("s", "id", "least").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    of_class = space.table(of_class.select("s", "least", "comp"), "of-class")
    least = space.table(of_class.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    named_class = of_class.join(least, "comp").select("s", "component_id", "comp")
    joined = sketch.select("doc_id", "h", F.col("n").alias("n_shingles"), "s").join(named_class, "s", "left")
    return joined.select("doc_id", "h", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "comp")


def _texts(rows: DataFrame, classes: DataFrame, space: Workspace) -> DataFrame:
    """id and squeezed text of one document of each class."""
    wanted = classes.select("at.key", "at.h", "id")
    found = squeezed(rows, "key", "h").join(wanted.hint("shuffle_hash"), ["key", "h"]).select("id", "z")
    return space.table(found, "texts")


def kept_documents(docs: DataFrame, space: Workspace, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, of the least doc_id (null after all
    others), then of the least hash of its text. Of rows without words, which are linked with
    nothing, one row of each doc_id and text. Rows that share a doc_id but no component all stay."""
    found = _grouped(docs, space, size)
    alone = F.col("comp").isNull()
    by = ["comp", F.when(alone, F.col("doc_id")).alias("of"), F.when(alone, F.col("h")).alias("text")]
    by_text = found.groupBy("doc_id", "h", "comp").agg(F.count(F.lit(1)).alias("n"))
    least = by_text.groupBy(*by).agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h", "n")).alias("x"))
    kept = space.table(least.select(F.coalesce("x.doc_id", F.lit(_LEAST_ID)).alias("key"), "x.h", "x.n"), "kept")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID))
    marked = docs.select(rows_of(docs).alias("row"), key.alias("key"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    stay = marked.join(kept.filter("n = 1").hint("shuffle_hash"), ["key", "h"], "left_semi")
    repeated = kept.filter("n > 1")
    if not repeated.isEmpty():
        stay = stay.unionByName(marked.join(repeated, ["key", "h"], "left_semi").dropDuplicates(["key", "h"]))
    return stay.select("row.*")
