"""Embedding near-dedup (operator 8) by E8 lattice hashing.

Unit vectors are projected to random 8-dimensional spaces and decoded to the nearest point of the
E8 lattice, whose Voronoi cells are the hash buckets. A table's key joins the cells of several such
projections (*blocks*). A vector is stored in its own cell of each table and looks into the
``PROBES`` nearest of the cells that differ from it by one of the 240 neighbours in one block. A pair
meets in a table if one's own cell is the other's own or probed cell. Each met pair is verified by
its cosine in double precision.

How many blocks and tables there are, and how fine the cells, follows from the number of vectors
(``SCHEMES``), so that a vector meets about a hundred unrelated ones whatever that number is. The
keys of a vector grow as about the fourth root of it, candidates in proportion to it. All schemes
meet a pair at cosine 0.9 exactly with probability 0.988, closer pairs nearly always.

Identical vectors are one class with a count. Cells hold light keys first; only rows of cells
in which something meets fetch their vectors. Rows of a crowded cell are dealt to blocks of
``BLOCK``, and each pair of blocks is one matrix product in some task, so no task holds a large
cell. A pair is counted only in the first table and cell in which it meets, so links come out as
counts and spanning edges, never as rows of pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; very large or small finite ones are scaled by a power of two first, which changes no
cosine; vectors of different lengths aren't compared; a null vec_id takes part, and a
component's id is the least vec_id in it; repeated rows are copies that link with each other;
labels and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Workspace, mix
from quern.llm.components import components

PROBES = 8
COSINE = 0.9


@dataclass(frozen=True)
class Scheme:
    """Keys of ``tables`` times ``blocks`` projections, scaled by ``scale`` before they are decoded."""

    blocks: int
    scale: float
    tables: int


#: Up to how many vectors each scheme is for; unrelated vectors meet with probability 7e-4, 2e-4, 6e-6 and 3e-8.
SCHEMES = ((200_000, Scheme(2, 0.55, 12)), (1_000_000, Scheme(2, 0.65, 22)), (20_000_000, Scheme(3, 0.55, 50)), (1 << 62, Scheme(4, 0.55, 168)))
BLOCK = 512
#: Groups up to this size are compared together with others.
SMALL = 48
SEED = 8


@lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if np.prod(s) > 0]
    return np.array(found)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even coordinate sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    near[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 moved by 1/2 in each coordinate."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@lru_cache(maxsize=1024)
def _projection(table: int, size: int, blocks: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, size]).normal(size=(size, 8 * blocks))


def _key(points: np.ndarray, table: int, size: int) -> np.ndarray:
    """Hashes of points (their last axis)."""
    with np.errstate(over="ignore"):
        found = np.full(points.shape[:-1], table * 1_000_003 + size, np.uint64)
        for k in range(points.shape[-1]):
            found = mix(found * np.uint64(31) + np.rint(2 * points[..., k]).astype(np.int64).view(np.uint64))
        return found.view(np.int64)


def scheme_for(vectors: int) -> Scheme:
    return next(scheme for most, scheme in SCHEMES if vectors <= most)


def cells(unit: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Keys of own cells (vector, table) and probed cells (vector, table, probe)."""
    n, size = unit.shape
    own, probed = np.empty((n, scheme.tables), np.int64), np.empty((n, scheme.tables, PROBES), np.int64)
    around = neighbours()
    rows = np.arange(n)[:, None]
    for t in range(scheme.tables):
        x = (unit @ _projection(t, size, scheme.blocks) * scheme.scale).reshape(n * scheme.blocks, 8)
        centre = nearest_e8(x)
        # all neighbours are equally long, so the nearest have the largest product
        product = ((x - centre) @ around.T).reshape(n, -1)
        names = _key(centre, t, size).reshape(n, scheme.blocks).view(np.uint64)
        moved = np.argpartition(-product, PROBES, axis=1)[:, :PROBES]
        block, step = moved // len(around), moved % len(around)
        others = _key(centre.reshape(n, -1, 8)[rows, block] + around[step], t, size).view(np.uint64)
        with np.errstate(over="ignore"):
            # the key is the sum of its blocks' hashes, each mixed with the block's number
            salt = mix(np.arange(1, scheme.blocks + 1, dtype=np.uint64))
            whole = mix(names ^ salt).sum(axis=1, dtype=np.uint64)
            own[:, t] = whole.view(np.int64)
            probed[:, t] = (whole[:, None] - mix(names ^ salt)[rows, block] + mix(others ^ salt[block])).view(np.int64)
    return own, probed


def _scaled(x) -> np.ndarray | None:
    """The vector scaled so that its largest component is near 1; None if it can't be compared."""
    v = np.array([np.nan if c is None else c for c in x.as_py()] if x.is_valid else [], np.float64)
    if not len(v) or not np.isfinite(v).all() or not v.any():
        return None
    return np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) + 0.0


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = list(map(_scaled, batch.column("embedding")))
        keys = [None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vectors]
        raw = [None if v is None else v.tobytes() for v in vectors]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "s", "x"])


def _rows(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.float64) for x in batch.column(column).to_pylist()]


def _cell_rows(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                vectors, ids = _rows(batch, "x"), batch.column("id").to_numpy()
                sizes = np.array([len(v) for v in vectors])
                for size in np.unique(sizes):
                    some = np.flatnonzero(sizes == size)
                    v = np.array([vectors[k] for k in some])
                    own, probed = cells(v / np.linalg.norm(v, axis=1, keepdims=True), scheme)
                    keys = np.concatenate([own.ravel(), probed.ravel()])
                    names = np.concatenate([np.repeat(ids[some], x[0].size) for x in (own, probed)])
                    mine = np.arange(len(keys)) < own.size
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(names), pa.array(mine)], ["cell", "id", "own"])

    return run


def _first_meeting(a, b, own, probed, cell) -> np.ndarray:
    """Which pairs, a the one of the smaller id, meet in ``cell`` first: in no earlier table, and in
    the cell of the smaller id if they meet in both of a table."""
    in_a = (own[a] == own[b]) | (probed[b] == own[a][:, :, None]).any(axis=2)
    in_b = (probed[a] == own[b][:, :, None]).any(axis=2)
    table = (in_a | in_b).argmax(axis=1)
    k = np.arange(len(a))
    return np.where(in_a[k, table], own[a, table], own[b, table]) == cell


def close_pairs(count: np.ndarray, own: np.ndarray, block: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group, given in a row with ``count`` rows each, one of which is stored there,
    whose cosine reaches the threshold. In a group of two blocks only pairs across them count."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    first = np.cumsum(count) - count
    # small groups all at once, pair by pair
    row = np.flatnonzero(np.repeat(count <= SMALL, count))
    behind = np.repeat(first + count, count)[row] - row - 1
    i = np.repeat(row, behind)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
    group = np.repeat(np.arange(len(count)), count)
    lowest, highest = np.minimum.reduceat(block, first), np.maximum.reduceat(block, first)
    fits = (own[i] | own[j]) & ((lowest == highest)[group[i]] | (block[i] != block[j]))
    i, j = i[fits], j[fits]
    found = [(np.zeros(0, np.int64),) * 2]
    for k in range(0, len(i), 50_000):
        p, q = i[k : k + 50_000], j[k : k + 50_000]
        close = np.einsum("ij,ij->i", vectors[p], vectors[q]) / (norms[p] * norms[q]) >= COSINE
        found.append((p[close], q[close]))
    # large ones by a matrix product each
    for g in np.flatnonzero(count > SMALL).tolist():
        some = slice(first[g], first[g] + count[g])
        stored = np.flatnonzero(own[some])
        close = (vectors[some][stored] @ vectors[some].T) / np.outer(norms[some][stored], norms[some]) >= COSINE
        close &= ~own[some][None, :] | (stored[:, None] < np.arange(count[g])[None, :])
        if lowest[g] != highest[g]:
            close &= block[some][stored][:, None] != block[some][None, :]
        x, y = np.nonzero(close)
        found.append((stored[x] + first[g], y + first[g]))
    i, j = zip(*found, strict=True)
    return np.concatenate(i), np.concatenate(j)


def count_links(scheme: Scheme, cell, i, j, ids, weight, vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, an id that it is connected with) from the pairs that meet first in the cell of their rows."""
    # one row of each id stands for all
    used, at = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
    names, row = np.unique(ids, return_index=True)
    row = row[np.searchsorted(names, used)]
    own, probed = cells(vectors[row] / np.sqrt((vectors[row] ** 2).sum(axis=1))[:, None], scheme)
    links, parent = np.zeros(len(used), np.int64), list(range(len(used)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    step = max(1, 5_000_000 // (scheme.tables * PROBES))
    for k in range(0, len(i), step):
        p, q = at[: len(i)][k : k + step], at[len(i) :][k : k + step]
        p, q = np.minimum(p, q), np.maximum(p, q)
        first = _first_meeting(p, q, own, probed, cell[i[k : k + step]])
        p, q = p[first], q[first]
        np.add.at(links, p, weight[row[q]])
        np.add.at(links, q, weight[row[p]])
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            if (ra := root(a)) != (rb := root(b)):
                parent[max(ra, rb)] = min(ra, rb)
    some = np.flatnonzero(links)
    return used[some], links[some], used[[root(k) for k in some.tolist()]]


def _verify(scheme: Scheme):
    def links_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of whole groups."""
        sizes = pc.binary_length(batch.column("x")).to_numpy()
        for size in np.unique(sizes).tolist():
            some = batch.filter(pa.array(sizes == size))
            cell, low, high, ids, own, block, weight = (some.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "low", "high", "id", "own", "block", "weight"))
            new = np.append(True, (cell[1:] != cell[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
            vectors = np.frombuffer(b"".join(some.column("x").to_pylist()), np.float64).reshape(len(ids), -1)
            i, j = close_pairs(np.diff(np.append(np.flatnonzero(new), len(ids))), own, block, vectors)
            if len(i):
                columns = count_links(scheme, cell, i, j, ids, weight, vectors)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "links", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                if held is not None:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                # the last group may go on
                changes = [np.flatnonzero(np.diff(batch.column(c).to_numpy())) for c in ("cell", "low", "high")]
                last = max((int(x[-1]) + 1 for x in changes if len(x)), default=0)
                held = batch.slice(last)
                if last:
                    yield from links_of(batch.slice(0, last))
        if held is not None:
            yield from links_of(held)

    return run


def near_duplicates(vectors: DataFrame, space: Workspace) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    keyed = rows.mapInArrow(_classes, "vec_id long, s binary, x binary")
    classes = keyed.filter("s IS NOT NULL").groupBy("s").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("x").alias("x"))
    classes = space.table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    scheme = scheme_for(classes.count())
    light = space.table(classes.select("id", "x").mapInArrow(_cell_rows(scheme), "cell long, id long, own boolean"), "cells")
    counted = light.groupBy("cell").agg(F.count("id").alias("rows"), F.sum(F.col("own").cast("int")).alias("stored"))
    useful = counted.filter("stored > 0 AND rows > 1").select("cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    met = light.join(useful, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    full = met.join(classes.select("id", "weight", "x"), "id")
    full = full.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    full = full.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    # vectors of one cell have one length, for the length is part of its key
    dealt = full.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    found = space.table(dealt.mapInArrow(_verify(scheme), "u long, links long, v long"), "found")

    comps = components(found.select("u", "v"), space, "near").withColumnRenamed("node", "id")
    links = found.groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    named = classes.drop("x").join(links, "id", "left").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(least, "comp").select("s", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    joined = keyed.select("vec_id", "s").join(named, "s", "left")
    component = F.when(F.col("s").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")
    )
