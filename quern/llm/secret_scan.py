r"""Secret scans with an incremental blob ledger (operator 6).

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds a
row for each blob and rule version already scanned, with what was found. A scan looks only at
blobs without such a row, once each however many paths hold them, and joins findings back to
all paths. Only addresses are grouped; the texts of unseen blobs are shuffled once, by the
(distinct) document chosen for each blob, so a blob that a third of all paths hold stays spread.
The ledger is durable: :class:`Ledger` is a folder to which each scan adds its findings as one
atomic step, and which any later session opens again.

Rules of version 2, in the order of their kinds; matches are leftmost and non-overlapping per
kind, and spans are in code points, end exclusive. Base kinds: ``assign``, ``access`` and
``hex``; the others add spans and never change the base ones. A ``pem`` span runs through the END
line of the same label if no other key begins before it, else to the end of the base64 text.

Defined results: a null text is the empty text, in which nothing is found; rows with a null
doc_id, and repeated rows, are paths of their own; other columns are ignored, whatever their names; an
empty table gives no rows. Texts are scanned whole; a very long one takes a small multiple of its own bytes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Workspace, finished_folders, rows_of, slices, squeezed, unsqueezer

RULE_VERSION = 2

#: What follows a key's first line: anything up to its END line; or header lines, long runs of base64 and a short last line.
_PEM_BODY = r"""(?:(?:(?!-----BEGIN\x20)[\s\S])*?-----END\x20\1-----
    |(?:(?:\s|\\[rn])*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)*+(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{20,}+={0,2})++
     (?:[\x20\t]*(?:\r?\n|\\n)[\x20\t]*[A-Za-z0-9+/]{1,19}+={0,2}(?=[\x20\t]*(?:[\r\n\\]|\Z)))?)?"""

# Kind, pattern, least code points of the match (of its last group, if it has groups).
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]+", 24),
    ("pem", r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----" + re.sub(r"\n\s*", "", _PEM_BODY), 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)
BASE = ("assign", "access", "hex")
_COMPILED = [(kind, re.compile(pattern, re.A), least) for kind, pattern, least in RULES]
#: A text without any of these, in lower case, has no match of the kind.
_HINTS = {
    "assign": ("passw", "secret", "token", "api"), "access": ("akia",), "pem": ("-----begin",), "forge": ("gh",), "chat": ("xox",), "jwt": ("eyj",),
}
#: Runs that are long enough can be looked for at once: a run is matched whole or not at all.
_FAST = {"hex": re.compile(r"[0-9a-f]{24,}"), "access": re.compile(r"AKIA[A-Z0-9]{16,}")}

_FINDINGS = "blob binary, rule_version int, spans array<struct<kind: string, start: long, end: long>>"


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the order of the rules."""
    lower, found = text.lower(), []
    for rank, (kind, pattern, least) in enumerate(_COMPILED):
        if kind in _HINTS and not any(h in lower for h in _HINTS[kind]):
            continue
        for m in _FAST.get(kind, pattern).finditer(text):
            if len(m.group(m.lastindex or 0)) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by ``[REDACTED]``."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: x[1]):
        if start >= at:
            out += [text[at:start], "[REDACTED]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpress = unsqueezer()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in slices(batches, "z", 2 << 20):
        found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(unpress(z).decode())] for z in batch.column("z").to_pylist()]
        columns = [batch.column("blob"), pa.array([RULE_VERSION] * len(found), pa.int32()), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["blob", "rule_version", "spans"])


def addressed(docs: DataFrame) -> DataFrame:
    """path (doc_id), text and blob (SHA-256 of the text) of each version."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


class Ledger:
    """What has been found in each blob under each rule version, in a folder of Parquet tables.

    A scan adds one table, which counts once Spark has marked it as finished; a scan that fails
    leaves nothing. Two scans at once may scan a blob twice, with equal findings.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame:
        """blob, rule_version and spans, once for each pair."""
        found = finished_folders(self.spark, self.folder)
        rows = self.spark.read.schema(_FINDINGS).parquet(*found) if found else self.spark.createDataFrame([], _FINDINGS)
        return rows if len(found) < 2 else rows.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))

    def add(self, findings: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        findings.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(_FINDINGS).parquet(path)

    def scan(self, docs: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
        """Scans the blobs that the ledger lacks and adds them; doc_id and blob of all paths, and this scan's findings."""
        paths, scanned = _scanned(docs, self.read() if finished_folders(self.spark, self.folder) else None, space)
        return paths, self.add(scanned)


def update_ledger(docs: DataFrame, ledger: DataFrame | None, space: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans blobs that the ledger (blob, rule_version, spans) lacks.

    Returns doc_id and blob of all paths, the findings of this scan, and the ledger with them.
    """
    paths, scanned = _scanned(docs, ledger, space)
    scanned = space.table(scanned, "findings")
    return paths, scanned, scanned if ledger is None else ledger.unionByName(scanned)


def _scanned(docs: DataFrame, ledger: DataFrame | None, space: Workspace) -> tuple[DataFrame, DataFrame]:
    rows = addressed(docs)
    key = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key")
    paths = space.table(rows.select("doc_id", "blob"), "paths")
    unseen = paths.groupBy("blob").agg(F.min(key).alias("key"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob")
        unseen = unseen.join(known, "blob", "left_anti")
    keyed = rows.withColumn("key", key).select("key", "blob", "text")
    texts = squeezed(keyed, "key", "blob").join(unseen.hint("shuffle_hash"), ["key", "blob"], "left_semi")
    # rows repeated under one doc_id are scanned each, and their equal findings kept once
    return paths, texts.mapInArrow(_scan, _FINDINGS).groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))


def findings_by_path(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id, blob and the spans of each path; blobs without findings have an empty list."""
    some = ledger.filter((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    return paths.join(some, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(some.schema["spans"].dataType)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count(kind) for kind in BASE),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )


def redacted(docs: DataFrame, space: Workspace) -> DataFrame:
    """The rows of ``docs`` with every secret in ``text`` replaced, and ``n_chars``, if there, set anew."""
    _, _, ledger = update_ledger(docs, None, space)
    some = ledger.filter((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    blob = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    joined = docs.select(rows_of(docs).alias("row"), blob.alias("blob")).join(some, "blob", "left").select("row.text", "row", "spans")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    texts[k] = redact(texts[k], [(s["kind"], s["start"], s["end"]) for s in spans])
            fields = batch.column("row").flatten()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else x for c, x in zip(names, fields, strict=True)], names)

    found = joined.mapInArrow(run, docs.schema)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found
