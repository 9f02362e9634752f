"""Toxicity by maximum-scoring segments (operator 10).

1. *Token log-odds with Dirichlet priors.* From at most ``TRAIN_ROWS`` labelled documents (the
   documented bound; lowest hashes of doc_id), the number of toxic and other documents with
   each word gives its log-odds under a Dirichlet prior of a tenth of the counts. A word scores
   the end of their confidence interval (``Z`` standard deviations) that is nearer to zero, so words
   that toxic documents prefer score above zero, words that others prefer below it, and words
   of which too little is known zero; all score ``DRIFT`` less.
2. *Segments.* The best segment of a whole text comes from running sums; where it is significant,
   a linear-time scan finds all maximal scoring segments (Ruzzo and Tompa).
3. *Extreme-value calibration.* The score S of the best segment of n words by chance exceeds x
   with probability 1 - exp(-K n exp(-lambda x)) (Karlin and Altschul). lambda solves
   E[exp(lambda s)] = 1 over the words of other training documents, and K is the maximum-likelihood
   estimate from their best segments. ``lambda S - log(K n)`` of the best segment (K n at least 1), and the sum of
   these over all segments with an expected number of ``EXPECTED`` by chance or less, are a
   document's features.
4. A logistic fit on the features of the training documents turns them into a probability.

Only the text is scored: lang, source, doc_id and labels are never inputs. The model is one
dictionary of words, bounded by the training bound, and every document is scored where it lies.

Defined results: a null or empty text is scored as one without toxic words; documents without
a label (or with a null one) don't train; several labels of one document: the highest; without
any usable label of both kinds all scores are the share of toxic training rows (0 if none);
other columns are ignored; an empty table gives no rows. Very long texts are scored whole, in
memory of a small multiple of their bytes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Workspace, slices, split_words

TRAIN_ROWS = 60_000
Z, MIN_DOCS, PRIOR = 2.0, 3, 0.1
#: A stretch of 1/DRIFT words that both kinds use alike, between two toxic ones, costs 1.
DRIFT = 0.05
#: Segments of which chance makes more in a text of the same length aren't significant.
EXPECTED = 1.0
THRESHOLD = 0.7
RIDGE = 1e-3

#: ASCII punctuation and control characters separate words.
_APART = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    k: float = 1.0
    weights: tuple[float, ...] = ()
    base: float = 0.0

    def _table(self) -> tuple[pa.Array, np.ndarray]:
        if not hasattr(self, "_found"):
            odds = np.fromiter(self.words.values(), np.float64, len(self.words))
            self._found = pa.array(list(self.words), pa.string()), np.append(odds, 0.0) - DRIFT
        return self._found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_found"}

    def scored(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The scores of each text's words."""
        names, scores = self._table()
        words, codes, ends = split_words(texts, _APART)
        places = pc.fill_null(pc.index_in(words, value_set=names), len(names)).to_numpy()
        found, first = scores[places][codes], 0
        for end in ends.tolist():
            yield found[first:end]
            first = end

    def nats(self, score: float, length: int) -> float:
        """How unlikely a segment is in other documents of so many words; above 0 if its expected number is
        below 1. The law holds for long texts; in short ones, too, one segment of score 0 is expected."""
        return self.rate * score - math.log(max(1.0, self.k * length))

    def features(self, scores: np.ndarray) -> tuple[float, float]:
        """Of the best segment, and of all significant ones."""
        best = max(0.0, self.nats(best_segment(scores), len(scores)))
        if best <= -math.log(EXPECTED):
            return best, 0.0
        found = [self.nats(s, len(scores)) for s, _, _ in segments_of(scores)]
        return best, sum(x for x in found if x >= -math.log(EXPECTED))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.base)
        x = design(np.array([self.features(s) for s in self.scored(texts)]).reshape(-1, 2))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -700, 700)))


def best_segment(scores: np.ndarray) -> float:
    """The score of the best segment; 0 if no word scores above 0."""
    if not len(scores):
        return 0.0
    after = np.cumsum(scores)
    before = np.minimum(np.minimum.accumulate(after - scores), 0.0)
    return max(0.0, float((after - before).max()))


def segments_of(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last position) of a sequence of scores."""
    after, at = np.cumsum(scores), np.flatnonzero(scores > 0)
    return _joined(at.tolist(), (after[at] - scores[at]).tolist(), after[at].tolist())


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a sequence that scores ``-drift`` everywhere but at the
    hits (position, positive score)."""
    before, after, total, then = [], [], 0.0, -1
    for position, score in hits:
        before.append(total - drift * (position - then - 1))
        total, then = before[-1] + score, position
        after.append(total)
    return _joined([position for position, _ in hits], before, after)


def _joined(positions: list[int], before: list[float], after: list[float]) -> list[tuple[float, int, int]]:
    """Joins single words that score above 0, given with the running sums on both sides of them,
    to maximal segments. Linear in them."""
    # Candidates: first and last position, running sums before and after them, and the nearest
    # candidate on the left whose running sum before is smaller.
    found: list[tuple[int, int, float, float, int]] = []
    for position, low, total in zip(positions, before, after, strict=True):
        first = position
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= low:
                k = found[k][4]
            if k < 0 or found[k][3] >= total:
                found.append((first, position, low, total, k))
                break
            # joining from candidate k on gives more than either part
            first, low = found[k][0], found[k][2]
            del found[k:]
    return [(high - low, first, last) for first, last, low, high, _ in found]


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x)])


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Ridge-regularised Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + RIDGE * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def solve_rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum(shares * exp(lambda * values)) = 1."""
    mean = float((values * shares).sum())
    if mean >= 0 or values.max() <= 0:
        return 1.0
    total = lambda rate: (shares * np.exp(np.minimum(rate * values, 700))).sum()
    low, high = 0.0, 1.0
    while total(high) < 1 and high < 1e3:
        low, high = high, 2 * high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return max(high, 1e-3)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Other and toxic documents with each word, and its occurrences in other documents, by slice of the texts."""
    for batch in slices(batches, "text"):
        words, codes, ends = split_words(batch.column("text"), _APART)
        toxic = batch.column("toxic").to_numpy().astype(bool)
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        pairs = np.unique(doc * len(words) + codes)
        of, word = np.divmod(pairs, max(1, len(words)))
        count = lambda x: pa.array(np.bincount(x, minlength=len(words)).astype(np.int64))  # noqa: B023, E731
        columns = [words, count(word[~toxic[of]]), count(word[toxic[of]]), count(codes[~toxic[doc]])]
        yield pa.RecordBatch.from_arrays(columns, ["word", "other", "toxic", "said"])


def word_odds(counts: DataFrame, mass: tuple[int, int]) -> DataFrame:
    """Adds ``odds`` to each word's counts, in which ``mass`` are the sums of other and toxic ones."""
    prior = PRIOR * (F.col("other") + F.col("toxic"))
    odds = [F.log((F.col(c) + prior) / (F.lit(m + PRIOR * sum(mass)) - F.col(c) - prior)) for c, m in zip(("other", "toxic"), mass, strict=True)]
    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior))
    raw = odds[1] - odds[0]
    return counts.withColumn("odds", F.signum(raw) * F.greatest(F.lit(0.0), F.abs(raw) - Z * spread))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits the model on labelled documents that aren't held out."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    sample = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` pairs of numbers
    chosen = docs.sparkSession.createDataFrame(sample.toPandas(), "doc_id long, toxic int")
    space = Workspace(docs.sparkSession, "toxicity")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    texts = space.table(texts.select("text", "toxic"), "texts")
    try:
        return _fitted(texts, space)
    finally:
        space.close()


def _fitted(texts: DataFrame, space: Workspace) -> Model:
    context = texts.sparkSession.sparkContext
    kinds = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    total = (kinds.get(0, 0), kinds.get(1, 0))
    model = Model(base=total[1] / max(1, sum(total)))
    if not min(total):
        return model
    counts = texts.mapInArrow(_word_counts, "word string, other long, toxic long, said long")
    counts = space.table(counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("other", "toxic", "said"))), "counts")
    other, toxic, said = (x or 0 for x in counts.agg(*(F.sum(c) for c in ("other", "toxic", "said"))).first())
    if not (other and toxic):
        return model
    # words of at most `rows` documents
    kept = word_odds(counts.filter(F.col("other") + F.col("toxic") >= MIN_DOCS), (other, toxic)).filter("odds <> 0").select("word", "odds", "said").orderBy("word").toPandas()
    model.words = dict(zip(kept["word"], kept["odds"].tolist(), strict=True))
    shares = kept["said"].to_numpy() / max(1, said)
    model.rate = solve_rate(np.append(kept["odds"].to_numpy(), 0.0) - DRIFT, np.append(shares, max(0.0, 1 - shares.sum())))

    shared = context.broadcast(model)

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            terms = [len(s) * math.exp(-shared.value.rate * best_segment(s)) for s in shared.value.scored(batch.column("text")) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.float64())], ["term"])

    # K n exp(-lambda S) has mean 1 over other documents, which is also K's likelihood equation
    model.k = texts.filter("toxic = 0").mapInArrow(chance, "term double").agg(F.count("term") / F.sum("term")).first()[0] or 1.0

    ready = context.broadcast(model)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            best, every = zip(*map(ready.value.features, ready.value.scored(batch.column("text"))), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(every), batch.column("toxic")], ["best", "all", "toxic"])

    # at most `rows` documents, unless training documents are repeated; equal rows are counted
    found = texts.mapInArrow(featured, "best double, all double, toxic int")
    found = found.select(F.round("best", 1).alias("best"), F.round("all", 1).alias("all"), "toxic").groupBy("best", "all", "toxic").count().orderBy("best", "all", "toxic").toPandas()
    weight = found["count"].to_numpy()
    x, y = design(found[["best", "all"]].to_numpy()), found["toxic"].to_numpy()
    model.weights = tuple(fit_logistic(np.repeat(x, weight, axis=0), np.repeat(y, weight)).tolist())
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_scores(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The table with a score column added (it replaces one of that name)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = pa.array(shared.value.scores(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), scores], [*rest, name])

    docs = docs.select(*(F.col(f"`{c}`") for c in rest))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, filtered where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(shared.value.scores(batch.column("text").cast(pa.string())) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
