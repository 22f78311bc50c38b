"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (lower-cased letters), pairs of neighbours and pairs that skip one word, each hashed to one of
2**20 coordinates and counted once. FTRL-proximal learns with a rate for each coordinate; its L1 term leaves few weights,
which are of bounded size and travel to every task by broadcast. Scoring never sees labels, languages, sources or ids.

Defined cases: a very long text is scored whole and alone; null and empty texts, and texts without letters, have no feature and get the score of the bias; rows are
independent, so repeated rows repeat their score; without labelled rows the weights are
empty and every score is just below 0.5, so nothing is rejected; a null doc_id counts as held out; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import map_batches, texts_of
from inkstone.llm.words import CHUNK, NOT_LETTER, U, chunks, mix

BITS = 20
#: Bound of the fitting sample: labelled rows, those of least hash of doc_id. Passes over it.
SAMPLE_ROWS, EPOCHS = 10_000, 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0


@dataclass
class Model:
    bias: float
    index: np.ndarray
    weight: np.ndarray


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By chunk: the first row, the number of rows, and (row in the chunk, coordinate) of every feature, repeats included."""
    shift = U(64 - BITS)
    for c in chunks(column, CHUNK, NOT_LETTER):
        h = c.hashes(seed=11, lower=True)
        row = np.repeat(np.arange(c.rows), np.diff(c.first))
        rows, found = [row], [(h >> shift).astype(np.int64)]
        for gap, seed in ((1, 13), (2, 17)):
            if len(h) > gap:
                same = row[:-gap] == row[gap:]
                pair = mix(h[:-gap] * U(2 * seed + 1) + (h[gap:] ^ U(seed)))
                rows.append(row[:-gap][same])
                found.append((pair[same] >> shift).astype(np.int64))
        yield c.row, c.rows, np.concatenate(rows), np.concatenate(found)


class Ftrl:
    """FTRL-proximal: weights are derived from the sums z and n, so a coordinate that never matters stays exactly 0."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        return w

    def learn(self, i: np.ndarray, label: int) -> None:
        """i: distinct coordinates, the bias (the last one) included."""
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """labels: doc_id and toxic of the rows to learn from. The sample is drawn by ids alone, so of the texts only the sampled ones move;
    one task then learns from them and returns the weights. Where a doc_id has several labels or texts, each pairing counts."""
    key = F.xxhash64(F.col("doc_id"), F.lit(5))
    ids = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"), key.alias("h")).orderBy("h", "doc_id", "toxic").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("h", "doc_id", "text", "toxic")

    def learn(batches):
        model, seen = Ftrl(), []
        bias = np.array([1 << BITS])
        for batch in batches:
            labels = batch.column("toxic").to_pylist()
            for first, n, row, found in features(batch.column("text")):
                key = np.unique(row << BITS | found)
                cuts = np.searchsorted(key, np.arange(n + 1) << BITS)
                for k in range(n):
                    i = np.concatenate([(key[cuts[k] : cuts[k + 1]] & ((1 << BITS) - 1)), bias])
                    seen.append((i.astype(np.int32), labels[first + k]))
        for _ in range(EPOCHS):
            for i, label in seen:
                model.learn(i, label)
        all_weights = model.weights(np.arange((1 << BITS) + 1))
        index = np.flatnonzero(all_weights)
        yield pa.RecordBatch.from_pydict({"i": pa.array(index, pa.int64()), "w": pa.array(all_weights[index], pa.float64())})

    one = sample.repartition(1).sortWithinPartitions("h", "doc_id", "toxic", "text")
    found = sorted((r.i, r.w) for r in map_batches(one, learn, "i long, w double").collect())
    bias = next((w for i, w in found if i == 1 << BITS), -1e-9)
    kept = [x for x in found if x[0] < 1 << BITS]
    return Model(bias, np.array([i for i, _ in kept], np.int64), np.array([w for _, w in kept]))


def logits(column: pa.Array, model: Model, weights: np.ndarray) -> np.ndarray:
    total = np.full(len(column), model.bias)
    for first, n, row, found in features(column):
        at = np.flatnonzero(weights[found])
        key = np.unique(row[at] << BITS | found[at])
        total[first : first + n] += np.bincount(key >> BITS, weights[key & ((1 << BITS) - 1)], n)
    return np.clip(total, -35, 35)


def dense(model: Model) -> np.ndarray:
    weights = np.zeros(1 << BITS)
    weights[model.index] = model.weight
    return weights


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights = dense(shared.value)
        for batch in batches:
            p = 1 / (1 + np.exp(-logits(batch.column("text"), shared.value, weights)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32), pa.int32())})

    return map_batches(texts_of(docs), run, "doc_id long, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights = dense(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(logits(batch.column("text"), shared.value, weights) < 0))

    return map_batches(docs, run, docs.schema)
