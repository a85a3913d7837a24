"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (orders ``ORDERS``) of the lower-cased text's
characters (code points) with runs of blanks as one blank, hashed to ``1 << HASH_BITS`` cells. Over all
labelled training rows, spread over the cluster, each cell gets the number of toxic
and other documents that hold it; r = log of the ratio of the smoothed shares. The
``FEATURES`` cells whose shares differ most, in standard errors, stay. A logistic regression on
x * r is then fitted on the driver to at most ``FIT_ROWS`` labelled rows (half of each
label where there are enough, taken by hash order). Score: the logistic of its sum,
where x is divided by nothing: one sure n-gram of a short insult counts alike in short
and long texts.

The text is the only input of a score. Edge cases: null and empty texts score the bias
alone; a null or missing label, or a null id, trains nothing; a repeated label row
counts once (the larger label); with one class or no labels every score is the share of
toxic labels (0.5 without labels); empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, crc32_of_id, map_batches, settle, text_bytes

ORDERS = (4, 6)
HASH_BITS = 20
#: Cells kept by support: a bound of the model.
FEATURES = 4096
#: Labelled rows that the regression is fitted to at most.
FIT_ROWS = 4000
#: Labels are broadcast up to so many (about 30 bytes each).
BROADCAST_LABELS = 1_000_000
FOLDS = 5
#: Documents added to each cell, dealt to the labels by their shares, so that a rare cell leans to neither.
SMOOTHING = 2.0
RIDGE = 5e-3
ROUNDS = 150

_BLANK_TABLE = bytes(32 if c in b"\t\n\x0b\x0c\r" else ASCII_LOWER[c] for c in range(256))


def cells_of(text: bytes) -> list[np.ndarray]:
    """For each order, the hashed n-grams of a text at each position."""
    flat = b" " + b" ".join(text.translate(_BLANK_TABLE).split()) + b" "
    data = np.frombuffer(flat, np.uint8).astype(np.uint32) if flat.isascii() else np.frombuffer(flat.decode().encode("utf-32-le"), np.uint32)
    out = []
    for order in ORDERS:
        n = len(data) - order + 1
        if n <= 0:
            continue
        mixed = np.full(n, order, np.uint32)
        for at in range(order):
            mixed *= np.uint32(0x01000193)
            mixed += data[at : at + n]
        mixed *= np.uint32(0x9E3779B1)
        out.append(mixed >> np.uint32(32 - HASH_BITS))
    return out


def held_out(key: Column) -> Column:
    return crc32_of_id(key) % FOLDS == 0


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold, an id once."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def labelled(docs: DataFrame, marks: DataFrame, few: bool, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` and the label of labelled rows. Few labels go to the documents, whose texts
    then stay where they are; more than BROADCAST_LABELS are joined by a shuffle."""
    return docs.select("doc_id", *columns).join(F.broadcast(marks) if few else marks, "doc_id")


def cell_counts(rows: DataFrame) -> DataFrame:
    """(cell, positive, negative): documents of each label that hold the cell. A task
    adds up dense arrays and reports its non-zero cells once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << HASH_BITS), np.int64)
        seen = np.zeros(1 << HASH_BITS, bool)
        for batch in batches:
            marks = batch.column("toxic").to_pylist()
            for raw, mark in zip(text_bytes(batch.column("text")), marks):
                for cells in cells_of(raw):
                    seen[cells] = True
                held = np.flatnonzero(seen)
                seen[held] = False
                counts[mark, held] += 1
        held = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(held), 1 << 16):
            part = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1, part]), pa.array(counts[0, part])], names=["cell", "positive", "negative"])

    return rows.select("text", "toxic").mapInArrow(run, "cell bigint, positive bigint, negative bigint").groupBy("cell").agg(
        F.sum("positive").alias("positive"), F.sum("negative").alias("negative")
    )


class Model:
    """``weight`` of each cell (0 for cells that aren't features) and the bias."""

    def __init__(self, cells: np.ndarray, weights: np.ndarray, bias: float):
        self.table = np.zeros(1 << HASH_BITS, np.float32)
        self.table[cells] = weights
        self.feature = np.zeros(1 << HASH_BITS, bool)
        self.feature[cells] = True
        self.bias = bias

    def score(self, text: bytes) -> float:
        held = [c[self.feature[c]] for c in cells_of(text)]
        held = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.table[held].sum(dtype=np.float64), -30, 30))))


def log_ratios(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int) -> np.ndarray:
    """Naive Bayes log-count ratio of each cell, of smoothed document shares."""
    share = n_positive / (n_positive + n_negative)
    toxic = (positive + SMOOTHING * share) / (n_positive + SMOOTHING)
    other = (negative + SMOOTHING * (1 - share)) / (n_negative + SMOOTHING)
    return np.log(toxic) - np.log(other)


def choose(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int) -> np.ndarray:
    """Places of the cells to keep: those whose shares in the two labels differ most, in standard errors."""
    share = (positive + negative) / (n_positive + n_negative)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_positive + 1 / n_negative))
    worth = np.abs(positive / n_positive - negative / n_negative) / error
    return np.sort(np.argsort(-worth, kind="stable")[:FEATURES])


def fit_logistic(indices: np.ndarray, rows: np.ndarray, values: np.ndarray, labels: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression; a class counts half of the loss, Adam steps."""
    n = len(labels)
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, n - labels.sum()))
    weights, bias = np.zeros(features), 0.0
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, ROUNDS + 1):
        logits = np.bincount(rows, values * weights[indices], n) + bias
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) * share
        slope = np.append(np.bincount(indices, values * error[rows], features) + RIDGE * weights, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    none = np.zeros(0, np.int64)
    marks = settle(training_labels(labels), "toxic-labels")
    few = marks.count() <= BROADCAST_LABELS
    ids = settle(labelled(docs, marks, few, ()), "toxic-rows")
    sums = dict(ids.groupBy("toxic").count().collect())
    n_positive, n_negative = sums.get(1, 0), sums.get(0, 0)
    if not n_positive or not n_negative:
        share = min(max((n_positive + 0.5) / (n_positive + n_negative + 1), 1e-6), 1 - 1e-6)
        return Model(none, none, float(np.log(share / (1 - share))))
    rows = labelled(docs, marks, few, ("text",))
    counted = cell_counts(rows).toArrow()  # one row a cell: bounded by the hash
    cells, positive, negative = (counted[n].to_numpy() for n in ("cell", "positive", "negative"))
    order = np.argsort(cells)
    cells, positive, negative = cells[order], positive[order], negative[order]
    ratio = log_ratios(positive, negative, n_positive, n_negative)
    kept = choose(positive, negative, n_positive, n_negative)
    chosen, ratio = cells[kept], ratio[kept]
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def features(batch: pa.RecordBatch) -> dict:
        lists = []
        for raw in text_bytes(batch.column("text")):
            held = cells_of(raw)
            found = shared.value[np.concatenate(held)] if held else none
            lists.append(np.unique(found[found >= 0]).astype(np.int32))
        return {"toxic": batch.column("toxic"), "held": pa.array(lists, pa.list_(pa.int32()))}

    each = FIT_ROWS // 2
    order = F.xxhash64("doc_id"), F.col("doc_id")
    halves = [ids.filter(F.col("toxic") == t).distinct().orderBy(*order).limit(max(each, FIT_ROWS - other)) for t, other in ((1, n_negative), (0, n_positive))]
    picked = docs.select("doc_id", "text").join(F.broadcast(halves[0].union(halves[1])), "doc_id").select("text", "toxic").limit(2 * FIT_ROWS)
    sample = map_batches(picked, "toxic int, held array<int>", features).toArrow().combine_chunks()
    marks = sample["toxic"].to_numpy().astype(np.float64)
    held = sample["held"].combine_chunks()
    indices = held.flatten().to_numpy()
    lengths = np.diff(held.offsets.to_numpy())
    weights, bias = fit_logistic(indices, np.repeat(np.arange(len(marks)), lengths), ratio[indices], marks, len(chosen))
    return Model(chosen, weights * ratio, bias)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        return {key: batch.column(0), "score": np.array([shared.value.score(t) for t in text_bytes(batch.column(1))])}

    return map_batches(docs.select(F.col(key).cast("long").alias(key), text), f"{key} bigint, score double", run)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract of op8."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects (score of 0.5 or more)."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            kept = pa.array([shared.value.score(t) < 0.5 for t in text_bytes(batch.column(at))], pa.bool_())
            yield batch.filter(kept)

    return docs.mapInArrow(run, schema)
