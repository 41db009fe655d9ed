"""Quality classifier: hashed word n-grams, logistic regression trained by follow-the-regularised-leader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.common import give_back_memory, stored, text_or_empty

# Weights: 2 ** BITS doubles, 2 MB; the bound of what is sent to every task.
BITS = 18
# Labelled documents that the model is fitted on, about; how many of them one
# task learns from; and examples that it sees at least, over several epochs.
TRAINING_ROWS = 24_000
SHARD_ROWS = 6_000
LEAST_EXAMPLES, LEAST_EPOCHS = 12_000, 2
ALPHA, BETA, L1, L2 = 0.15, 1.0, 0.2, 1.0
THRESHOLD = 0.3

_SHAPES = (b"#*$%&|<>", b"0123456789", b"!?", b".,;:")


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text: words, pairs of words, word repeats and kinds of marks.

    Values are shares of their kind of feature, square-rooted, so long and
    short texts compare. Hash indices may meet; equal indices are summed.
    """
    lowered = text.lower()
    words = lowered.split()
    mask = np.uint64((1 << bits) - 1)
    found, values = [np.zeros(1, np.uint64)], [np.ones(1)]

    def add(kind: int, ids: np.ndarray) -> None:
        if len(ids):
            mixed = (ids + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
            which, counts = np.unique((mixed >> np.uint64(64 - bits)) & mask, return_counts=True)
            found.append(which)
            values.append(np.sqrt(counts / len(ids)))

    if words:
        one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        add(1, one)
        add(2, one[:-1] * np.uint64(31) + one[1:])
        distinct = len(found[1])
        shares = [sum(map(text.count, (bytes([c]) for c in group))) / len(text) for group in _SHAPES]
        upper = sum(a != b for a, b in zip(text[:4000], lowered[:4000])) if len(text) <= 4000 else _upper(text)
        shares += [upper / len(text), sum(map(len, words)) / len(words) / 40]
        shares += [1 - distinct / len(words), text.count(b"\n") / len(words)]
        # Ten steps per share, each a feature of its own.
        steps = np.array([100 * i + min(9, int(np.sqrt(max(0.0, s)) * 12)) for i, s in enumerate(shares)], np.uint64)
        mixed = (steps + np.uint64(7_000_003)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(64 - bits)) & mask)
        values.append(np.full(len(steps), 0.7))
    indices, back = np.unique(np.concatenate(found), return_inverse=True)
    return indices.astype(np.int64), np.bincount(back, np.concatenate(values))


def _upper(text: bytes) -> int:
    codes = np.frombuffer(text, np.uint8)
    return int(((codes >= 65) & (codes <= 90)).sum())


class Leader:
    """Follow-the-regularised-leader with a learning rate per weight."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, values: np.ndarray, label: float) -> None:
        weights = self.weights(at)
        slope = (probability(float(weights @ values)) - label) * values
        step = (np.sqrt(self.n[at] + slope**2) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += slope - step * weights
        self.n[at] += slope**2


def probability(margin: float | np.ndarray) -> float | np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0)))


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, seed: int = 0, most: int = TRAINING_ROWS) -> DataFrame:
    """(order, text, label): about `most` of the labelled documents that may be learnt from.

    `labels` has (doc_id, quality). Rows without an id or label don't count,
    nor do ids whose labels disagree. Which rows are drawn, and in which order
    they are learnt, follows from doc_id, not from how the table is laid out.
    An id that several documents have counts once, with the least of their texts.
    `most` bounds what is sent to every task to pick them: ids and labels.
    """
    agreed = (
        labels.filter("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .filter("label = other")
        .select("doc_id", "label")
    )
    agreed = agreed.filter(usable)
    share = most / max(agreed.count(), 1)
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53)
    drawn = agreed.withColumn("order", place).filter(F.col("order") < share)
    texts = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    drawn = texts.join(F.broadcast(drawn), "doc_id").groupBy("order").agg(
        F.min("text").alias("text"), F.first("label").cast("double").alias("label")
    )
    return stored(drawn, "training")


def fit(training: DataFrame, bits: int = BITS) -> np.ndarray:
    """The weights, averaged over models that tasks learn from about SHARD_ROWS rows each.

    Without rows all weights are 0, and every score is 0.5. Only the weights
    that aren't 0 reach the driver: 16 bytes times 2 ** bits per shard at most.
    """
    shards = max(1, round(training.count() / SHARD_ROWS))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        leader = Leader(bits)
        rows = rows.sort_values(["order", "text"])
        examples = []
        for text, label in zip(rows["text"], rows["label"], strict=True):
            at, values = features(text, bits)
            examples.append((at.astype(np.int32), values, label))
        for _ in range(max(LEAST_EPOCHS, -(-LEAST_EXAMPLES // len(examples)))):
            for at, values, label in examples:
                leader.learn(at, values, label)
        weights = leader.weights()
        at = np.flatnonzero(weights)
        examples.clear()
        give_back_memory()
        return pd.DataFrame({"at": at, "weight": weights[at]})

    shard = F.floor(F.col("order") * 1e9).cast("bigint") % shards
    learnt = training.groupBy(shard.alias("shard")).applyInPandas(learn, "at bigint, weight double").toPandas()
    used = training.select(shard.alias("shard")).distinct().count()
    weights = np.zeros(1 << bits)
    np.add.at(weights, learnt["at"].to_numpy(dtype=np.int64), learnt["weight"].to_numpy(dtype=float))
    return weights / max(used, 1)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """(row, score): the probability of label 1 by a sparse dot product over the whole text.

    A null text counts as ''; texts without words score what the bias says.
    """
    bits = (len(weights) - 1).bit_length()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    # Arrow hands out one text at a time; pandas would hold all of a batch once more.
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            margins = np.empty(len(batch))
            for k, document in enumerate(batch):
                at, values = features(document.as_py(), bits)
                margins[k] = model[at] @ values
            yield pa.array(probability(margins))
        give_back_memory()

    return docs.select(F.struct("*").alias("row"), scored(text_or_empty(text).cast("binary")).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = THRESHOLD) -> DataFrame:
    """(row, score, predicted): every document scored by a model of the labels that may be used.

    Repeated rows score alike; an empty table gives no rows; columns other than
    doc_id and text are carried in `row` and never looked at.
    """
    weights = fit(labelled(docs, labels, usable))
    return score(docs, weights).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
