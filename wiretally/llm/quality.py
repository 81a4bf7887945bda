"""Quality classifier: support vectors over naive Bayes features.

A text is the set of its n-grams: words and word pairs, and runs of up to three
word shapes. Each indicator is scaled by the log-count ratio of its classes, and
a linear hinge-loss model is fitted to them by dual coordinate descent. A
held-back part of the sample turns margins into probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wiretally.llm.common import bounded_sample, fold, with_field

# The learning sample has at most this many labelled rows.
SAMPLE = 6000
BUCKET_BITS = 18
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
SEED = 42
CALIBRATION = 4
# Tokens looked up at a time, and tokens a task remembers.
PIECE = 1 << 17
KNOWN = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
MASK = np.uint64((1 << BUCKET_BITS) - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shape(token: str) -> int:
    """A number for how a token is written; signs stand for themselves."""
    if not (token[0].isalnum() or token[0] == "_"):
        return 16 + xxhash.xxh32_intdigest(token[:3].encode()) % 65521
    if token.islower():
        return 1 if len(token) > 3 else 2
    if token.isupper():
        return 3 if len(token) > 1 else 4
    if token.isdigit():
        return 5
    return 6 if token.istitle() else 7


def _numbers(token: str) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace"), SEED), shape(token)


def features(text: str | None, known: dict[str, tuple[int, int]]) -> np.ndarray:
    """Sorted distinct buckets of the text's n-grams; at most ``2 ** BUCKET_BITS``."""
    seen = np.zeros(0, np.uint64)
    tokens: list[tuple[int, int]] = []

    def flush() -> None:
        nonlocal seen, tokens
        pairs = np.array(tokens, np.uint64).reshape(-1, 2)
        word, kind = pairs[:, 0], pairs[:, 1].copy()
        kind[1:][word[1:] == word[:-1]] = 8  # a word said again
        grams = [word * _A, (word[:-1] * _B) ^ (word[1:] * _C), kind * _C]
        grams.append((kind[:-1] * _A + kind[1:] * _B) ^ _C)
        grams.append((kind[:-2] * _A + kind[1:-1] * _B + kind[2:] * _C) ^ _B)
        mixed = np.concatenate([(g ^ np.uint64(i)) * _A >> np.uint64(64 - BUCKET_BITS) for i, g in enumerate(grams)])
        seen = np.unique(np.concatenate([seen, mixed]))
        # The last two tokens go on into the next piece.
        tokens = tokens[-2:]

    for match in _TOKEN.finditer(text or ""):
        token = match[0]
        got = known.get(token)
        if got is None:
            got = _numbers(token)
            if len(known) >= KNOWN:
                known.clear()
            if len(token) <= 64:
                known[token] = got
        tokens.append(got)
        if len(tokens) >= PIECE:
            flush()
    if tokens:
        flush()
    return seen.astype(np.int64)


@dataclass
class Model:
    #: Weight of each bucket with its log-count ratio taken in.
    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        margin = np.array([self.weights[b].sum(dtype=np.float64) for b in rows])
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    size = 1 << BUCKET_BITS
    p, q = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    for b, y in zip(rows, good, strict=True):
        (p if y else q)[b] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Hinge-loss weights for rows of indicators times ``scale``, the last for a constant of 1."""
    random = np.random.default_rng(SEED)
    weights, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    # Each class has the same share of the cost.
    share = len(rows) / (2 * np.array([max(1, (signs < 0).sum()), max(1, (signs > 0).sum())]))
    most = COST * share[(signs > 0).astype(int)]
    values = [scale[b] for b in rows]
    # Rows are scaled to length 1.
    values = [v / max(np.sqrt((v * v).sum()), 1e-9) for v in values]
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            b, v, y = rows[i], values[i], signs[i]
            gradient = y * (weights[b] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weights[b] += step * v
                bias += step
                alpha[i] = new
    return np.r_[weights, bias]


def train(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """A model from rows of buckets; with one class only, or none, its share is every score."""
    size = 1 << BUCKET_BITS
    if len(set(good.tolist())) < 2:
        share = float(good.mean()) if len(good) else 0.5
        odds = np.log((share * len(good) + 1) / ((1 - share) * len(good) + 1))
        return Model(np.zeros(size, np.float32), 1.0, float(odds))
    held = np.arange(len(rows)) % CALIBRATION == 0
    if len(set(good[~held].tolist())) < 2 or len(set(good[held].tolist())) < 2:
        held[:] = False
    fit = [r for r, h in zip(rows, held, strict=True) if not h]
    ratios = log_count_ratios(fit, good[~held])
    found = dual_coordinate_descent(fit, np.where(good[~held], 1.0, -1.0), ratios)

    calibrating = [r for r, h in zip(rows, held, strict=True) if h] or rows
    y = good[held] if held.any() else good
    weights = (found[:-1] * ratios).astype(np.float32)
    norms = [max(np.sqrt((ratios[b] ** 2).sum()), 1e-9) for b in calibrating]
    margins = np.array([weights[b].sum(dtype=np.float64) / n for b, n in zip(calibrating, norms, strict=True)])
    slope, offset = _sigmoid(margins + found[-1], y)
    return NormedModel(weights, slope, offset + slope * found[-1], (ratios**2).astype(np.float32))


@dataclass
class NormedModel(Model):
    #: Squared ratio of each bucket, for the length of a row.
    squares: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        margin = np.array(
            [
                self.weights[b].sum(dtype=np.float64)
                / max(np.sqrt(self.squares[b].sum(dtype=np.float64)), 1e-9)
                for b in rows
            ]
        )
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _sigmoid(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest sigmoid, by Newton's steps with smoothed targets."""
    n1, n0 = good.sum(), (~good.astype(bool)).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        d, w = p - target, np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([(d * margin).sum() + 1e-3 * slope, d.sum()])
        hessian = np.array(
            [[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum()]]
        )
        step = np.linalg.solve(hessian + 1e-9 * np.eye(2), gradient)
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-7:
            break
    return float(max(slope, 1e-3)), float(offset)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of labelled rows outside the held-out fold.

    The sample is the first ``SAMPLE`` different labels by a hash of ``doc_id``,
    and of their texts, if some numbers have several, the first ``SAMPLE`` by a hash;
    rows that are the same count once. Only the buckets of these come to the driver.
    """
    usable = labels.where((fold(F.col("doc_id")) != 1) & F.col("quality").isin(0, 1))
    chosen = bounded_sample(
        usable.select(F.col("doc_id").alias("l_id"), F.col("quality").alias("good")),
        SAMPLE, SEED, "l_id", "good",
    )

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            rows = [features(t.as_py(), known).astype(np.uint32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("good"), pa.array(rows, pa.binary())],
                ["id", "good", "buckets"],
            )

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
        .select(F.col("doc_id").cast("string").alias("id"), F.col("good").cast("int"), "text")
        .mapInArrow(of_batches, "id string, good int, buckets binary")
        .dropDuplicates()
        .orderBy(F.xxhash64(F.lit(SEED), "id", "good", "buckets"), "id", "good", "buckets")
        .limit(SAMPLE)
        .collect()
    )
    found = sorted((r["id"], r["good"], bytes(r["buckets"])) for r in rows)
    mixed = [found[i] for i in np.random.default_rng(SEED).permutation(len(found))]
    return train(
        [np.frombuffer(b, np.uint32).astype(np.int64) for _, _, b in mixed],
        np.array([g for _, g, _ in mixed], bool),
    )


def with_scores(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """``docs`` with the score ``name`` of its ``text``; nothing else is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            rows = (features(t.as_py(), known) for t in batch.column("text"))
            score = np.concatenate([model.scores([r]) for r in rows] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score)], [*batch.schema.names, name]
            )

    return docs.mapInArrow(of_batches, with_field(docs, name, DoubleType()))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Defined cases: null and empty texts are scored as texts without features;
    without labels of both kinds every text gets the share of good ones; rows
    and labels repeated are learned from once; a null ``doc_id`` counts
    as empty text for its fold and has no label; an empty table gives no rows;
    labels, ``lang``, ``source`` and ``doc_id`` are no inputs of a score.
    """
    scored = with_scores(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted to be good; cases as above, columns of any name are kept."""
    # A name that no column has.
    name = "_score" + "_" * max(map(len, docs.columns))
    return with_scores(docs, learn(docs, labels), name).where(F.col(name) >= 0.5).drop(name)
