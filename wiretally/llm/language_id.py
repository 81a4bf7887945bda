"""Language identification by averaged hashed subword embeddings.

A text's subwords are its byte n-grams inside words. Each hashes to an embedding;
their average goes through a linear softmax. Both are trained together by
stochastic gradient descent, and a held-back part of the sample sets a
temperature for the probabilities and the confidence below which a prediction is
marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import bounded_sample_by, fold

# The learning sample has at most this many rows of each language, of the most frequent
# languages, and in all.
PER_LANGUAGE = 800
LANGUAGES = 256
SAMPLE = 32_000
BUCKET_BITS = 15
DIMENSION = 16
NGRAMS = (2, 3, 4)
EPOCHS = 6
RATE = 0.6
SEED = 42
# Every fifth row of the sample calibrates; errors among accepted ones stay below the share.
CALIBRATION = 5
MOST_ERRORS = 0.01
# Bytes of text whose subwords are looked up at a time.
PIECE = 1 << 18

_SPACES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def letters_of(text: str | None) -> bytes:
    """Lower-case bytes with everything ASCII but letters as spaces, a space before and after."""
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(_SPACES) + b" "


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def subwords(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams that have no space inside, and where they start."""
    space = text == 0x20
    value, inside = text.astype(np.uint32), np.zeros(len(text), bool)
    buckets, starts = [], []
    for n in range(2, max(NGRAMS) + 1):
        if len(text) < n:
            break
        value = value[:-1] * np.uint32(16777619) ^ text[n - 1 :]
        if n > 2:
            inside = inside[:-1] | space[n - 2 : -1]
        else:
            inside = space[:-1] & space[1:]
        if n in NGRAMS:
            at = np.flatnonzero(~inside)
            mixed = (value[at] ^ np.uint32(n)) * np.uint32(2654435769)
            buckets.append(mixed >> np.uint32(32 - BUCKET_BITS))
            starts.append(at)
        if n == 2:
            inside = np.zeros(len(inside), bool)
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(starts)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and how often each occurs; never more than there are buckets."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    body = np.frombuffer(letters_of(text), np.uint8)
    # Pieces overlap so that each n-gram is in one of them.
    for at in range(0, len(body), PIECE):
        found, starts = subwords(body[at : at + PIECE + max(NGRAMS) - 1])
        total += np.bincount(found[starts < PIECE], minlength=len(total))
    some = np.flatnonzero(total)
    return some, total[some]


@dataclass
class Model:
    languages: list[str]
    #: Embeddings times output weights: a bucket's share of each language's logit.
    logits: np.ndarray
    temperature: float
    threshold: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """A model from (language, buckets, counts); None without rows."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    random = np.random.default_rng(SEED)
    embeddings = random.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSION)) / DIMENSION
    output = np.zeros((DIMENSION, len(languages)))
    known = [(languages.index(lang), b, c / c.sum()) for lang, b, c in rows if len(b)]
    fit = [x for i, x in enumerate(known) if i % CALIBRATION or len(known) < 50]
    held = known[::CALIBRATION]
    steps, at = max(1, EPOCHS * len(fit)), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(fit)):
            y, b, weight = fit[i]
            mean = weight @ embeddings[b]
            error = _softmax(mean @ output)
            error[y] -= 1
            rate = RATE * (1 - at / steps)
            back = output @ error
            output -= rate * np.outer(mean, error)
            # The step of an embedding follows its share; long texts spread theirs thin.
            embeddings[b] -= rate * np.sqrt(len(b)) * weight[:, None] * back
            at += 1
    logits = embeddings @ output

    z = np.array([weight @ logits[b] for _, b, weight in held]).reshape(-1, len(languages))
    y = np.array([h[0] for h in held], int)
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).sum() for t in grid]
    temperature = float(grid[int(np.argmin(losses))]) if len(y) else 1.0
    p = _softmax(z / temperature)
    right, score = p.argmax(1) == y, p.max(1)
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(wrong <= MOST_ERRORS)
    threshold = float(score[order][good[-1]]) if len(good) else 1.0
    return Model(languages, logits.astype(np.float32), temperature, threshold)


def learn(docs: DataFrame) -> Model | None:
    """Train on a bounded sample of rows with a language outside the held-out fold.

    The sample is of the ``LANGUAGES`` languages with most rows (ties by name): the first
    ``PER_LANGUAGE`` different ids of each by a hash, or fewer, so that it has
    ``SAMPLE`` in all; if ids have several texts, as many of these, the same text
    once. It is chosen without reading texts. Only bucket counts come to the driver,
    at most ``2 ** BUCKET_BITS`` of a row.
    """
    labelled = docs.where((fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull())
    most = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    languages = [r["lang"] for r in most.limit(LANGUAGES).collect()]
    if not languages:
        return train([])
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(languages)))
    labelled = labelled.where(F.col("lang").isin(languages))
    # At most SAMPLE rows.
    chosen = bounded_sample_by(labelled.select("doc_id", "lang"), each, SEED, "lang", "doc_id").select(
        F.col("doc_id").alias("c_id"), F.col("lang").alias("c_lang")
    )

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            pairs = [counted(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("lang"),
                    pa.array([b.astype(np.uint32).tobytes() for b, _ in pairs], pa.binary()),
                    pa.array([c.astype(np.uint32).tobytes() for _, c in pairs], pa.binary()),
                ],
                ["id", "lang", "buckets", "counts"],
            )

    in_language = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(SEED), "id", "buckets"), "id", "buckets", "counts")
    rows = (
        labelled.where("text is not null")
        .join(
            F.broadcast(chosen),
            (F.col("doc_id") == F.col("c_id")) & (F.col("lang") == F.col("c_lang")),
            "left_semi",
        )
        .select(F.col("doc_id").cast("string").alias("id"), "lang", "text")
        .mapInArrow(of_batches, "id string, lang string, buckets binary, counts binary")
        .dropDuplicates()
        .withColumn("place", F.row_number().over(in_language))
        .where(F.col("place") <= each)
        .collect()
    )
    found = sorted((r["lang"], r["id"], bytes(r["buckets"]), bytes(r["counts"])) for r in rows)
    random = np.random.default_rng(SEED)
    mixed = [found[i] for i in random.permutation(len(found))]
    return train(
        [(lang, np.frombuffer(b, np.uint32), np.frombuffer(c, np.uint32)) for lang, _, b, c in mixed]
    )


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text; ``und`` and 0 without a letter."""
    letters = np.array([has_letter(t) for t in texts], bool)
    if model is None or not letters.any():
        return ["und"] * len(texts), np.zeros(len(texts))
    sums = np.zeros((len(texts), len(model.languages)))
    counts = np.zeros(len(texts))
    held: list[int] = []
    parts: list[bytes] = []

    def flush() -> None:
        lengths = np.array([len(p) for p in parts])
        body = np.frombuffer(b"".join(parts) + b" ", np.uint8)
        doc = np.repeat(np.array(held), lengths)
        found, starts = subwords(body)
        inside = starts < len(doc)
        owner = doc[starts[inside]]
        np.add.at(counts, owner, 1)
        for k in range(len(model.languages)):
            share = model.logits[found[inside], k]
            sums[:, k] += np.bincount(owner, weights=share, minlength=len(texts))

    size = 0
    for i in np.flatnonzero(letters):
        body = letters_of(texts[i])[:-1]
        for at in range(0, len(body), PIECE):
            held.append(int(i))
            parts.append(body[at : at + PIECE])
            size += len(parts[-1])
            if size >= PIECE:
                flush()
                held, parts, size = [], [], 0
    if parts:
        flush()
    p = _softmax(sums / np.maximum(counts, 1)[:, None] / model.temperature)
    best = p.argmax(1)
    names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, p.max(1), 0.0)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of every row; only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        threshold = model.threshold if model else 1.0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, score = predict(part.column("text").to_pylist(), model)
                accepted = [n != "und" and s >= threshold for n, s in zip(names, score, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names), pa.array(score), pa.array(accepted, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "accepted"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        of_batches, f"doc_id {kind}, lang_pred string, score double, accepted boolean"
    )


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` of every row of ``docs``.

    Defined cases: a null text or one without a letter is ``und`` with score 0,
    and so is every text where no row has a language to learn from; ``accepted``
    is false where the calibrated confidence is too low; repeated rows stay
    rows; a null ``doc_id`` counts as empty text for its fold; an empty table
    gives no rows; ``lang``, ``source`` and ``doc_id`` are no inputs.
    """
    return identify(docs, learn(docs)).select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "lang_pred",
        "score",
        "accepted",
    )
