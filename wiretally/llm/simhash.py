"""SimHash near-duplicates with bit-sliced comparison.

Two fingerprints within two bits agree on at least two of four 16-bit bands, so
distinct fingerprints meet in six tables keyed by two bands. Inside a bucket,
fingerprints are stored as vertical bit planes: one 64-bit word holds one bit of
64 fingerprints, carry-save counters add up the differing bits of all of them at
once, and a word is abandoned once all of its fingerprints exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import staged
from wiretally.llm.components import connected_components

SHINGLE = 3
RADIUS = 2
HASH_SEED = 42
BANDS = 4
# Fingerprints of a chunk; a larger bucket is compared chunk by chunk.
CHUNK = 4096
# Words compared at a time in a task.
STEP = 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, as a signed number; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    # bytes.lower and bytes.split know ASCII letters and white space only.
    n = max(1, len(words) - shingle + 1)
    parts = zip(*[words[i:] for i in range(min(shingle, len(words)))], strict=False)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(p), HASH_SEED) for p in parts), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        rows = hashes[at : at + STEP].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time is turned into Python objects.
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of_batches, f"doc_id {kind}, fp bigint")


def near_words(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Pairs of positions within ``radius`` (1 to 3) bits in one group, smaller position first.

    ``groups`` is sorted. Each group fills words of 64 lanes of its own; every
    fingerprint is compared with each word of its group.
    """
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    words = (sizes + 63) // 64
    first = np.r_[0, np.cumsum(words)[:-1]]
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(groups)) - starts[group]
    word, bit = first[group] + lane // 64, (lane % 64).astype(np.uint64)

    planes = np.zeros((64, int(words.sum())), np.uint64)
    member = np.zeros(planes.shape[1], np.uint64)
    one = np.uint64(1)
    np.bitwise_or.at(member, word, one << bit)
    for j in range(64):
        np.bitwise_or.at(planes[j], word, ((fps >> np.uint64(j)) & one) << bit)

    # Which rows are compared with which words, split into steps of bounded size.
    row_words = words[group]
    ends = np.cumsum(row_words)
    found = []
    at = 0
    while at < len(groups):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + STEP, side="right")))
        rows = np.repeat(np.arange(at, to), row_words[at:to])
        offset = np.arange(len(rows)) - np.repeat(ends[at:to] - row_words[at:to] - base, row_words[at:to])
        found.append(_compare(fps, planes, member, rows, first[group[rows]] + offset, radius))
        at = to
    rows, at_word, hits = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(rows):
        return np.zeros((0, 2), np.int64)
    lanes = np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, b = np.nonzero(lanes)
    other = starts[group[rows[k]]] + (at_word[k] - first[group[rows[k]]]) * 64 + b
    pairs = np.stack([rows[k], other], axis=1)
    return pairs[pairs[:, 0] < pairs[:, 1]]


def _compare(fps, planes, member, rows, at_word, radius):
    """Rows, words and matching lanes; the row's own lane matches too."""
    ones, twos, over = (np.zeros(len(rows), np.uint64) for _ in range(3))
    mine = fps[rows]
    for j in range(64):
        differs = planes[j][at_word] ^ (np.uint64(0) - ((mine >> np.uint64(j)) & np.uint64(1)))
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if j % 8 == 7 and len(rows):
            far = over | _above(ones, twos, radius)
            stay = (member[at_word] & ~far) != 0
            if not stay.all():
                rows, at_word, mine = rows[stay], at_word[stay], mine[stay]
                ones, twos, over = ones[stay], twos[stay], over[stay]
    hits = member[at_word] & ~(over | _above(ones, twos, radius))
    some = hits != 0
    return rows[some], at_word[some], hits[some]


def _above(ones, twos, radius):
    return {1: twos, 2: twos & ones, 3: np.zeros_like(ones)}[radius]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position linked to each of ``n`` positions, over any number of links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket as a forest, so a bucket gives fewer links than it has members."""
    names = ("band", "key", "a", "b", "fp")

    def links(cols: dict[str, np.ndarray], groups: np.ndarray) -> pa.RecordBatch:
        fps = cols["fp"].view(np.uint64)
        pairs = near_words(fps, groups)
        label = forest(pairs[:, 0], pairs[:, 1], len(fps))
        some = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols["fp"][some]), pa.array(cols["fp"][label[some]])], ["u", "v"]
        )

    held = None
    for batch in batches:
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        if held is not None:
            cols = {c: np.concatenate([held[c], cols[c]]) for c in names}
        if not len(cols["fp"]):
            continue
        new = np.zeros(len(cols["fp"]), bool)
        for c in names[:-1]:
            new[1:] |= cols[c][1:] != cols[c][:-1]
        groups = np.cumsum(new)
        # The last bucket may go on in the next batch.
        end = int(np.searchsorted(groups, groups[-1]))
        if end:
            yield links({c: v[:end] for c, v in cols.items()}, groups[:end])
        held = {c: v[end:] for c, v in cols.items()}
    if held is not None and len(held["fp"]):
        yield links(held, np.zeros(len(held["fp"]), np.int64))


def near_links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links ``u, v`` that connect all distinct fingerprints within two bits of each other.

    A bucket above ``chunk`` members is dealt to chunks by hash, and each pair of
    chunks is compared in a place of its own, so no task holds a whole bucket.
    """
    width = 64 // BANDS
    band = [F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1) for i in range(BANDS)]
    tables = F.array(
        *[
            F.struct(F.lit(t).alias("band"), (F.shiftleft(band[i], width) + band[j]).alias("key"))
            for t, (i, j) in enumerate(combinations(range(BANDS), 2))
        ]
    )
    rows = fps.select("fp", F.inline(tables))
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk)
    mine = F.pmod(F.xxhash64("fp"), chunks)
    dealt = (
        rows.join(buckets, ["band", "key"])
        .select("band", "key", "fp", mine.alias("c"), chunks.alias("m"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("d"))
        .select("band", "key", F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"), "fp")
    )
    sorted_rows = dealt.repartition("band", "key", "a", "b").sortWithinPartitions(
        "band", "key", "a", "b"
    )
    return sorted_rows.mapInArrow(_bucket_links, "u bigint, v bigint")


def _components(marked: DataFrame) -> DataFrame:
    """``c_fp, root`` for every distinct fingerprint of ``marked``."""
    distinct = staged(marked.select("fp").distinct(), "distinct")
    roots = staged(connected_components(near_links(distinct)), "roots")
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("c_fp"), F.coalesce("root", "fp").alias("root")
    )


def simhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most
    two differing bits. Defined cases: a null, empty or blank text has the
    fingerprint 0 and is linked like any other; equal fingerprints are linked;
    repeated rows stay rows; a null ``doc_id`` is a component's id only where no
    other is reachable; an empty table gives no rows; other columns are not read.
    """
    marked = staged(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = staged(_components(marked).join(least, F.col("c_fp") == F.col("fp")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("c_fp", "component_id")
    return marked.join(named, F.col("fp") == F.col("c_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component that of the smallest ``doc_id``.

    Null ids come last; rows of one ``doc_id`` are told apart by a hash of their
    text, and of fully repeated rows one stays. Other cases are those of
    ``simhash_components``; columns of any name are kept.
    """
    keys = [
        F.col("doc_id").isNull().alias("k_null"),
        F.coalesce(F.col("doc_id"), F.lit(0)).alias("k_id"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k_text"),
    ]
    marked = staged(
        fingerprints(docs.select(F.struct(*keys).alias("doc_id"), "text")), "fingerprints"
    )
    stays = (
        marked.join(_components(marked), F.col("fp") == F.col("c_fp"))
        .groupBy("root")
        .agg(F.min("doc_id").alias("k"))
        .select("k.*")
    )
    names = ["k_null", "k_id", "k_text"]
    first = Window.partitionBy(*names).orderBy(F.lit(1))
    return (
        docs.select(F.struct("*").alias("doc"), *keys)
        .join(staged(stays, "stays").hint("merge"), names, "left_semi")
        .withColumn("copy", F.row_number().over(first))
        .where("copy = 1")
        .select("doc.*")
    )
