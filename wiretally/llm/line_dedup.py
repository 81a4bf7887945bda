"""Repeated runs of lines, by a suffix array over line numbers.

Distributed prefix doubling ranks every suffix by its first 1, 2, 4, ... lines:
a suffix's new rank comes from its own and that of the suffix half-way on. Two
ranks that overlap name any length between two powers of two, so equal pairs of
ranks are the longest-common-prefix interval of that length, and the interval's
first member is the copy that stays.

A run counts if it has ``MIN_WORDS`` words. Every line of such a run lies in a
shortest run of that many words that starts or that ends inside it, so the
intervals of shortest runs decide every line of every maximal run. As each line
has a word, such runs have at most ``MIN_WORDS`` lines, which bounds the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import WORD, staged

# Words of the shortest repeated run that is deleted.
MIN_WORDS = 50
# Intervals with more than this share of all members are few enough to be broadcast.
HOT = 1000


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key without nulls: null mark, number and hash of the text."""
    return docs.select(
        F.struct("*").alias("doc"),
        F.col("doc_id").isNull().alias("k_null"),
        F.coalesce(F.col("doc_id"), F.lit(0)).alias("k_id"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k_text"),
        "text",
    )


KEYS = ["k_null", "k_id", "k_text"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc, k_*, place, line, words, id``: arrays of each document's lines that occur twice or more.

    ``line`` numbers all lines of the text, ``place`` those with a word.
    """
    numbered = F.filter(
        F.transform(
            _lines(F.col("text")),
            lambda x, i: F.struct(
                i.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"), x.alias("content")
            ),
        ),
        lambda x: x["words"] > 0,
    )
    lines = (
        _keyed(docs.select("doc_id", "text"))
        .select(*KEYS, F.posexplode(numbered).alias("place", "l"))
        .select(*KEYS, "place", "l.line", "l.words", F.unhex(F.md5("l.content")).alias("digest"))
    )
    ids = (
        lines.groupBy("digest")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", F.monotonically_increasing_id().alias("id"))
    )
    found = (
        lines.join(staged(ids, "line-ids"), "digest")
        .groupBy(*KEYS)
        .agg(F.sort_array(F.collect_set(F.struct("place", "line", "words", "id"))).alias("l"))
        .select(F.monotonically_increasing_id().alias("doc"), *KEYS, "l.place", "l.line", "l.words", "l.id")
    )
    return staged(found, "repeated-lines")


def shortest_runs(place: np.ndarray, words: np.ndarray, min_words: int):
    """For each line, the lines of the shortest run of ``min_words`` that starts and that ends there.

    Runs stay within stretches of neighbouring places; 0 where there is none.
    """
    n = len(place)
    ahead, behind = np.zeros(n, np.int32), np.zeros(n, np.int32)
    cuts = np.flatnonzero(np.diff(place) != 1) + 1
    for s, e in zip(np.r_[0, cuts], np.r_[cuts, n], strict=True):
        upto = np.cumsum(words[s:e])
        before = upto - words[s:e]
        at = np.arange(e - s)
        end = np.searchsorted(upto, before + min_words)
        ahead[s:e] = np.where(end < e - s, end - at + 1, 0)
        start = np.searchsorted(before, upto - min_words, side="right") - 1
        behind[s:e] = np.where(start >= 0, at - start + 1, 0)
    return ahead, behind


def _positions(repeated: DataFrame, min_words: int) -> DataFrame:
    """``doc, place, line, id, ahead, behind`` of every line in a stretch of ``min_words``."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                place, line, words, ids = (
                    batch.column(c)[row].values.to_numpy() for c in ("place", "line", "words", "id")
                )
                ahead, behind = shortest_runs(place, words, min_words)
                # A stretch has such a run that starts at its first line, or none at all.
                keep = _in_long_stretch(place, ahead)
                doc = np.full(int(keep.sum()), batch.column("doc")[row].as_py(), np.int64)
                out.append((doc, *(x[keep] for x in (place, line, ids, ahead, behind))))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                    ["doc", "place", "line", "id", "ahead", "behind"],
                )

    return repeated.select("doc", "place", "line", "words", "id").mapInArrow(
        of_batches, "doc bigint, place int, line int, id bigint, ahead int, behind int"
    )


def _in_long_stretch(place: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    first = np.r_[True, np.diff(place) != 1]
    return (ahead[first] > 0)[np.cumsum(first) - 1]


def _doubled(ranks: DataFrame, half: int) -> DataFrame:
    """Ranks by twice as many lines, of the suffixes whose longer prefix occurs twice or more.

    Pairs of ranks are sorted in ranges, and the place of a pair in that order is
    its rank. A pair that occurs once can be in no repeated run and is left out.
    """
    half_on = Window.partitionBy("doc").orderBy("place").rangeBetween(half, half)
    pairs = staged(
        ranks.withColumn("next", F.first("rank").over(half_on)).where("next is not null"), "pairs"
    )
    order = (
        pairs.groupBy("rank", "next")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .orderBy("rank", "next")
        .select("rank", "next", F.monotonically_increasing_id().alias("doubled"))
    )
    return staged(
        pairs.join(staged(order, "order"), ["rank", "next"]).select(
            "doc", "place", F.col("doubled").alias("rank")
        ),
        "ranks",
    )


def repeated_run_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``k_null, k_id, k_text, lines``: the lines to delete, one row per document with any."""
    repeated = _repeated_lines(docs)
    positions = staged(_positions(repeated, min_words), "positions")
    runs = positions.select("doc", F.col("place").alias("start"), F.col("ahead").alias("n")).union(
        positions.select("doc", F.expr("place - behind + 1"), "behind")
    )
    runs = runs.where("n > 0")
    longest = runs.agg(F.max("n")).head()[0] or 0

    ranks, half, intervals = positions.select("doc", "place", F.col("id").alias("rank")), 1, []
    while half <= longest:
        ends = ranks.select("doc", F.col("place").alias("second"), F.col("rank").alias("upper"))
        starts = ranks.select("doc", F.col("place").alias("start"), F.col("rank").alias("lower"))
        intervals.append(
            runs.where((F.col("n") >= half) & (F.col("n") < 2 * half))
            .withColumn("second", F.col("start") + F.col("n") - half)
            .join(starts, ["doc", "start"])
            .join(ends, ["doc", "second"])
            .select("doc", "start", "n", "lower", "upper")
        )
        if 2 * half <= longest:
            ranks = _doubled(ranks, half)
        half *= 2
    if not intervals:
        empty = repeated.where("false")
        return empty.select(*KEYS, F.col("line").alias("lines"))

    keys = repeated.select("doc", F.struct(*KEYS).alias("key"))
    members = staged(
        reduce(DataFrame.union, intervals)
        .join(keys, "doc")
        .select("doc", "start", "n", "lower", "upper", F.struct("key", "start").alias("at")),
        "intervals",
    )
    # Members of one interval share a prefix of n lines; the first in the corpus stays.
    interval = ["n", "lower", "upper"]
    firsts = members.groupBy(*interval).agg(F.min("at").alias("first"), F.count("*").alias("m"))
    firsts = staged(firsts.where("m > 1"), "firsts")
    # Members of frequent intervals meet their first one where they are read; of the others each
    # has a small share of all members.
    hot = F.broadcast(firsts.where(F.col("m") > members.count() / HOT))
    later = members.join(hot, interval).unionByName(
        members.join(hot, interval, "left_anti").join(firsts, interval)
    )
    places = (
        later.where("at > first")
        .select("doc", F.explode(F.expr("sequence(start, start + n - 1)")).alias("place"))
        .distinct()
    )
    lines = (
        places.join(positions.select("doc", "place", "line"), ["doc", "place"])
        .groupBy("doc")
        .agg(F.collect_list("line").alias("lines"))
    )
    return repeated.select("doc", *KEYS).join(lines, "doc").select(*KEYS, "lines")


def drop_repeated_runs(
    docs: DataFrame, min_words: int = MIN_WORDS, deleted: str | None = "lines_deleted"
) -> DataFrame:
    """``docs`` without the lines of later copies of repeated runs, and their number as ``deleted``.

    A run is one or more neighbouring lines with a word, of ``min_words`` words
    together; blank lines between are passed over and stay. Copies are ordered by
    ``doc_id`` (null last), then by place; the first stays, but for lines in which a
    copy overlaps an earlier one: of 60 equal lines one stays, as the runs that
    begin at its second to last lines are copies. Words are separated by ASCII white space, lines by a line feed, and lines are equal if identical.
    Defined cases: a null text stays null; a text whose lines all go is empty;
    rows of one ``doc_id`` and text are one document and lose the same lines;
    rows of one ``doc_id`` and other texts are ordered by a hash of the text; an
    empty table gives no rows; other columns are kept, whatever their names, and
    ``n_chars``, if there, is counted anew where lines went. ``deleted`` must be
    no column of ``docs``; None leaves the number out.
    """
    lines = staged(repeated_run_lines(docs, min_words), "deleted-lines")
    # Documents with deleted lines grow with the corpus: they are never broadcast.
    rows = _keyed(docs).join(lines.hint("merge"), KEYS, "left")
    # The numbers that stay are found by hashing, and the text is split once.
    kept = F.expr(
        "transform(array(split(text, '\n', -1)), parts -> array_join(transform("
        "array_except(sequence(0, size(parts) - 1), lines), i -> parts[i]), '\n'))[0]"
    )
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept)
    rows = rows.withColumn("text", text)
    out = [
        F.col("text")
        if c == "text"
        else F.when(F.col("lines").isNull(), F.col("doc.n_chars"))
        .otherwise(F.length("text"))
        .cast(docs.schema[c].dataType)
        .alias(c)
        if c == "n_chars"
        else F.col("doc")[c].alias(c)
        for c in docs.columns
    ]
    if deleted is not None:
        out.append(F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias(deleted))
    return rows.select(*out)
