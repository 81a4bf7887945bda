"""Periodic runs of words: Lyndon arrays by Baier's grouping, roots extended into runs.

Phase one of Baier's suffix sorter groups the suffixes of a text by their longest
Lyndon prefix: groups begin with one word each and are taken from the highest
down, and whatever stands right before a group's members moves to a new group just
above its own. A group's prefix length is then the Lyndon array, without a suffix
array. Every run's period is the length of a Lyndon word that starts in it, under
the order of words or the reverse order, so both arrays together hold the root of
every run; roots are extended by longest common extensions to both sides.

Words that can be in no run of the wanted exponent are set aside first: three
neighbouring words inside a run come again one period on, so they occur as often as
the run has periods, but for the last. Stretches in which that fails are cut there, which
loses no run and no neighbour that could extend one.
"""

from __future__ import annotations

import hashlib
from binascii import crc32
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EXPONENT = 4
LEAST = 6
# Words of the documents that are looked at together; a longer document stands alone.
STEP = 1 << 16
# Neighbouring words that must come again.
GRAM = 3
COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def lyndon_array(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place, by Baier's grouping.

    ``ranks`` orders the letters. Groups are intervals of ``order``; a group's
    number is where its interval starts, so one placed above another one's rest
    takes the end of its interval.
    """
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    group_of = np.searchsorted(ranks[order], ranks).tolist()
    order = order.tolist()
    where = [0] * n
    for at, i in enumerate(order):
        where[i] = at
    # By start: one past the interval's end, and the length of the common prefix.
    ends: dict[int, int] = {}
    for i in range(n):
        ends[group_of[i]] = ends.get(group_of[i], group_of[i]) + 1
    prefix = dict.fromkeys(ends, 1)
    before = [-1] * n
    lengths = [0] * n
    upto = n
    while upto:
        # Members of the highest group that is not done; they move no more.
        group = group_of[order[upto - 1]]
        size = prefix[group]
        members = sorted(order[group:upto])
        upto = group
        times: dict[int, int] = {}
        for i in members:
            lengths[i] = size
            # The nearest place before whose group is lower.
            j = i - 1
            while j >= 0 and group_of[j] >= group:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if not times:
            continue
        by_times: dict[int, list[int]] = {}
        for j, count in times.items():
            by_times.setdefault(count, []).append(j)
        for count in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}
            chosen = by_times[count]
            # To the end of their intervals, which then begin a group of their own.
            for j in chosen:
                old = group_of[j]
                last = ends[old] - 1
                ends[old] = last
                at, other = where[j], order[last]
                order[at], order[last] = other, j
                where[other], where[j] = at, last
                moved[old] = moved.get(old, 0) + 1
            starts = {old: ends[old] for old in moved}
            for j in chosen:
                group_of[j] = starts[group_of[j]]
            for old, number in moved.items():
                start = starts[old]
                ends[start] = start + number
                prefix[start] = prefix[old] + count * size
    return np.array(lengths, np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many first letters of two strings are the same; looks no farther than twice that."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        end = min(at + step, n)
        same = a[at:end] == b[at:end]
        if not same.all():
            return at + int(same.argmin())
        at += len(same)
        step *= 2
    return n


def runs_of(letters: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, sorted; length is at least ``exponent`` periods and ``least``."""
    found: set[tuple[int, int, int]] = set()
    n = len(letters)
    ranks = np.unique(letters, return_inverse=True)[1].astype(np.int64)
    for order in (ranks, -ranks):
        lengths = lyndon_array(order)
        # A run has exponent - 1 whole roots in a row, all of its period.
        roots = np.arange(n)
        for turn in range(1, exponent - 1):
            ahead = roots + turn * lengths[roots]
            roots, ahead = roots[ahead < n], ahead[ahead < n]
            roots = roots[lengths[ahead] == lengths[roots]]
        last: dict[int, tuple[int, int]] = {}
        for i in roots.tolist():
            p = int(lengths[i])
            start, end = last.get(p, (0, 0))
            if start <= i and i + p <= end:
                continue
            end = i + p + _common(ranks[i:], ranks[i + p :])
            start = i - _common(ranks[:i][::-1], ranks[: i + p][::-1])
            last[p] = start, end
            if end - start >= max(least, exponent * p):
                found.add((start, end - start, p))
    return sorted((s, n, p) for s, n, p in found)


def stretches(words: np.ndarray, owner: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of ``words`` that may hold runs; none crosses an ``owner``.

    Words are compared by a hash of neighbours, whose collisions only keep more.
    """
    often = min(exponent - 1, least - GRAM + 1)
    n = len(words)
    if often < 2 or n < GRAM:
        cuts = np.flatnonzero(np.diff(owner)) + 1
        return [(int(a), int(b)) for a, b in zip(np.r_[0, cuts], np.r_[cuts, n], strict=True) if b - a >= least]
    w = words.astype(np.uint64)
    hashed = w[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (w[1:-1] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    hashed = (hashed ^ hashed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + w[2:] * np.uint64(0x165667B19E3779F9)
    starts = np.flatnonzero(owner[:-2] == owner[2:])
    while len(starts):
        # Stretches are neighbouring starts of one owner.
        broken = (np.diff(starts) != 1) | (owner[starts[1:]] != owner[starts[:-1]])
        stretch = np.r_[0, np.cumsum(broken)].astype(np.uint64)
        key = hashed[starts] ^ stretch * np.uint64(0x94D049BB133111EB)
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = count[place] >= often
        if keep.all():
            break
        starts = starts[keep]
    if not len(starts):
        return []
    cuts = np.flatnonzero((np.diff(starts) != 1) | (owner[starts[1:]] != owner[starts[:-1]])) + 1
    begins, ends = starts[np.r_[0, cuts]], starts[np.r_[cuts, len(starts)] - 1] + GRAM
    long = ends - begins >= least
    return list(zip(begins[long].tolist(), ends[long].tolist(), strict=True))


def rearranged(words: list[bytes], doc_id: str) -> list[bytes]:
    """The words as the query takes them: of one document in ten, the end becomes periodic."""
    h, n = crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // len(root) + 1))[: n - a]


def _outcome(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The digest columns of one document."""
    said = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, said, hashlib.sha256(b" ".join(words)).hexdigest()
    dropped = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        dropped[s + q] += 1
        dropped[s + n] -= 1
    stays = np.cumsum(dropped[:-1]) == 0
    kept = b" ".join(w for w, k in zip(words, stays.tolist(), strict=True) if k)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    return (
        len(runs), start, length, period, 1000 * length // period, said, hashlib.sha256(kept).hexdigest()
    )


def _of_documents(documents: list[list[bytes]]) -> Iterator[tuple]:
    """The digest columns of documents that are looked at together."""
    numbers: dict[bytes, int] = {}
    flat = [numbers.setdefault(w, len(numbers)) for words in documents for w in words]
    words, sizes = np.array(flat, np.int64), np.array([len(d) for d in documents], np.int64)
    del flat
    first = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(len(documents)), sizes)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for begin, end in stretches(words, owner):
        document = int(owner[begin])
        shift = begin - int(first[document])
        runs.setdefault(document, []).extend((s + shift, n, q) for s, n, q in runs_of(words[begin:end]))
    for i, of_document in enumerate(documents):
        yield _outcome(of_document, sorted(runs.get(i, ())))


def periodic_runs(docs: DataFrame, take=None) -> DataFrame:
    """``doc_id`` and the digest columns of the runs of every row's words.

    Words are separated by ASCII white space and compared as they are. A run is a
    longest stretch of words with a smallest period, at least ``EXPONENT`` periods and
    ``LEAST`` words long. ``n_runs`` counts them; ``start``, ``length``, ``period`` and
    ``exponent_milli`` are of the longest (ties: the first, then the shorter
    period), null without one; ``runs_sha256`` digests all of them and
    ``collapsed_sha256`` the text with the first period of each run left. ``take``
    may change a document's words by its number before they are looked at.
    Defined cases: a null or empty text has no words; a null ``doc_id`` counts as
    empty text for ``take``; runs may overlap and all count; texts of any length
    are taken whole; repeated rows stay rows; an empty table gives no rows; other
    columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, size = [], [], 0
            ids = batch.column("doc_id").to_pylist()
            for i, text in zip(ids, batch.column("text"), strict=True):
                # bytes.split knows ASCII white space only.
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if take is not None:
                    words = take(words, "" if i is None else str(i))
                held.append(words)
                size += len(words)
                if size >= STEP:
                    out.extend(_of_documents(held))
                    held, size = [], 0
            out.extend(_of_documents(held))
            arrays = [pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *COLUMNS])

    return docs.select("doc_id", "text").mapInArrow(
        of_batches,
        f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, "
        "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    )
