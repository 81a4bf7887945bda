"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton reads tokens: it accepts exactly the token sequences that merging
would leave, and there is one for each string. It starts as one state that loops
on every byte. Merge ``a b -> c`` is then applied as a gadget: the state after
``a`` loses its arc ``b``; wherever ``a`` could be followed by ``b`` there is now
an arc ``c``, into a copy of the state after ``b`` as it was then. A state is so
known by its last token: its arcs are those of the state it was copied from, at
the time of the copy, without the arcs cut since. Spelled out, the arcs of 50,000
merges number about a billion, so the gadgets are kept as three tables (parts
and time of each token, cut arcs) and an arc is worked out when first asked for.

A word is encoded by following arcs whose labels spell it: each of its prefixes
has one accepted sequence, so one state per position suffices. Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType

from wiretally.llm.common import with_field

#: The pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Words and arcs that a task remembers; both are emptied when full.
WORDS_KEPT = 80_000
ARCS_KEPT = 100_000
# Bytes of the beginning that is looked up first for the longest label.
FIRST_TRY = 4
# Rows that a task turns into ids at a time.
ROWS = 128
BYTES = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Labels:
    """What the arcs of a byte-level vocabulary emit; all that decoding needs."""

    def __init__(self, vocabulary: dict[str, int], added: dict[str, int]):
        letters = byte_letters()
        self.labels: dict[int, bytes] = {}
        for token, i in vocabulary.items():
            self.labels[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            self.labels[i] = token.encode()
        self.added = added

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class Automaton(Labels):
    """Tables compiled from the merges, in order, of a byte-level vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list, added: dict[str, int]):
        super().__init__(vocabulary, added)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.time = {i: 0 for i, label in self.labels.items() if len(label) == 1}
        self.cut: dict[int, int] = {}
        for at, merge in enumerate(merges, 1):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self._gadget(vocabulary[a], vocabulary[b], vocabulary[a + b], at)
        #: The longest token that each beginning of a label begins with.
        self.longest: dict[bytes, int] = {b"": -1}
        #: The longest token that a token's label begins with, other than itself.
        self.shorter: dict[int, int] = {}
        for token in sorted(self.time, key=lambda i: len(self.labels[i])):
            label, last = self.labels[token], -1
            for end in range(1, len(label)):
                last = self.longest.setdefault(label[:end], last)
            self.longest[label], self.shorter[token] = token, last
        self.sizes = [0] * (max(self.labels, default=0) + 1)
        for token, label in self.labels.items():
            self.sizes[token] = len(label)
        self.decimals = [str(i) for i in range(len(self.sizes))]
        self.arcs: dict[int, bool] = {}
        # Words met lately, and those met before them.
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _gadget(self, a: int, b: int, c: int, at: int) -> None:
        # Where nothing leads over a and b, there is no arc to lay.
        if a in self.time and b in self.time and c not in self.time and self.has_arc(a, b):
            self.cut[a << 32 | b] = at
            self.left[c], self.right[c], self.time[c] = a, b, at

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow where ``state`` is the last token."""
        now, cut, time = len(self.labels) + 2, self.cut.get, self.time
        while True:
            at = cut(state << 32 | token)
            if at is not None and at < now:
                return False
            made, fresh = time[state], time[token]
            if not made and not fresh:
                return True
            if made >= fresh:
                # The state is a copy of the one after its right part, just before its merge.
                state, now = self.right[state], min(now, made)
            else:
                # The arc was laid beside that of its left part, after the cut of its merge.
                token, now = self.left[token], min(now, fresh + 1)

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The one sequence of arcs from the start that spells ``word``.

        Longer labels are tried first. A position is reached with one state only,
        so one that led nowhere is not tried again.
        """
        longest, sizes, shorter = self.longest.get, self.sizes, self.shorter
        arcs, arcs_get, n = self.arcs, self.arcs.get, len(word)
        at, state, path = 0, -1, []
        dead: set[int] = set()
        while at < n:
            # The longest label that goes on from here; most are about as long as the first try.
            end = at + FIRST_TRY if at + FIRST_TRY < n else n
            token = longest(word[at:end])
            if token is None:
                while token is None:
                    end -= 1
                    token = longest(word[at:end])
            else:
                while end < n:
                    end += 1
                    more = longest(word[at:end])
                    if more is None:
                        break
                    token = more
            while True:
                if token < 0:
                    # Nothing leads on from here: take back the last arc for a shorter one.
                    dead.add(at)
                    last = path.pop()
                    at -= sizes[last]
                    token, state = shorter[last], path[-1] if path else -1
                    continue
                end = at + sizes[token]
                if end not in dead:
                    if state < 0:
                        break
                    key = state << 32 | token
                    arc = arcs_get(key)
                    if arc is None:
                        if len(arcs) >= ARCS_KEPT:
                            arcs.clear()
                        arc = arcs[key] = self.has_arc(state, token)
                    if arc:
                        break
                token = shorter[token]
            path.append(token)
            at, state = end, token
        return tuple(path)

    def _missed(self, word: str) -> tuple[int, ...]:
        got = self.older.get(word) or self.encode_word(word.encode())
        if len(self.words) >= WORDS_KEPT:
            self.words, self.older = {}, self.words
        # Very long words are unlikely to come again.
        if len(word) <= 64:
            self.words[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``."""
        ids: list[int] = []
        for part, special in self._parts(text):
            if special is not None:
                ids.append(special)
                continue
            words = split(part)
            found = list(map(self.words.get, words))
            if None in found:
                found = [f or self._missed(w) for f, w in zip(found, words, strict=True)]
            ids.extend(chain.from_iterable(found))
        return ids

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """``text`` cut at the added tokens, which stand for themselves."""
        if not any(token in text for token in self.added):
            yield text, None
            return
        longest_first = sorted(self.added, key=len, reverse=True)
        for part in regex.split("(" + "|".join(map(regex.escape, longest_first)) + ")", text):
            if part in self.added:
                yield "", self.added[part]
            elif part:
                yield part, None


# Printing ASCII, line ends, tabs and Latin letters: in such text these classes are the
# pattern's classes.
_PLAIN = re.compile(r"[\n\r\t -~À-ÖØ-öø-ž]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-ž"
_PLAIN_WORDS = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"
).findall
_ANY_WORDS = regex.compile(PATTERN).findall


def split(text: str) -> list[str]:
    """The words of ``text``: ``PATTERN``'s matches, found the quick way where that is the same."""
    return _PLAIN_WORDS(text) if _PLAIN.fullmatch(text) else _ANY_WORDS(text)


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read on the driver and sent to the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


_COMPILED: dict[tuple[type, str], Labels] = {}


def compiled(vocabulary: str, kind: type = Automaton):
    """The automaton, or the labels alone, of a vocabulary file's text; a worker compiles it once."""
    key = kind, hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _COMPILED:
        file = json.loads(vocabulary)
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        merges = [file["model"]["merges"]] if kind is Automaton else []
        _COMPILED[key] = kind(file["model"]["vocab"], *merges, added)
    return _COMPILED[key]


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no piece but a single row has more than ``BYTES`` in ``column``."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(ROWS, batch.num_rows - at)
            while n > 1 and batch.column(column).slice(at, n).nbytes > BYTES:
                n //= 2
            yield batch.slice(at, n)
            at += n


def encode(docs: DataFrame, path: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array ``ids`` of the token ids of ``column``.

    Added tokens that occur in a text become their own id, as they do in the
    tokenizers library. Defined cases: a null or empty text has no ids; texts of
    any length are encoded whole; repeated rows and other columns are kept; an
    empty table gives no rows.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(vocabulary.value)
        for batch in _slices(batches, column):
            found = [automaton.encode(t.as_py() or "") for t in batch.column(column)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, ids]
            )

    return docs.mapInArrow(of_batches, with_field(docs, ids, ArrayType(IntegerType())))


def decode(encoded: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``encoded`` with the text ``column`` of the array ``ids``; null ids give an empty text.

    Bytes that are not UTF-8 become U+FFFD.
    """
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = compiled(vocabulary.value, Labels)
        for batch in _slices(batches, ids):
            lists = batch.column(ids)
            values = lists.flatten().to_numpy().tolist()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()).tolist()
            texts = [labels.decode(values[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column]
            )

    return encoded.mapInArrow(of_batches, with_field(encoded, column, StringType()))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; cases as in ``encode``.

    Texts are encoded and decoded in one pass, a row at a time, so that neither
    ids nor decoded texts travel.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(vocabulary.value)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = automaton.encode(text.as_py() or "")
                said, decoded = ",".join(map(automaton.decimals.__getitem__, ids)), automaton.decode(ids)
                rows.append(
                    (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (said, decoded)))
                )
            kinds = (pa.int64(), pa.string(), pa.string())
            arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        of_batches, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
