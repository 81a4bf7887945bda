"""Secret scan with assignment-aware lexing.

Texts are lexed as source or configuration: names, signs and literals. A name
followed by an assignment sign and a literal is a pair; a literal may join
several strings and earlier names, whose constant values are taken in. A pair
counts if its target's name is sensitive and its value looks like a secret; a
constant that reaches a sensitive name by way of another name counts where it
was written. Spans of three fixed patterns are always there.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns and the least length of what they find.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "named")

# How strongly a part of a target's name tells of a secret; a pair needs NEEDED in all.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.7,
    "private": 0.5, "auth": 0.5, "access": 0.3, "api": 0.3, "key": 0.5, "signing": 0.3,
    "encryption": 0.3, "client": 0.1, "salt": 0.4, "cookie": 0.3, "session": 0.3,
    "public": -0.6, "id": -0.3, "name": -0.4, "url": -0.4, "path": -0.4, "file": -0.3,
    "count": -0.6, "length": -0.6, "type": -0.5, "limit": -0.6, "max": -0.3,
}
NEEDED = 1.4
LEAST_VALUE = 8
# Characters of a value that are looked at for its score; constants keep no more of theirs.
SCORED = 1024
# Values that as a whole stand for a secret without being one: a standing word, others, digits.
_STANDING = frozenset(
    "your my some the insert enter example sample dummy test changeme change placeholder todo none null"
    " true false here replace".split()
)
_FILLING = frozenset(
    "password passwd passphrase pwd secret token api key access client private credential credentials"
    " value user name string text goes with me".split()
)
_LONGEST_WORD = max(map(len, _STANDING | _FILLING))
_DRAWN = re.compile(
    r"x++|X++|\*++|\.++|-++|<.*>|\$\{.*\}|%\([^)]*\).*|\{\{.*\}\}", re.DOTALL
)

_LEX = re.compile(
    r"""(?P<name>[A-Za-z_][A-Za-z0-9_.-]*)"""
    r"""|(?P<number>[0-9][A-Za-z0-9_.]*)"""
    r"""|(?P<sign>:=|=>|->|==|!=|<=|>=|[=:+])"""
    r"""|(?P<end>\n)"""
    r"""|(?P<quote>["'`])"""
    r"""|(?P<other>[^\s])"""
)
# Quotes and line ends with the backslashes before them.
_MARKS = re.compile(r"""(\\*)("{3,}|'{3,}|["'\n])""")
_ANNOTATION = frozenset("[]|,?.<>")
_PREFIXES = frozenset(("b", "r", "u", "f", "rb", "br", "rf", "fr"))
# A value without quotes runs to white space or a separator.
_BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>]+")
_HINT = re.compile(r"[=:>]")
# Some part of a sensitive name; a text without one has no pair that counts.
_SENSITIVE = re.compile("|".join("[_.-]*".join(w) for w, x in NAME_SCORES.items() if x > 0), re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    joined = ["".join(p) for p in zip(parts, parts[1:], strict=False)]
    return sum(NAME_SCORES.get(p, 0.0) for p in {*parts, *joined})


def is_placeholder(value: str) -> bool:
    """Whether ``value`` is made of words that stand for a secret, in time linear in it.

    Words are joined or parted by ``-_ .``; at least one is a standing word, and
    up to four digits may end it. Values drawn of one character or in brackets
    stand for others too.
    """
    if _DRAWN.fullmatch(value):
        return True
    body = value.lower().rstrip("0123456789")
    if len(value) - len(body) > 4:
        return False
    # Places that words lead to, and those of them with a standing word on the way.
    n = len(body)
    some, standing = [False] * (n + 1), [False] * (n + 1)
    some[0] = True
    for i in range(n):
        if not some[i]:
            continue
        if i and body[i] in "-_ .":
            some[i + 1], standing[i + 1] = True, standing[i + 1] or standing[i]
            continue
        for end in range(i + 2, min(n, i + _LONGEST_WORD) + 1):
            word = body[i:end]
            if word in _STANDING:
                some[end] = standing[end] = True
            elif word in _FILLING:
                some[end], standing[end] = True, standing[end] or standing[i]
    return standing[n]


def value_score(value: str) -> float:
    """0 to 1 by length, kinds of characters and entropy; 0 for placeholders and prose."""
    value = value[:SCORED]
    if len(value) < LEAST_VALUE or " " in value.strip() or is_placeholder(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(
        any(map(test, value)) for test in (str.islower, str.isupper, str.isdigit)
    ) + any(not c.isalnum() for c in value)
    return min(1.0, 0.2 * (kinds - 1) + 0.25 * entropy / 2 + min(n, 32) / 80)


class Literal:
    """The first characters of a value and what it was put together from."""

    __slots__ = ("parts", "spans", "value")

    def __init__(self):
        self.value = ""
        self.spans: list[tuple[int, int]] = []
        self.parts: list[Literal] = []

    def add(self, text: str) -> None:
        self.value += text[: SCORED - len(self.value)]

    def collect(self, found: set, seen: set) -> None:
        """Add the spans of all parts to ``found``; parts in ``seen`` were collected before."""
        left = [self]
        while left:
            literal = left.pop()
            if id(literal) not in seen:
                seen.add(id(literal))
                found.update(literal.spans)
                left.extend(literal.parts)


def named_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that are assigned to a sensitive name, directly or through constants."""
    if not _HINT.search(text) or not _SENSITIVE.search(text):
        return []
    #: Name to the literal it was last given; all of them stay, so that each is collected once.
    constants: dict[str, Literal] = {}
    every: list[Literal] = []
    found: set[tuple[int, int]] = set()
    seen: set[int] = set()
    for target, literal in _assignments(text, constants):
        constants[target] = literal
        every.append(literal)
        score = name_score(target)
        worth = value_score(literal.value) if score > 0 else 0.0
        if worth > 0 and score + worth >= NEEDED:
            literal.collect(found, seen)
    return sorted(found)


def _tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of each token; a quote that nothing closes is a sign of its own."""
    # A quote or line end behind an odd number of backslashes is part of a literal, wherever that began.
    closing: dict[str, list[int]] = {k: [] for k in ('"', "'", '"""', "'''", "\n")}
    for m in _MARKS.finditer(text):
        free, mark = len(m[1]) % 2 == 0, m[2][0]
        for at in range(m.start(2) + (not free), m.end()):
            closing[mark].append(at)
            if m.end() - at >= 3 and mark != "\n":
                closing[mark * 3].append(at)
    out, at = [], 0

    def after(mark: str, place: int) -> int:
        places = closing[mark]
        i = bisect_left(places, place)
        return places[i] if i < len(places) else len(text)

    while m := _LEX.search(text, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "quote":
            kind, quote = "other", m[0]
            if quote == "`":
                end = text.find("`", at)
                if end >= 0 and text.find("\n", at, end) < 0:
                    kind, at = "string", end + 1
            else:
                triple = after(quote * 3, start + 3) if text.startswith(quote * 3, start) else len(text)
                end = after(quote, at)
                if triple < len(text):
                    kind, at = "string", triple + 3
                elif end < after("\n", at):
                    kind, at = "string", end + 1
        out.append((kind, text[start:at], start, at))
    return out


def _assignments(text: str, constants: dict):
    """(target, literal) of each pair of a text, from its start to its end."""
    tokens = _tokens(text)
    i = 0
    while i < len(tokens):
        kind, sign, _, _ = tokens[i]
        if kind != "sign" or sign not in ("=", ":", ":=", "=>") or not i:
            i += 1
            continue
        target = _target(tokens, i)
        if not target:
            i += 1
            continue
        if sign == ":":
            i = _annotated(tokens, i)
        literal, i = _value(text, tokens, i + 1, constants)
        if literal.spans or literal.parts:
            yield target, literal


def _target(tokens: list, i: int) -> str:
    """The name before the sign at ``i``: a word, a quoted word or the last subscript."""
    kind, word, _, _ = tokens[i - 1]
    if word == "]" and i > 2 and tokens[i - 3][1] == "[":
        kind, word, _, _ = tokens[i - 2]
    target = _inner(word) if kind == "string" else word if kind == "name" else ""
    return target if re.fullmatch(r"[A-Za-z_][\w.-]*", target, re.ASCII) else ""


def _annotated(tokens: list, i: int) -> int:
    """The place of the ``=`` behind a type annotation that begins at ``i``; ``i`` without one."""
    j = i + 1
    while j < len(tokens) and (tokens[j][0] == "name" or tokens[j][1] in _ANNOTATION):
        j += 1
    # The sign is followed by a literal, else what looks like a type is a value.
    if i + 1 < j < len(tokens) and tokens[j][1] == "=":
        k = _literal(tokens, j + 1)
        if k < len(tokens) and tokens[k][0] == "string":
            return j
    return i


def _literal(tokens: list, i: int) -> int:
    """The place of the string that begins at ``i`` or behind line ends and parentheses; else ``i``."""
    j = i
    while j < len(tokens) and (tokens[j][0] == "end" or tokens[j][1] in ("(", "\\")):
        j += 1
    if j + 1 < len(tokens) and tokens[j][1].lower() in _PREFIXES and tokens[j + 1][2] == tokens[j][3]:
        j += tokens[j + 1][0] == "string"
    if j == len(tokens) or tokens[j][0] != "string":
        return i
    # On a line of its own a quoted word with a sign is the next name.
    crossed = any(t[0] == "end" for t in tokens[i:j])
    if crossed and j + 1 < len(tokens) and tokens[j + 1][1] in (":", "=>", "="):
        return i
    return j


def _quote(word: str) -> int:
    return 3 if len(word) > 5 and word[:3] in ('"""', "'''") else 1


def _inner(word: str) -> str:
    return word[_quote(word) : -_quote(word)]


def _value(text, tokens, i, constants):
    """A literal, a known name, or several of them joined by ``+`` or within parentheses."""
    literal = Literal()
    begin, i = i, _literal(tokens, i)
    depth = sum(t[1] == "(" for t in tokens[begin:i])
    while i < len(tokens):
        kind, word, at, end = tokens[i]
        if kind == "string":
            literal.add(_inner(word))
            q = _quote(word)
            if end - at > 2 * q:
                literal.spans.append((at + q, end - q))
            i += 1
        elif kind in ("name", "number", "other"):
            if kind == "name" and word in constants:
                literal.add(constants[word].value)
                literal.parts.append(constants[word])
                i += 1
            else:
                bare = _BARE.match(text, at)
                if not bare or literal.spans or literal.parts:
                    break
                literal.value, literal.spans = bare[0][:SCORED], [(at, bare.end())]
                while i < len(tokens) and tokens[i][2] < bare.end():
                    i += 1
                break
        else:
            break
        # What joins the next part: a plus sign, a continued line or open parentheses.
        j, joined = i, False
        while j < len(tokens):
            word = tokens[j][1]
            if word == "+":
                joined = True
            elif word == "\\" and j + 1 < len(tokens) and tokens[j + 1][0] == "end":
                joined = joined or tokens[j + 2 : j + 3] and tokens[j + 2][0] == "string"
            elif word == "(" and joined:
                depth += 1
            elif tokens[j][0] != "end" or not (depth or joined):
                break
            j += 1
        if j < len(tokens) and (joined or depth and tokens[j][0] == "string"):
            i = j
            continue
        break
    return literal, i


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans, sorted; offsets in code points."""
    text = text or ""
    found = [
        (m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED
    ]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found += [(a, 3, b) for a, b in named_spans(text)]
    return sorted(found)


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_named, base_sha256, spans`` of every row.

    Spans are ``kind:start:end`` by start, then kind, joined by commas. Defined
    cases: a null text counts as empty and has no spans; spans of several kinds
    may overlap and all stay; texts are scanned whole, assignments over line
    ends where a literal goes on or follows, constants along the text; repeated rows stay rows; an empty table gives
    no rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ("n_assign", "n_access", "n_hex", "n_named", "base_sha256", "spans")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = spans_of(text.as_py())
                said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
                base = ",".join(s for s, x in zip(said, found, strict=True) if x[1] < 3)
                n = Counter(x[1] for x in found)
                rows.append(
                    (*(n[k] for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), ",".join(said))
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [
                pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(
        of_batches,
        f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_named bigint, "
        "base_sha256 string, spans string",
    )
