"""Personal data by fixed patterns and a semi-Markov conditional random field.

Four patterns give the base spans. The field adds spans in forms that they do not
know: a number without its country sign, an address with its at sign spelled out.
It scores whole candidate segments of a bounded number of tokens by features of
the span as a whole (digits, groups, separators, check digits, what stands before
and after, the word that announces it), and a dynamic program over segment ends
chooses boundaries and kinds jointly. Tokens outside of segments are of kind
``other``.

It is trained by full-batch ascent of the conditional likelihood, marginals by
forward and backward passes over segments, on a bounded sample of the corpus: lines
around numbers and at signs, with base spans as labels, and rewritten copies of
these in which an entity takes one of its other forms or a plain number takes its place.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
# Lines of the learning sample with a base span, and as many without.
SAMPLE = 120
ROUNDS = 40
RATE = 0.2
DECAY = 1e-3
SEED = 42
# Tokens of a segment at most, and of a line of the learning sample.
LONGEST = 20
LINE = 48
# Characters around a number or at sign that are looked at.
REACH = 40
# Tokens whose segments are scored at a time.
STEP = 2048
CUES = 64

# The base patterns.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PART = re.compile(r"[0-9]+")
CARD_DIGITS, PHONE_DIGITS, MOST_OCTET = (14, 19), (10, 15), 255


def luhn(digits: str) -> bool:
    """Whether the last of ``digits`` is their check digit."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches in time linear in the text: the local part is the run before an at sign."""
    floor, at = 0, text.find("@")
    while at >= 0:
        run = text[floor:at]
        local = len(run) - len(run.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each dotted number."""
    for number in _DOTTED.finditer(text):
        if number[0].count(".") < 3:
            continue
        parts = list(_PART.finditer(text, number.start(), number.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= MOST_OCTET for p in four):
                yield four[0].start(), four[3].end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns' matches, sorted."""
    found = [(a, EMAIL, b) for a, b in _emails(text)]
    if _PART.search(text):
        found += [(a, IP, b) for a, b in _addresses(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                found.append((m.start(), CARD, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m[0]) <= PHONE_DIGITS[1]:
                found.append((m.start(), PHONE, m.end()))
    return sorted(found)


# What a segment may be about; the field looks at the neighbourhood only.
_ANCHOR = re.compile(r"[0-9@]+|[(\[]\x20?at\x20?[)\]]", re.IGNORECASE)


def neighbourhoods(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of a line around numbers and at signs, cut at white space where there is any."""
    held: list[int] | None = None
    for m in _ANCHOR.finditer(text):
        a, b = m.start(), m.end()
        if held and a - held[1] <= 2 * REACH and text.find("\n", held[1], a) < 0:
            held[1] = b
            continue
        if held:
            yield _widened(text, *held)
        held = [a, b]
    if held:
        yield _widened(text, *held)


def _widened(text: str, a: int, b: int) -> tuple[int, int]:
    low, high = max(0, a - REACH), min(len(text), b + REACH)
    low = max(low, text.rfind("\n", low, a) + 1)
    line = text.find("\n", b, high)
    high = line if line >= 0 else high
    space = text.find(" ", low, a)
    if low and text[low - 1] not in " \n" and space >= 0:
        low = space + 1
    space = text.rfind(" ", b, high)
    if high < len(text) and text[high] not in " \n" and space >= 0:
        high = space
    return low, high


_TOKEN = re.compile(r"(?P<word>[^\W\d_]+)|(?P<number>[0-9]+)|(?P<space>[^\S\n]+)|(?P<sign>.)", re.DOTALL)
WORD, NUMBER, SPACE, DOT, DASH, OPEN, CLOSE, PLUS, AT, JOIN, OTHER = range(11)
_SIGNS = {".": DOT, "-": DASH, "(": OPEN, "[": OPEN, ")": CLOSE, "]": CLOSE, "+": PLUS, "@": AT, "_": JOIN, "%": JOIN, "/": JOIN}
_GROUPS = {"word": WORD, "number": NUMBER, "space": SPACE}


@dataclass
class Tokens:
    """Tokens of a neighbourhood and sums over them from its start."""

    starts: np.ndarray
    ends: np.ndarray
    kinds: np.ndarray
    #: Column c has how many tokens before each place have property c.
    sums: np.ndarray
    #: Sums of digits, those at even or odd places doubled.
    checks: np.ndarray
    cues: np.ndarray


# Columns of ``sums``.
(DIGITS, GROUPS, WORDS, DOTS, SPACES, DASHES, OPENS, CLOSES, PLUSES, ATS, JOINS, OTHERS, WIDE, BADS, FOURS) = range(15)


def tokens_of(text: str) -> Tokens:
    found = [(_GROUPS.get(m.lastgroup) if m.lastgroup != "sign" else _SIGNS.get(m[0], OTHER), m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    n = len(found)
    each = np.zeros((n, 15), np.int64)
    column = {WORD: WORDS, SPACE: SPACES, DOT: DOTS, DASH: DASHES, OPEN: OPENS, CLOSE: CLOSES, PLUS: PLUSES, AT: ATS, JOIN: JOINS, OTHER: OTHERS}
    checks = np.zeros((n, 2), np.int64)
    cues = np.zeros(n, np.int64)
    digits, cue, since = 0, 0, 0
    for i, (kind, word, _, _) in enumerate(found):
        cues[i] = cue if i - since <= 3 else 0
        if kind == NUMBER:
            each[i, DIGITS], each[i, GROUPS] = len(word), 1
            each[i, BADS] = len(word) > 3 or int(word) > MOST_OCTET
            each[i, FOURS] = len(word) == 4
            for d in map(int, word):
                twice = sum(divmod(2 * d, 10))
                checks[i, digits % 2] += twice
                checks[i, 1 - digits % 2] += d
                digits += 1
        else:
            each[i, column[kind]] = 1
            if kind == WORD:
                cue, since = 1 + int.from_bytes(hashlib.md5(word.lower().encode()).digest()[:4]) % (CUES - 1), i
                bracketed = 0 < i < n - 1 and found[i - 1][0] == OPEN and found[i + 1][0] == CLOSE
                if bracketed and word.lower() in ("at", "dot"):
                    # Spelled out, with its brackets no sign of its own.
                    each[i, WORDS], each[i, ATS if word.lower() == "at" else DOTS] = 0, 1
            elif kind == SPACE:
                each[i, WIDE] = len(word) > 1
    zero = np.zeros((1, 15), np.int64)
    return Tokens(
        np.array([x[2] for x in found], np.int64),
        np.array([x[3] for x in found], np.int64),
        np.array([x[0] for x in found], np.int64),
        np.r_[zero, np.cumsum(each, axis=0)],
        np.r_[zero[:, :2], np.cumsum(checks, axis=0)],
        cues,
    )


def candidates(t: Tokens, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last token of each candidate that begins in ``low`` to ``high``.

    It has a number or an at sign, words only beside an at sign, begins and ends
    as entities do, and holds nothing that none of them holds.
    """
    n = len(t.kinds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = low + np.flatnonzero(np.isin(t.kinds[low:high], (WORD, NUMBER, PLUS, OPEN)))
    a = np.repeat(begins, LONGEST)
    b = a + np.tile(np.arange(1, LONGEST + 1), len(begins))
    inside = b <= n
    a, b = a[inside], b[inside]
    held = t.sums[b] - t.sums[a]
    ok = (
        np.isin(t.kinds[b - 1], (WORD, NUMBER))
        & (held[:, OTHERS] + held[:, WIDE] == 0)
        & (held[:, DIGITS] + held[:, ATS] > 0)
        & ((held[:, WORDS] == 0) | (held[:, ATS] == 1))
        & (held[:, OPENS] == held[:, CLOSES])
    )
    return a[ok], b[ok]


# Sizes of the templates, each a whole-span feature with so many values.
_SIZES = (1, 10, 6, 3, 6, 6, 4, 3, 3, 8, 4, 4, 12, 12, 3, 3, 2, 3, CUES, 4, 2, 2)
_OFFSETS = np.r_[0, np.cumsum(_SIZES)]
FEATURES = int(_OFFSETS[-1])


def features(t: Tokens, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each segment the numbers of its features, one of each template."""
    held = t.sums[b] - t.sums[a]
    digits, groups = held[:, DIGITS], held[:, GROUPS]
    # Kinds with the line's ends, which are of a kind of their own.
    ends = np.full(3, OTHER + 1)
    kinds = np.r_[t.kinds, ends]

    def glued(sign: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Whether a sign next to the segment joins it to a word or number."""
        return np.isin(kinds[sign], (DOT, DASH, JOIN, PLUS)) & np.isin(kinds[beyond], (WORD, NUMBER))

    before, after = kinds[a - 1], kinds[b]
    # The last digit is not doubled, those at every other place before it are.
    last = t.sums[b, DIGITS] - 1
    column = (last + 1) % 2
    check = t.checks[b, column] - t.checks[a, column]
    plain = held[:, WORDS] + held[:, ATS] + held[:, JOINS] == 0
    carded = plain & (digits >= 13) & (digits <= 19)
    octets = plain & (groups == 4) & (held[:, DOTS] == 3) & (held[:, DIGITS] <= 12)
    domain = (held[:, ATS] == 1) & (t.kinds[b - 1] == WORD) & (held[:, DOTS] > 0)
    values = (
        np.zeros(len(a), np.int64),
        np.searchsorted([1, 4, 7, 10, 11, 13, 14, 17, 20], digits, side="right"),
        np.minimum(groups, 5),
        np.minimum(held[:, ATS], 2),
        np.minimum(held[:, DOTS], 5),
        np.minimum(held[:, SPACES], 5),
        np.minimum(held[:, DASHES], 3),
        np.minimum(held[:, OPENS], 2),
        np.where(t.kinds[a] == PLUS, 1, np.where(held[:, PLUSES] > 0, 2, 0)),
        np.minimum(held[:, WORDS], 7),
        np.minimum(held[:, JOINS], 3),
        np.select([t.kinds[a] == WORD, t.kinds[a] == NUMBER, t.kinds[a] == PLUS], [0, 1, 2], 3),
        before,
        after,
        np.where(carded, np.where(check % 10 == 0, 2, 1), 0),
        np.where(octets, np.where(held[:, BADS] == 0, 2, 1), 0),
        domain.astype(np.int64),
        np.where(t.kinds[b - 1] == WORD, 0, 1) + (held[:, FOURS] > 0),
        t.cues[a],
        np.minimum(held[:, FOURS], 3),
        glued(a - 1, a - 2),
        glued(b, b + 1),
    )
    return np.stack(values, axis=1) + _OFFSETS[:-1]


@dataclass
class Model:
    #: Weight of each kind and feature.
    weights: np.ndarray
    #: Weight of a segment of a kind (last: other) before one of another.
    steps: np.ndarray


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    most = np.where(np.isfinite(most), most, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


def train(lines: list[tuple[Tokens, list[tuple[int, int, int]]]]) -> Model:
    """Weights that make the labelled segments likely; a segment is (first, kind, one past the last)."""
    m, k, size = len(KINDS), len(KINDS) + 1, len(lines)
    owners, firsts, widths, coded, gold = [], [], [], [], []
    seen_steps = np.zeros((k, k))
    lengths = np.array([len(t.kinds) for t, _ in lines])
    for i, (t, segments) in enumerate(lines):
        a, b = candidates(t, 0, len(t.kinds))
        owners.append(np.full(len(a), i))
        firsts.append(a)
        widths.append(b - a)
        coded.append(features(t, a, b))
        label = np.full(len(a), -1)
        for s, kind, e in segments:
            label[(a == s) & (b == e)] = kind
        gold.append(label)
        at, last = 0, m
        for s, kind, e in sorted(segments):
            for _ in range(at, s):
                seen_steps[last, m] += 1
                last = m
            seen_steps[last, kind] += 1
            at, last = e, kind
        for _ in range(at, len(t.kinds)):
            seen_steps[last, m] += 1
            last = m
    owner, first, width, label = map(np.concatenate, (owners, firsts, widths, gold))
    codes = np.concatenate(coded)
    n = int(lengths.max(initial=0))
    model = Model(np.zeros((m, FEATURES)), np.zeros((k, k)))
    known = np.stack([np.bincount(codes[label == y].ravel(), minlength=FEATURES) for y in range(m)]).astype(float)
    squares = [np.full_like(model.weights, 1e-6), np.full_like(model.steps, 1e-6)]
    rows = np.arange(size)
    back = np.arange(1, LONGEST + 1)
    for _ in range(ROUNDS):
        score = model.weights[:, codes].sum(axis=2).T
        scores = np.full((n + LONGEST + 1, LONGEST, size, m), -np.inf)
        scores[first, width - 1, owner] = score
        # Forward: the likelihood of all segmentations up to a place that end with a kind.
        ahead = np.full((n + 1, size, k), -np.inf)
        ahead[0, :, m] = 0
        into = np.full((n + 1 + LONGEST, size, k), -np.inf)
        for at in range(n + 1):
            if at:
                span = back[back <= at]
                ahead[at, :, :m] = _log_sum(into[at - span, :, :m] + scores[at - span, span - 1], 0)
                ahead[at, :, m] = into[at - 1, :, m]
            into[at] = _log_sum(ahead[at][:, :, None] + model.steps[None], 1)
        total = _log_sum(ahead[lengths, rows], 1)
        # Backward: the likelihood of the rest after a segment of a kind that ends there.
        behind = np.full((n + LONGEST + 1, size, k), -np.inf)
        expected_steps = np.zeros((k, k))
        expected = np.zeros((len(owner), m))
        for at in range(n, -1, -1):
            after = np.full((size, k), -np.inf)
            after[:, :m] = _log_sum(scores[at] + behind[at + back][:, :, :m], 0)
            after[:, m] = behind[at + 1, :, m] if at < n else -np.inf
            going = _log_sum(model.steps[None] + after[:, None, :], 2)
            behind[at] = np.where((lengths == at)[:, None], 0.0, np.where((lengths > at)[:, None], going, -np.inf))
            live = lengths > at
            with np.errstate(invalid="ignore"):
                joint = ahead[at][:, :, None] + model.steps[None] + after[:, None, :] - total[:, None, None]
            expected_steps += np.where(np.isfinite(joint), np.exp(joint), 0)[live].sum(axis=0)
        reach = into[first, owner, :m] + score + behind[first + width, owner, :m] - total[owner][:, None]
        expected = np.exp(np.minimum(reach, 0))
        slope = known - np.stack([np.bincount(codes.ravel(), np.repeat(expected[:, y], codes.shape[1]), FEATURES) for y in range(m)])
        for value, gradient, square in (
            (model.weights, slope - DECAY * size * model.weights, squares[0]),
            (model.steps, seen_steps - expected_steps - DECAY * size * model.steps, squares[1]),
        ):
            square += gradient**2
            value += RATE * gradient / np.sqrt(square) * 5**0.5
    # A step between others weighs nothing, so that what is far from segments need not be scored.
    model.steps -= model.steps[m, m]
    return model


def decode(t: Tokens, model: Model) -> list[tuple[int, int, int]]:
    """The best segmentation's entities as (first token, kind, one past the last)."""
    n, m = len(t.kinds), len(KINDS)
    steps = model.steps
    # What a segment must weigh at least, whatever is beside it; the others can't be chosen.
    least = np.array([min(steps[y, m] + steps[m, z] - steps[y, k] - steps[k, z] for y in range(m + 1) for z in range(m + 1)) for k in range(m)])
    ending: dict[int, list[tuple[int, int, float]]] = {}
    for low in range(0, n, STEP):
        a, b = candidates(t, low, min(n, low + STEP))
        if not len(a):
            continue
        score = model.weights[:, features(t, a, b)].sum(axis=2).T
        for row, kind in zip(*np.nonzero(score > least - 1e-9), strict=True):
            ending.setdefault(int(b[row]), []).append((int(a[row]), int(kind), float(score[row, kind])))
    if not ending:
        return []
    best = np.full((n + 1, m + 1), -np.inf)
    best[0, m] = 0
    came: dict[tuple[int, int], tuple[int, int]] = {}
    other = np.zeros(n + 1, np.int64)
    for at in range(1, n + 1):
        through = best[at - 1] + steps[:, m]
        other[at] = through.argmax()
        best[at, m] = through[other[at]]
        for a, kind, score in ending.get(at, ()):
            through = best[a] + steps[:, kind]
            value = through.max() + score
            if value > best[at, kind]:
                best[at, kind] = value
                came[at, kind] = a, int(through.argmax())
    out, at, label = [], n, int(best[n].argmax())
    while at:
        if label == m:
            at, label = at - 1, int(other[at])
            continue
        a, before = came[at, label]
        out.append((a, label, at))
        at, label = a, before
    return out[::-1]


# Other forms of an entity, and words that announce it.
_CUES = {
    EMAIL: ("mail", "email", "contact", "write to"),
    IP: ("host", "address", "ip", "server"),
    CARD: ("card", "card number", "paid with", "visa"),
    PHONE: ("phone", "call", "tel", "mobile"),
}
_PLAIN_CUES = ("order", "id", "on", "version", "page", "about", "no")


_NAME = re.compile(r"[A-Za-z]+|[0-9]+")


def _other_form(draw: random.Random, kind: int, text: str) -> str:
    digits = "".join(c for c in text if c.isdigit())
    if kind == EMAIL:
        left, _, right = text.partition("@")
        names = _NAME.findall(text)
        left = draw.choice((left, names[0], f"{names[0]}.{names[-2]}", f"{names[0]}_{names[-2]}{digits[:2]}"))
        right = draw.choice((right, right.partition(".")[2], f"{names[0]}.{names[-1]}"))
        right = right if "." in right else text.partition("@")[2]
        at, dot = draw.choice(((" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" @ ", ".")))
        return left + at + right.replace(".", dot)
    if kind == IP:
        return text.replace(".", draw.choice(("[.]", "(.)", " . ")))
    if kind == CARD:
        return draw.choice((".", "/", " . ")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    national = digits[-10:] if len(digits) >= 10 else digits
    a, b, c = national[:-7], national[-7:-4], national[-4:]
    return draw.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b}-{c}"))


def _plain_number(draw: random.Random) -> str:
    def number(low, high):
        return str(draw.randint(low, high))

    return draw.choice(
        (
            f"{number(1900, 2090)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}",
            f"{draw.randint(0, 23):02d}:{draw.randint(0, 59):02d}",
            f"{number(0, 20)}.{number(0, 40)}.{number(0, 99)}",
            f"{number(0, 9999)}.{draw.randint(0, 99):02d}",
            number(0, 99_999),
            number(10**8, 10**17),
            f"{number(1, 400)}-{number(401, 900)}",
            f"{number(1, 999)} {draw.randint(0, 999):03d}",
            f"{number(256, 999)}.{number(0, 255)}.{number(256, 999)}.{number(0, 255)}",
        )
    )


def rewritten(draw: random.Random, line: str, spans: list[tuple[int, int, int]], plain: bool):
    """``line`` with each entity in another form after a word that announces it, or a plain number there."""
    out, found, at = "", [], 0
    for a, kind, b in spans:
        if a < at:
            continue
        out += line[at:a]
        cue = draw.choice(_PLAIN_CUES if plain else _CUES[kind])
        # Cards and spelled-out addresses need no announcing.
        if plain or kind in (PHONE, IP) or draw.random() < 0.5:
            out += cue + draw.choice((" ", ": "))
        form = _plain_number(draw) if plain else _other_form(draw, kind, line[a:b])
        if not plain:
            found.append((len(out), kind, len(out) + len(form)))
        out += form
        at = b
    return out + line[at:], found


def _labelled(line: str, spans: list[tuple[int, int, int]]):
    """Tokens with their segments; None where a span does not end with tokens or the line is too long."""
    t = tokens_of(line)
    if not 0 < len(t.kinds) <= LINE:
        return None
    first = {int(s): i for i, s in enumerate(t.starts)}
    past = {int(e): i + 1 for i, e in enumerate(t.ends)}
    segments, upto = [], 0
    a, b = candidates(t, 0, len(t.kinds))
    possible = set(zip(a.tolist(), b.tolist(), strict=True))
    for s, kind, e in spans:
        if s not in first or e not in past or first[s] < upto or (first[s], past[e]) not in possible:
            return None
        segments.append((first[s], kind, past[e]))
        upto = past[e]
    return t, segments


def learn(docs: DataFrame) -> Model | None:
    """Train on the corpus; None where no line has a base span.

    The sample is the first ``SAMPLE`` different neighbourhoods with a base span,
    and as many without one, by a hash of their text. Tasks send on no more than
    that each, and the driver takes no more.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, tuple[str, str]]] = [{}, {}]
        for batch in batches:
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = None
                for low, high in neighbourhoods(text):
                    spans = base_spans(text) if spans is None else spans
                    inside = [(a - low, k, b - low) for a, k, b in spans if low <= a and b <= high]
                    line = text[low:high]
                    key = hashlib.md5(f"{SEED}:{line}".encode("utf-8", "surrogatepass")).hexdigest()
                    held[bool(inside)][key] = line, ",".join(f"{a}:{k}:{b}" for a, k, b in inside)
                for i, lines in enumerate(held):
                    if len(lines) > 4 * SAMPLE:
                        held[i] = {key: lines[key] for key in heapq.nsmallest(SAMPLE, lines)}
        rows = [
            (bool(i), key, *lines[key]) for i, lines in enumerate(held) for key in heapq.nsmallest(SAMPLE, lines)
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["found", "key", "line", "spans"])

    # Long neighbourhoods are no use for learning and are not sent.
    sent = (
        docs.select("text")
        .mapInArrow(of_batches, "found boolean, key string, line string, spans string")
        .where(f"length(line) <= {8 * LINE}")
        .distinct()
    )
    rows = [r for f in (True, False) for r in sent.where("found" if f else "not found").orderBy("key").limit(SAMPLE).collect()]
    draw = random.Random(SEED)
    lines = []
    for row in rows:
        spans = [tuple(map(int, s.split(":"))) for s in row["spans"].split(",") if s]
        lines.append(_labelled(row["line"], spans))
        if spans:
            lines.append(_labelled(*rewritten(draw, row["line"], spans, plain=False)))
            lines.append(_labelled(*rewritten(draw, row["line"], spans, plain=True)))
    lines = [x for x in lines if x]
    return train(lines) if any(segments for _, segments in lines) else None


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the field's entities that share no character with a base span."""
    if model is None:
        return []
    out, near = [], 0
    for low, high in neighbourhoods(text):
        t = tokens_of(text[low:high])
        for first, kind, past in decode(t, model):
            a, b = low + int(t.starts[first]), low + int(t.ends[past - 1])
            while near < len(base) and base[near][0] < a and base[near][2] <= a:
                near += 1
            if not any(s < b and a < e for s, _, e in base[near : near + 8]):
                out.append((a, kind, b))
    return out


def personal_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row.

    The four numbers and the digest are of the base spans; ``spans`` has those that
    the field adds too, as ``kind:start:end`` by start, then kind. Defined cases: a null
    text counts as empty and has no spans; base spans of several kinds may
    overlap and all stay, an added one that overlaps one of them is left out; texts are
    scanned whole; without a base span in the table nothing is learned or added;
    repeated rows stay rows; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
    model = learn(docs)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                added = added_spans(text, base, model)
                n = Counter(k for _, k, _ in base)
                said, every = (
                    ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans) for spans in (base, sorted(base + added))
                )
                rows.append((*(n[k] for k in range(4)), hashlib.sha256(said.encode()).hexdigest(), every, len(added)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(
        of_batches,
        f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "base_sha256 string, spans string, n_added bigint",
    )
