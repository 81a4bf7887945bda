"""Personal data, periodic runs and centroid clusters against brute force."""

import hashlib
import random
import re
from binascii import crc32

import numpy as np
import pytest

from tests.llm.helpers import documents, odd, rows
from wiretally.llm import centroids, periodic_runs, personal_data
from wiretally.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _plain_personal(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_patterns_of_random_texts():
    draw = random.Random(2)
    parts = ["1", "23", "0", "255", "256", ".", "..", "-", " ", "+", "(", ")", "@", "a", "b.c", "_", "\n", "4111 1111", "é"]
    for _ in range(20_000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 24)))
        assert personal_data.base_spans(text) == _plain_personal(text), text
    # Linear in the text, whatever it holds.
    for hostile in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000):
        personal_data.base_spans(hostile)


def test_personal_data_of_a_table_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    docs = docs.union(odd(spark).select("doc_id", "text"))
    got = personal_data.personal_spans(docs)
    want = []
    for doc_id, text in docs.collect():
        base = _plain_personal(text or "")
        said = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in base)
        n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
        want.append((doc_id, *n, hashlib.sha256(said.encode()).hexdigest()))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    # Every base span stays beside the added ones, in order.
    texts = dict(docs.where("doc_id is not null").distinct().collect())
    for row in got.where("doc_id is not null").collect():
        said = [s.split(":") for s in row["spans"].split(",") if s]
        places = [(int(a), personal_data.KINDS.index(k), int(b)) for k, a, b in said]
        assert places == sorted(places)
        assert set(_plain_personal(texts[row["doc_id"]] or "")) <= set(places)
    assert personal_data.personal_spans(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def field(spark):
    return personal_data.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize(
    "text, found",
    [
        ("call (030) 555-1234 now", ["phone (030) 555-1234"]),
        ("phone: 212.555.0199 or so", ["phone 212.555.0199"]),
        ("write to jane.doe (at) example.org today", ["email jane.doe (at) example.org"]),
        ("card: 4026.0839.7753.1332 please", ["card 4026.0839.7753.1332"]),
        ("ip 10[.]0[.]0[.]7 is down", ["ip 10[.]0[.]0[.]7"]),
        # Two valid numbers that the pattern takes for one invalid number.
        ("the 2353820953013749 4550997810720808 of them", ["card 4550997810720808"]),
        ("on 2024-01-05 at 12:30 in version 3.11.4 of order 20240105", []),
        ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and so on', []),
        ("plain words only", []),
    ],
)
def test_added_spans(field, text, found):
    base = personal_data.base_spans(text)
    got = personal_data.added_spans(text, base, field)
    assert [f"{personal_data.KINDS[k]} {text[a:b]}" for a, k, b in got] == found


def test_field_on_held_out_forms(spark, field):
    draw, right, n = random.Random(9), 0, 0
    for (text,) in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect():
        base = personal_data.base_spans(text)
        for low, high in personal_data.neighbourhoods(text):
            inside = [(a - low, k, b - low) for a, k, b in base if low <= a and b <= high]
            for plain in (False, True) if inside else ():
                line, spans = personal_data.rewritten(draw, text[low:high], inside, plain)
                labelled = personal_data._labelled(line, spans)
                if labelled:
                    n += 1
                    right += personal_data.decode(labelled[0], field) == labelled[1]
    assert n > 20 and right >= 0.95 * n


def test_best_segmentation_against_all(field):
    tokens = personal_data.tokens_of("tel 030 555-1234 at a@b.com 10.0.0.1")
    a, b = personal_data.candidates(tokens, 0, len(tokens.kinds))
    scores = field.weights[:, personal_data.features(tokens, a, b)].sum(axis=2).T
    segments = [(int(s), int(e), k, scores[i, k]) for i, (s, e) in enumerate(zip(a, b, strict=True)) for k in range(4)]
    n, memory = len(tokens.kinds), {}

    def best(at, last):
        if at == n:
            return 0.0, ()
        if (at, last) not in memory:
            value, rest = best(at + 1, 4)
            options = [(value + field.steps[last, 4], rest)]
            for s, e, k, score in segments:
                if s == at:
                    value, rest = best(e, k)
                    options.append((value + field.steps[last, k] + score, ((s, k, e), *rest)))
            memory[at, last] = max(options)
        return memory[at, last]

    assert personal_data.decode(tokens, field) == list(best(0, 4)[1])


def _plain_lyndon(word):
    out = []
    for i in range(len(word)):
        j = i + 1
        while j < len(word) and word[j:] > word[i:]:
            j += 1
        out.append(j - i)
    return out


def _plain_runs(word, exponent=4, least=6):
    out, n = [], len(word)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if word[i] != word[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and word[j] == word[j + q]:
                j += 1
            size = j - i + q
            smaller = any(all(word[k] == word[k + d] for k in range(i, i + size - d)) for d in range(1, q))
            if size >= max(least, exponent * q) and not smaller:
                out.append((i, size, q))
            i = j
    return sorted(out)


def _random_words(draw):
    n, k = draw.randint(1, 60), draw.randint(1, 4)
    word = [draw.randrange(k) for _ in range(n)]
    for _ in range(draw.randint(0, 2)):
        a = draw.randrange(n)
        p, end = 1 + draw.randrange(max(1, (n - a) // 3)), draw.randint(a, n)
        for i in range(a, end):
            word[i] = word[a + (i - a) % p]
    return word


@pytest.mark.parametrize("seed", range(3))
def test_lyndon_arrays_and_runs_against_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(600):
        word = _random_words(draw)
        letters = np.array(word, np.int64)
        assert periodic_runs.lyndon_array(letters).tolist() == _plain_lyndon(word)
        assert periodic_runs.lyndon_array(-letters).tolist() == _plain_lyndon([-x for x in word])
        for exponent, least in ((2, 2), (3, 3), (4, 6)):
            want = _plain_runs(word, exponent, least)
            assert periodic_runs.runs_of(letters, exponent, least) == want
            found = []
            for a, b in periodic_runs.stretches(letters, np.zeros(len(word), np.int64), exponent, least):
                found += [(s + a, n, q) for s, n, q in periodic_runs.runs_of(letters[a:b], exponent, least)]
            assert sorted(found) == want


def _plain_row(doc_id, text):
    words = (text or "").encode().split()
    number = "" if doc_id is None else str(doc_id)
    h, n = crc32(number.encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = _plain_runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    longest = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    start, length, period = longest
    return (
        doc_id, len(found), start, length, period, 1000 * length // period if found else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def test_periodic_runs_of_documents(spark):
    draw = random.Random(4)
    texts = [" ".join(f"w{x}" for x in _random_words(draw)) for _ in range(300)]
    texts += ["", " \n", "a " * 50, "Über über Über über Über über Über über", "x\x1cy x\x1cy " * 9]
    docs = documents(spark, texts).select("doc_id", "text").union(odd(spark).where("doc_id <> 4 or doc_id is null").select("doc_id", "text"))
    want = sorted((_plain_row(*r) for r in docs.collect()), key=repr)
    assert rows(periodic_runs.periodic_runs(docs, take=periodic_runs.rearranged)) == want
    assert any(r[1] for r in want)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_runs_of_a_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    short = docs.where("n_chars < 1200").select("doc_id", "text")
    want = sorted((_plain_row(*r) for r in short.collect()), key=repr)
    ids = {r[0] for r in want}
    got = [r for r in rows(QUERIES["op13_periodic_runs"](spark, SF_DIR)) if r[0] in ids]
    assert got == want
    long = periodic_runs.periodic_runs(odd(spark).where("doc_id = 4")).head()
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 60_000, 1)


def _plain_clusters(vectors, k=16, rounds=3):
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centers))

    for _ in range(rounds):
        members = [[] for _ in centers]
        for _, v in vectors:
            members[nearest(v)[1]].append(v)
        centers = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centers, strict=True)]
    placed = [(i, *nearest(v)[::-1]) for i, v in vectors]
    of = [sum(d for _, c, d in placed if c == n) for n in range(len(centers))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, of[c], sum(of), digests[c]) for i, c, d in placed), key=repr)


@pytest.mark.parametrize("n", [3, 16, 150])
def test_clusters_of_odd_vectors(spark, n):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(n)
    data = [(i, [float(x) for x in draw.normal(0, 0.05, 64)]) for i in range(n)]
    data += [(5, [0.25] * 64), (5, [0.25] * 64), (None, [0.5] * 64)]
    usable = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in data]
    data += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [nan] * 64), (906, [inf] + [0.0] * 63)]
    table = spark.createDataFrame([(*r, "x") for r in data], "vec_id bigint, embedding array<double>, cluster string")
    assert rows(centroids.centroid_clusters(table)) == _plain_clusters(usable)
    assert centroids.centroid_clusters(table.limit(0)).count() == 0


def test_walks_find_the_nearest_and_skip_most():
    draw = np.random.default_rng(1)
    centers = draw.integers(-40, 40, (60, 8)) * 20
    vectors = centers[draw.integers(0, 60, 4000)] + draw.integers(-9, 9, (4000, 8))
    centers[7] = centers[3]
    at, distance, tested = centroids.nearest(vectors, centers)
    all_distances = ((vectors[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (at == all_distances.argmin(axis=1)).all() and (distance == all_distances.min(axis=1)).all()
    assert tested < all_distances.size / 2
    # All as far as all others: ties go to the smallest number.
    assert centroids.nearest(np.zeros((2, 3), np.int64), np.eye(3, dtype=np.int64))[0].tolist() == [0, 0]
