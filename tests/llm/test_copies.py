"""Exact and near duplicates and repeated lines, against brute force."""

import hashlib
import random
import string
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd, rows
from wiretally.llm import language_id, line_dedup, quality, simhash
from wiretally.llm.common import bounded_sample
from wiretally.llm.components import connected_components
from wiretally.llm.exact_dedup import exact_dedup

SF_DIR = "/root/testdata/sf0.01"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_exact_dedup_of_odd_rows(spark):
    docs = odd(spark)
    got = exact_dedup(docs).collect()
    assert len(got) == docs.count()
    groups = defaultdict(list)
    for r in docs.collect():
        text = (r["text"] or "").translate(LOWER)
        groups[hashlib.sha256(text.encode()).hexdigest()].append(r["doc_id"])
    for r in got:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == (max(known) if known else None)
    # Exactly one row of each text stays, also among repeated rows.
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(groups)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_of_hot_texts_beyond_the_broadcast(spark):
    texts = ["hot"] * 300 + [f"pair {i // 2}" for i in range(200)]
    got = exact_dedup(documents(spark, texts), tracked=64, heavy=8).collect()
    assert sum(r["kept"] for r in got) == 101
    assert {r["group_size"] for r in got} == {300, 2}
    assert {r["keep_id"] for r in got if r["group_size"] == 300} == {299}


def _plain_fingerprint(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def _plain_components(pairs, n):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def _expected_components(docs):
    fps = [_plain_fingerprint(t) for _, t in docs]
    near = [
        (i, j)
        for i in range(len(docs))
        for j in range(i)
        if (fps[i] ^ fps[j]).bit_count() <= 2
    ]
    roots = _plain_components(near, len(docs))
    least = {}
    for (doc_id, _), r in zip(docs, roots, strict=True):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return sorted(
        ((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(docs, fps, roots, strict=True)),
        key=repr,
    )


def test_simhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(simhash.simhash_components(docs)) == _expected_components(pairs)


def test_simhash_of_odd_rows(spark):
    docs = odd(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(simhash.simhash_components(docs)) == _expected_components(pairs)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_near_words_against_all_pairs():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    fps = np.repeat(base, 20)
    for _ in range(2):
        fps ^= np.uint64(1) << draw.integers(0, 64, len(fps)).astype(np.uint64)
    groups = np.sort(draw.integers(0, 5, len(fps)))
    want = {
        (i, j)
        for i in range(len(fps))
        for j in range(i + 1, len(fps))
        if groups[i] == groups[j] and int(fps[i] ^ fps[j]).bit_count() <= 2
    }
    got = {tuple(p) for p in simhash.near_words(fps, groups).tolist()}
    assert got == want


@pytest.mark.parametrize("chunk", [2, 7, 4096])
def test_large_buckets_are_compared_in_chunks(spark, chunk):
    draw = random.Random(2)
    fps = {draw.getrandbits(20) for _ in range(150)}
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), chunk)
    order = sorted(fps)
    at = {f: i for i, f in enumerate(order)}
    near = [(i, j) for i, a in enumerate(order) for j, b in enumerate(order[:i]) if (a ^ b).bit_count() <= 2]
    got = [(at[r["u"]], at[r["v"]]) for r in links.collect()]
    assert set(got) <= set(near) | {(b, a) for a, b in near} or all(
        _plain_components(near, len(order))[a] == _plain_components(near, len(order))[b] for a, b in got
    )
    assert _plain_components(got, len(order)) == _plain_components(near, len(order))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    links = spark.createDataFrame(chain + star + [(7, 7)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert connected_components(links.limit(0)).count() == 0


def test_one_of_each_group_of_near_copies_stays(spark):
    docs = odd(spark)
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    # Empty texts are one group, whose smallest number is 1; of a repeated row one stays.
    assert rows(got, "doc_id") == [(1,), (4,), (5,), (None,)]
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_near_copies_of_a_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted({r for _, _, r in _expected_components(pairs)})
    got = simhash.drop_near_copies(docs)
    assert sorted(r["doc_id"] for r in got.collect()) == want and len(want) < len(pairs)
    assert got.columns == docs.columns


def _plain_line_dedup(docs, min_words):
    """Delete by all pairs of runs; documents in order of their number, null last."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    places = []
    for d in order:
        lines = [(n, x) for n, x in enumerate((docs[d][1] or "").split("\n")) if x.split()]
        places.append([(d, n, x) for n, x in lines])
    first, deleted = {}, defaultdict(set)
    for of_doc in places:
        for i in range(len(of_doc)):
            for j in range(i, len(of_doc)):
                run = tuple(x for _, _, x in of_doc[i : j + 1])
                if sum(len(x.split()) for x in run) < min_words:
                    continue
                at = (of_doc[i][0], i)
                if first.setdefault(run, at) != at:
                    deleted[of_doc[i][0]].update(n for _, n, _ in of_doc[i : j + 1])
    out = []
    for d, (doc_id, text) in enumerate(docs):
        if deleted[d]:
            text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in deleted[d])
        out.append((doc_id, text, len(deleted[d])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_runs_against_all_runs(spark, seed):
    draw = random.Random(seed)
    stock = [" ".join(draw.choice("abcdef") for _ in range(draw.randint(1, 5))) for _ in range(8)]
    texts = []
    for i in range(60):
        lines = [draw.choice([*stock, f"own {i} {k}", ""]) for k in range(draw.randint(0, 14))]
        if texts and draw.random() < 0.5:
            lines += draw.choice(texts).split("\n")
        texts.append("\n".join(lines))
    docs = list(enumerate(texts))
    got = line_dedup.drop_repeated_runs(documents(spark, docs), min_words=9)
    assert rows(got, "doc_id", "text", "lines_deleted") == _plain_line_dedup(docs, 9)


def test_repeated_runs_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = line_dedup.drop_repeated_runs(docs)
    assert rows(got, "doc_id", "text", "lines_deleted") == _plain_line_dedup(pairs, 50)
    assert got.where("lines_deleted > 0 and n_chars <> length(text)").count() == 0


def test_repeated_runs_of_odd_rows(spark):
    docs = odd(spark)
    got = line_dedup.drop_repeated_runs(docs)
    assert got.columns == [*docs.columns, "lines_deleted"]
    assert rows(got.drop("lines_deleted")) == rows(docs)
    many = documents(spark, [(9, "w " * 60), (9, "w " * 60), (None, "w " * 60), (3, None)])
    assert rows(line_dedup.drop_repeated_runs(many), "doc_id", "text", "lines_deleted") == [
        (3, None, 0),
        (9, "w " * 60, 0),
        (9, "w " * 60, 0),
        (None, "", 1),
    ]
    assert line_dedup.drop_repeated_runs(docs.limit(0)).count() == 0


def test_repeated_runs_read_staged_tables_only(spark):
    docs = documents(spark, ["a b c\nd e f\n" * 4] * 3)
    got = line_dedup.drop_repeated_runs(docs, min_words=3)
    first = [r["text"] for r in got.orderBy("doc_id").collect()]
    # Only the first of the repeated lines stays; the empty end is no line with a word.
    assert first == ["a b c\nd e f\n", "", ""]
    assert got.agg(F.sum("lines_deleted")).head()[0] == 22


def test_hot_intervals_and_copies_that_overlap(spark):
    # One line in a third of all lines, frequent runs and rare ones, and 60 equal lines.
    hot, pair = "word " * 30 + "end", "one two three " * 9
    texts = ["\n".join([hot, pair, hot, f"own {i} " * 3, hot, hot]) for i in range(40)]
    docs = list(enumerate([*texts, "\n".join(["w"] * 60), "x\n" + "\n".join(["w"] * 49), "w " * 55]))
    got = rows(line_dedup.drop_repeated_runs(documents(spark, docs)), "doc_id", "text", "lines_deleted")
    assert got == _plain_line_dedup(docs, 50)
    # As the docstring says.
    assert {d: n for d, _, n in got}[40] == 59


def test_long_copies_take_time_linear_in_their_lines(spark):
    def seconds(n):
        text = "\n".join(f"line {i} of a long text" for i in range(n))
        docs = documents(spark, [text, text, "other"]).repartition(3)
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            got = rows(line_dedup.drop_repeated_runs(docs), "doc_id", "lines_deleted")
            best = min(best, time.perf_counter() - start)
            assert got == [(0, 0), (1, n), (2, 0)]
        return best

    seconds(1000)
    assert seconds(40_000) < 4 * seconds(5000) + 10


def test_tail_of_exact_copies_is_aggregated_before_the_shuffle(spark):
    plan = exact_dedup(documents(spark, ["a", "b", "a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan and "partial_count" in plan


def _sampled(spark, column, values, n):
    table = spark.createDataFrame([(v,) for v in values], f"{column} string").repartition(8)
    return [r[0] for r in bounded_sample(table, n, 3, column).collect()]


def test_samples_hold_their_bound_and_hold_values_once(spark):
    values = [f"line {i}" for i in range(20_000)] + ["hot line"] * 40_000
    got = _sampled(spark, "text", values, 4000)
    assert len(got) == len(set(got)) == 4000
    assert sorted(_sampled(spark, "text", values[:300] + ["hot line"] * 900, 4000)) == sorted({*values[:300], "hot line"})
    assert _sampled(spark, "text", ["a"] * 50, 10) == ["a"]


def test_learning_samples_with_repeated_ids_and_many_languages(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "train", lambda rows, good: seen.update(quality=len(rows)))
    monkeypatch.setattr(language_id, "train", lambda rows: seen.update(rows=len(rows), languages={r[0] for r in rows}))
    monkeypatch.setattr(quality, "SAMPLE", 60)
    monkeypatch.setattr(language_id, "SAMPLE", 500)
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    one_id = documents(spark, [(free[0], f"text number {i} {i * i}") for i in range(2000)])
    quality.learn(one_id, spark.createDataFrame([(free[0], 1), (free[1], 0)], "doc_id bigint, quality int"))
    assert 0 < seen["quality"] <= 60
    language_id.learn(one_id)
    assert 0 < seen["rows"] <= 500 and seen["languages"] == {"en"}
    many = one_id.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.concat(F.lit("l"), "text").alias("lang"))
    language_id.learn(many)
    assert 0 < seen["rows"] <= 500 and len(seen["languages"]) <= language_id.LANGUAGES
