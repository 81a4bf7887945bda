"""Tokenization, classifiers, scans, mixing, search and the pipeline on small tables."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import documents, odd, rows
from wiretally.llm import bpe, language_id, license_scan, mixing, quality, secret_scan, topk
from wiretally.llm.queries import QUERIES, VOCABULARY

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def _digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return (
        len(ids),
        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def test_tokens_match_the_library(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op2_bpe"](spark, SF_DIR).collect()}
    want = {r["doc_id"]: _digests(library, r["text"]) for r in docs.collect()}
    assert got == want


def test_tokens_of_odd_rows_and_strings(spark, library):
    draw = random.Random(3)
    parts = ["a", "aa", " ", "  ", "\n", "\r\n", "the", "<|endoftext|>", "<|endof", "'s", "1", "²", "é", "日本", "😀", "\x1c", "\x85", "zz"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(300)] + ["aaaa" * 50]
    docs = odd(spark).select("doc_id", "text").union(documents(spark, texts).select("doc_id", "text"))
    got = rows(bpe.token_digests(docs, VOCABULARY))
    assert got == sorted(((r[0], *_digests(library, r[1])) for r in docs.collect()), key=repr)
    assert bpe.token_digests(docs.limit(0), VOCABULARY).count() == 0


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = language_id.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).head()
    assert right >= 0.99 * n > 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_languages_of_odd_rows(spark):
    # Of these only number 7 is outside the held-out fold.
    docs = odd(spark).select("doc_id", "text", "lang").union(
        documents(spark, [(7, "some words")]).select("doc_id", "text", "lang")
    )
    got = {(r["doc_id"], r["lang_pred"] == "und") for r in language_id.language_id(docs).collect()}
    assert {(1, True), (2, True), (3, True), (4, False)} <= got
    assert language_id.language_id(docs.limit(0)).count() == 0


def test_quality_of_held_out_texts(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = QUERIES["op7_quality"](spark, SF_DIR)
    assert got.count() == 1000
    held = got.where("held_out").join(labels, "doc_id")
    right, n = held.agg(F.count_if(F.col("quality") == F.col("predicted")), F.count("*")).head()
    assert right >= 0.95 * n > 0


def test_quality_of_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(5, 1), (4, 0), (2, 0), (None, 1)], "doc_id bigint, quality int")
    got = quality.quality_scores(docs, labels)
    assert got.count() == docs.count() and got.where("score between 0 and 1").count() == docs.count()
    assert quality.quality_scores(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def _plain_base(text):
    found = []
    kind = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
    for m in re.finditer(kind, text, re.ASCII):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def test_base_spans_of_a_table_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    docs = docs.union(odd(spark).select("doc_id", "text"))
    got = secret_scan.secret_spans(docs).select("doc_id", "base_sha256")
    want = [(r[0], hashlib.sha256(_plain_base(r[1] or "").encode()).hexdigest()) for r in docs.collect()]
    assert rows(got) == sorted(want, key=repr)
    assert secret_scan.secret_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, found",
    [
        ('db_pwd = "kR8#mQ2!vT9z"', ["kR8#mQ2!vT9z"]),
        ('{"client_secret": "Zx81kQm29vLp44"}', ["Zx81kQm29vLp44"]),
        ('BASE = "Zx81kQm29v"\nAUTH_TOKEN = BASE + "Lp44wR7t"', ["Zx81kQm29v", "Lp44wR7t"]),
        ("export API_KEY=Zx81kQm29vLp44", ["Zx81kQm29vLp44"]),
        ('password = "your-password-here"', []),
        ('token_count = "1234567890"', []),
        ("The secret: a plain sentence follows", []),
        ('title = "Zx81kQm29vLp44"', []),
        ('os.environ["DB_PASSWORD"] = "kR8#mQ2!vT9z"', ["kR8#mQ2!vT9z"]),
        ('password: str = "kR8#mQ2!vT9z"', ["kR8#mQ2!vT9z"]),
        ('auth_token: Optional[str] = (\n    "Zx81kQm29v"\n    "Lp44wR7t"\n)', ["Zx81kQm29v", "Lp44wR7t"]),
        ('{"client_secret":\n  "Zx81kQm29vLp44"}', ["Zx81kQm29vLp44"]),
        ('db_pwd = \\\n    "kR8#mQ2!vT9z"', ["kR8#mQ2!vT9z"]),
        ('db_pwd = "kR8#mQ2" + \\\n    "!vT9zLp4"', ["kR8#mQ2", "!vT9zLp4"]),
        ('db_pwd = """kR8#mQ2!vT9z"""', ["kR8#mQ2!vT9z"]),
        ('self.db_pwd = b"kR8#mQ2!vT9z"', ["kR8#mQ2!vT9z"]),
        ('db_pwd = "test9#Kq2!vT9zLp4"', ["test9#Kq2!vT9zLp4"]),
        ('db_pwd = "some-9#Kq2!vT9zLp4"', ["some-9#Kq2!vT9zLp4"]),
        ('db_pwd = "test-password1"', []),
        ("credentials:\n  name: plain\n", []),
        ('secrets:\n  "title": "Zx81kQm29vLp44"\n', []),
    ],
)
def test_named_literals(text, found):
    assert [text[a:b] for a, b in secret_scan.named_spans(text)] == found


@pytest.mark.parametrize(
    "make",
    [
        lambda n: f'db_password = "{"changeme" * n}!"',
        lambda n: 'a = "q"\n' + "a = a + a\n" * n + "db_password = a",
        lambda n: "a = 'kR8#mQ2!vT9z'\n" + "a = a + 'x1'\n" * n + "db_password = a",
        lambda n: "password = " + "\\\\'" * n,
        lambda n: "password = " + "'a\\\\" * n,
        lambda n: 'password = ' + '\\\\"""' * n,
        lambda n: "password = " + "x" * 8 * n,
        lambda n: "token: " + "word " * n,
        lambda n: "token = (" * n,
        lambda n: "token =\n" * n,
    ],
)
def test_named_spans_take_time_linear_in_the_text(make):
    def seconds(n):
        text, best = make(n), float("inf")
        for _ in range(3):
            start = time.perf_counter()
            secret_scan.named_spans(text)
            best = min(best, time.perf_counter() - start)
        return best

    small, large = seconds(2000), seconds(8000)
    assert large < 10 * small + 0.05


def test_constants_joined_over_and_over():
    text = 'a = "kR8#mQ2!"\nb = a + "vT9zQ1x"\n' + "b = b + b\n" * 1000 + "db_pwd = b\n"
    assert [text[x:y] for x, y in secret_scan.named_spans(text)] == ["kR8#mQ2!", "vT9zQ1x"]


_PLAIN_STRING = re.compile(
    r'''"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\'{3}(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'{3}'''
    r'''|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'|`[^`\n]*`'''
)


def test_literals_against_a_plain_lexer():
    draw = random.Random(5)
    for _ in range(20_000):
        text = "".join(draw.choices(['"', "'", "`", "\\", "\n", "a", " ", '"""', "'''", "=", "1"], k=draw.randint(0, 14)))
        want, at = [], 0
        while at < len(text):
            m = _PLAIN_STRING.match(text, at) or secret_scan._LEX.match(text, at)
            if m and text[at] in "\"'`" and m[0] != text[at]:
                want.append(m.span())
            at = m.end() if m else at + 1
        assert [(a, b) for kind, _, a, b in secret_scan._tokens(text) if kind == "string"] == want, text


def _plain_placeholder(value):
    """Whether some way to part ``value`` into words has a standing one; tries all ways."""

    def ways(rest, words):
        if re.fullmatch("[0-9]{0,4}", rest):
            yield words
        for word in secret_scan._STANDING | secret_scan._FILLING:
            if rest.startswith(word):
                yield from ways(rest[len(word) :].lstrip("-_ ."), [*words, word])

    return any(secret_scan._STANDING & set(words) for words in ways(value, []))


def test_placeholders_against_all_ways_to_part_them():
    draw = random.Random(6)
    parts = [*sorted(secret_scan._STANDING), "password", "token", "key", "me", "value", "-", "_", ".", "q", "1", "23"]
    for _ in range(3000):
        value = "".join(draw.choices(parts, k=draw.randint(1, 5))).lstrip("-._") or "q"
        assert secret_scan.is_placeholder(value) == _plain_placeholder(value), value
        assert secret_scan.is_placeholder(value.upper()) == _plain_placeholder(value)
        assert not secret_scan.is_placeholder(value + "#Kq2")


def test_licence_lines(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    want = lines.where(F.lower("line").rlike("licensed? under|mit license|rights reserved"))
    got = license_scan.license_paragraphs(docs)
    assert rows(got, "doc_id", "paragraph") == rows(want, "doc_id", "paragraph")
    named = {r["family"] for r in got.collect()}
    assert named == {"MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "all-rights-reserved"}


def test_licences_of_odd_rows(spark):
    assert license_scan.license_paragraphs(odd(spark)).count() == 0
    assert license_scan.license_paragraphs(odd(spark).limit(0)).count() == 0


def test_wrapped_and_versioned_licences(spark):
    ordinary = [f"plain line {i} about the weather of {i * 7} towns\nand a second one {i}" for i in range(200)]
    gpl = (
        "int a;\n\n// This program is free software: you can redistribute it and/or modify\n"
        "// it under the terms of the GNU General Public License as published by\n"
        "// the Free Software Foundation, either version 3 of the License, or\n"
        "// (at your option) any later version.\n\nint main;"
    )
    bsd = (
        "# Redistribution and use in source and binary forms, with or without\n"
        "# modification, are permitted provided that the following conditions are met:\n"
    )
    said = {
        900: (gpl, [(2, "GPL-3.0")]),
        901: (gpl.replace("version 3", "version 2"), [(2, "GPL-2.0")]),
        902: (gpl.replace("GNU General", "GNU Affero General"), [(2, "AGPL-3.0")]),
        903: (bsd, [(0, "BSD-3-Clause")]),
        904: ("x = 1\n# SPDX-License-Identifier: MIT", [(1, "MIT")]),
        905: ("/* SPDX-License-Identifier: GPL-2.0-or-later OR BSD-2-Clause */", [(0, "BSD-2-Clause"), (0, "GPL-2.0")]),
        906: ("This work is licensed under the GNU General Public License, version 2.", [(0, "GPL-2.0")]),
        907: ("This work is licensed under the GNU General Public License, version 7.", []),
        908: ("Some words.\nReleased under the MIT License.\nReleased under the MIT License.\nMore words.", [(1, "MIT"), (2, "MIT")]),
        909: (
            " * Permission to use, copy, modify, and/or distribute this\n * software for any purpose "
            "with or without fee is hereby\n * granted, provided that",
            [(0, "ISC")],
        ),
    }
    docs = documents(spark, [*ordinary, *((i, t) for i, (t, _) in said.items())])
    want = sorted((i, p, f) for i, (_, finds) in said.items() for p, f in finds)
    assert rows(license_scan.license_paragraphs(docs), "doc_id", "paragraph", "family") == want


@pytest.fixture(scope="module")
def ordinary_lines(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 40")
    plain = lines.where(~F.lower("line").rlike("licen|rights"))
    return [r["line"] for r in plain.orderBy(F.md5("line")).limit(400).collect()]


def test_licences_anywhere_in_a_line(spark, ordinary_lines):
    words = " ".join(f"w{i}" for i in range(70))
    said = {
        900: (f"{words} Released under the MIT License.", [(0, "MIT")]),
        901: (f"{words} Released under the MIT License. {words}\nLicensed under the Apache License, Version 2.0.", [(0, "MIT"), (1, "Apache-2.0")]),
        902: ("The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.", [(0, "MIT")]),
        903: ("x\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", [(2, "MIT")]),
        904: ("This file is licensed under GPL version 3", [(0, "GPL-3.0")]),
        905: ("Apache License\nVersion 2.0, January 2004", [(0, "Apache-2.0")]),
        906: ("We have the permission of the software house and all the copyright rights in it.", []),
        907: ("Released under the MIT License. " * 400, [(0, "MIT")] * 400),
    }
    docs = documents(spark, [*ordinary_lines, *((i, t) for i, (t, _) in said.items())])
    want = sorted((i, p, f) for i, (_, finds) in said.items() for p, f in finds)
    got = license_scan.license_paragraphs(docs).where("doc_id >= 900")
    assert rows(got, "doc_id", "paragraph", "family") == want


def test_licences_are_learned_from_every_window(spark):
    """More texts than a bounded sample would hold, two windows of most, some copies and a licence."""
    texts = [" ".join(f"the{i % 7} software{i} {j}" for j in range(60)) for i in range(3000)]
    docs = documents(spark, [*texts, *texts[:500], None, "", "Released under the MIT License.", "Some rights."])
    known = license_scan._known(spark)
    ordinary = license_scan._ordinary(docs, known)
    assert ordinary.count() == 2 * 3500 + 1
    assert ordinary.select("h").distinct().count() == 2 * 3000 + 1
    # Each different window once as it is and once with a statement, of every family in both halves.
    examples = license_scan._examples(docs, known).cache()
    assert rows(examples.groupBy(F.col("label") > 0).agg(F.sum("n"))) == [(False, 6001.0), (True, 6001.0)]
    assert examples.select("half", "label").distinct().count() == 2 * (1 + len(license_scan.TEMPLATES))


def test_confidence_that_few_windows_exceed():
    # Of 2,000 windows two may be above.
    assert license_scan._level({1: 1990.0, 400: 8.0, 9000: 1.0, 9900: 1.0}) == 0.04
    assert license_scan._level({1: 1990.0, 400: 7.0, 9000: 2.0, 9900: 1.0}) == 0.9
    assert license_scan._level({3: 1.0, 7: 1.0}) == 0.0007


def test_licences_of_held_out_paragraphs(spark, ordinary_lines):
    """Each family's statements with words left out and set into ordinary text; ordinary text alone."""
    draw, texts, want = random.Random(8), list(ordinary_lines[:200]), []
    for family, said in license_scan.TEMPLATES.items():
        for statement in said:
            parts = statement.split()
            # Not a name or number, without which nothing is said of a family.
            spare = [i for i in range(6, len(parts) - 6) if parts[i].islower() and parts[i] != "2.1"]
            if spare:
                del parts[draw.choice(spare)]
            texts.append("\n".join(draw.sample(ordinary_lines[200:], 3)) + "\n" + " ".join(parts) + "\n" + draw.choice(ordinary_lines[200:]))
            want.append((len(texts) - 1, 3, family))
    got = rows(license_scan.license_paragraphs(documents(spark, texts)), "doc_id", "paragraph", "family")
    right = len(set(got) & set(want))
    assert right >= 0.95 * len(want), set(want) - set(got)
    assert len(set(got) - set(want)) <= 0.05 * len(want), set(got) - set(want)
    named = {f for _, _, f in set(got) & set(want)}
    assert named == set(license_scan.TEMPLATES)


def test_mix_of_odd_rows(spark):
    docs = odd(spark)
    counts = mixing.mixing_counts(docs)
    assert counts.count() == docs.count() and counts.where("taken > 2 * size").count() == 0
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    taken = counts.agg(F.sum("taken")).head()[0]
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).head()[0] == taken
    assert rows(mixing.mixing_counts(docs)) == rows(counts)
    assert mixing.mixing_counts(docs.limit(0)).count() == 0


def _plain_top(vectors, k=10):
    out = []
    for q, v in vectors:
        if q is not None and q % 100 == 0:
            scores = [
                (-sum(a * b for a, b in zip(v, w, strict=False)), c is None, c or 0)
                for c, w in vectors
                if c != q
            ]
            for rank, (s, no_id, c) in enumerate(sorted(scores)[:k], 1):
                out.append((q, rank, None if no_id else c, -s))
    return sorted(out, key=repr)


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [float(np.sin(i * j + 1)) for j in range(6)]) for i in range(230)]
    data += [(300, [1.0, 2.0]), (301, []), (302, None), (303, [1.0, None]), (304, [nan, 1.0]), (305, [inf]), (None, [3.0] * 6), (306, [3.0] * 6), (307, [3.0] * 6)]
    table = spark.createDataFrame([(*r, "x") for r in data], "vec_id bigint, embedding array<double>, v string")
    whole = [
        (i, [int(np.floor(1024 * x)) for x in v])
        for i, v in data
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    assert rows(topk.top_inner_products(table)) == _plain_top(whole)
    assert topk.top_inner_products(table.limit(0)).count() == 0


def test_queries_move_to_reachable_lanes_only(spark, monkeypatch):
    draw = np.random.default_rng(6)
    v = draw.normal(0, 1, (2000, 16)) * draw.lognormal(0, 2, (2000, 1))
    whole = [(i, [int(np.floor(1024 * x)) for x in row]) for i, row in enumerate(v)]
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    moved, reaching = [], topk._reaching

    def counted(query_blocks, blocks):
        out = reaching(query_blocks, blocks)
        moved.append((out.count(), query_blocks.count() * blocks.select("lane").distinct().count()))
        return out

    monkeypatch.setattr(topk, "_reaching", counted)
    monkeypatch.setattr(topk, "BLOCK", 64)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = rows(topk.top_inner_products(table))
    finally:
        spark.conf.unset(coalesce)
    assert got == _plain_top(whole)
    few, all_pairs = moved[0]
    assert 0 < few <= all_pairs // 3


def test_pruned_blocks_keep_every_winner():
    draw = np.random.default_rng(4)
    c = np.floor(draw.normal(0, 1024, (3000, 32)) * draw.lognormal(0, 1, (3000, 1)) * np.geomspace(4, 0.1, 32)).astype(np.int64)
    q, ids = c[:40], np.arange(3000)
    rotation = np.linalg.svd((c.T @ c).astype(float))[2].T
    exact = q @ c.T
    exact[np.arange(40), np.arange(40)] = np.iinfo(np.int64).min
    bounds = np.sort(exact, axis=1)[:, -25]
    got = defaultdict(list)
    for r, col, s in zip(*topk.block_top(ids[:40], q, bounds, ids, np.zeros(3000, bool), c, rotation, 10), strict=True):
        got[r].append((-s, col))
    want = {i: sorted((-int(exact[i, j]), j) for j in range(3000))[:10] for i in range(40)}
    assert {r: sorted(v) for r, v in got.items()} == want


def test_pipeline_is_its_stages_in_turn(spark, library, tmp_path):
    # Names that stages use for columns of their own.
    docs = odd(spark).withColumns({"_score": F.lit(0.1), "lines_deleted": F.lit(7)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    got = rows(corpus_pipeline.run(spark, str(tmp_path)))
    assert got == sorted(((r["doc_id"], *_digests(library, r["text"])) for r in step.collect()), key=repr)
