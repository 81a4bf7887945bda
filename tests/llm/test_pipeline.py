"""The whole pipeline against plain decisions, stage by stage in Python, on planted documents."""

import hashlib
import random
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import DOCS, rows
from tests.llm.test_copies import _expected_components, _plain_fingerprint, _plain_line_dedup
from wiretally.llm import quality
from wiretally.llm.queries import VOCABULARY

SF_DIR = "/root/testdata/sf0.001"


def _score(model, text):
    return model.scores([quality.features(text, {})])[0]


def _good(docs, model):
    return [d for d in docs if _score(model, d[1]) >= 0.5]


def _without_runs(docs):
    texts = {doc_id: text for doc_id, text, _ in _plain_line_dedup([d[:2] for d in docs], 50)}
    return [(d[0], texts[d[0]], d[2]) for d in docs]


def _one_of_each(docs):
    stay = {root for _, _, root in _expected_components([d[:2] for d in docs])}
    return [d for d in docs if d[0] in stay]


def _mixed(docs):
    """Each source's share of 150% of all words by water-filling, taken in the order of the keys' hashes."""
    of = defaultdict(list)
    for doc_id, text, source in docs:
        key = hashlib.md5(f"42:{doc_id}".encode()).hexdigest()
        of[source].append((key, len((text or "").encode().split()), (doc_id, text, source)))
    size = {s: sum(n for _, n, _ in d) for s, d in of.items()}
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(size.values())
    while len(target) < len(of):
        # Of the sources not yet settled, those whose share is above their cap.
        unsettled = [s for s in order if s not in target]
        level = left / sum(weight[s] for s in unsettled)
        full = [s for s in unsettled if 2 * size[s] <= weight[s] * level]
        target |= {s: 2 * size[s] for s in full} if full else {s: weight[s] * level for s in unsettled}
        left -= sum(2 * size[s] for s in full)
    out = []
    for s, members in of.items():
        whole = int(target[s] // size[s]) if size[s] else 0
        gap, cut, later = target[s] - whole * size[s], False, []
        more = set()
        for key, n, doc in sorted(members) if gap else ():
            cut = cut or n > gap
            if cut:
                later.append((n, key, doc))
            else:
                gap -= n
                more.add(doc[0])
        fits = [x for x in later if x[0] <= gap]
        if fits:
            more.add(max(fits)[2][0])
        out += [doc for _, _, doc in members for _ in range(whole + (doc[0] in more))]
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The small table with shared passages and near copies planted in it; what was planted."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    docs = [tuple(r) for r in given]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    model = quality.learn(spark.read.parquet(f"{SF_DIR}/documents.parquet"), labels)
    long = [d for d in docs if d[1] and len(d[1].split()) > 250 and _score(model, d[1]) > 0.9]
    assert len(long) > 6
    draw = random.Random(1)
    words = sorted({w for d in long for w in d[1].split()})
    passages, near = [], []
    for i in range(3):
        passage = " ".join(draw.choice(words) for _ in range(60 + i))
        passages.append(passage)
        for k, (_, text, lang, source) in enumerate(long[2 * i : 2 * i + 3]):
            line = " ".join(text.split()[k : k + 150])
            docs.append((20_000 + 10 * i + k, f"{line} {i} {k}\n{passage}\n{line} {k} {i}", lang, source))
    for i, (_, text, lang, source) in enumerate(long):
        line = " ".join([*text.split(), str(i), "of", "its", "own"])
        copy = f"{line} too"
        if (_plain_fingerprint(line) ^ _plain_fingerprint(copy)).bit_count() <= 2:
            near.append((30_000 + i, 40_000 + i))
            docs += [(near[-1][0], line, lang, source), (near[-1][1], copy, lang, source)]
    assert near
    draw.shuffle(docs)
    table = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], DOCS)
    table.repartition(5).write.parquet(f"{folder}/documents.parquet")
    return folder, docs, passages, near


def test_whole_run_against_plain_decisions(spark, corpus):
    folder, docs, passages, near = corpus
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.learn(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    good = _good([(d[0], d[1], d[3]) for d in docs], model)
    assert {d for pair in near for d in pair} <= {d[0] for d in good}
    clean = _without_runs(good)
    for passage in passages:
        assert sum(passage in (text or "") for _, text, _ in good) > 1
        assert sum(passage in (text or "") for _, text, _ in clean) == 1
    single = _one_of_each(clean)
    ids = {d[0] for d in single}
    assert all(len(ids & set(pair)) < 2 for pair in near)
    assert len(single) < len(clean) < len(docs)
    library, want = Tokenizer.from_file(VOCABULARY), []
    for doc_id, text, _ in _mixed(single):
        tokens = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(tokens, skip_special_tokens=False)
        numbers = ",".join(map(str, tokens))
        want.append(
            (doc_id, len(tokens), *(hashlib.sha256(x.encode()).hexdigest() for x in (numbers, decoded)))
        )
    assert len(want) > len(single)
    assert rows(corpus_pipeline.run(spark, folder)) == sorted(want, key=repr)
