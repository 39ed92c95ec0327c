import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import repeats
from tidemark.llm.suffix_sort import common_at_least, smaller_than_next, suffix_array

from .conftest import words


def brute(docs):
    data = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    out = []
    for d, b in data:
        mark = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                mark[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        spans = sum(1 for k, m in enumerate(mark) if m and (not k or not mark[k - 1]))
        out.append((d, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect()), key=str)


def random_docs(seed):
    r = random.Random(seed)
    passages = [words(1000 + i, r.choice([20, 40, 80])) for i in range(4)]
    docs = []
    for i in range(25):
        parts = [words(seed * 100 + i, r.randint(5, 60))]
        for _ in range(r.choice([0, 1, 2])):
            p = r.choice(passages)
            a = r.randrange(max(1, len(p) - 150))
            parts.insert(r.randrange(len(parts) + 1), p[a : a + r.randint(150, 500)])
        docs.append((i, r.choice(["", " ", "é"]).join(parts)))
    return [*docs, (90, "ab" * 400), (91, "z" * 201), (92, docs[3][1]), (93, docs[3][1])]


@pytest.mark.parametrize("many", [50_000, 0])
def test_random_documents(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    docs = random_docs(3)
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_a_segment_has_one_mark(spark):
    p, q = words(20, 60).encode()[:201], words(21, 60).encode()[:201]
    # Starts 0, 1 of a and 9, 10 of b stand twice; c's own strings all do, as it stands twice itself.
    a, b, c = p + b"." * 8, b"#" * 9 + p, q
    rows = [(1, 1, 1, len(a) - 199, a), (1, 2, 1, len(b) - 199, b), (1, 3, 2, len(c) - 199, c), (1, 4, 1, 1, words(22, 60).encode()[:200])]
    counted = repeats._counted(spark.createDataFrame(rows, "ah long, sh long, n long, starts int, bytes binary"))
    assert sorted(map(tuple, counted.collect())) == [(1, 1, 0, 2), (1, 2, 9, 11)]


def test_runs_of_a_segment_are_one_mark():
    p, q = words(23, 60).encode()[:200], words(24, 60).encode()[:200]
    both = p[:150] + b"-" * 20 + q
    rows = [{"ah": 1, "sh": k, "n": 1, "starts": len(x) - 199, "bytes": x} for k, x in enumerate([both, both[:205], both[60:260], both[-202:]])]
    marks = [m for batch in repeats._judge(iter([pa.RecordBatch.from_pylist(rows)])) for m in batch.to_pylist()]
    assert [(m["sh"], m["a"], m["b"]) for m in marks] == [(0, 0, 171), (1, 0, 6), (2, 0, 1), (3, 0, 3)]


def test_odd_documents(odd_docs, no_docs):
    assert got(odd_docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    cut = repeats.remove_repeats(odd_docs)
    assert cut.columns == [*odd_docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert repeats.remove_repeats(no_docs).count() == 0


def test_long_texts_in_chunks(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 500)
    text = words(8, 700).encode()
    places = sorted((int(f), int(c)) for _, first, _, count, _, _ in repeats.segments([text]) for f, c in zip(first, count, strict=True))
    at = 0
    for first, count in places:  # every start once
        assert first == at
        at += count
    assert at == len(text) - 199


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(0, 50))
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        b = data.tobytes()
        assert suffix_array(data, 64).tolist() == sorted(range(n), key=lambda i: b[i:])
        assert smaller_than_next(data, n).tolist() == [i + 1 < n and b[i:] < b[i + 1 :] for i in range(n)]


def test_common_prefixes():
    data = np.frombuffer(b"abcabcabd" + bytes(20), np.uint8)
    a, b = np.array([0, 0, 3]), np.array([3, 6, 6])
    assert common_at_least(data, a, b, 5).tolist() == [True, False, False]
    assert common_at_least(data, a, b, 2).tolist() == [True, True, True]


@pytest.mark.parametrize("seed", range(8))
def test_only_wanted_suffixes_keep_their_order(seed):
    r = np.random.default_rng(seed)
    data = r.integers(97, 97 + r.integers(1, 4), 300).astype(np.uint8)
    begin = np.sort(r.choice(280, 6, replace=False))
    end = np.minimum(begin + r.integers(1, 12, 6), np.append(begin[1:], 300))
    order = suffix_array(data, 400, begin, end).tolist()
    wanted = {i for a, b in zip(begin.tolist(), end.tolist(), strict=True) for i in range(a, b)}
    assert len(set(order)) == len(order) and wanted <= set(order)
    raw = data.tobytes()
    assert order == sorted(order, key=lambda i: raw[i:])
