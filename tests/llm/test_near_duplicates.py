import random

import numpy as np
import pytest

from tidemark.llm import near_duplicates as nd

from .conftest import words


def brute(docs):
    """doc rows to (least id of the class, links) by all pairs of word shingles."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 10 * common >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(docs)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in nd.jaccard_join(df).collect()), key=str)


def test_odd_documents(odd_docs, no_docs):
    assert got(odd_docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert nd.jaccard_join(no_docs).count() == 0


@pytest.mark.parametrize("block", [400, 3])
def test_random_families(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    r = random.Random(5)
    docs, k = [], 0
    for f in range(12):
        base = words(100 + f, 60).split()
        for _ in range(r.choice([1, 2, 7])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = "new" + str(k)
            docs.append((k, " ".join(w)))
            k += 1
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_recall_just_above_the_threshold(spark):
    docs = []
    for f in range(150):
        base = words(9000 + f, 120)  # 116 shingles; 29 more make a similarity of 0.8 exactly
        docs += [(2 * f, base), (2 * f + 1, base + " " + words(20_000 + f, 20 + f % 10))]
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_a_chain_of_buckets_is_not_one_group(spark, monkeypatch):
    """Texts that overlap like tiles of a roof: neighbours are similar, ends are not; blocks that share no bucket aren't compared."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    text = words(77, 460).split()
    docs = [(k, " ".join(text[6 * k : 6 * k + 100])) for k in range(60)]
    want = brute(docs)
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == want
    assert len({c for _, c, _ in want}) == 1 and max(n for _, _, n in want) <= 4


def test_deduplicate_keeps_one_of_each_class(odd_docs, no_docs):
    kept = nd.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    # 1, 2, 2, 3 and the null id with the same text are one class; 9 and 10 another; texts without words all stay.
    assert ids == sorted([1, None, 5, 5, 6, 7, 8, 9, 11, 12, 13, 14], key=str)
    assert nd.deduplicate(no_docs).count() == 0


def test_class_without_ids(spark):
    docs = spark.createDataFrame([(None, words(1, 30)), (None, words(1, 30)), (4, words(2, 30))], "doc_id long, text string")
    assert sorted((r["doc_id"] for r in nd.deduplicate(docs).collect()), key=str) == [4, None]


def test_pruning_table():
    least = nd.least_matches()
    assert all(0 < least[n] < n for n in least) and least[240] > 100
    # The bound by integration of the posterior at one point.
    n, t = 48, 0.8
    x = np.linspace(0, 1, 200_001)
    for m in (least[n] - 1, least[n]):
        density = x**m * (1 - x) ** (n - m)
        share = density[x >= t].sum() / density.sum()
        assert (share < 1e-6) == (m < least[n])


def test_many_pairs_count_alike():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 50, 30)).astype(np.uint64) for _ in range(30)]
    a, b = np.triu_indices(30, 1)
    plain = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    assert nd._intersections(sets, a, b).tolist() == plain


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    found = {r["node"]: r["component"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in (100, 101, 103)} == {100}


def test_a_large_cluster_is_not_sent_once_a_block(spark, monkeypatch):
    """Near copies, some of which hang on the others by few buckets: rows sent to tiles grow with n ** 1.5, and no link is lost."""
    monkeypatch.setattr(nd, "BLOCK", 10)
    kept, n, r = [], 600, random.Random(8)
    durable = nd.durable
    monkeypatch.setattr(nd, "durable", lambda df: kept.append(durable(df)) or kept[-1])
    base, docs = words(300, 150).split(), []
    for k in range(n):
        w = list(base)
        for i in range(min(20, 1 + int(r.expovariate(1 / 3.5)))):
            w[r.randrange(len(w))] = f"new{k}x{i}"
        docs.append((k, " ".join(w)))
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
    members, sides = (next(d for d in kept if columns <= set(d.columns)) for columns in ({"text", "block"}, {"ti", "tj", "side"}))
    assert n / 2 < members.join(sides, "block").count() < 3 * n * (n / 10) ** 0.5


def test_a_block_is_bounded_by_bytes(spark, monkeypatch):
    docs = [(k, words(400, 200) + f" tail{k}") for k in range(40)]
    monkeypatch.setattr(nd, "BLOCK_BYTES", 5000)
    kept, durable = [], nd.durable
    monkeypatch.setattr(nd, "durable", lambda df: kept.append(durable(df)) or kept[-1])
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == [(k, 0, 39) for k in sorted(range(40), key=lambda k: str((k, 0, 39)))]
    members = next(d for d in kept if {"text", "block"} <= set(d.columns))
    assert members.select("block").distinct().count() > 4


@pytest.mark.parametrize("part", [7, 400])
@pytest.mark.parametrize("first", [0, 23, 60])
def test_pairs_by_parts(monkeypatch, part, first):
    monkeypatch.setattr(nd, "PART", part)
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 62, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(100) < 0.93], np.arange(k, k + 4, dtype=np.uint64)])) for k in range(59)] + [np.zeros(0, np.uint64)]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if first in (0, 60) or a < first <= b if len(sets[a]) and 10 * len(c := np.intersect1d(sets[a], sets[b])) >= 8 * (len(sets[a]) + len(sets[b]) - len(c))}
    parts = list(nd.linked_pairs(sets, first))
    assert sorted((x, y) for a, b in parts for x, y in zip(a.tolist(), b.tolist(), strict=True)) == sorted(want) and 0 < len(want)
    root, plain = np.arange(60), list(range(60))
    for a, b in parts:
        root = nd.least_of(root, a, b)
    for _ in range(60):
        for x, y in want:
            plain[x] = plain[y] = min(plain[x], plain[y])
    assert root.tolist() == plain
