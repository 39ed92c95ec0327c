"""Language model scores and language identification."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import language_id, lm_scoring
from tidemark.llm.context_tree import END, ContextTree, grams

from .conftest import words


def base_scores(docs):
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(x for d, t in docs if not held(d) for x in tok(t))
    n, v = sum(c.values()), len(c)
    return sorted(((d, held(d), len(tok(t)), sum(c[x] > 0 for x in tok(t)), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tok(t)), 6)) for d, t in docs), key=str)


@pytest.mark.parametrize("hot", [1 << 19, 10])
def test_base_scores(odd_docs, no_docs, hot):
    rows = lm_scoring.score_documents(odd_docs, hot=hot).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=str)
    assert got == base_scores([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert all(r["score"] < 0 for r in rows)
    assert lm_scoring.score_documents(no_docs).count() == 0


def tree_of(texts, depth, most=1 << 15):
    pad = bytes([END]) * depth
    g = np.concatenate([grams(np.frombuffer(pad + t + bytes([END]), np.uint8), depth) for t in texts])
    codes, n = np.unique(g, return_counts=True)
    rows = Counter()
    for d in range(depth + 1):
        for c, k in zip(codes, n, strict=True):
            rows[d, int(c >> 8) & ((1 << 8 * d) - 1), int(c & 255)] += int(k)
    size = Counter()
    for (d, c, _), k in rows.items():
        size[d, c] += k
    kept = sorted(sorted(size, key=lambda x: (-size[x], x))[:most])
    index = {x: i for i, x in enumerate(kept)}
    data = [(index[d, c], b, k) for (d, c, b), k in rows.items() if (d, c) in index]
    return ContextTree(np.array([d for d, _ in kept]), np.array([c for _, c in kept], np.int64), *(np.array(x) for x in zip(*data, strict=True))), rows, index


def test_tree_is_a_distribution():
    tree, _, _ = tree_of([b"abracadabra", b"banana band"], 2)
    assert np.allclose((10.0 ** tree.log10.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_tree_against_recursion():
    """Weights and mixtures of one bit decision, worked out node by node."""
    texts = [b"abababb", b"bbaab"]
    tree, rows, index = tree_of(texts, 2)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def counts(d, c, node):  # decisions below ``node``
        bit = node.bit_length() - 1
        zero = sum(k for (x, y, s), k in rows.items() if (x, y) == (d, c) and (1 << bit | s >> (8 - bit)) == node and not s >> (7 - bit) & 1)
        one = sum(k for (x, y, s), k in rows.items() if (x, y) == (d, c) and (1 << bit | s >> (8 - bit)) == node and s >> (7 - bit) & 1)
        return zero, one

    def children(d, c):
        return [x for x in index if x[0] == d + 1 and x[1] & ((1 << 8 * d) - 1) == c]

    def weighted(d, c, node):
        own = kt(*counts(d, c, node))
        inner = children(d, c)
        if not inner:
            return own, 1.0
        split = sum(weighted(*x, node)[0] for x in inner)
        total = np.logaddexp(own, split) - math.log(2)
        return total, math.exp(own - math.log(2) - total)

    def predict(path, node):
        (d, c), rest = path[0], path[1:]
        zero, one = counts(d, c, node)
        p = (one + 0.5) / (zero + one + 1)
        if not rest:
            return p
        w = weighted(d, c, node)[1]
        return w * p + (1 - w) * predict(rest, node)

    for ctx in (b"ab", b"ba", b"bb"):
        path = [(0, 0), (1, ctx[1]), (2, ctx[0] << 8 | ctx[1])]
        for s in (97, 98, END):
            want = sum(math.log10(predict(path, 1 << bit | s >> (8 - bit)) if s >> (7 - bit) & 1 else 1 - predict(path, 1 << bit | s >> (8 - bit))) for bit in range(8))
            assert abs(tree.log10[index[2, path[2][1]], s] - want) < 1e-4


def test_scores_follow_the_automaton():
    tree, rows, index = tree_of([words(i, 40).encode() for i in range(5)], 3, 200)
    text = words(9, 60).encode()
    whole, total = bytes([END]) * 3 + text + bytes([END]), 0.0
    for i in range(3, len(whole)):
        d = max(d for d in range(4) if (d, int.from_bytes(whole[i - d : i], "big")) in index)
        total += tree.log10[index[d, int.from_bytes(whole[i - d : i], "big")], whole[i]]
    assert np.allclose(tree.score([text, b"", text], chunk=50), [total, tree.log10[max(i for (d, c), i in index.items() if c == int.from_bytes(bytes([END]) * d, "big")), END], total], atol=1e-3)


LANGS = {"xx": "lorem ipsum dolor sit amet", "yy": "kuko wakazi hapana ndiyo sana", "zz": "größer schön über straße würde"}


def language_docs(n=160):
    import random

    r = random.Random(1)
    out = []
    for i in range(n):
        lang = r.choice(list(LANGS))
        out.append((i, " ".join(r.choice(LANGS[lang].split()) for _ in range(r.randint(3, 30))), lang))
    return out


def test_language_id(spark):
    docs = language_docs() + [(500, None, "xx"), (501, "123 !!", "xx"), (502, "", "yy"), (503, LANGS["yy"], None), (None, LANGS["zz"], "zz")]
    rows = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert len(rows) == len(docs)
    for d, t, lang in docs:
        r = rows[d]
        assert r["held_out"] == (zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if d in (500, 501, 502):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == (lang or "yy")


@pytest.mark.parametrize("most", [4096, 2])
def test_language_id_against_brute_force(spark, monkeypatch, most):
    """Every step by its definition: bound letters, summed n-grams, prototypes, what is common taken away, cosines; in one pass or two."""
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", most)
    docs = [(d, t + " " + words(d, d % 4), lang) for d, t, lang in language_docs(70)] + [(900, "Größe, größer!", "zz"), (900, "Größe, größer!", "zz"), (901, None, "xx"), (902, "k", None), (None, LANGS["yy"] * 30, "yy")]
    letters = language_id.Encoder(256).letter

    def vector(text):
        low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        if not low.strip():
            return None
        low = " " + " ".join(low.split()) + " "
        return sum(np.roll(letters(ord(a)).astype(float), 2) * np.roll(letters(ord(b)), 1) * letters(ord(c)) for a, b, c in zip(low, low[1:], low[2:], strict=False))

    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    unit = lambda v: v / np.linalg.norm(v)
    sums = {}
    for d, t, lang in docs:
        if lang and not held(d) and (v := vector(t)) is not None:
            sums[lang] = sums.get(lang, 0) + unit(v)
    names = sorted(sums)
    raw = np.array([unit(sums[x]) for x in names])
    mean = raw.mean(axis=0)
    away = np.array([unit(x - mean) for x in raw])
    want = []
    for d, t, _ in docs:
        v = vector(t)
        cosines = [-1.0] if v is None else away @ unit(v - unit(mean) * (unit(mean) @ v))
        want.append((d, held(d), "und" if v is None else names[int(np.argmax(cosines))], round(max(0.0, float(np.max(cosines))), 3)))
    got = language_id.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), dimensions=256).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 3)) for r in got), key=str) == sorted(want, key=str)


def test_language_id_odd(odd_docs, no_docs, spark):
    assert language_id.identify(odd_docs).count() == odd_docs.count()
    assert language_id.identify(no_docs).count() == 0
    none = spark.createDataFrame([(1, "text here", None)], "doc_id long, text string, lang string")
    assert language_id.identify(none).first()["lang_pred"] == "und"


def test_vectors_are_sums_of_bound_letters():
    e = language_id.Encoder(64)
    v = e.vector("ab")
    want = sum(np.roll(e.letter(ord(x)).astype(int), 2) * np.roll(e.letter(ord(y)).astype(int), 1) * e.letter(ord(z)) for x, y, z in (" ab", "ab "))
    assert v.tolist() == want.tolist()
    assert e.vector("1 2") is None


@pytest.mark.parametrize("hot_grams", [1 << 20, 500, 0])
def test_scores_are_those_of_the_tree_of_all_contexts(spark, hot_grams):
    """More contexts than 32,768: rare ones count too, whether grams are sent to the tasks or joined."""
    texts = [(i, words(i, 150) + (" été Größe" if i % 3 else "")) for i in range(80)] + [(80, None), (81, "Zq0zq " * 40)]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    plain = {d: lm_scoring.plain(t) for d, t in texts}
    tree, _, index = tree_of([t for d, t in plain.items() if not held(d)], lm_scoring.DEPTH, most=1 << 30)
    assert len(index) > 1 << 15 and any(map(held, plain))
    want = tree.score(list(plain.values()))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(docs, hot_grams=hot_grams).collect()}
    assert np.allclose([got[d] for d in plain], want, rtol=1e-5, atol=1e-3)


def test_without_training_texts_every_bit_is_a_half(spark):
    held = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    row = lm_scoring.score_documents(spark.createDataFrame([(held, "some text")], "doc_id long, text string")).collect()[0]
    assert row["held_out"] and math.isclose(row["score"], 10 * 8 * math.log10(0.5))
