import random
from collections import Counter

import pytest

from tidemark.llm import packing
from tidemark.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file

from .conftest import words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with planted copies, near copies, passages, benchmark items and junk."""
    r = random.Random(2)
    item, passage = words(900, 40), words(901, 90)
    docs = [(i, words(i, 200)) for i in range(60)]
    docs += [(60, docs[0][1]), (61, " ".join(["changed", *docs[1][1].split()[1:]])), (62, words(62, 60) + " " + item + " " + words(63, 60)), (63, words(64, 100) + " " + passage), (64, words(65, 100) + " " + passage + " " + words(66, 20))]
    docs += [(65, "same words here " * 40), (66, words(67, 10)), (67, None), (68, "")]
    d = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), dict(docs), passage


def test_stages(spark, folder):
    import corpus_pipeline as cp

    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, path)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert set(texts) - set(seen["quality_rules"]) == {65, 66, 67, 68}
    assert set(seen["quality_rules"]) - set(seen["jaccard_join"]) == {60, 61}
    cut = {i for i, r in seen["suffix_dedup"].items() if r["text"] != texts[i]}
    assert cut == {63, 64} and all(passage[5:-5] not in seen["suffix_dedup"][i]["text"] for i in cut)
    assert all(r["n_chars"] == len(r["text"]) for r in seen["suffix_dedup"].values())
    assert set(seen["suffix_dedup"]) - set(seen["decontamination"]) == {62}
    encode = packing.encoder(tokenizer_file("word_bpe_49k.json"))
    want = {i: len(encode(r["text"])) // 4 + 1 for i, r in seen["decontamination"].items()}
    assert {i: r["length"] for i, r in seen["best_fit_packing"].items()} == want


def test_run(spark, folder):
    import corpus_pipeline as cp

    rows = cp.run(spark, folder[0]).collect()
    assert Counter(r["piece"] for r in rows) == {0: 62}


def brute_run(docs, items):
    """(doc_id, length in tokens) of what the pipeline keeps, by plain loops."""
    from .test_decontaminate import brute as leaks
    from .test_near_duplicates import brute as classes
    from .test_quality import brute as measures

    def keep(text):
        n, chars, symbols, lines, repeats = measures(text)
        return n >= 50 and 100 * repeats <= 50 * n and 100 * symbols <= 25 * n and lines == 0 and 2 * n <= chars <= 15 * n

    docs = [d for d in docs if keep(d[1])]
    least, once = {}, []
    for (d, c, links), (_, text) in zip(sorted(classes(docs), key=str), sorted(docs, key=lambda x: str((x[0],))), strict=True):
        if not links or d == c and c not in least:
            once.append((d, text))
            least[c] = d
    data = [(d, t.encode()) for d, t in once]
    count = Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    cut = []
    for d, b in data:
        mark = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                mark[k : k + 200] = b"\1" * 200
        cut.append((d, bytes(x for x, m in zip(b, mark, strict=True) if not m).decode("utf-8", "ignore")))
    bad = {d for d, _, _ in leaks(cut, items)}
    encode = packing.encoder(tokenizer_file("word_bpe_49k.json"))
    return sorted((d, len(encode(t)) // 4 + 1) for d, t in cut if d not in bad)


def test_against_brute_force_with_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, ties, columns with clashing names; then empty tables."""
    import corpus_pipeline as cp

    r = random.Random(9)
    item, passage = words(800, 40), words(801, 90)
    docs = [(i, words(500 + i, 120)) for i in range(25)]
    docs += [(3, docs[3][1]), (30, docs[4][1]), (31, docs[5][1] + " tail"), (32, words(33, 60) + " " + item.upper()), (34, words(35, 70) + " " + passage), (36, passage + " " + words(37, 70))]
    docs += [(40, None), (41, ""), (42, "word " * 80), (43, words(44, 3000))]
    rows = [(i, t, None, "src", len(t or ""), "x", 7, 8) for i, t in docs]
    r.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long, k1 string, kept int, shift int"
    frame = spark.createDataFrame(rows, schema)
    frame.write.parquet(f"{tmp_path}/a/documents.parquet")
    items = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    items.write.parquet(f"{tmp_path}/a/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    got = Counter()
    for x in cp.run(spark, f"{tmp_path}/a").collect():
        got[x["doc_id"]] += x["length"]
    assert sorted(got.items()) == brute_run(docs, [(1, item)])
    for name, table in (("documents", frame), ("benchmark", items), ("labels", labels)):
        table.limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert cp.run(spark, f"{tmp_path}/b").collect() == []


def test_registration():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {n[: n.index("_") + 1] for n in QUERIES if n.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names and set(ORACLE_SQL) <= set(QUERIES)


def test_a_cluster_of_near_copies_in_jaccard_join(spark, monkeypatch):
    """One of the cluster stays, and its texts aren't sent to tiles once a block."""
    import corpus_pipeline as cp
    from tidemark.llm import near_duplicates as nd

    monkeypatch.setattr(nd, "BLOCK", 10)
    kept, durable, r, n = [], nd.durable, random.Random(9), 250
    monkeypatch.setattr(nd, "durable", lambda df: kept.append(durable(df)) or kept[-1])
    base, docs = words(500, 150).split(), [(n, words(501, 150))]
    for k in range(n):
        w = list(base)
        for i in range(r.choice([1, 1, 2, 2, 3])):
            w[r.randrange(len(w))] = f"new{k}x{i}"
        docs.append((k, " ".join(w)))
    left = cp.jaccard_join(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(row["doc_id"] for row in left.collect()) == [0, n]
    members, sides = (next(d for d in kept if columns <= set(d.columns)) for columns in ({"text", "block"}, {"ti", "tj", "side"}))
    assert members.join(sides, "block").count() < 2 * n * (n / 10) ** 0.5
