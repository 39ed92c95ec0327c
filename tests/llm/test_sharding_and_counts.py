import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import sharding
from tidemark.llm import token_counts as tc

from .conftest import words


def check_shards(docs, shards=16):
    rows = sharding.vector_shards(docs, shards).collect()
    texts = docs.collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in texts), key=str)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["k1"], r["k2"]].add(r["shard"])
        assert 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, groups


def test_odd_documents(odd_docs, no_docs):
    check_shards(odd_docs)
    assert sharding.vector_shards(no_docs).count() == 0


def test_balance_and_groups(spark):
    r = random.Random(1)
    docs = [(i, words(i, r.choice([5, 50, 200]))) for i in range(1500)] + [(5000 + i, words(7, 40)) for i in range(40)]
    rows, groups = check_shards(spark.createDataFrame(docs, "doc_id long, text string"))
    load = [sum(x["size"] for x in rows if x["shard"] == s) for s in range(16)]
    assert max(load) / min(load) < 1.03
    count = Counter(x["shard"] for x in rows)
    assert max(count.values()) / min(count.values()) < 1.1
    tokens = [sum(x["tokens"] for x in rows if x["shard"] == s) for s in range(16)]
    assert max(tokens) / min(tokens) < 1.1
    assert all(len(s) == 1 for s in groups.values())  # equal texts stay together


def test_a_group_of_a_third_of_all_rows_is_split(spark):
    docs = [(i, words(i, 60)) for i in range(600)] + [(1000 + i, words(7, 60)) for i in range(300)]
    rows, groups = check_shards(spark.createDataFrame(docs, "doc_id long, text string"))
    load = [sum(x["size"] for x in rows if x["shard"] == s) for s in range(16)]
    assert max(load) / min(load) < 1.25


def test_leveling_never_worsens_and_ends_where_no_exchange_helps():
    for seed in range(12):
        r = np.random.default_rng(seed)
        items = np.stack([r.lognormal(3, 1, 40), r.lognormal(2, 1, 40), np.ones(40)], axis=1).round()
        before = sharding.place(items, 4)
        after = sharding.level(items, before, 4)

        def badness(where, items=items):
            load = np.stack([np.bincount(where, items[:, d], 4) for d in range(3)], axis=1) / items.sum(axis=0) * 4 - 1
            return (load**2 * np.array(sharding.WEIGHTS)).sum()

        assert badness(after) <= badness(before) + 1e-12
        # Brute force: no single move from the worst shard helps.
        load = np.stack([np.bincount(after, items[:, d], 4) for d in range(3)], axis=1) / items.sum(axis=0) * 4 - 1
        a = int(np.argmax((load**2 * np.array(sharding.WEIGHTS)).sum(axis=1)))
        for i in np.flatnonzero(after == a):
            for b in range(4):
                other = after.copy()
                other[i] = b
                assert badness(other) >= badness(after) - 1e-9


def test_place_prefers_room():
    items = np.array([[8, 8, 1], [8, 8, 1], [1, 1, 8], [1, 1, 8]], float)
    where = sharding.place(items, 2)
    assert where[0] != where[1] and where[2] != where[3]


def counts_of(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in df.collect()}


def brute(docs):
    total = defaultdict(lambda: [0, 0])
    for d in docs:
        k = d["source"], d["lang"], "w"
        total[k][0] += 1
        total[k][1] += len((d["text"] or "").encode().split())
    return {k: tuple(v) for k, v in total.items()}


def test_rollup(odd_docs, no_docs, spark, tmp_path):
    versions = {"w": tc.words}
    counts = tc.count_tokens(odd_docs, versions)
    rollup = tc.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0 and rollup.batches() == []
    assert rollup.commit("b1", tc.signed(counts, 1))
    assert counts_of(rollup.totals()) == brute(odd_docs.collect())
    assert not rollup.commit("b1", tc.signed(counts, 1))  # sent again
    assert counts_of(rollup.totals()) == brute(odd_docs.collect())
    assert rollup.commit("b2", tc.signed(tc.count_tokens(no_docs, versions), 1))
    # A revision: two documents change, one moves, one goes.
    new = [(1, "one two", "en", "a"), (3, "three", "fr", "z"), (8, None, None, None)]
    old = odd_docs.filter("doc_id in (1, 3, 8, 9)")
    after = spark.createDataFrame([(*n, 0, "", 0, "", 0, 0) for n in new], odd_docs.schema)
    assert rollup.commit("b3", tc.changes(tc.count_tokens(old, versions), tc.count_tokens(after, versions)))
    want = brute([d for d in odd_docs.collect() if d["doc_id"] not in (1, 3, 8, 9)] + after.collect())
    assert counts_of(rollup.totals()) == want
    assert tc.changes(counts, counts).count() == 0
    assert rollup.compact() and not rollup.compact()
    again = tc.Rollup(spark, str(tmp_path / "r"))
    assert counts_of(again.totals()) == want and again.batches() == ["b1", "b2", "b3"]
    assert not again.commit("b1", tc.signed(counts, 1)) and counts_of(again.totals()) == want
    assert again.commit("b4", tc.signed(counts, 1)) and again.commit("b5", tc.signed(counts, -1))
    assert counts_of(again.totals()) == want and again.compact() and counts_of(again.totals()) == want


def test_of_two_writers_of_a_batch_one_succeeds(odd_docs, spark, tmp_path):
    first, second = (tc.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    counts = tc.count_tokens(odd_docs, {"w": tc.words})
    settle = second._settle

    def late(aside, done):
        assert first.commit("b", tc.signed(counts, 1))  # the other writer comes between
        return settle(aside, done)

    second._settle = late
    assert not second.commit("b", tc.signed(counts, 1))
    assert counts_of(first.totals()) == brute(odd_docs.collect()) and first._names("staged") == []


def test_query_equals_a_plain_count(spark, tmp_path, odd_docs):
    from tidemark.llm.queries import op10_token_rollup, tokenizer_file

    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = counts_of(op10_token_rollup(spark, str(tmp_path)))
    want = {(s, lang, "words-1"): v for (s, lang, _), v in brute(odd_docs.collect()).items()}
    from tokenizers import Tokenizer

    library, more = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), defaultdict(lambda: [0, 0])
    for d in odd_docs.collect():
        k = d["source"], d["lang"], "word_bpe_49k-1"
        more[k][0] += 1
        more[k][1] += len(library.encode(d["text"] or "", add_special_tokens=False).ids)
    assert got == want | {k: tuple(v) for k, v in more.items()}


def test_a_failed_batch_leaves_nothing(odd_docs, spark, tmp_path):
    from pyspark.sql import functions as F

    rollup = tc.Rollup(spark, str(tmp_path / "r"))
    bad = tc.signed(tc.count_tokens(odd_docs, {"w": tc.words}), 1).withColumn("tokens", F.raise_error(F.lit("lost")).cast("long"))
    try:
        rollup.commit("b", bad)
    except Exception:  # noqa: BLE001
        pass
    assert rollup.batches() == [] and rollup.totals().count() == 0


def test_vocabulary_counts(odd_docs):
    from tidemark.llm.queries import tokenizer_file

    path = tokenizer_file("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    got = sorted(r["n_tokens"] for r in tc.count_tokens(odd_docs, {"v": tc.vocabulary(path)}).collect())
    assert got == sorted(len(library.encode(d["text"] or "", add_special_tokens=False).ids) for d in odd_docs.collect())
