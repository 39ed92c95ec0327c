import math
import re
from collections import Counter

from tidemark.llm import quality

from .conftest import words


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def rows(df):
    return [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in df.collect()]


def test_measurements_match_brute_force(odd_docs):
    got = rows(quality.ledger(odd_docs))
    want = [(r["doc_id"], *brute(r["text"])) for r in odd_docs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeats_and_lines(spark):
    texts = ["a b c a b c d a b", "a a a a", "one\n\none\ntwo\n one\none", "x y z", "x y", "", "# $ a|b\n%%\n%%", "a b c d a b c d a b c d", "w\x0bx\x0cy\rz w x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(rows(quality.ledger(docs))) == [(i, *brute(t)) for i, t in enumerate(texts)]


def test_policies_and_ablation(spark):
    texts = [words(1, 80), words(2, 20), "ab*** " * 1 + " ".join(f"{w}***" for w in words(3, 90).split()), words(4, 70) + " You idiot, you are PATHETIC", " ".join(w.upper() + "!!" for w in words(5, 90).split()), "same words here " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = quality.ledger(docs).cache()
    kept = {r["doc_id"]: r["kept"] for r in quality.apply_policy(entries).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}
    v1 = {r["doc_id"]: r["kept"] for r in quality.apply_policy(entries, "v1").collect()}
    assert v1[3] and not v1[1]
    bits = [r["fail_bits"] for r in entries.collect()]
    for r in quality.ablation(entries).collect():
        bit = 1 << quality.RULES[r["rule"]]
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_failed_alone"] == sum(b == bit for b in bits)
        assert r["n_kept_without"] == sum(not b & ~bit for b in bits)


def test_keep_returns_the_columns(odd_docs, no_docs):
    kept = quality.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, None, 8, 13}
    assert quality.ledger(no_docs).count() == 0 and quality.ablation(quality.ledger(no_docs)).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = quality.keep(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_insults_count_in_any_case(spark):
    texts = [words(4, 70) + " you are an IDIOT and a MORON", words(4, 70).upper() + " IDIOT MORON", words(4, 70) + " Idiot, mOrOn", words(4, 70) + " IDIOT idiotic", words(4, 70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_toxic"], r["kept"]) for r in quality.apply_policy(quality.ledger(docs)).collect()}
    assert got == {0: (2, False), 1: (2, False), 2: (2, False), 3: (1, True), 4: (0, True)}


def labelled(spark):
    """Documents of which some hold words that begin alike; labels of most of them; copies of one toxic document."""
    docs = [(k, words(700 + k, 90) + (" badwork Badword" if k % 5 == 0 else "")) for k in range(120)]
    docs += [(500 + k, docs[0][1] + " " + words(60_000 + k, 3)) for k in range(60)] + [(None, "badwords"), (900, None)]
    labels = [(k, int(k % 5 == 0)) for k in range(110)] + [(500 + k, 1) for k in range(60)] + [(None, 1), (900, 1), (3, None), (77_777, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_marks_are_found_once_for_copies(spark):
    docs, labels = labelled(spark)
    marks = quality.toxic_marks(docs, labels)
    # The words of the copied document would all be marks if its copies counted.
    assert marks == ["badw", "badwor"]
    assert quality.toxic_marks(docs, labels.limit(0)) == [] and quality.toxic_marks(docs.limit(0), labels) == []
    # By hand: 22 toxic documents and a few of the copies have the mark, none of 88 others has it.
    assert 2 * (22 * math.log(110 / 22) + 88 * math.log(110 / 88)) > quality.LEAST_SURE > 2 * (3 * math.log(110 / 22) + 1)


def test_marked_words_are_counted_in_the_whole_text(spark):
    texts = ["badword BADWORK " + words(4, 120), words(4, 120) + " badwor", words(4, 3000) + " badwo badwords bad", words(4, 120) + " abadwo bad", "bad bad " + words(4, 120), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = quality.apply_policy(quality.ledger(docs, marks=["badwor", "badwo", "bad", "other"])).collect()
    assert {r["doc_id"]: (r["n_marked"], r["kept"]) for r in entries} == {0: (2, False), 1: (1, True), 2: (3, True), 3: (1, True), 4: (2, False), 5: (0, False)}
    assert {r["n_marked"] for r in quality.ledger(docs).collect()} == {0}


def test_held_out_toxic_documents(spark):
    """Marks found on some documents hold for others."""
    docs = [(k, words(3000 + k, 100) + (" ".join(["", f"vilek{k}", f"vilek{k}ast"]) if k % 4 == 0 else "")) for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = quality.toxic_marks(frame, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int"))
    kept = {r["doc_id"] for r in quality.keep(frame, marks=marks).collect()}
    assert kept == {k for k in range(400) if k % 4}


def test_ablation_of_an_older_policy_ignores_newer_bits(spark):
    docs = spark.createDataFrame([(0, "badword badwork " + words(4, 120))], "doc_id long, text string")
    entries = quality.ledger(docs, marks=["badwor"])
    assert [r["kept"] for r in quality.apply_policy(entries, "v2").collect()] == [True]
    assert {r["rule"]: r["n_kept_without"] for r in quality.ablation(entries, "v3").collect()}["toxic_rate"] == 1
