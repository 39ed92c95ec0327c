import pytest

from tidemark.llm import decontaminate as dc

from .conftest import words

ITEMS = [
    (1, "A train leaves Boston at 3 pm and travels 60 miles per hour toward Denver. How long does it take to cover 180 miles?"),
    (2, words(50, 40)),
    (3, "tiny item"),
    (4, None),
    (5, "Exactly five words stand here"),
]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def found(docs, benchmark):
    return sorted((r["doc_id"], r["item_id"]) for r in dc.matches(docs, benchmark).collect())


def test_copies_changed_numbers_and_clean_text(spark, benchmark):
    docs = spark.createDataFrame(
        [
            (1, words(1, 50) + " " + ITEMS[0][1] + " " + words(2, 30)),
            (2, "intro words here. " + ITEMS[0][1].replace("60", "75").replace("180", "225").replace("Boston", "Austin").replace("Denver", "Tulsa").replace("3 pm", "9 pm")),
            (3, words(3, 200)),
            (4, words(4, 20) + " " + ITEMS[1][1].upper() + ". " + words(5, 20)),
            (5, None),
            (6, ""),
            (7, "so exactly five words stand here too"),
            (8, " ".join(ITEMS[1][1].split()[:9]) + " " + words(6, 60)),
            (None, ITEMS[1][1]),
        ],
        "doc_id long, text string",
    )
    got = {(r["doc_id"], r["item_id"]): r for r in dc.matches(docs, benchmark).collect()}
    assert (1, 1) in got and (2, 1) in got and (4, 2) in got and (7, 5) in got and (None, 2) in got
    assert not [k for k in got if k[0] in (3, 5, 6, 8)]
    assert got[1, 1]["share"] == 1.0 and got[1, 1]["first_word"] == 50


def test_inconsistent_slots_do_not_count(spark):
    item = "add 5 apples and 5 pears then take 5 plums and 5 figs from the old brown basket"
    docs = spark.createDataFrame([(1, item.replace("5", "9")), (2, "add 1 apples and 2 pears then take 3 plums and 4 figs from the old brown basket")], "doc_id long, text string")
    assert found(docs, spark.createDataFrame([(1, item)], "item_id long, text string")) == [(1, 1)]


def test_decontaminate_keeps_rows_and_columns(odd_docs, no_docs, spark, benchmark):
    kept = dc.decontaminate(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    item = spark.createDataFrame([(1, words(1, 120))], "item_id long, text string")
    assert {r["doc_id"] for r in dc.decontaminate(odd_docs, item).collect()} == {None, 5, 6, 7, 8, 9, 10, 11, 12, 14}
    assert dc.decontaminate(no_docs, benchmark).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(odd_docs, empty).count() == odd_docs.count() and dc.matches(odd_docs, empty).count() == 0


def test_templates():
    w = dc.Words()
    words_ = "Then Anna ran 5 km - Bob ran 7 miles".split()
    h, kinds, at = w.of(words_)
    assert kinds.tolist() == [dc.NAME, dc.NAME, dc.LITERAL, dc.NUMBER, dc.UNIT, dc.NAME, dc.LITERAL, dc.NUMBER, dc.UNIT]
    assert at.tolist() == [0, 1, 2, 3, 4, 6, 7, 8, 9] and h[3] == h[7]
    assert dc.slots(words_, kinds, at, 0, 5, dc.PLAIN) == ["1=5", "2=km"] and dc.slots(words_, kinds, at, 0, 5, dc.NAMES) == ["3=then", "3=anna", "1=5", "2=km"]


def tokens(text):
    """(kind, value) of each token, without the operator's tables."""
    out = []
    for word in (text or "").split():
        bare = word.strip(dc.EDGE)
        low = bare.lower()
        if low:
            out.append((dc.NUMBER if any(c.isdigit() for c in low) else dc.UNIT if low in dc.UNITS else dc.NAME if bare[0].isupper() else dc.LITERAL, low))
    return out


def template(part, form):
    """The window's form and slot values, or None if it isn't looked up in that form."""
    slots = [k not in (dc.LITERAL, *([dc.NAME] if form == dc.PLAIN else [])) for k, _ in part]
    if form == dc.NAMES and (2 * sum(k == dc.LITERAL for k, _ in part) < len(part) or not any(k == dc.NAME for k, _ in part)):
        return None
    return tuple((k if s else v) for (k, v), s in zip(part, slots, strict=True)), [(k, v) for (k, v), s in zip(part, slots, strict=True) if s]


def brute(docs, items):
    """(doc, item, matched places) by comparing every window with every window, row by row."""
    out = []
    for item, item_text in items:
        it = tokens(item_text)
        if len(it) < dc.MIN_TOKENS:
            continue
        size = dc.window_of(len(it))
        n = len(it) - size + 1
        need = dc.needed_of(len(it))
        for doc, text in docs:
            dt = tokens(text)
            found = {}
            for form in (dc.PLAIN, dc.NAMES):
                for i in range(n):
                    for d in range(len(dt) - size + 1):
                        x, y = template(it[i : i + size], form), template(dt[d : d + size], form)
                        if x and y and x[0] == y[0]:
                            found.setdefault(d - i, []).append((i, list(zip(x[1], y[1], strict=True))))
            fit = set()
            for shift, rows in found.items():
                pairs = {p for _, ps in rows for p in ps}
                bad = {p for p in pairs for q in pairs if p != q and (p[0] == q[0] or p[1] == q[1])}
                fit |= {(shift, i) for i, ps in rows if not bad.intersection(ps)}
            best = max((len({i for s, i in fit if (s + k * dc.NEARBY) // (2 * dc.NEARBY) == (t + k * dc.NEARBY) // (2 * dc.NEARBY)}) for t, _ in fit for k in (0, 1)), default=0)
            if best >= need:
                out.append((doc, item, best))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    import random

    r = random.Random(4)
    names, nouns = ["Anna", "Bob", "Cem", "Dora", "Eve"], ["apples", "pears", "plums", "figs"]

    def question():
        a, b, c, d = r.choice(names), r.choice(names), r.randint(2, 9), r.randint(2, 9)
        return f"{a} has {c} {r.choice(nouns)} . {b} brings {d} more to {a} in the old basket . How many does {a} have now ?"

    items = [(k, question()) for k in range(12)] + [(20, words(40, 30)), (21, words(40, 30)), (21, words(40, 30)), (22, words(41, 6)), (23, words(42, 11)), (24, words(43, 200)), (25, None), (26, "too short")]
    docs = [(k, words(200 + k, 12) + " " + question() + " " + words(300 + k, 10)) for k in range(25)]
    long = items[17][1].split()
    docs += [
        (50, words(60, 20) + " " + " ".join(long[40:100]) + " " + words(61, 20)),  # 60 words of a long item
        (51, " ".join(words(40, 30).split()[:12] + ["inserted"] + words(40, 30).split()[12:])),
        (52, words(42, 11).title()),
        (53, words(40, 30).upper()),
        (54, " ".join(w if k != 5 else "other" for k, w in enumerate(words(42, 11).split()))),
        (55, None),
        (55, ""),
        (56, items[0][1]),
        (56, items[0][1]),
        (None, items[0][1]),
        (None, items[0][1]),
        (57, words(99, 300)),
    ]
    assert long == words(43, 200).split()
    got = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert sorted(((x["doc_id"], x["item_id"], x["n_matched"]) for x in got), key=str) == want
    hit = {(d, i) for d, i, _ in want}
    assert {(50, 24), (51, 20), (51, 21), (52, 23), (53, 20), (54, 23), (56, 0), (None, 0)} <= hit and not [d for d, _ in hit if d in (55, 57)]
    assert sum((d, i) == (51, 21) for d, i, _ in want) == 2 and sum((d, i) == (56, 0) for d, i, _ in want) == 2


def test_short_items_with_other_names_and_numbers(spark):
    item = "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have"
    docs = [(1, "intro " + item.replace("Tom", "Anna").replace("5", "7").replace("3", "4")), (2, "Berlin is the capital of Germany."), (3, "unfinished words before " + item)]
    items = spark.createDataFrame([(1, item), (2, "Paris is the capital of which European country")], "item_id long, text string")
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), items) == [(1, 1), (3, 1)]


def test_how_many_places_are_needed():
    assert [dc.window_of(n) for n in (4, 7, 8, 15, 16, 23, 24, 300)] == [4, 7, 4, 4, 5, 5, 8, 8]
    assert [dc.needed_of(n) for n in (4, 7, 8, 15, 16, 24, 60, 91, 92, 1000)] == [1, 1, 3, 6, 4, 6, 16, 26 - 1, 25, 25]


def test_clashing_columns(odd_docs, spark):
    benchmark_ = spark.createDataFrame([(1, words(1, 120), "x")], "item_id long, text string, hash string")
    named = odd_docs.withColumnRenamed("hash", "t1").withColumnRenamed("class_id", "t2")
    assert dc.decontaminate(named, benchmark_).columns == named.columns
    assert dc.matches(named, benchmark_).count() == dc.matches(odd_docs, benchmark_).count() > 0
