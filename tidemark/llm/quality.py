"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and stores its measurements and one
failure bit per rule. A policy is a named, versioned mask: ``apply_policy``
and ``ablation`` only combine bits, so texts are never measured again.

One rule is fitted: ``toxic_marks`` finds, from labelled documents, beginnings
of words that toxic documents hold far oftener than others, in any language;
``toxic_rate`` fails a document that has several such words for its length.
The fit is a count over SAMPLE labelled documents at most; copies and near
copies among them count once, so that one copied text can't make all its words
marks. What it finds is a list of MAX_MARKS at most, held in the expression.

Defined cases: a null text counts as empty (no words: rule ``few_words`` and
``no_letters`` fail); every row of the input gives one row, repeated rows and
null doc_ids too; an input column whose name is also a ledger column is
replaced by the ledger's; an empty table gives an empty ledger; very long
texts are measured whole; labels that are null, or of no document, teach
nothing, and without labels there are no marks. Ties among marks go by the
alphabet.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let, require

#: Insults of which a text that holds two different ones fails ``toxic_terms``.
TOXIC = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

#: Bit of each rule. Bits are never reused, so that stored ledgers stay readable.
RULES = {
    "few_words": 0,
    "repeated_windows": 1,
    "symbols": 2,
    "duplicate_lines": 3,
    "short_words": 4,
    "long_words": 5,
    "no_letters": 6,
    "toxic_terms": 7,
    "shouting": 8,
    "toxic_rate": 9,
}

#: Versioned policies: a document goes if any of these rules fails it.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "no_letters", "shouting"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "no_letters", "toxic_terms", "shouting"),
    "v3": tuple(RULES),
}
DEFAULT_POLICY = "v3"

#: Labelled documents that are counted at most, those with the least hash of their id; letters of a mark (of whole words, if they have fewer); marks at most.
SAMPLE, LETTERS, MAX_MARKS = 20_000, (4, 6), 2_000
#: A mark stands in so many different toxic documents at least, with so large a log-odds ratio, and a likelihood ratio (G) against chance so large:
#: by chance alone one beginning of some twenty million has it.
LEAST_DOCS, LEAST_ODDS, LEAST_SURE = 4, 1.6, 30.0
#: A document fails ``toxic_rate`` with so many marked words, if they are one in so many of its words or more.
MARKED, ONE_IN = 2, 130

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "has_letter", "n_toxic", "n_exclaim", "n_marked")


def mask(policy: str) -> int:
    """The bits that a policy looks at."""
    return sum(1 << RULES[r] for r in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more.

    Windows are sorted with their places; a window equal to a neighbour in
    that order is repeated. Each repeated window covers three words, less
    what the next repeated window covers already. n log n in the words.
    """

    def places(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"]))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        return let(pairs, repeated)

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"].cast("long"),
        )

    def count(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        hashes = F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        windows = F.transform(starts, lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1), F.lit(" "), F.get(w, i + 2)))
        # Texts whose windows all hash apart repeat none; only the others compare the windows themselves.
        return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("long")).otherwise(covered(places(windows)))

    return count(words)


def _letters(text: Column) -> Column:
    """The lower-cased runs of letters of a text."""
    return F.split(F.lower(text), "[^\\p{L}]+")


def toxic_marks(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Beginnings of words that tell toxic documents, by the labels' column toxic (1 or 0)."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    words = F.filter(F.array_distinct(_letters("text")), lambda w: w != "")

    # Spark gives a function of two parameters an element's place, so these have one.
    def beginning(n: int):
        return lambda x: F.substring(x, 1, n)

    def hashed(k: int):
        return lambda x: F.xxhash64(x, F.lit(k))

    def read(w: Column) -> Column:
        marks = F.array_distinct(F.concat(*[F.transform(w, beginning(n)) for n in LETTERS]))
        return F.struct(marks.alias("marks"), *[F.array_min(F.transform(w, hashed(k))).alias(f"m{k}") for k in (1, 2)])

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    told = durable(told.select("toxic", let(words, read).alias("x"))).select("toxic", "x.*").filter(F.size("marks") > 0).dropDuplicates(["toxic", "m1", "m2"])
    counted = told.select("toxic", F.explode("marks").alias("mark")).groupBy("mark").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    totals = told.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("all"))
    odds = F.log((F.col("a") + 0.5) / (F.col("toxic") + 1)) - F.log((F.col("b") + 0.5) / (F.col("all") - F.col("toxic") + 1))
    toxic, clean = F.col("toxic"), F.col("all") - F.col("toxic")
    held = (F.col("a") + F.col("b")) / F.col("all")
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    sure = 2 * (part(F.col("a"), toxic * held) + part(F.col("b"), clean * held) + part(toxic - F.col("a"), toxic * (1 - held)) + part(clean - F.col("b"), clean * (1 - held)))
    # The totals are one row.
    rated = counted.filter(F.col("a") >= LEAST_DOCS).join(F.broadcast(totals)).withColumn("odds", odds).withColumn("sure", sure)
    best = rated.filter((F.col("odds") >= LEAST_ODDS) & (F.col("sure") >= LEAST_SURE)).orderBy(F.desc("sure"), "mark").limit(MAX_MARKS)
    return sorted(r["mark"] for r in best.select("mark").collect())


def measure(docs: DataFrame, text: str = "text", marks: list[str] | None = None) -> DataFrame:
    """Adds the measurements of MEASURES. marks: what ``toxic_marks`` found."""
    require(docs, text)
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def all_of(w: Column) -> Column:
        return let(F.array_join(w, ""), lambda joined: counts(w, joined))

    def counts(w: Column, joined: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            (F.length(joined) - F.length(F.translate(joined, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.length(joined) - F.length(F.replace(joined, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
            _repeat_words(w).alias("n_repeat_words"),
            F.coalesce(joined.rlike("\\p{L}"), F.lit(False)).alias("has_letter"),
        )

    known = [(n, [m for m in marks or () if least < len(m) <= n]) for least, n in zip((0, *LETTERS), LETTERS, strict=False)]
    known = [(n, m) for n, m in known if m]

    def toxic(hits: Column) -> Column:
        terms = F.size(F.array_distinct(F.filter(hits, lambda p: p.isin(*TOXIC))))
        marked = F.size(F.filter(hits, lambda p: reduce(or_, [F.substring(p, 1, n).isin(*m) for n, m in known]))) if known else F.lit(0)
        return F.struct(terms.cast("long").alias("n_toxic"), marked.cast("long").alias("n_marked"))

    def maybe(p: Column) -> Column:
        # One look at each word, by its beginnings, finds the few that count.
        longest = LETTERS[-1]
        found = {longest: {w[:longest] for w in TOXIC}}
        for n, m in known:
            found.setdefault(n, set()).update(m)
        return reduce(or_, [F.substring(p, 1, n).isin(*sorted(m)) for n, m in found.items()])

    place = {"n_lines": "_of_lines", "n_dup_lines": "_of_lines", "n_toxic": "_of_terms", "n_marked": "_of_terms"}

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return (
        docs.withColumns({"_of_words": let(words, all_of), "_of_lines": let(lines, line_counts), "_of_terms": let(F.filter(_letters(t), maybe), toxic)})
        .withColumns({m: F.col(place.get(m, "_of_words"))[m] for m in MEASURES})
        .drop("_of_words", "_of_lines", "_of_terms")
    )


def failure_bits() -> Column:
    """The mask of failed rules, from the measurements; integers only, so every engine agrees."""
    n = F.col("n_words")
    fails = {
        "few_words": n < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 100 * F.col("n_symbols") > 25 * n,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 40 * F.col("n_lines"),
        "short_words": F.col("word_chars") < 2 * n,
        "long_words": F.col("word_chars") > 15 * n,
        "no_letters": ~F.col("has_letter"),
        "toxic_terms": F.col("n_toxic") >= 2,
        "shouting": 2 * F.col("n_exclaim") > n,
        "toxic_rate": (F.col("n_marked") >= MARKED) & (ONE_IN * F.col("n_marked") >= n),
    }
    bits = [F.when(fails[r], F.lit(1 << b)).otherwise(0) for r, b in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


def ledger(docs: DataFrame, text: str = "text", marks: list[str] | None = None) -> DataFrame:
    """docs with MEASURES and ``fail_bits``; each rule is evaluated once."""
    return measure(docs, text, marks).withColumn("fail_bits", failure_bits())


def apply_policy(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``policy`` and ``kept`` to ledger rows."""
    return entries.withColumns({"policy": F.lit(policy), "kept": F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0})


def keep(docs: DataFrame, policy: str = DEFAULT_POLICY, marks: list[str] | None = None) -> DataFrame:
    """The rows of docs that the policy keeps; all columns stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return apply_policy(ledger(rows, marks=marks), policy).filter("kept").select("row.*")


def ablation(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """One row per rule of the policy: documents it fails, fails alone, and that stay if the rule is dropped.

    One pass: rows are first counted by their masked bits (at most 2 ** rules
    rows), and every ablation is read off those counts.
    """
    on = mask(policy)
    counts = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(on)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits").bitwiseAND(F.lit(on).cast("long") - F.col("bit")) == 0).alias("n_kept_without"),
    )
