import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import packing
from tidemark.llm.queries import tokenizer_file

from .conftest import words

PATH = tokenizer_file("word_bpe_49k.json")


def check_plan(counts, capacity, **options):
    """Every piece is placed once and sequences have no gaps; returns how many there are."""
    sequences, seen = defaultdict(list), defaultdict(list)
    for length, first, n, seq, offset in packing.plan(dict(counts), capacity, **options):
        seen[length].append((first, n))
        for k in range(n):
            sequences[seq + k].append((offset, length))
    for length, n in counts.items():
        at = 0
        for first, m in sorted(seen[length]):
            assert first == at
            at += m
        assert at == n
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


@pytest.mark.parametrize("seed", range(25))
def test_plan(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 60, 300])
    counts = Counter(r.randint(1, capacity) for _ in range(r.randint(0, 300)))
    n = check_plan(counts, capacity, groups=(r.choice([1, 4, 16]),))
    assert n >= -(-sum(x * k for x, k in counts.items()) // capacity)


def test_plan_is_near_the_bound():
    r = random.Random(1)
    counts = Counter(min(4096, int(r.lognormvariate(6, 1)) + 1) for _ in range(5000))
    bound = -(-sum(x * k for x, k in counts.items()) // 4096)
    assert check_plan(counts, 4096) <= bound * 1.005 + 1


def best_fit_decreasing(counts, capacity):
    """How many sequences plain best fit of all pieces takes."""
    from bisect import bisect_left, insort

    rooms, opened = [], 0
    for x in sorted(Counter(counts).elements(), reverse=True):
        i = bisect_left(rooms, x)
        if i < len(rooms):
            room = rooms.pop(i)
        else:
            room, opened = capacity, opened + 1
        insort(rooms, room - x)
    return opened


def histogram(kind):
    r = random.Random(3)
    draw = {
        "thirds and halves": lambda: r.choice([r.randint(1300, 1420), r.randint(1900, 2150), r.randint(1030, 1100)]),
        "even": lambda: r.randint(1030, 2400),
        "long": lambda: min(4096, int(r.lognormvariate(7.6, 0.5)) + 1),
    }[kind]
    return Counter(draw() for _ in range(3000))


@pytest.mark.parametrize("kind", ["thirds and halves", "even", "long"])
def test_configurations_beat_best_fit(kind):
    """On hard histograms the programme's plan takes fewer sequences than best fit, and configurations place nearly all large pieces."""
    counts = histogram(kind)
    plain = best_fit_decreasing(counts, 4096)
    assert check_plan(counts, 4096) < plain
    _, placed = packing._plan(counts, 4096, 128, 1024)
    assert placed >= 0.95 * sum(n for x, n in counts.items() if x > 1024)


@pytest.mark.parametrize("seed", range(20))
def test_programme_against_all_bases(seed):
    """The simplex method's total is the least over all basic solutions of a small programme."""
    r = random.Random(seed)
    capacity = 20
    sizes = sorted(r.sample(range(6, 18), 3), reverse=True)
    demand = np.array([r.randint(1, 30) for _ in sizes], float)
    patterns = packing.configurations(sizes, capacity)
    got = packing.fewest(patterns, demand).sum()
    everything = set()
    for counts in itertools.product(range(4), repeat=3):
        if 0 < sum(c * s for c, s in zip(counts, sizes, strict=True)) <= capacity:
            everything.add(counts)
    columns = np.array([*sorted(everything), *(-np.eye(3))]).T
    costs = np.array([1.0] * len(everything) + [0.0] * 3)
    best = np.inf
    for basis in itertools.combinations(range(columns.shape[1]), 3):
        m = columns[:, basis]
        if abs(np.linalg.det(m)) > 1e-9:
            x = np.linalg.solve(m, demand)
            if (x >= -1e-9).all():
                best = min(best, costs[list(basis)] @ x)
    assert abs(got - best) < 1e-3


def test_linear_groups_round_up_and_have_equal_cardinality():
    groups = packing.linear_groups({10: 3, 7: 5, 5: 4}, 4)
    assert [sum(n for _, n in g[1]) for g in groups] == [3, 3, 3, 3]
    assert [g[0] for g in groups] == [10, 7, 7, 5]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(PATH), packing.encoder(PATH)
    texts = ["", " ", "Hello, WORLD's don't 123 4é", "ΑΣ ΣΑ σας İstanbul ﬁ ½ 漢字 😀!!", "a\x1cb c\x85d e f", "<|endoftext|> x <|startoftext|>y", words(1, 500), "x" * 3000, "é ẛ̣"]
    for t in texts:
        got = encode(t)
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == library.encode(t, add_special_tokens=False).ids, t


def test_packing_documents(odd_docs, no_docs):
    encode = packing.encoder(PATH)
    rows = packing.best_fit_packing(odd_docs, PATH, keep_ids=True).collect()
    want = []
    for d in odd_docs.collect():
        ids = encode(d["text"] or "") + (1).to_bytes(4, "little")
        want += [(d["doc_id"], k, a // 4, len(ids[a : a + 16384]) // 4, zlib.crc32(ids[a : a + 16384])) for k, a in enumerate(range(0, len(ids), 16384))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.best_fit_packing(no_docs, PATH).count() == 0
