"""Collocations against plain counting, the double array against a dictionary, and edge cases; SQL is compared in test_bruteforce.py."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapelab.llm import collocations as co
from tapelab.llm.wordhash import Words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        some = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + z] for p, a in some.items() for z in range(2, len(p)) for i in range(len(p) - z + 1) if 100 * a >= 80 * some[p[i : i + z]]}
        scored = []
        for p, a in some.items():
            if p not in gone:
                score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def got(spark, rows, least=30, top=2000, parts=3, **more):
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, lang string, key string, n int, seed int").repartition(parts)
    return sorted(tuple(r) for r in co.mine(df, least=least, top=top, **more).collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    voc = ["a", "B", "über", "日本", "d|e", "f-g", "Ünder", "x" * 40, "it's", "I"]
    line = lambda: "".join(r.choice(voc) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(r.randint(1, 60)))
    out = [(i, line(), r.choice(["en", "de", None, "und"])) for i in range(250)]
    return out + [(i, "New  York\tCity hall", "en") for i in range(40)] + [(1, None, "en"), (2, "", None), (3, " ,. ", "fr"), (None, "only here once", "fr")] + out[:30]


def test_against_plain_counting(spark, rows):
    want = plain(rows, 30, 2000)
    assert len(want) > 20 and got(spark, rows) == want
    assert got(spark, rows, least=7, top=5) == plain(rows, 7, 5)
    # several tries, each with a pass of its own, count the same
    assert got(spark, rows, least=7, max_phrases=50, parts=1) == plain(rows, 7, 2000)


def test_edges(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None), (2, "", "en"), (3, "some words", "en")]) == []
    long = [(1, "alpha beta gamma " * 70_000, "en"), (2, "y" * 600_000, "en")]
    assert got(spark, long) == plain(long, 30, 2000)
    ties = [(i, f"p{i % 40} q{i % 40}. z{i % 40} y{i % 40}", None) for i in range(1200)]
    assert got(spark, ties, top=50) == plain(ties, 30, 50)


def test_trie_holds_what_was_put_in():
    r = random.Random(1)
    phrases = sorted({" ".join(f"w{min(int(r.expovariate(0.02)), 300)}" for _ in range(r.randint(1, 4))).encode() for _ in range(3000)})
    seeds = np.array([r.choice([5, 2**63 + 9]) for _ in phrases], np.uint64)
    trie = co.build_trie(seeds, *co.word_hashes(phrases), np.arange(len(phrases)))
    w = Words(phrases)
    for i, p in enumerate(phrases):
        for seed in (5, 2**63 + 9):
            there, state = trie.step(np.zeros(1, np.int64), np.array([trie.langs[seed]]))
            for h in w.hash[w.first[i] : w.first[i + 1]]:
                there, state = trie.step(state, trie.words.get(np.full(len(state), h)).astype(np.int64))
            number = int(trie.accept[state[0]]) if len(state) else -1
            assert number == (i if seeds[i] == seed else -1)


def test_products_beyond_64_bits(spark):
    big = spark.createDataFrame([("en", 1, "a", 10**15), ("en", 1, "b", 10**15 + 1), ("en", 2, "a b", 10**15 - 7)], "lang string, k int, phrase string, f long")
    assert [r["score"] for r in co.scored(big).collect()] == [2_000_000 * (10**15 - 7) // (2 * 10**15 + 1)]


def test_a_trie_is_built_in_little_memory():
    """The driver builds it. Before its arrays were narrower it took 146 bytes an edge, now 91."""
    import tracemalloc

    r = np.random.default_rng(1)
    words = r.integers(1, 2**63, 5_000, dtype=np.uint64)
    hashes = words[np.minimum((r.pareto(0.6, (60_000, 4)) * 20).astype(int), 4_999)]
    hashes = np.unique(hashes, axis=0)
    tracemalloc.start()
    trie = co.build_trie(np.ones(len(hashes), np.uint64), np.full(len(hashes), 4), hashes, np.arange(len(hashes)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 115 * (trie.check >= 0).sum()
