"""Vector codes against plain whole-number arithmetic, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from tapelab.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, x int, code string"


def plain(rows, rounds=vc.ROUNDS):
    """Codes, errors and codebooks of (vec_id, embedding, label) rows, in Python integers."""
    kept = [(i, [math.floor(1024 * v) if abs(v) < 2**53 else 1024 * int(v) for v in e], y) for i, e, y in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    w = -(-max((len(e) for _, e, _ in kept), default=0) // 4)
    kept = [(i, e + [0] * (4 * w - len(e)), y) for i, e, y in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[e[p * w : p * w + w] for _, e, _ in first] for p in range(4)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    best = lambda a, book: min((far(a, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            at = [(best(e[p * w : p * w + w], books[p])[1], e[p * w : p * w + w]) for _, e, _ in kept]
            for k in range(len(books[p])):
                mine = [x for c, x in at if c == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    out = []
    for i, e, y in kept:
        found = [best(e[p * w : p * w + w], books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
    total = {}
    for _, _, d, y in out:
        total[y] = total.get(y, 0) + d
    fits = lambda n: n if n < 2**63 else None
    return sorted(((i, c, fits(d), fits(total[y]), digest) for i, c, d, y in out), key=str)


def got(spark, rows, rounds=vc.ROUNDS, parts=3):
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in vc.compress(df, rounds).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_sequency_order():
    for n in (1, 2, 8, 32):
        h = np.array([[1]])
        while len(h) < n:
            h = np.block([[h, h], [h, -h]])
        assert ((np.diff(h[vc.by_sequency(n)], axis=1) != 0).sum(1) == np.arange(n)).all()
        x = np.arange(n)[None, :] ** 2
        assert (vc.transform(x) == x @ h[vc.by_sequency(n)].T).all()


@pytest.mark.parametrize("width,entries", [(16, 256), (5, 9), (1, 3), (0, 2)])
def test_nearest_with_ties(width, entries):
    rng = np.random.default_rng(width)
    x = rng.integers(-4, 4, (2 * vc.BLOCK + 7, width))
    book = np.vstack([x[: entries // 2], x[: entries - entries // 2]])  # entries that repeat: ties
    full = ((x[:, None] - book) ** 2).sum(2)
    at, far = vc.nearest(x, book)
    assert (at == full.argmin(1)).all() and (far == full.min(1)).all()
    big = x.astype(object) * 10**30
    at, far = vc.nearest(big[:50], book.astype(object) * 10**30)
    assert (at == full[:50].argmin(1)).all() and (far == full[:50].min(1).astype(object) * 10**60).all()


def test_against_plain_arithmetic(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(400), [rng.gauss(k % 5, 1) for _ in range(12)], rng.choice([None, 1, 2])) for k in range(700)]
    rows += rows[:40]  # rows that repeat
    assert got(spark, rows) == plain(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None, 2.0, 3.0], 1), (3, [1.0, nan, 2.0, 3.0], 1), (4, [1.0, inf, 2.0, 3.0], 1), (None, [0.5, -0.5, 0.25, 1e-9], None), (5, [-1e-9, 0.0, 1.0, 2.0], None), (5, [-1e-9, 0.0, 1.0, 2.0], 7), (6, [], 7), (7, [1.0, 2.0, 3.0, 4.0, 5.0], 7)]
    assert got(spark, rows, parts=4) == plain(rows) and len(plain(rows)) == 5
    assert got(spark, []) == [] and got(spark, rows[:4]) == []
    huge = [(1, [1e38, -1e38, 3.0, 1e12], 1), (2, [2e38, 5.0, -3.5, 1e12], 1), (3, [1.0, 1.0, 1.0, 1.0], 2)]
    huge += [(k, [1e37 * k, 1.0, 1.0, 1.0], 2) for k in range(4, 300)]
    assert got(spark, huge) == plain(huge)
    assert got(spark, [(6, [], None)]) == plain([(6, [], None)])
