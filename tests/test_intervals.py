import random

import pytest

from braidframe.operators import intervals

SCHEMA = "run string, node bigint, s bigint, e bigint, lo string, hi string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def brute(rows):
    by = {}
    for run, node, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault((run, node), []).append((s, e))
    gaps, periods = set(), set()
    for k, spans in by.items():
        spans.sort()
        a, b = spans[0]
        for s, e in spans[1:]:
            if s > b:
                periods.add((*k, a, b))
                gaps.add((*k, b, s))
                a, b = s, e
            b = max(b, e)
        periods.add((*k, a, b))
    return gaps, periods


def both(spark, rows):
    df = frame(spark, rows)
    got = [{tuple(r) for r in f(df, ["run", "node"], "s", "e").collect()} for f in (intervals.gaps, intervals.periods)]
    counts = [f(df, ["run", "node"], "s", "e").count() for f in (intervals.gaps, intervals.periods)]
    assert counts == [len(g) for g in got]
    return tuple(got)


CASES = {
    "touching": [("a", 1, 0, 10), ("a", 1, 10, 20)],
    "nested and equal": [("a", 1, 0, 100), ("a", 1, 5, 6), ("a", 1, 0, 100), ("a", 1, 99, 130)],
    "gap of one": [("a", 1, 0, 10), ("a", 1, 11, 20)],
    "nulls and empty ones": [("a", 1, None, 5), ("a", 1, 5, None), ("a", 1, 7, 7), ("a", 1, 9, 3), ("b", 1, 3, 4)],
    "null keys": [(None, None, 0, 5), (None, None, 8, 9), ("a", None, 1, 2), (None, 1, 4, 6), (None, 1, 9, 12)],
    "negative": [("a", 1, -50, -20), ("a", 1, -10, 10), ("a", 1, 30, 64)],
    "across cells": [("a", 1, 2**36 - 5, 2**36 + 5), ("a", 1, 2**36 + 5, 2**37), ("a", 1, 2**37 + 1, 2**37 + 2)],
    "long over short": [("a", 1, 0, 2**45 + 3), ("a", 1, 2**36 + 7, 2**36 + 9), ("a", 1, 2**40, 2**40 + 1), ("a", 1, 2**45 + 10, 2**45 + 20)],
    "aligned words": [("a", 1, 0, 64), ("a", 1, 64, 4096), ("a", 1, 4096, 4096 * 64), ("a", 1, 4096 * 64 + 1, 4096 * 65)],
    "extremes": [("a", 1, -(2**60), -(2**60) + 1), ("a", 1, 2**60 - 1, 2**60)],
    "empty": [],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    assert both(spark, CASES[name]) == brute(CASES[name])


def test_random(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(4000):
        key = ("hot", 0) if rng.random() < 0.4 else (f"r{rng.randint(0, 60)}", rng.randint(0, 3))
        s = rng.randint(0, 2 ** rng.choice([8, 20, 37, 41]))
        rows.append((*key, s, s + rng.randint(1, 2 ** rng.choice([1, 6, 7, 12, 13, 24, 38]))))
    assert both(spark, rows) == brute(rows)


def cover(group, a, b):
    """group -> sorted blocks (lo, hi)."""
    import numpy as np

    out = {}
    for r, (words, masks) in enumerate(intervals.blocks(np.array(group), np.array(a), np.array(b))):
        for w, mask in zip(words.tolist(), masks.tolist(), strict=True):
            for slot in range(64):
                if mask >> slot & 1:
                    lo = (((w % 2**30) << 6) + slot) << (6 * r)
                    out.setdefault(w >> 30, []).append((lo, lo + (1 << 6 * r)))
    return {g: sorted(v) for g, v in out.items()}


def test_blocks_of_one_interval():
    rng = random.Random(2)
    rows = [(i, s, min(s + n, 2**36)) for i, (s, n) in enumerate((rng.randint(0, 2**35), rng.randint(1, 2 ** rng.choice([4, 20, 35]))) for _ in range(200))]
    got = cover(*zip(*rows, strict=True))
    for i, s, e in rows:
        found = got[i]
        assert found[0][0] == s and found[-1][1] == e and all(x[1] == y[0] for x, y in zip(found, found[1:]))
        assert len(found) <= 2 * 64 * 6


def test_siblings_merge_upward_and_covered_blocks_go():
    assert cover([0, 0], [0, 30], [30, 64]) == {0: [(0, 64)]}
    assert cover([0] * 64, [64 * i for i in range(64)], [64 * i + 64 for i in range(64)]) == {0: [(0, 4096)]}
    assert cover([0] * 3, [0, 1, 70], [4096, 2, 130]) == {0: [(0, 4096)]}
    # filled level by level, up to the whole cell
    assert cover([3] * 4, [0, 1, 2**20 + 5, 2**35], [1, 2**20 + 5, 2**35, 2**36]) == {3: [(i << 30, (i + 1) << 30) for i in range(64)]}
    assert cover([0, 1], [0, 5], [5, 9]) == {0: [(i, i + 1) for i in range(5)], 1: [(i, i + 1) for i in range(5, 9)]}


def test_one_cell_over_many_batches(spark):
    rng = random.Random(6)
    rows = [("hot", 1, s, s + rng.randint(1, 9000)) for s in (rng.randint(0, 2**33) for _ in range(25_000))] + [("hot", 1, 5, 2**32), ("hot", 1, 2**36 - 7, 2**38 + 9)]
    assert both(spark, rows) == brute(rows)
