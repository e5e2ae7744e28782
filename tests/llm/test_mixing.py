from collections import Counter, defaultdict

import pytest

from braidframe.llm import bpe, mixing

DOCS = "doc_id bigint, text string, source string, n_tokens string, finish string, weight string"
TARGETS = "source string, target_share double, max_repeats int, n_texts string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x") for i, t, s in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], TARGETS)


def corpus(sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((i, f"{source} text number {k} " + "word " * (k % 7), source))
            i += 1
    return rows


def test_shares_and_repeats(spark):
    rows = corpus({"big": 400, "small": 20, "mid": 100, "unused": 50})
    goal = targets(spark, [("big", 0.6, 1), ("small", 0.1, 3), ("mid", 0.3, 2), ("absent", 0.5, 2)])
    mixed = mixing.mix(docs(spark, rows), goal)
    found = mixed.collect()
    assert [r["finish"] for r in found] == sorted(r["finish"] for r in found)
    uses = Counter((r["source"], r["doc_id"]) for r in found)
    assert max(n for (s, _), n in uses.items() if s == "small") <= 3 and max(n for (s, _), n in uses.items() if s == "big") == 1
    share = {r["source"]: r for r in mixing.shares(mixed, goal).collect()}
    longest = max(r["n_tokens"] for r in found)
    total = sum(r["n_tokens"] for r in found)
    for source, want in (("big", 0.6), ("small", 0.1), ("mid", 0.3)):
        assert abs(share[source]["n_tokens"] - want * total) <= 2 * longest
    assert share["absent"]["n_tokens"] == 0 and share["absent"]["reached_share"] == 0 and "unused" not in share
    assert share["small"]["n_uses"] == sum(n for (s, _), n in uses.items() if s == "small")


def test_against_brute_force(spark):
    rows = corpus({"a": 60, "b": 25, "c": 5})
    goal = {"a": (0.5, 2), "b": (0.4, 3), "c": (0.1, 4)}
    found = mixing.mix(docs(spark, rows), targets(spark, [(s, w, r) for s, (w, r) in goal.items()]), budget=900)
    size = {i: bpe.encoder().count(t) for i, t, _ in rows}
    have = defaultdict(int)
    for i, _, s in rows:
        have[s] += size[i]
    _, live = mixing.cutoffs(dict(have), goal, 900)
    got = [(r["source"], r["doc_id"], r["use"], r["finish"]) for r in found.collect()]
    # the whole order of all uses that the repeats allow, from the shuffled passes that came out
    order = defaultdict(list)
    for s, i, use, finish in got:
        order[s].append((i, use, finish))
    for s, uses in order.items():
        served = 0
        for k, (i, use, finish) in enumerate(uses):
            served += size[i]
            assert finish == pytest.approx(served / live[s][0])
            assert use == k // sum(1 for x in rows if x[2] == s) + 1
    total = sum(size[i] for _, i, _, _ in got)
    assert 900 - max(size.values()) < total <= 900
    everything = mixing.mix(docs(spark, rows), targets(spark, [(s, w, r) for s, (w, r) in goal.items()]), budget=10**9)
    front = [(r["source"], r["doc_id"], r["use"], r["finish"]) for r in everything.collect()]
    assert front[: len(got)] == got and size[front[len(got)][1]] + total > 900
    assert Counter(s for s, *_ in front) == {"a": 120, "b": 75, "c": 20}


def test_cutoffs():
    goal = {"a": (0.5, 1), "b": (0.25, 2), "none": (0.25, 1)}
    end, live = mixing.cutoffs({"a": 100, "b": 10}, goal, None)
    assert live["a"][0] == pytest.approx(2 / 3) and end == pytest.approx(60.0)  # b: 20 tokens at a third
    end, _ = mixing.cutoffs({"a": 100, "b": 10}, goal, 80)
    assert end * 2 / 3 == pytest.approx(60.0)  # b ran out at 20, a fills the rest
    assert mixing.cutoffs({"a": 100, "b": 10}, goal, 10**6)[0] * 2 / 3 >= 100
    assert mixing.cutoffs({}, goal, None) == (0.0, {})


def test_equal_texts_count_as_one(spark):
    rows = [(1, "same text", "a"), (2, "same text", "a"), (3, "same text", "b"), (4, "other", "a"), (5, "b only", "b")]
    texts = {(r["source"], r["doc_id"]) for r in mixing.supply(docs(spark, rows), targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)])).collect()}
    assert texts == {("a", 1), ("a", 4), ("b", 5)}


def test_nulls_and_empties(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "text", None), (4, "text of a", "a")]
    goal = targets(spark, [("a", 1.0, 2), (None, 0.5, 1), ("b", None, 1), ("c", 0.3, None), ("d", 0.0, 1)])
    assert {r["doc_id"] for r in mixing.mix(docs(spark, rows), goal).collect()} == {4}
    assert mixing.mix(docs(spark, []), goal).count() == 0
    assert mixing.mix(docs(spark, rows), targets(spark, [])).count() == 0
    assert mixing.shares(mixing.mix(docs(spark, []), goal), goal).where("n_tokens > 0").count() == 0


def test_hot_source_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 10)
    rows = corpus({"hot": 300, "b": 40})
    goal = targets(spark, [("hot", 0.8, 1), ("b", 0.2, 2)])
    one = [tuple(r) for r in mixing.mix(docs(spark, rows), goal).collect()]
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 10**9)
    assert [tuple(r) for r in mixing.mix(docs(spark, rows), goal).collect()] == one
