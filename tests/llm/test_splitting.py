import random

from hypothesis import given, settings
from hypothesis import strategies as st

from braidframe.llm import bpe, splitting

DOCS = "doc_id bigint, text string, source string, piece string, max_tokens string"
LIMITS = "source string, max_tokens int, overlap_tokens int"


def check(text, limit, overlap):
    enc = bpe.encoder()
    found = splitting.Splitter(enc).pieces(text, limit, overlap)
    assert found[0][0] == 0 == found[0][1] and found[-1][2] == len(text)
    for start, fresh, end, n in found:
        assert start <= fresh < end and n == enc.count(text[start:end])
        assert n <= limit or end - fresh == 1
    for a, b in zip(found, found[1:]):
        assert a[2] == b[1] and b[0] >= a[0]
    return found


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=120), st.integers(1, 20), st.integers(0, 25))
def test_any_text(text, limit, overlap):
    check(text, limit, overlap)


def test_cut_at_headings():
    sections = [f"# Title {i}\n" + "Some words follow here. " * 20 + "\n\n" for i in range(6)]
    found = check("".join(sections), 130, 0)
    starts = [sum(map(len, sections[:i])) for i in range(6)]
    assert [p[0] for p in found] == starts


def test_small_siblings_are_merged():
    items = "".join(f"- item {i} of the list\n" for i in range(40))
    found = check(items, 60, 0)
    assert all(items[p[0]] == "-" for p in found) and len(found) < 12


def test_nested_lists_stay_together():
    block = "- parent\n" + "".join(f"    - child {k} with words\n" for k in range(5))
    found = check(block * 8, 60, 0)
    assert all((block * 8)[p[0] :].startswith("- parent") for p in found)


def test_packs_of_an_oversized_section_stand_for_themselves():
    big = "# A\n" + "".join(f"Paragraph {i} of the first section has some words.\n\n" for i in range(14))
    small = ["# B\nshort text\n\n", "# C\nshort text as well\n"]
    text = big + "".join(small)
    found = check(text, 100, 0)
    cut = len(big)
    assert any(p[0] == cut for p in found), "no piece holds the end of A with B"
    assert [text[p[0] : p[2]] for p in found if p[0] >= cut] == ["".join(small)]


def test_fences_are_no_headings():
    code = "```python\n# comment\nx = 1\n\n# another\ny = 2\n```\n"
    assert splitting.outline("# T\n" + code + "after\n")[:2] == [(0, 1), (4, 7)]
    assert all(d >= 7 for _, d in splitting.outline("# T\n" + code + "after\n")[1:])
    assert [d for _, d in splitting.outline("~~~\n# a\n~~~\n# b\n")] == [7, 40, 40, 1]


def test_underlined_headings_tables_and_markup():
    nodes = splitting.outline("Title\n=====\n\ntext\n\nSub\n---\n\n| a | b |\n| 1 | 2 |\ntail\n")
    assert [d for _, d in nodes] == [1, 7, 2, 7, 40, 7]
    nodes = splitting.outline("<div>one</div><p>two</p><h2>three</h2><ul><li>x</li><li>y</li></ul>")
    assert [d for _, d in nodes].count(7) >= 3 and 2 in [d for _, d in nodes]
    assert splitting.outline(" \n\n") == [(0, 7)] and splitting.outline("") == [(0, 7)]


def test_rows_of_a_table_are_not_cut():
    table = "".join(f"| row {i} | some value {i} | more |\n" for i in range(60))
    assert all(table[p[0]] == "|" for p in check(table, 80, 0))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 '\n\té中😀.-#|<p>`~="), max_size=80), st.data())
def test_counts_by_difference(text, data):
    enc = bpe.encoder()
    m = splitting.Measured(enc, text)
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    assert m.count(a, b) == enc.count(text[a:b])


def test_sentences_in_one_line():
    text = " ".join(f"Sentence number {i} ends here." for i in range(60))
    found = check(text, 50, 0)
    assert all(text[p[0] :].lstrip().startswith("Sentence") for p in found)


def test_overlap_is_exact_on_words():
    text = " ".join(f"word{i}" for i in range(2000))
    enc = bpe.encoder()
    found = check(text, 100, 20)
    assert {enc.count(text[s:f]) for s, f, _, _ in found[1:]} == {20}


def test_text_without_boundary():
    rng = random.Random(1)
    text = "".join(rng.choice("0123456789abcdef") for _ in range(20_000))
    assert len(check(text, 256, 16)) > 20
    check("中" * 3000, 100, 10)
    check("😀" * 50, 2, 1)


def test_overlap_larger_than_limit():
    check("one two three four five six seven eight nine ten", 3, 50)


def test_table(spark):
    long = "word " * 300
    rows = [(1, long, "a"), (2, "short", "a"), (3, None, "a"), (4, "", "a"), (5, long, "none"), (6, long, None), (7, long, "b"), (8, " \n" * 900, "a")]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], DOCS)
    limits = spark.createDataFrame([("a", 100, 10), ("a", 120, 5), ("b", None, 3), (None, 10, 1)], LIMITS)
    found = splitting.split_oversized(df, limits).collect()
    assert {r["doc_id"] for r in found} == {i for i, t, s in rows if s == "a" and t and bpe.encoder().count(t) > 100}
    assert all(r["text"] == rows[r["doc_id"] - 1][1][r["start"] : r["end"]] and r["n_tokens"] <= 100 for r in found)
    assert {r["n_pieces"] for r in found if r["doc_id"] == 1} == {sum(r["doc_id"] == 1 for r in found)}
    assert splitting.split_oversized(df.limit(0), limits).count() == 0
    assert splitting.split_oversized(df, limits.limit(0)).count() == 0
    slim = splitting.split_oversized(df, limits, with_text=False)
    assert "text" not in slim.columns and slim.count() == len(found)
