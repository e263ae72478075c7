import random

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import fingerprints as fp
from graphloom.llm.shared import likely_in
from tests.llm.helpers import docs


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.text("ab\U0001f600é", max_size=40), st.text("ab\U0001f600é", max_size=40), st.integers(0, 40), st.integers(0, 40), st.integers(0, 40))
def test_spans(x, y, a, b, n):
    p, q = fp.Prefixes(x), fp.Prefixes(y)
    inside = a + n <= len(x) and b + n <= len(y)
    assert p.equal(a, q, b, n) == (inside and x[a : a + n] == y[b : b + n])
    if a <= len(x) and b <= len(y):
        assert p.forward(a, q, b) == common(x[a:], y[b:])
        assert p.backward(a, q, b) == common(x[:a][::-1], y[:b][::-1])


def test_predecessors(spark):
    head = "h" * fp.HEAD
    texts = [head + "abc", head + "abd", "other", head + "abc", "", None, head + "xbc"]
    got = {r["doc_id"]: r for r in fp.compare(docs(spark, *texts)).collect()}
    assert [got[i]["copy_of"] for i in range(1, 8)] == [1, 2, 3, 1, 5, 5, 7]
    assert [got[i]["previous_id"] for i in range(1, 8)] == [None, 1, None, 2, None, None, 4]
    assert (got[2]["common_prefix"], got[2]["common_suffix"]) == (fp.HEAD + 2, 0) and (got[7]["common_prefix"], got[7]["common_suffix"]) == (fp.HEAD, 2)


def test_runs_of_a_large_group(spark, monkeypatch):
    head = "h" * fp.HEAD
    texts = [head + "x" * (i % 5) + str(i) for i in range(23)]
    want = sorted(map(tuple, fp.compare(docs(spark, *texts)).collect()))
    monkeypatch.setattr(fp, "RUN", 4)
    assert sorted(map(tuple, fp.compare(docs(spark, *texts)).collect())) == want
    assert [r[5] for r in want] == [None, *range(1, 23)]


def test_several_texts_under_one_id(spark):
    df = docs(spark, "short").unionByName(docs(spark, "longer text"))
    (r,) = fp.compare(df).collect()
    assert r["n_chars"] == 11


def test_bitmap_filter_loses_nothing(spark):
    rows, wanted = spark.range(5000), spark.range(0, 5000, 37)
    kept = {r[0] for r in likely_in(rows, rows["id"], wanted).collect()}
    assert set(range(0, 5000, 37)) <= kept and len(kept) < 400
    assert likely_in(rows, rows["id"], wanted.where("false")).count() == 0


def maximal(x, y):
    """All maximal common spans of LEAST characters or more, by brute force."""
    out = []
    for shift in range(-len(y) + 1, len(x)):
        a, b, n = max(shift, 0), max(-shift, 0), 0
        for k in range(min(len(x) - a, len(y) - b) + 1):
            if a + k < len(x) and b + k < len(y) and x[a + k] == y[b + k]:
                n += 1
            else:
                if n >= fp.LEAST:
                    out.append((a + k - n, b + k - n, n))
                n = 0
    return out


def test_spans_anywhere_against_brute_force(spark):
    """Passages in the middle and at the end, copies edited in their first characters, a repeated passage, spans just below and at the least length."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh \U0001f600") for _ in range(n))
    passage, long, line = word(90), word(700), word(fp.LEAST)
    texts = [word(200) + passage + word(150), word(31) + passage, "X" + long, "Y" + long[1:], long[:300] + "#" + long[301:] + word(20), word(40) + long[250:600] + word(50), line + "|" + line, word(77) + line, word(20) + line[1:] + "~", "h" * 80, "h" * 75 + "!", passage, passage, "", "short"]
    got = sorted(tuple(x) for x in fp.shared_spans(docs(spark, *texts)).collect())
    want = sorted((j + 1, i + 1, *s) for j in range(len(texts)) for i in range(j) if texts[i] != texts[j] and texts[j] not in texts[:j] for s in maximal(texts[j], texts[i]))
    assert got == want and {(2, 1), (4, 3), (5, 4), (6, 5), (8, 7)} <= {x[:2] for x in want}
    plain = {x["doc_id"]: x["previous_id"] for x in fp.compare(docs(spark, *texts)).collect()}
    assert plain[2] is None and plain[4] is None


def test_spans_of_random_copies(spark):
    r = random.Random(8)
    base = "".join(r.choice("ab") for _ in range(900))
    texts = []
    for _ in range(14):
        t = list(base[r.randrange(300) : 900 - r.randrange(300)])
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = r.choice("abc")
        texts.append("".join(t))
    df = docs(spark, *texts).repartition(3)
    got = sorted(tuple(x) for x in fp.shared_spans(df.unionByName(df)).collect())
    assert got == sorted((j + 1, i + 1, *s) for j in range(14) for i in range(j) for s in maximal(texts[j], texts[i]))


def test_spans_do_not_depend_on_batches(spark):
    df = docs(spark, *["x" * i + "The same passage stands in every one of these texts, and is longer than the least length." + str(i) * 3 for i in range(40)])
    want = sorted(map(tuple, fp.shared_spans(df).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, fp.shared_spans(df).collect())) == want and len(want) >= 40 * 39 // 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
