import itertools
import random

from graphloom.llm import licenses
from tests.llm.helpers import docs


def test_increasing_is_longest():
    r = random.Random(3)
    for _ in range(200):
        b = r.sample(range(9), 7)
        got = licenses.increasing(list(enumerate(b)))
        longest = max(len(c) for n in range(8) for c in itertools.combinations(b, n) if list(c) == sorted(c))
        assert len(got) == longest and [y for _, y in got] == sorted(y for _, y in got)


def test_alignment_is_monotone_and_equal():
    r = random.Random(4)
    for _ in range(200):
        a, b = [r.choice("abcdefgh") for _ in range(12)], [r.choice("abcdefgh") for _ in range(10)]
        pairs = licenses.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(licenses.align(list("abc"), list("abc"))) == 3


def test_hits():
    s = licenses.Scanner()
    text = "Some words first. " + licenses.NOTICES["MIT"].replace("Software", "Programme") + " and after. Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0."
    got = [h[0] for h in s.scan(text)]
    assert got == ["MIT", "CC-BY-NC-4.0-notice", "CC-BY-4.0-notice"]
    assert s.scan("the license of a driver was released under the moon") == [] == s.scan("")


def test_pigeonhole_filter_loses_nothing():
    """Windows placed by distinctive words find every notice that keeps the required share of its words."""
    r = random.Random(6)
    s = licenses.Scanner()
    for name, notice in s.notices:
        for _ in range(5):
            drop = set(r.sample(range(len(notice)), len(notice) - s.required(notice)))
            text = " ".join(["lorem"] * 7 + [w for i, w in enumerate(notice) if i not in drop] + ["ipsum"] * 7)
            hits = s.scan(text)
            assert hits, name
            if not drop:
                assert name in [h[0] for h in hits] or max(h[5] for h in hits) >= len(notice)


def test_whole_table_against_all_windows(spark, sf):
    """The query against scanning every text, without Spark's filter."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    s = licenses.Scanner()
    want = sorted((r["doc_id"], *h) for r in df.collect() for h in s.scan(r["text"] or ""))
    assert sorted(tuple(r) for r in licenses.op7_license_scan(spark, sf).collect()) == want and want


def longest(a, b):
    """Words of the longest common subsequence, by its table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(row[j - 1], last[j])
    return row[-1]


def test_hits_and_misses_against_common_subsequences(spark, sf):
    """On small texts: every notice whose words stand there in order, densely enough and without a doubtful word, is found; and no hit says more than a longest common subsequence allows."""
    s = licenses.Scanner()
    notices = dict(s.notices)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = licenses.words(r["text"] or "")
        hits = s.scan(r["text"] or "")
        for name, cover, dense, first, end, n in hits:
            assert n <= longest(w[first:end], notices[name]) and abs(cover - n / len(notices[name])) < 1e-4 and abs(dense - n / (end - first)) < 1e-4
        for name, notice in s.notices:
            for k in range(len(w) - len(notice) + 1):
                if w[k : k + len(notice)] == notice:
                    assert any(f < k + len(notice) and e > k for _, _, _, f, e, _ in hits), (r["doc_id"], name)


def test_long_texts_of_licenses():
    s = licenses.Scanner()
    both = f"Copyright 2020\n{licenses.NOTICES['MIT']}\n\n{licenses.NOTICES['MIT-disclaimer']}"
    assert [h[0] for h in s.scan(both)] == ["MIT", "MIT-disclaimer"]
    assert [h[0] for h in s.scan(licenses.NOTICES["BSD-2-Clause"] + licenses.NOTICES["BSD-3-Clause-third"] + licenses.NOTICES["BSD-disclaimer"])] == ["BSD-2-Clause", "BSD-3-Clause-third", "BSD-disclaimer"]
    assert [h[0] for h in s.scan(licenses.NOTICES["Apache-2.0-header"])] == ["Apache-2.0-header"]


def test_no_notices(spark):
    assert licenses.scan(docs(spark, "All rights reserved."), {}).count() == 0


def test_words_inserted_up_to_the_density_limit():
    """As the alignment of the text without windows, wherever words come between the notice's, and with as many as the density admits."""
    (hit,) = licenses.Scanner().scan("Released under the terms of the MIT License")
    assert hit == ("MIT-notice", 1.0, 0.625, 0, 8, 5)
    r = random.Random(7)
    met = tried = 0
    for name, text in licenses.NOTICES.items():
        s = licenses.Scanner({name: text})
        ((_, notice),) = s.notices
        for kept in {len(notice), s.required(notice)}:
            most = int(kept / s.density) - kept
            for k in {most, most // 2, most * 3 // 4}:
                for spread in (False, True):
                    some = sorted(r.sample(range(len(notice)), kept))
                    gaps = [r.randrange(1, kept) if spread else kept // 2 for _ in range(k)]
                    w = ["lorem"] * 150
                    for j, at in enumerate(some):
                        w += ["ipsum"] * gaps.count(j) + [notice[at]]
                    w += ["dolor"] * 150
                    whole = licenses.align(w, notice)
                    length = whole[-1][0] - whole[0][0] + 1
                    if len(whole) >= s.required(notice) and len(whole) / length >= s.density:
                        hits = s.scan(" ".join(w))
                        assert [h[5] >= len(whole) for h in hits] == [True], (name, kept, k, spread, hits)
                        met += 1
                    tried += 1
    assert met > 0.8 * tried
    s = licenses.Scanner({"MIT": licenses.NOTICES["MIT"]})
    w = licenses.words(licenses.NOTICES["MIT"])
    assert not s.scan(" ".join([*w[:50], *["ipsum"] * len(w), *w[50:]]))


def test_stray_words_in_a_wide_window_do_not_hide_a_notice():
    got = licenses.Scanner().scan("the MIT reader says: Released under the MIT License. The next License is released.")
    assert [(h[0], h[5]) for h in got] == [("MIT-notice", 5)] and got[0][2] == 1.0
