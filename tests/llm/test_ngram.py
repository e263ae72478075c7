import random

import numpy as np

from graphloom.llm import ngram_join as nj
from tests.llm.helpers import docs


def grams(text, n=nj.NGRAM):
    import re

    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(texts, t=nj.THRESHOLD):
    g = [grams(x) for x in texts]
    out = {}
    for i in range(len(g)):
        for j in range(i + 1, len(g)):
            both = len(g[i] & g[j])
            if both and both / len(g[i] | g[j]) >= t:
                out[i + 1, j + 1] = (both, len(g[i]), len(g[j]))
    return out


def made(n=160, seed=3):
    """Groups of near copies of any closeness, one passage that all share, short and empty texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [r.choice(words) for _ in range(25)]
    out = []
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.choice([2, 4, 40, 120]))]
        for _ in range(r.choice([1, 1, 3, 12])):
            x = [r.choice(words) if r.random() < r.choice([0, 0.02, 0.1]) else w for w in base]
            out.append(" ".join(x + shared if r.random() < 0.3 else x))
    return [*out[:n], "", None, "solo", "SOLO!"]


def test_pairs_against_brute_force(spark):
    texts = made()
    want = brute(texts)
    got = {(r["doc_a"], r["doc_b"]): (r["overlap"], r["n_a"], r["n_b"]) for r in nj.jaccard_pairs(docs(spark, *texts)).collect()}
    assert got == want and len(want) > 50


def test_cells_do_not_change_the_pairs(spark, monkeypatch):
    texts = made(80, 5)
    whole = sorted(map(tuple, nj.jaccard_pairs(docs(spark, *texts)).collect()))
    monkeypatch.setattr(nj, "CELL", 4)
    assert sorted(map(tuple, nj.jaccard_pairs(docs(spark, *texts)).collect())) == whole


def test_chunks_of_groups_do_not_change_the_pairs(spark, monkeypatch):
    texts = made(80, 6)
    monkeypatch.setattr(nj, "GROUP", 2)
    got = {(r["doc_a"], r["doc_b"]): (r["overlap"], r["n_a"], r["n_b"]) for r in nj.jaccard_pairs(docs(spark, *texts)).collect()}
    assert got == brute(texts)


def test_divide_skip_is_the_count():
    r = np.random.default_rng(2)
    for k in range(60):
        n, d = 12, 9
        member = r.random((n, d)) < r.random((n, 1))
        key = np.array([i * d + j for i in range(n) for j in range(d) if member[i, j]])
        lists = np.arange(n)
        begin, end = np.searchsorted(key, lists * d + 2), np.searchsorted(key, lists * d + 7)
        for t in (1, 3, 6):
            for mu in (0.01, 1.0, 10.0):
                found, seen = nj.divide_skip(key, d, lists, begin, end, t, mu)
                count = member[:, 2:7].sum(0)
                assert found.tolist() == [j + 2 for j in range(5) if count[j] >= t] and seen.tolist() == [count[j - 2] for j in found]
            lens = end - begin
            rows = [(key[a:b] - i * d).tolist() for i, (a, b) in enumerate(zip(begin, end, strict=True))]
            heap, runs = nj.heap_merge(rows, t), nj.run_merge(key, lists * d, begin, lens, t)
            assert heap == tuple(x.tolist() for x in runs) == ([j for j in range(d) if member[:, 2:7].sum(0)[j - 2 : j - 1].sum() >= t and 2 <= j < 7], heap[1]), k


def test_bitmaps_never_refuse_a_similar_pair():
    texts = made(120, 8)
    value, start = nj.ngram_sets([x or "" for x in texts], nj.NGRAM)
    maps = nj.parity_bitmaps(value, start)
    sizes = np.diff(start).tolist()
    ask = lambda i, j: nj.admits(sizes[i], int.from_bytes(maps[i], "little"), 8 * len(maps[i]), sizes[j], int.from_bytes(maps[j], "little"), 8 * len(maps[j]), nj.THRESHOLD)
    want = brute(texts)
    assert all(ask(a - 1, b - 1) and ask(b - 1, a - 1) for a, b in want)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sizes[i] and sizes[j]]
    assert sum(ask(i, j) for i, j in pairs) < len(want) + 0.05 * len(pairs)


def test_classes_against_brute_force(spark, monkeypatch):
    texts = [*made(120, 12), "one two three four five", "One two, three four FIVE!", "one two three four five"]
    pairs = brute(texts)
    least = {i: i for i in range(1, len(texts) + 1)}
    for _ in texts:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    want = {i: (c, len(grams(texts[i - 1])), sum(i in p for p in pairs)) for i, c in least.items()}
    df = docs(spark, *texts)
    take = lambda df: {r["doc_id"]: (r["class_id"], r["n_grams"], r["n_links"]) for r in nj.similarity_classes(df).collect()}
    assert take(df) == want
    monkeypatch.setattr(nj, "CELL", 4)
    assert take(df.unionByName(df).repartition(3)) == want


def test_one_of_each_group_stays(spark):
    texts = made(120, 9)
    pairs = brute(texts)
    least = {i: i for i in range(1, len(texts) + 1)}
    for _ in texts:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    kept = {r["doc_id"] for r in nj.keep_one_per_group(docs(spark, *texts)).collect()}
    assert kept == {i for i, l in least.items() if i == l}


def test_a_shared_passage_is_no_copy(spark):
    r = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"x{r.random()}" for _ in range(100)) + " " + passage for _ in range(30)]
    assert nj.jaccard_pairs(docs(spark, *texts)).count() == 0
    assert nj.keep_one_per_group(docs(spark, *texts)).count() == 30
