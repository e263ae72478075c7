import random

import numpy as np
import pytest

from graphloom.llm import packing
from tests.llm.helpers import docs


def plain(lengths, capacity, weights, rule):
    """Best fit by its definition, over all bins ever opened."""
    bins, out = [], []
    for n in lengths:
        need = (n, 1, n * n)
        scored = []
        for b, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, need, strict=True)):
                if rule == "norm":
                    scored.append((sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, left, need, capacity, strict=True)), b))
                else:
                    scored.append((-sum(w * (x / c) * (y / c) for w, x, y, c in zip(weights, left, need, capacity, strict=True)), b))
        if scored:
            least = min(s for s, _ in scored)
            b = next(b for s, b in scored if s <= least + 1e-15)
        else:
            b = len(bins)
            bins.append(list(capacity))
        bins[b] = [x - y for x, y in zip(bins[b], need, strict=True)]
        out.append(b)
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_against_the_definition(rule):
    r = random.Random(1)
    for _ in range(15):
        lengths = sorted((r.randint(1, 60) for _ in range(300)), reverse=True)
        cap, w = (100, 7, 5000), (1.0, 0.25, 0.5)
        assert packing.best_fit(np.array(lengths), cap, w, rule).tolist() == plain(lengths, cap, w, rule)


def test_every_piece_once_and_no_bin_over(spark):
    r = random.Random(4)
    texts = [" ".join("w" for _ in range(r.choice([1, 5, 50, 400, 5000, 9000]))) for _ in range(120)]
    rows = packing.pack(docs(spark, *texts, None, ""), shard=40).collect()
    got = {}
    for x in rows:
        got.setdefault(x["doc_id"], []).append((x["piece"], x["first_token"], x["n_tokens"]))
    for i, t in enumerate(texts, 1):
        at = 0
        for k, (piece, first, n) in enumerate(sorted(got[i])):
            assert (piece, first) == (k, at)
            at += n
        assert at == len(t.split())
    bins = {}
    for x in rows:
        bins.setdefault((x["shard"], x["bin"]), []).append(x)
    for b in bins.values():
        n = [x["n_tokens"] for x in b]
        assert (sum(n), len(n), sum(v * v for v in n)) == (b[0]["bin_tokens"], b[0]["bin_docs"], b[0]["bin_attention"])
        assert sum(n) <= packing.MOST_TOKENS and len(n) <= packing.MOST_DOCS and sum(v * v for v in n) <= packing.MOST_ATTENTION
        assert sorted(x["slot"] for x in b) == list(range(len(b)))
    assert len(got) == len(texts)


def test_bad_capacities(spark):
    with pytest.raises(ValueError):
        packing.pack(docs(spark, "a"), capacity=(10, 1, 10), piece=20)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1]), (1, 1, 1), rule="other")
