import itertools
import random

import numpy as np

from graphloom.llm import language_id as li
from tests.llm.helpers import docs


def test_held_out_accuracy(spark, sf):
    """Fitted on half of the documents, tested on the other half, whose labels are not used."""
    df = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    model = li.fit(df.where("doc_id % 2 = 0"))
    rows = li.identify(df.where("doc_id % 2 = 1"), model).join(df, "doc_id").collect()
    right = sum(r["primary"] == r["lang"] for r in rows)
    assert right / len(rows) > 0.97
    assert sum(r["accepted"] for r in rows) / len(rows) > 0.99


def test_mixtures_are_found(spark, sf):
    df = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").toPandas()
    model = li.fit(spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet"))
    words = {k: " ".join(g["text"].fillna("")).split() for k, g in df.groupby("lang")}
    r = random.Random(1)
    good = 0
    for _ in range(40):
        a, b = r.sample(sorted(words), 2)
        text = " ".join(words[a][r.randrange(len(words[a]) - 99) :][:90] + words[b][r.randrange(len(words[b]) - 50) :][:40])
        ((langs, share, *_),) = li.infer([text], *model)
        good += langs[:2] == [a, b] and abs(share[0] - 90 / 130) < 0.15
    assert good >= 32


def test_noise_has_no_language(spark, sf):
    model = li.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    r = random.Random(2)
    noise = " ".join("".join(r.choice("qxzjkvw") for _ in range(7)) for _ in range(60))
    assert not li.accepts(li.infer([noise], *model)[0])
    assert not li.accepts(li.infer(["1234 !!"], *model)[0])
    ask = lambda text: li.accepts(li.infer([text], *model)[0])
    assert not ask("qxz vvk jjw xqz"), "short noise is noise"
    dump = " ".join(f"{r.getrandbits(64):016x}" for _ in range(300))
    assert not ask(dump + " qxz vvk"), "a dump of keys has no language, whatever few words stand in it"
    assert ask("the") and ask("and the")


def subsets(ll, penalty):
    """The best penalised likelihood over all sets of components, by a plain EM for each."""
    best = -np.inf
    for k in range(1, ll.shape[1] + 1):
        for s in itertools.combinations(range(ll.shape[1]), k):
            p, share = np.exp(ll[:, s].astype(float)), np.full(k, 1 / k)
            for _ in range(400):
                r = p * share
                share = (r / r.sum(1, keepdims=True)).mean(0)
            best = max(best, np.log((p * share).sum(1)).sum() - penalty * 0.5 * np.log(len(ll) + 1) * (k - 1))
    return best


def test_language_sets_against_all_subsets(spark, sf):
    """The penalised likelihood of the chosen set is that of the best of all sets, or within a nat of it (EM stops after ROUNDS)."""
    df = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    langs, logs = li.fit(df)
    words = {k: " ".join(g["text"].fillna("")).split() for k, g in df.toPandas().groupby("lang")}
    r = random.Random(4)
    close = 0
    for n in range(24):
        parts = r.sample(sorted(words), 1 + n % 3)
        text = " ".join(w for k in parts for w in words[k][r.randrange(len(words[k]) - 60) :][: r.randrange(10, 60)])
        ((names, _, n_words, like, _),) = li.infer([text], langs, logs)
        gram, word, _ = li.trigrams([text])
        best = subsets(np.add.reduceat(logs[gram], word, axis=0), li.PENALTY)
        close += best - (like - li.PENALTY * 0.5 * np.log(n_words + 1) * (len(names) - 1)) < 1
    assert close >= 22


def test_expectation_maximisation_climbs():
    r = np.random.default_rng(3)
    ll = r.normal(size=(200, 3)).astype(np.float32) * 3
    first = np.array([0, 50, 200])
    allowed = np.ones((2, 3), np.bool_)
    likes = [li._em(ll, first, allowed, k)[1] for k in range(8)]
    assert all((b >= a - 1e-3).all() for a, b in zip(likes, likes[1:], strict=False))
    share, _ = li._em(ll, first, allowed, 200)
    grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, 1, 51) for b in np.linspace(0, 1 - a, 51)]
    best = max(np.log(np.exp(ll[:50]) @ g).sum() for g in grid)
    assert np.log(np.exp(ll[:50]) @ share[0]).sum() >= best - 0.05


def test_words():
    gram, word, first = li.trigrams(["ab cd9 e", "", "99"])
    assert len(gram) == 6 and word.tolist() == [0, 2, 5] and first.tolist() == [0, 3, 3, 3]


def test_sample_is_bounded(spark):
    df = docs(spark, *["the cat sat"] * 20)
    langs, logs = li.fit(df, per_language=3)
    assert langs == ["en"] and logs.shape == (li.BUCKETS, 2)
