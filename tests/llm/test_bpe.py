import random

import pytest

from graphloom.llm import bpe
from tests.llm.helpers import docs


@pytest.fixture(scope="module")
def reference():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(bpe.PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    r = random.Random(8)
    alphabet = "aeiourstn  \n\t'éß漢🙂0123.,!?-_sSdDtTlLvVrReEmM  "
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(400)] + ["it's they'll we've I'd 'tis", "a" * 3000, "<|endoftext|>", "  lead and trail  ", "x\n\n\ny", " \n z", "supercalifragilisticexpialidocious" * 9]


def test_same_ids_as_a_public_encoder(spark, reference):
    texts = samples()
    got = {r["doc_id"]: r for r in bpe.encode(docs(spark, *texts)).collect()}
    for i, t in enumerate(texts, 1):
        assert got[i]["ids"] == reference.encode_ordinary(t), t
        assert got[i]["round_trip"] and got[i]["n_tokens"] == len(got[i]["ids"])


def test_round_trip(spark):
    texts = samples()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs(spark, *texts))).collect()}
    assert back == dict(enumerate(texts, 1))


def test_decode_of_bad_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [10**6, 72])], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(df).collect()}
    assert got[1] is None and got[2] == "" and got[3].startswith("�") and len(got[3]) == 2


def test_ties_merge_from_the_left(reference):
    v = bpe.vocabulary()
    for w in (b"aaaa", b"aaaaa", b"abababab", b"lololol"):
        ids, counts = v.encode_words([w])
        assert ids.tolist() == reference.encode_ordinary(w.decode()) and counts.tolist() == [len(ids)]
