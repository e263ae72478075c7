import base64
import hashlib

from graphloom.llm import media
from tests.llm.helpers import rows

CARD = hashlib.sha256(b"card").hexdigest()


def test_order_and_captions():
    page = f'<p>one<img src="sha256:{CARD}" alt="A">two</p><figure><img src="x.png"><figcaption>The <b>cap</b></figcaption></figure><p>three</p><img hidden src="y.png">'
    got = media.interleaved(page)
    assert [g[0] for g in got] == ["text", "image", "text", "image", "text"]
    assert got[1][3:] == (CARD, "A") and got[3][2:] == ("x.png", None, "The cap") and got[4][1] == "three"


def test_digests():
    assert media.digest_of("data:text/plain;base64," + base64.b64encode(b"card").decode()) == CARD
    assert media.digest_of("data:,card") == CARD == media.digest_of("x", "sha256-" + base64.b64encode(bytes.fromhex(CARD)).decode())
    assert media.digest_of("x.png") is None and media.digest_of("data:text/plain;base64,a") is None


def test_possible_digests_hold_all_that_are_found():
    b64 = base64.b64encode(bytes.fromhex(CARD)).decode()
    for page in (f'<img src="sha256:{CARD}">', f"<img src='x' data-digest=SHA256:{CARD}>", f'<img src="sha256&colon;{CARD}">', f'<video src=x integrity="sha256-{b64}">', '<img src="data:,card">', f'<img src="&#115;ha256:{CARD.upper()}"><p hidden>', "<p>x", "", f"<!-- sha256:{CARD} -->"):
        got = {x[3] for x in media.interleaved(page) if x[3]}
        assert got <= set(media.possible_digests(page)), page
    assert media.possible_digests(None) == []


def test_join_keeps_places(spark):
    other = "0" * 64
    page = f'<img src="sha256:{CARD}"><p>t</p><img src="sha256:{other}"><img src="sha256:{CARD.upper()}"><img src="plain.png">'
    pages = spark.createDataFrame([(1, page), (1, page), (2, "<p>no media"), (None, page)], "page_id bigint, html string")
    store = spark.createDataFrame([(CARD.upper(), bytearray(b"card")), (CARD, bytearray(b"zzz")), (None, bytearray(b"n")), (other, None)], "digest string, payload binary")
    out = media.resolve(pages, store)
    assert out.count() == 4
    for r in out.where("page_id = 1").collect():
        assert [t is None for t in r["texts"]] == [True, False, True, True, True]
        assert [None if m is None else m["payload"] and bytes(m["payload"]) for m in r["media"]] == [b"card", None, None, b"card", None]
        assert (r["n_media"], r["n_resolved"]) == (4, 2) and len(r["captions"]) == 5
    (lone,) = out.where("page_id is null").collect()
    assert (lone["n_media"], lone["n_resolved"]) == (4, 2)


def test_whole_table(spark, sf):
    out = media.op5_interleaved_media(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert out.count() == pages.count()
    cards = {r["digest"] for r in media.title_cards(pages).collect()}
    for r in out.collect():
        for m in r["media"]:
            if m is not None and m["digest"] is not None:
                assert (m["payload"] is not None) == (m["digest"] in cards)
                assert m["payload"] is None or hashlib.sha256(bytes(m["payload"])).hexdigest() == m["digest"]
    assert rows(out.select("page_id"))
