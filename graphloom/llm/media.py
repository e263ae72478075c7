"""Interleaved document sequences: a page as its texts and its media, in order, with payloads resolved by digest.

Parsing yields, in document order, items of text and references to media; a reference carries the digest of its payload, where the page
names one ("sha256:<hex>" or "sha256-<base64>" as address or integrity, a data: address, or data-digest), and its caption. The digests that a page may refer to are
picked out of its source first; only (key, digest) travel to the join with the media table, in which a digest has one payload. Then the payloads meet the page, which is parsed once, item by item.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html
import re
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.html_text import BLOCKS, Lines, Node, hidden_selectors, parse, visible
from graphloom.llm.shared import likely_in, table

MEDIA = {"img": "image", "video": "video", "audio": "audio", "embed": "object", "object": "object", "input": "image"}
ITEM = "kind string, text string, url string, digest string, caption string"
_HEX = re.compile(r"sha256[:-]([0-9a-fA-F]{64})")
_B64 = re.compile(r"sha256-([A-Za-z0-9+/]{43}=)")


def digest_of(url: str, *named: str) -> str | None:
    """The lower-case hexadecimal SHA-256 that a reference names or, for a data: address, that its content has."""
    for s in (*named, url):
        s = s.strip()
        if m := _HEX.fullmatch(s):
            return m[1].lower()
        if m := _B64.fullmatch(s):
            return base64.b64decode(m[1]).hex()
    if url[:5].lower() == "data:":
        head, comma, body = url[5:].partition(",")
        if comma:
            raw = urllib.parse.unquote_to_bytes(body)
            if head.lower().endswith(";base64"):
                try:
                    raw = base64.b64decode(re.sub(rb"\s", b"", raw) + b"=" * (-len(raw) % 4))
                except binascii.Error:
                    return None
            return hashlib.sha256(raw).hexdigest()
    return None


def possible_digests(source: str | None) -> list[str]:
    """All digests that ``interleaved`` finds in a page, and perhaps others that stand in it, without parsing it unless it has a data: address."""
    if not source:
        return []
    text = html.unescape(source) if "&" in source else source
    out = {m.lower() for m in _HEX.findall(text)} | {base64.b64decode(m).hex() for m in _B64.findall(text)}
    if "data:" in text.lower():
        out |= {x[3] for x in interleaved(source) if x[3]}
    return sorted(out)


def _inner(node: Node, rules: frozenset[str]) -> str:
    out, todo = Lines(), [node]
    while todo:
        n = todo.pop()
        if n.__class__ is str:
            if n:
                out.add(n)
        elif visible(n, rules):
            if n.tag in BLOCKS or n.tag == "br":
                out.end()
            todo.extend(reversed(n.children))
    return " ".join(x for x in out.lines() if x)


def _reference(node: Node) -> tuple[str, str | None, str]:
    """Address, digest and caption of a media element itself."""
    a = node.attrs
    url = a.get("src") or a.get("data") or a.get("data-src") or ""
    if not url and a.get("srcset"):
        url = a["srcset"].split(",")[0].split()[0] if a["srcset"].strip(", ") else ""
    if not url:
        todo = [c for c in node.children if c.__class__ is Node]
        source = next((c for c in todo if c.tag == "source" and (c.attrs.get("src") or c.attrs.get("srcset"))), None)
        if source is not None:
            return _reference(source)[:2] + (a.get("alt") or a.get("title") or a.get("aria-label") or "",)
    return url, digest_of(url, a.get("data-digest", ""), a.get("integrity", "")), a.get("alt") or a.get("title") or a.get("aria-label") or ""


def interleaved(source: str) -> list[tuple[str, str | None, str | None, str | None, str | None]]:
    """(kind, text, url, digest, caption) of a page's items in order; neighbouring texts are one item.

    A figure's caption belongs to every medium in the figure and is no text of its own; a medium elsewhere has its alternative text.
    """
    root = parse(source)
    rules = hidden_selectors(root)
    items: list[tuple] = []
    out = Lines()
    figures: list[str] = []
    todo: list = [(root, False)]

    def flush() -> None:
        nonlocal out
        if text := "\n".join(out.lines()).strip("\n"):
            items.append(("text", text, None, None, None))
        out = Lines()

    while todo:
        node, leaving = todo.pop()
        if node.__class__ is str:
            if node:
                out.add(node)
            continue
        tag = node.tag
        if leaving:
            if tag == "figure":
                figures.pop()
            out.end(BLOCKS.get(tag, 0))
            continue
        medium = MEDIA.get(tag)
        if medium and (tag != "input" or node.attrs.get("type", "").lower() == "image"):
            # these elements show no text of their own: judge their attributes only
            shown = Node("span", node.raw)
            if visible(shown, rules) and tag not in rules:
                flush()
                url, digest, caption = _reference(node)
                items.append((medium, None, url or None, digest, (figures[-1] if figures and figures[-1] else caption) or None))
            continue
        if not visible(node, rules):
            continue
        if tag == "br":
            out.end()
            continue
        if tag == "figure":
            caption = [c for c in node.children if c.__class__ is Node and c.tag == "figcaption"]
            held = any(c.__class__ is Node and (c.tag in MEDIA or c.children) for c in node.children if c not in caption)
            figures.append(" ".join(filter(None, (_inner(c, rules) for c in caption))) if held else "")
        if tag == "figcaption" and figures and figures[-1]:
            continue
        if tag in BLOCKS:
            out.end(BLOCKS[tag])
            todo.append((node, True))
        todo.extend((c, False) for c in reversed(node.children))
    flush()
    return items


def _items():
    def items(source: pd.Series) -> pd.Series:
        return pd.Series([[] if s is None else [dict(zip(("kind", "text", "url", "digest", "caption"), x, strict=True)) for x in interleaved(s)] for s in source], dtype=object)

    items.__annotations__ = {"source": pd.Series, "return": pd.Series}
    return F.pandas_udf(items, f"array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in ITEM.split(', ')))}>>")


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, items) of every row: ``items`` an array of structs (kind, text, url, digest, caption) in document order.

    Null and empty pages have an empty array, repeated rows each their own; pages of any length are read whole; a null page_id stays null; an empty table gives no rows.
    """

    return pages.select(pages[id_col].cast("bigint").alias("page_id"), _items()(pages[html_col].cast("string")).alias("items"))


def resolve(pages: DataFrame, media: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, texts, media, captions, n_media, n_resolved): three arrays of one length, aligned by position.

    At each position either ``texts`` or ``media`` (kind, url, digest, payload) is set; ``captions`` belongs to the medium there.
    ``media`` the table: digest (hexadecimal SHA-256) and payload.

    * A digest that the table lacks, and a reference without one, keep their place with a null payload. A digest in several rows of the table: the payload that
      has this digest, if any, and of several the least by (their own SHA-256, bytes): only digests of payloads are compared before the join.
    * Null and empty pages have empty arrays. A null page_id is resolved like any other. Of rows that repeat a page_id each gets its own result; very long pages are read whole.
    * Digests compare in lower case; null digests match nothing. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    keyed = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[html_col].cast("string").alias("html")).withColumn("key", F.xxhash64("page_id", "html"))

    def possible(source: pd.Series) -> pd.Series:
        return pd.Series([possible_digests(s) for s in source], dtype=object)

    possible.__annotations__ = {"source": pd.Series, "return": pd.Series}
    refs = keyed.select("key", F.explode(F.pandas_udf(possible, "array<string>")("html")).alias("digest"))
    store = media.select(F.lower(media["digest"]).alias("digest"), media["payload"].cast("binary").alias("payload")).where("digest is not null and payload is not null")
    store = likely_in(store, F.xxhash64("digest"), refs.select(F.xxhash64("digest")))  # payloads that no page refers to do not travel
    store = store.groupBy("digest").agg(F.min(F.struct(F.sha2("payload", 256) != F.col("digest"), F.sha2("payload", 256), "payload")).alias("s")).select("digest", "s.payload")
    found = refs.join(store, "digest").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("digest", "payload"))).alias("payloads"))
    both = keyed.join(found, "key", "left").withColumn("items", _items()("html"))
    medium = "if(x.kind = 'text', null, named_struct('kind', x.kind, 'url', x.url, 'digest', x.digest, 'payload', if(x.digest is null, null, try_element_at(payloads, x.digest))))"
    done = both.select("page_id", F.transform("items", lambda x: x["text"]).alias("texts"), F.expr(f"transform(items, x -> {medium})").alias("media"), F.transform("items", lambda x: x["caption"]).alias("captions"))
    return done.withColumns({"n_media": F.expr("size(filter(media, m -> m is not null))"), "n_resolved": F.expr("size(filter(media, m -> m.payload is not null))")})


def _title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def illustrated(pages: DataFrame) -> DataFrame:
    """The pages with two figures each: one of the page's title card, whose digest the store has, and one of a picture that it lacks."""
    card = F.concat(F.lit('</h1><figure><img src="sha256:'), F.sha2(_title(F.col("html")), 256), F.lit('" alt="card"><figcaption>Card of <i>'), _title(F.col("html")), F.lit("</i></figcaption></figure>"))
    lost = F.concat(F.lit('<p><img src="'), F.col("url"), F.lit('/lost.png" data-digest="sha256:'), F.sha2(F.coalesce("url", F.lit("")), 256), F.lit('" alt="lost picture"></p></article>'))
    html = F.replace(F.replace(F.col("html"), F.lit("</h1>"), F.coalesce(card, F.lit("</h1>"))), F.lit("</article>"), F.coalesce(lost, F.lit("</article>")))
    return pages.select("page_id", html.alias("html"))


def title_cards(pages: DataFrame) -> DataFrame:
    """The store of payloads: each page's title as bytes, by digest."""
    return pages.select(F.sha2(_title(F.col("html")), 256).alias("digest"), _title(F.col("html")).cast("binary").alias("payload"))


def op5_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages come without media, so each is given two figures first; see ``illustrated``."""
    pages = table(spark, sf_dir, "pages")
    return resolve(illustrated(pages), title_cards(pages))
