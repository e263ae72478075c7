"""The operators over pages against plain versions on Python's own HTML tokenizer, which shares no code with them."""

import hashlib
import random
from html.parser import HTMLParser

from graphloom.llm import html_text, media

UNSEEN = {"head", "script", "style", "title"}
VOID = {"meta", "br", "img"}
BREAKS = {"p", "li", "div", "h1", "ul", "nav", "article", "footer", "br", "figure", "figcaption", "body", "html"}


class Plain(HTMLParser):
    """Events of a page: words that are seen, breaks between blocks, and media; a figure's caption goes to its media."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.unseen, self.events, self.caption, self.figure = 0, [], None, None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in UNSEEN and tag not in VOID:
            self.unseen += 1
        if tag in BREAKS:
            self.events.append("\0")
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.caption = []
        if tag == "img":
            digest = next((x[7:] for x in (attrs.get("data-digest", ""), attrs.get("src", "")) if x.startswith("sha256:")), None)
            item = ["image", digest, attrs.get("alt")]
            self.events.append(item)
            if self.figure is not None:
                self.figure.append(item)

    def handle_endtag(self, tag):
        if tag in UNSEEN:
            self.unseen -= 1
        if tag in BREAKS:
            self.events.append("\0")
        if tag == "figcaption":
            for item in self.figure:
                item[2] = " ".join(self.caption)
            self.caption = None
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if self.unseen:
            return
        if self.caption is not None:
            self.caption += data.split()
        else:
            self.events.append(data)


def events(page):
    p = Plain()
    p.feed(page)
    p.close()
    return p.events


def blocks(page):
    """Words of each block of a page, those without words left out."""
    text = "".join(x for x in events(page) if isinstance(x, str))
    return [b.split() for b in text.split("\0") if b.split()]


def test_text_of_the_whole_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in html_text.op3_html_text(spark, sf).collect()}
    assert set(got) == set(pages)
    for k, page in pages.items():
        lines = [line.removeprefix("- ").split() for line in got[k].split("\n")]
        assert [x for x in lines if x] == blocks(page), k


def test_text_of_random_trees():
    """Trees are made first and written as HTML, with and without the end tags that may be left out; what is seen follows from the tree."""
    r = random.Random(11)
    for _ in range(300):
        want: list[list[str]] = []

        def block(depth, hidden, want=want):
            tag = r.choice(["p", "div", "ul", "section"] if depth else ["p"])
            gone = hidden or r.random() < 0.15
            attr = r.choice([" hidden", ' style="display: none"', " HIDDEN"]) if gone and not hidden else r.choice(["", ' title="a > b"', " data-x='<p>'"])
            words = [f"w{r.randrange(1000)}" for _ in range(r.randrange(1, 5))]
            inline = " ".join(r.choice([w, f"<b>{w}</b>", f"<span>{w}</span>", f"<!-- no -->{w}"]) for w in words)
            if tag == "p":
                if not gone:
                    want.append(words)
                return f"<p{attr}>{inline}" + ("</p>" if r.random() < 0.5 else "")
            if tag == "ul":
                if not gone:
                    want.append(words)
                return f"<ul{attr}><li>{inline}{r.choice(['', '</li>'])}</ul>"
            return f"<{tag}{attr}>" + "".join(block(depth - 1, gone) for _ in range(r.randrange(1, 4))) + f"</{tag}>"

        page = "".join(block(3, False) for _ in range(3))
        lines = [line.removeprefix("- ").split() for line in html_text.visible_text(page).split("\n")]
        assert [x for x in lines if x] == want, page


def test_sequences_of_the_whole_table(spark, sf):
    """Positions, captions and payloads of the query against the plain events of the same pages."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in media.illustrated(pages).collect()}
    cards = {r["digest"]: bytes(r["payload"]) for r in media.title_cards(pages).collect()}
    for row in media.op5_interleaved_media(spark, sf).collect():
        want: list = []
        for x in events(source[row["page_id"]]):
            if isinstance(x, list):
                want.append(x)
            elif x.strip("\0 \n"):
                if not want or isinstance(want[-1], list):
                    want.append("")
                want[-1] += x
            elif want and not isinstance(want[-1], list):
                want[-1] += " "
        assert len(row["texts"]) == len(row["media"]) == len(row["captions"]) == len(want)
        for text, medium, caption, w in zip(row["texts"], row["media"], row["captions"], want, strict=True):
            if isinstance(w, list):
                assert text is None and (medium["kind"], medium["digest"], caption) == tuple(w)
                assert (bytes(medium["payload"]) if medium["payload"] is not None else None) == cards.get(w[1])
                assert medium["payload"] is None or hashlib.sha256(bytes(medium["payload"])).hexdigest() == w[1]
            else:
                assert medium is None and caption is None and "".join(text.replace("\n- ", "\n").removeprefix("- ").split()) == "".join(w.split())
