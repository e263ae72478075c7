"""Document fingerprints from prefix polynomial hashes.

With P[i] the sum of (c[j] + 1) * B**j for j < i modulo a prime, the hash of any span follows from two entries, and two spans are compared in constant
time by bringing both to the same power: (P[a+n] - P[a]) * B**b == (Q[b+n] - Q[b]) * B**a. Two primes below 2**31 give 62 bits in plain
64-bit arithmetic. Longest common extensions, forwards and backwards, are found by binary search over span equality.

``compare`` relates documents that begin alike; ``shared_spans`` finds every passage of LEAST characters or more that two documents share, wherever it lies.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import U64, arrow_batches, chunks, code_points, cut, doc_texts, likely_in, mix, table

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Documents that begin with the same HEAD characters are compared, each with the one before it.
HEAD = 64
#: Documents of a group that one task reads at a time: groups of any size are cut into runs of so many, each led by the last of the run before.
RUN = 256
#: An anchor is a span of GRAM characters whose hash is the least of WINDOW spans on end (winnowing); WINDOW is a power of two, and less than GRAM.
GRAM, WINDOW = 33, 32
#: Every passage of so many characters has an anchor, the same wherever it occurs.
LEAST = GRAM + WINDOW - 1
#: Characters that travel on each side of an anchor. Spans that do not end within them are joined from their first and last anchors.
REACH = 64
#: Pairs of anchors compared at a time.
BLOCK = 1 << 15


@functools.cache
def _powers(k: int, n: int) -> np.ndarray:
    p, b = PRIMES[k], BASES[k]
    out = np.ones(1, np.int64)
    step = b
    while len(out) < n:  # doubling: the powers beyond are those so far times B**len
        out = np.concatenate([out, out * step % p])
        step = step * step % p
    return out


def powers(k: int, n: int) -> np.ndarray:
    """B**0 ... modulo the k-th prime, at least n of them."""
    return _powers(k, 1 << max(16, (max(n, 1) - 1).bit_length()))


class Prefixes:
    """Modular prefix arrays of a text: constant-time span hashes."""

    def __init__(self, text: str) -> None:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self.n = len(cp)
        self.sums = []
        for k, p in enumerate(PRIMES):
            s = np.zeros(self.n + 1, np.int64)
            np.cumsum(cp * powers(k, self.n)[: self.n] % p, out=s[1:])
            self.sums.append(s % p)

    def equal(self, a: int, other: Prefixes, b: int, n: int) -> bool:
        """Whether the n characters from a are those of ``other`` from b."""
        if min(a, b, n) < 0 or a + n > self.n or b + n > other.n:
            return False
        for k, p in enumerate(PRIMES):
            w = powers(k, max(a, b) + 1)
            x = (int(self.sums[k][a + n]) - int(self.sums[k][a])) * int(w[b])
            y = (int(other.sums[k][b + n]) - int(other.sums[k][b])) * int(w[a])
            if (x - y) % p:
                return False
        return True

    def forward(self, a: int, other: Prefixes, b: int) -> int:
        """Length of the longest common extension from a and b onwards."""
        lo, hi = 0, min(self.n - a, other.n - b)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(a, other, b, mid) else (lo, mid - 1)
        return max(lo, 0)

    def backward(self, a: int, other: Prefixes, b: int) -> int:
        """Length of the longest common extension ending before a and b."""
        lo, hi = 0, min(a, b)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(a - mid, other, b - mid, mid) else (lo, mid - 1)
        return lo


def text_hashes(texts: list[str]) -> dict[str, np.ndarray]:
    """Length, and hashes of the whole and of the first HEAD characters, of each text."""
    cp, starts = code_points(texts)
    n = np.diff(starts)
    at = np.arange(len(cp)) - np.repeat(starts[:-1], n)
    head = starts[:-1] + np.minimum(n, HEAD)
    out = {"n_chars": n}
    for k, p in enumerate(PRIMES):
        w = powers(k, int(n.max(initial=1)))
        s = np.zeros(len(cp) + 1, np.int64)
        np.cumsum((cp.astype(np.int64) + 1) * w[at] % p, out=s[1:])
        out[f"hash_{k + 1}"] = (s[starts[1:]] - s[starts[:-1]]) % p
        out[f"head_{k + 1}"] = (s[head] - s[starts[:-1]]) % p
    return {c: out[c] for c in ("n_chars", "hash_1", "hash_2", "head_1", "head_2")}


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in arrow_batches(batches):
        out = text_hashes(texts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out.values())], ["doc_id", *out])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, hash_1, hash_2, head_1, head_2): hashes of the whole text and of its first HEAD characters."""
    return doc_texts(docs).mapInArrow(_hashes, "doc_id bigint, n_chars bigint, hash_1 bigint, hash_2 bigint, head_1 bigint, head_2 bigint")


def _extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares each row of a group, which come sorted, with the one before it."""
    key, last, last_id = None, None, None
    for pdf in batches:
        rows = []
        for g1, g2, run, d, h1, h2, text in zip(pdf["head_1"], pdf["head_2"], pdf["run"], pdf["doc_id"], pdf["hash_1"], pdf["hash_2"], pdf["text"], strict=True):
            now, here = Prefixes(text), (g1, g2, run)
            if (h1, h2) != (now.sums[0][-1], now.sums[1][-1]) or key == here and d == last_id:
                continue  # another text under the same doc_id, or a repeated row
            if key == here:
                ahead = now.forward(0, last, 0)
                rows.append((d, last_id, ahead, now.backward(now.n, last, last.n)))
            key, last, last_id = here, now, d
        yield pd.DataFrame(rows, columns=["doc_id", "previous_id", "common_prefix", "common_suffix"])


def compare(docs: DataFrame) -> DataFrame:
    """One row for each document: its fingerprint, the least doc_id with the same, and its longest common extensions with its predecessor.

    Returns (doc_id, n_chars, hash_1, hash_2, copy_of, previous_id, common_prefix, common_suffix). ``copy_of`` is the least doc_id of equal texts, the
    document's own if there is none before it. The predecessor is the document with the next lesser doc_id among those that begin with the same HEAD
    characters (shorter texts: that are equal); without one the last three columns are null. Each document meets one other, however many share a beginning.

    * A null text is an empty one: its hashes are zero, all empty texts are copies of each other, and they have no predecessor.
    * Rows without doc_id are left out. Rows that repeat a doc_id are one document; of several texts under one doc_id the one of
      the greatest (n_chars, hash_1, hash_2) counts. Texts of any length are hashed whole. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = doc_texts(docs).where("doc_id is not null")
    prints = fingerprints(rows)
    one = prints.groupBy("doc_id").agg(F.max(F.struct("n_chars", "hash_1", "hash_2", "head_1", "head_2")).alias("s")).select("doc_id", "s.*")
    same = Window.partitionBy("n_chars", "hash_1", "hash_2")
    group = Window.partitionBy("head_1", "head_2", F.least("n_chars", F.lit(HEAD)))
    one = one.withColumn("copy_of", F.min("doc_id").over(same)).withColumn("size", F.when(F.col("n_chars") > 0, F.count("*").over(group)).otherwise(1))
    one = cut(one.withColumn("place", F.row_number().over(group.orderBy("doc_id"))))
    # Only texts of groups travel; a run is read in order of doc_id, two texts in memory at a time.
    many = one.where("size > 1")
    texts = likely_in(rows, F.col("doc_id"), many.select("doc_id"))
    run = F.floor((F.col("place") - 1) / RUN)
    runs = F.when((F.col("place") % RUN == 0) & (F.col("place") < F.col("size")), F.array(run, run + 1)).otherwise(F.array(run))
    keys = many.select("doc_id", "n_chars", "hash_1", "hash_2", "head_1", "head_2", F.explode(runs).alias("run"))
    grouped = texts.join(keys, "doc_id").where(F.length("text") == F.col("n_chars"))
    grouped = grouped.repartition("head_1", "head_2", "run", F.least("n_chars", F.lit(HEAD))).sortWithinPartitions("head_1", "head_2", "run", "doc_id")
    near = grouped.select("head_1", "head_2", "run", "doc_id", "hash_1", "hash_2", "text").mapInPandas(_extend, "doc_id bigint, previous_id bigint, common_prefix bigint, common_suffix bigint")
    return one.join(near, "doc_id", "left").select("doc_id", "n_chars", "hash_1", "hash_2", "copy_of", "previous_id", "common_prefix", "common_suffix")


@functools.cache
def _inverses(k: int, n: int) -> np.ndarray:
    p = PRIMES[k]
    out, step = np.ones(1, np.int64), pow(BASES[k], -1, p)
    while len(out) < n:
        out = np.concatenate([out, out * step % p])
        step = step * step % p
    return out


def _sliding(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each WINDOW entries on end."""
    step = 1
    while step < WINDOW:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor of the texts: its text's number, its place in it and its hash, in order. All of a window's equal least spans are anchors."""
    cp, starts = code_points(texts)
    n = np.diff(starts)
    if len(cp) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(cp)) - np.repeat(starts[:-1], n)
    left = np.repeat(n, n) - at
    most = int(n.max())
    grams = len(cp) - GRAM + 1
    hashes = np.zeros(grams, np.int64)
    for k, p in enumerate(PRIMES):
        s = np.zeros(len(cp) + 1, np.int64)
        np.cumsum((cp.astype(np.int64) + 1) * powers(k, most)[at] % p, out=s[1:])
        back = _inverses(k, 1 << (most - 1).bit_length())
        hashes = (hashes << 31) | ((s[GRAM:] - s[:-GRAM]) % p * back[at[:grams]] % p)
    order = mix(hashes.astype(U64)) | U64(1)
    least = _sliding(order, np.minimum)
    least[left[: len(least)] < LEAST] = 0  # not within one text
    edge = np.zeros(WINDOW - 1, U64)
    found = np.flatnonzero(order == _sliding(np.concatenate([edge, least, edge]), np.maximum))
    return np.searchsorted(starts, found, "right") - 1, at[found], hashes[found]


def _anchor_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        all_texts = pdf["text"].tolist()
        for a, b in chunks(all_texts):
            number, _, hashes = anchors(all_texts[a:b])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[a:b][number], "gram": hashes}).drop_duplicates()


def _around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The anchors of each text whose hash is in ``grams``, with the characters around them and bits that tell which places before and after are such anchors."""
    for pdf in batches:
        all_texts = pdf["text"].tolist()
        for a, b in chunks(all_texts):
            texts, part = all_texts[a:b], pdf.iloc[a:b]
            number, at, hashes = anchors(texts)
            wanted = part["grams"].tolist()
            prints = text_hashes(texts)
            same = (prints["hash_1"] == part["hash_1"].to_numpy()) & (prints["hash_2"] == part["hash_2"].to_numpy())
            edges = np.searchsorted(number, np.arange(len(texts) + 1))
            keep = np.concatenate([np.isin(hashes[x:y], w) & ok for x, y, w, ok in zip(edges[:-1], edges[1:], wanted, same, strict=True)] or [np.zeros(0, bool)])
            number, at, hashes = number[keep], at[keep], hashes[keep]
            where = number * (1 << 40) + at  # far apart for each text
            before, after = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for o in range(1, WINDOW):  # the o-th neighbour, as far as any is near enough
                gap = where[o:] - where[:-o]
                if not (gap < WINDOW).any():
                    break
                bit = np.where(gap < WINDOW, 1 << np.minimum(gap - 1, WINDOW), 0)
                before[o:] |= bit
                after[:-o] |= bit
            yield pd.DataFrame({
                "gram": hashes, "doc_id": part["doc_id"].to_numpy()[number], "at": at, "lead": np.minimum(at, REACH), "before": before, "after": after,
                "around": [texts[i][max(0, x - REACH) : x + GRAM + REACH] for i, x in zip(number.tolist(), at.tolist(), strict=True)],
            })


def _met(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """All pairs of documents at the anchors of ``pdf``, which are sorted: spans from an anchor that is their first and last, else the end it is next to."""
    gram, doc, at = (pdf[c].to_numpy() for c in ("gram", "doc_id", "at"))
    once = np.ones(len(pdf), bool)
    once[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    pdf = pdf[once]
    gram, doc, at, lead, before, after = (pdf[c].to_numpy() for c in ("gram", "doc_id", "at", "lead", "before", "after"))
    cp, starts = code_points(pdf["around"].tolist())
    n = np.diff(starts)
    text = np.full((len(pdf), REACH + GRAM + REACH), -1, np.int32)
    text[np.repeat(np.arange(len(pdf)), n), np.arange(len(cp)) - np.repeat(starts[:-1], n) + np.repeat(REACH - lead, n)] = cp
    active, step = np.arange(len(pdf)), 1
    while len(active):
        active = active[active + step < len(pdf)]
        active = active[gram[active] == gram[active + step]]
        for k in range(0, len(active), BLOCK):
            y = active[k : k + BLOCK]
            x = y + step  # sorted by doc_id: never the lesser one
            x, y = x[doc[x] != doc[y]], y[doc[x] != doc[y]]
            equal = text[x] == text[y]
            equal &= text[x] >= 0
            whole = equal[:, REACH : REACH + GRAM].all(axis=1)
            x, y, equal = x[whole], y[whole], equal[whole]
            stop = np.zeros((len(x), 1), bool)
            b = np.argmin(np.concatenate([equal[:, :REACH][:, ::-1], stop], axis=1), axis=1)
            f = np.argmin(np.concatenate([equal[:, REACH + GRAM :], stop], axis=1), axis=1)
            low = lambda m: (1 << np.minimum(m, WINDOW - 1)) - 1
            first = (b < WINDOW) & (before[x] & before[y] & low(b) == 0)
            last = (f < WINDOW) & (after[x] & after[y] & low(f) == 0)
            short = b + GRAM + f < REACH + GRAM
            start, end = at[x] - b, at[x] + GRAM + f
            out = pd.DataFrame({"doc_id": doc[x], "other_id": doc[y], "shift": at[x] - at[y], "start": pd.array(start, "Int64"), "end": pd.array(end, "Int64")})
            yield out[first & short & (end - start >= LEAST)]
            yield out[first & ~short].assign(end=pd.NA).astype({"end": "Int64"})
            yield out[last & ~short].assign(start=pd.NA).astype({"start": "Int64"})
        step += 1


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        cut_at = int(np.searchsorted(pdf["gram"].to_numpy(), pdf["gram"].iloc[-1]))  # the last hash may go on
        if held and (cut_at or held[0]["gram"].iloc[0] != pdf["gram"].iloc[0]):
            yield from _met(pd.concat([*held, pdf.iloc[:cut_at]], ignore_index=True))
            held = []
        elif cut_at:
            yield from _met(pdf.iloc[:cut_at])
        held.append(pdf.iloc[cut_at:])
    if held:
        yield from _met(pd.concat(held, ignore_index=True))


def shared_spans(docs: DataFrame) -> DataFrame:
    """One row for each maximal common span of LEAST characters or more of two documents: (doc_id, other_id, start, other_start, length), doc_id > other_id.

    All pairs of documents with a common anchor meet, at every place of it, and are compared forwards and backwards from there; no group is cut, so the rows are as
    many as there are such spans. A span is maximal if the characters before it differ, or one document begins there, and so at its end.

    * Of equal texts only the least doc_id takes part: ``copy_of`` of ``compare`` names the others. Of several texts under one doc_id the one that ``compare`` takes counts.
    * Null texts are empty; texts shorter than LEAST share nothing. Rows without doc_id are left out; other columns are ignored.
    """
    rows = doc_texts(docs).where("doc_id is not null")
    one = fingerprints(rows).groupBy("doc_id").agg(F.max(F.struct("n_chars", "hash_1", "hash_2")).alias("s")).select("doc_id", "s.*").where(F.col("n_chars") >= LEAST)
    least = one.groupBy("n_chars", "hash_1", "hash_2").agg(F.min("doc_id").alias("doc_id"))
    by = Window.partitionBy("gram")
    grams = rows.mapInPandas(_anchor_hashes, "doc_id bigint, gram bigint")
    shared = grams.withColumn("a", F.min("doc_id").over(by)).withColumn("b", F.max("doc_id").over(by)).where("a < b")
    wanted = least.join(shared.groupBy("doc_id").agg(F.collect_set("gram").alias("grams")), "doc_id")
    texts = rows.join(wanted, "doc_id").where(F.length("text") == F.col("n_chars")).select("doc_id", "hash_1", "hash_2", "grams", "text")
    found = texts.mapInPandas(_around, "gram bigint, doc_id bigint, at bigint, lead bigint, before bigint, after bigint, around string")
    spans = cut(found.repartition("gram").sortWithinPartitions("gram", "doc_id", "at").mapInPandas(_pairs, "doc_id bigint, other_id bigint, shift bigint, start bigint, end bigint"))
    # On a shift, spans do not overlap: the last anchor's end that follows a first anchor's start is of the same span.
    ends = Window.partitionBy("doc_id", "other_id", "shift").orderBy(F.coalesce("start", "end"))
    long = spans.where("start is null or end is null").withColumn("end", F.lead("end").over(ends)).where("start is not null")
    out = spans.where("start is not null and end is not null").unionByName(long)
    return out.select("doc_id", "other_id", "start", (F.col("start") - F.col("shift")).alias("other_start"), (F.col("end") - F.col("start")).alias("length"))


def op6_shared_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages shared anywhere; ``op6_prefix_fingerprints`` and its SQL relate documents that begin alike."""
    return shared_spans(table(spark, sf_dir, "documents"))


def op6_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))


_SAME = "coalesce(nullif(list_position(list_transform(list_zip({a}, {b}, true), lambda x: x[1] = x[2]), false), 0) - 1, least(len({a}), len({b})))"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, t, length(t) AS n, CASE WHEN t = '' THEN [] ELSE string_split(t, '') END AS s FROM d),
h AS (
  SELECT doc_id, t, n, s, list_reduce(list_prepend(0::BIGINT, list_reverse(list_transform(s, lambda x: unicode(x)::BIGINT + 1))), lambda h, x: (h * {BASES[0]} + x) % {PRIMES[0]}) AS hash_1,
         list_reduce(list_prepend(0::BIGINT, list_reverse(list_transform(s, lambda x: unicode(x)::BIGINT + 1))), lambda h, x: (h * {BASES[1]} + x) % {PRIMES[1]}) AS hash_2,
         min(doc_id) OVER (PARTITION BY t) AS copy_of, CASE WHEN n > 0 THEN lag(doc_id) OVER w END AS previous_id, CASE WHEN n > 0 THEN lag(s) OVER w END AS r
  FROM c WINDOW w AS (PARTITION BY left(t, {HEAD}) ORDER BY doc_id)
)
SELECT doc_id, n AS n_chars, hash_1, hash_2, copy_of, previous_id,
       CASE WHEN r IS NOT NULL THEN {_SAME.format(a="s", b="r")} END AS common_prefix,
       CASE WHEN r IS NOT NULL THEN {_SAME.format(a="list_reverse(s)", b="list_reverse(r)")} END AS common_suffix
FROM h
"""
