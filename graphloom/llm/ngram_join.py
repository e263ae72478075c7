"""N-gram Jaccard self-join of documents by T-occurrence search (DivideSkip).

At any size of the input:

1. Documents with equal n-gram sets are one class, on a 128-bit key. A class has a parity bitmap of its set, two to four bits for an n-gram, and ``BANDS`` bands of two minhashes.
2. Classes that share a band are a group (a pair of similarity s is missed with chance (1 - s * s) ** BANDS: 0.001 % at 0.5, a millionth of that at 0.8).
3. In a group classes are linked whose bitmaps admit the overlap: the bits in which two differ are at most the n-grams in which the sets differ, so
   that a bitmap never refuses a similar pair. First each class is held against the least of its group, and a pair once, in however many groups it is: where all
   are linked with the least the group is settled. The members of the other groups are held against each other, in chunks of about ``GROUP``, each chunk against each.
4. Connected components of the links are the units of exact search; those beyond ``CELL`` classes are cut into chunks and searched chunk against chunk, so that memory
   stays bounded; a text travels once for each other chunk of its component, once where that has one.
5. In a component DivideSkip treats every class as a query over inverted lists of n-grams: the L longest lists are set aside, the others merged by a heap that skips
   what cannot reach T - L (long ones run by run, see ``HEAP``), and candidates that can still reach T are binary-probed in the long ones.

What is reported is exact (up to collisions of 64-bit hashes); only step 2 is approximate. Exact prefix filtering was tried in its place: on these texts its
candidates grow as the input to the power 1.7, as do chance meetings of n-grams, and its shuffle with them; see the README.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import U64, connected_components, cut, doc_texts, likely_in, mix, pandas_batches, table, word_hashes

NGRAM = 3
THRESHOLD = 0.5
BANDS, ROWS = 40, 2
#: Classes of a chunk of a group, and of a cell, that are looked at in one piece.
GROUP = 1024
CELL = 2048
#: Cost of a binary probe against one merged posting, in DivideSkip's choice of L.
MU = 1.0
#: Short lists of at most so many entries in all are merged by a heap; of more, run by run in an array, which finds the same.
HEAP = 512


def least_overlap(size, t: float):
    """n-grams that a set of that size has in common with any that it resembles."""
    return np.maximum(1, np.ceil(t * np.asarray(size) - 1e-9)).astype(np.int64)


def ngram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams, on end, and where each text's begin.

    A text of fewer than n words, but at least one, has a single n-gram of all its words; one without words has none.
    """
    words, first = word_hashes(texts)
    count = np.diff(first)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(texts)), grams)
    if not len(doc):
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(grams, out=start[1:])
    at = np.arange(len(doc)) - start[doc] + first[doc]
    value = np.zeros(len(doc), U64)
    for k in range(n):
        there = at + k < first[doc + 1]
        value = mix(value * U64(0x9E3779B97F4A7C15) + np.where(there, words[np.minimum(at + k, len(words) - 1)], U64(k + 1)))
    order = np.lexsort((value, doc))
    value = value[order]
    new = np.ones(len(value), np.bool_)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    np.cumsum(np.bincount(doc, minlength=len(texts)), out=start[1:])
    return value, start


def parity_bitmaps(value: np.ndarray, start: np.ndarray) -> list[bytes]:
    """Of each set a bitmap of 256 bits or the power of two that is at least twice its size: whether an odd number of its n-grams hash to a place."""
    size = np.diff(start)
    bits = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(bits)])
    own = np.repeat(np.arange(len(size)), size)
    place = (mix(value ^ U64(0x5851F42D4C957F2D)) & (bits[own] - 1).astype(U64)).astype(np.int64) + begin[own]
    packed = np.packbits((np.bincount(place, minlength=int(begin[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def admits(n_a: int, a: int, bits_a: int, n_b: int, b: int, bits_b: int, t: float) -> bool:
    """Whether two sets of those sizes and bitmaps (as numbers, with so many bits) may be similar. The larger bitmap is folded onto the other."""
    need = -int(-(t / (1 + t) * (n_a + n_b) - 1e-9) // 1)
    if min(n_a, n_b) < need:
        return False
    while bits_a > bits_b:
        bits_a //= 2
        a = (a & ((1 << bits_a) - 1)) ^ (a >> bits_a)
    while bits_b > bits_a:
        bits_b //= 2
        b = (b & ((1 << bits_b) - 1)) ^ (b >> bits_b)
    return (n_a + n_b - (a ^ b).bit_count()) // 2 >= need


def _keys(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate([[U64(0)], np.cumsum(value, dtype=U64)])
    return (total[start[1:]] - total[start[:-1]]).view(np.int64)


def _sets(n: int):
    """Size, key, bitmap and bands of every text's set; an empty one has no bands."""
    multipliers = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, texts in pandas_batches(batches):
            value, start = ngram_sets(texts, n)
            full = np.flatnonzero(np.diff(start))
            bands: list = [None] * len(texts)
            if len(full):
                mins = np.empty((len(full), BANDS * ROWS), np.uint32)
                for k, m in enumerate(multipliers):
                    mins[:, k] = np.minimum.reduceat(((value * m) >> U64(32)).astype(np.uint32), start[:-1][full])
                band = np.zeros((len(full), BANDS), U64) + np.arange(BANDS, dtype=U64)
                for r in range(ROWS):
                    band = mix(band * U64(0x9E3779B97F4A7C15) + mins[:, r::ROWS].astype(U64))
                for i, x in zip(full.tolist(), band.view(np.int64), strict=True):
                    bands[i] = x
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "n": np.diff(start), "k1": _keys(value, start), "k2": _keys(mix(value ^ U64(0xA5A5A5A5)), start),
                "bits": parity_bitmaps(value, start), "bands": bands,
            })

    return run


def _admitted(t: float):
    """Whether the bitmaps of each pair admit the overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [[(n, int.from_bytes(x, "little"), 8 * len(x)) for n, x in zip(pdf[f"n_{s}"].tolist(), pdf[f"bits_{s}"].tolist(), strict=True)] for s in "ab"]
            ok = [admits(*x, *y, t) for x, y in zip(*own, strict=True)]
            yield pdf[["a", "b"]].assign(ok=ok)

    return run


def _links(t: float):
    """Streams groups sorted by key; links each member to one of its cluster under ``admits``."""

    def cluster(rows: list[tuple], out: set) -> None:
        rest = rows
        while len(rest) > 1:
            todo, rest = [rest[0]], rest[1:]
            while todo and rest:
                u, away = todo.pop(), []
                for v in rest:
                    if admits(u[1], u[2], u[3], v[1], v[2], v[3], t):
                        out.add((u[0], v[0]) if u[0] < v[0] else (v[0], u[0]))
                        todo.append(v)
                    else:
                        away.append(v)
                rest = away

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        last = None
        for pdf in batches:
            out: set = set()
            for key, doc, n, bits in zip(pdf["key"].tolist(), pdf["doc_id"].tolist(), pdf["n"].tolist(), pdf["bits"].tolist(), strict=True):
                if key != last:
                    cluster(list(held.values()), out)
                    held, last = {}, key
                held[doc] = (doc, n, int.from_bytes(bits, "little"), 8 * len(bits))
            yield pd.DataFrame(list(out), columns=["a", "b"])
        if len(held) > 1:
            out = set()
            cluster(list(held.values()), out)
            yield pd.DataFrame(list(out), columns=["a", "b"])

    return run


def heap_merge(lists: list[list[int]], need: int) -> tuple[list[int], list[int]]:
    """Values that are in at least ``need`` of the rising lists, and in how many: a heap of the lists' heads that skips values which cannot get there (MergeSkip)."""
    width = max(1, (len(lists) - 1).bit_length())
    mask = (1 << width) - 1
    heap = [x[0] << width | k for k, x in enumerate(lists) if x]
    heapify(heap)
    at = [0] * len(lists)
    found, seen = [], []
    if need <= 1:
        now, count = -1, 0
        while heap:
            v = heap[0]
            value, k = v >> width, v & mask
            if value != now:
                if count:
                    found.append(now)
                    seen.append(count)
                now, count = value, 0
            count += 1
            at[k] += 1
            if at[k] < len(lists[k]):
                heapreplace(heap, lists[k][at[k]] << width | k)
            else:
                heappop(heap)
        if count:
            found.append(now)
            seen.append(count)
        return found, seen
    while len(heap) >= need:
        value = heap[0] >> width
        out = []
        while heap and heap[0] >> width == value:
            out.append(heappop(heap) & mask)
        if len(out) >= need:
            found.append(value)
            seen.append(len(out))
            for k in out:
                at[k] += 1
                if at[k] < len(lists[k]):
                    heappush(heap, lists[k][at[k]] << width | k)
            continue
        while len(out) < need - 1:  # any value before the next head is in fewer lists than needed
            out.append(heappop(heap) & mask)
        if not heap:
            break
        value = heap[0] >> width
        for k in out:
            at[k] = bisect_left(lists[k], value, at[k])
            if at[k] < len(lists[k]):
                heappush(heap, lists[k][at[k]] << width | k)
    return found, seen


def run_merge(key: np.ndarray, base: np.ndarray, begin: np.ndarray, size: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``heap_merge`` finds, for lists of many entries: their sorted runs are merged in one array."""
    first = np.cumsum(size) - size
    values = np.sort(key[np.repeat(begin - first, size) + np.arange(int(size.sum()))] - np.repeat(base, size))
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    seen = np.diff(np.append(edge, len(values)))
    keep = seen >= need
    return values[edge[keep]], seen[keep]


def divide_skip(key: np.ndarray, docs: int, lists: np.ndarray, begin: np.ndarray, end: np.ndarray, t: int, mu: float = MU) -> tuple[np.ndarray, np.ndarray]:
    """Documents that occur in at least ``t`` of the lists, and in how many.

    key: list * docs + document of all postings, sorted; the entries of each of ``lists`` that count are key[begin:end].
    """
    size = end - begin
    order = np.argsort(-size, kind="stable")[: np.count_nonzero(size)]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(order) < t:
        return none
    lists, begin, end, size = lists[order], begin[order], end[order], size[order]
    aside = min(int(t / (mu * np.log2(size[0] + 1) + 1)), t - 1)
    if size[aside:].sum() <= HEAP:
        short = zip((lists[aside:] * docs).tolist(), begin[aside:].tolist(), end[aside:].tolist(), strict=True)
        found, seen = (np.array(x, np.int64) for x in heap_merge([(key[a:b] - base).tolist() for base, a, b in short], t - aside))
    else:
        found, seen = run_merge(key, lists[aside:] * docs, begin[aside:], size[aside:], t - aside)
    if aside and len(found):
        wanted = (lists[:aside] * docs)[:, None] + found
        spot = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        seen = seen + (key[spot] == wanted).sum(0)
    keep = seen >= t
    return found[keep], seen[keep]


def similar_in(ids: np.ndarray, value: np.ndarray, start: np.ndarray, t: float) -> tuple[np.ndarray, ...]:
    """All pairs of the given n-gram sets whose Jaccard similarity is at least t: (i, j, overlap), i and j are positions."""
    sizes = np.diff(start)
    order = np.lexsort((ids, sizes))
    docs = len(ids)
    rank = np.empty(docs, np.int64)
    rank[order] = np.arange(docs)
    by = np.argsort(value, kind="stable")
    doc = rank[np.repeat(np.arange(docs), sizes)][by]
    value = value[by]
    new = np.ones(len(value), np.bool_)
    new[1:] = value[1:] != value[:-1]
    number = np.cumsum(new) - 1
    length = np.bincount(number)
    shared = length[number] > 1
    number, doc = (np.cumsum(length > 1) - 1)[number[shared]], doc[shared]
    key = np.sort(number * docs + doc)
    mine = np.argsort(doc, kind="stable")
    own = number[mine]
    edge = np.searchsorted(doc[mine], np.arange(docs + 1))
    size = sizes[order]
    out = []
    for q in range(1, docs):
        need = int(least_overlap(size[q], t))
        lists = own[edge[q] : edge[q + 1]]
        if len(lists) < need:
            continue
        low = int(np.searchsorted(size, need))  # smaller sets cannot be similar
        begin, end = np.searchsorted(key, lists * docs + low), np.searchsorted(key, lists * docs + q)
        found, seen = divide_skip(key, docs, lists, begin, end, need)
        ok = seen / (size[found] + size[q] - seen) >= t
        if ok.any():
            out.append((np.full(ok.sum(), q), found[ok], seen[ok]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    q, r, seen = (np.concatenate(x) for x in zip(*out, strict=True))
    return order[q], order[r], seen


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position in the component of each of n positions, under the links (i, j)."""
    root = np.arange(n)
    while True:
        least = root.copy()
        m = np.minimum(root[i], root[j])
        np.minimum.at(least, i, m)
        np.minimum.at(least, j, m)
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


PAIRS = "a bigint, b bigint, overlap bigint, n_a bigint, n_b bigint"
LINKED = "node bigint, root bigint, links bigint"


def _search(n: int, t: float, pairs: bool):
    """Streams cells sorted by (cell, doc_id). Of each cell the similar pairs that belong to it; or, a row a class, the least class that it is
    linked with in the cell, and of how many documents its links are."""

    def cell(parts: list[tuple], across: bool) -> pd.DataFrame:
        ids, chunk, many = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
        value = np.concatenate([p[3] for p in parts])
        start = np.concatenate([[0], np.cumsum(np.concatenate([p[4] for p in parts]))])
        i, j, seen = similar_in(ids, value, start, t)
        if across:  # pairs within a chunk belong to that chunk's own cell
            keep = chunk[i] != chunk[j]
            i, j, seen = i[keep], j[keep], seen[keep]
        if not pairs:
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            there = np.flatnonzero(links)
            return pd.DataFrame({"node": ids[there], "root": ids[_roots(len(ids), i, j)[there]], "links": links[there]})
        size = np.diff(start)
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pd.DataFrame({"a": ids[i], "b": ids[j], "overlap": seen, "n_a": size[i], "n_b": size[j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        last = last_id = across = None
        for pdf, texts in pandas_batches(batches):
            value, start = ngram_sets(texts, n)
            at, ids = pdf["cell"].to_numpy(), pdf["doc_id"].to_numpy()
            good = _keys(value, start) == pdf["k1"].to_numpy()  # else another text under the same doc_id
            for k in range(len(good)):
                if good[k]:  # a repeated row is one document
                    good[k] = (at[k], ids[k]) != last_id
                    last_id = (at[k], ids[k])
            if not good.all():
                value = value[np.repeat(good, np.diff(start))]
                start = np.concatenate([[0], np.cumsum(np.diff(start)[good])])
                at, ids = at[good], ids[good]
            if not len(at):
                continue
            chunk, many, apart = (pdf[c].to_numpy()[good] for c in ("chunk", "many", "across"))
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and at[a] != last:
                    yield cell(held, across)
                    held = []
                held.append((ids[a:b], chunk[a:b], many[a:b], value[start[a] : start[b]], np.diff(start[a : b + 1])))
                last, across = at[a], bool(apart[a])
        if held:
            yield cell(held, across)

    return run


def _classes(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (doc_id, text): (doc_id, n, k1, k2) of each document; and the classes, named by their least doc_id."""
    found = rows.mapInPandas(_sets(n), "doc_id bigint, n int, k1 bigint, k2 bigint, bits binary, bands array<bigint>")
    sets = cut(found.groupBy("doc_id").agg(F.min(F.struct("n", "k1", "k2", "bits", "bands")).alias("s")).select("doc_id", "s.*"))
    classes = sets.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many"), F.min(F.struct("bits", "bands")).alias("s"))
    return sets.select("doc_id", "n", "k1", "k2"), cut(classes.select("n", "k1", "k2", "rep", "many", "s.*"))


def _candidates(classes: DataFrame, t: float) -> DataFrame:
    """Links (a, b) between classes that share a band and whose bitmaps admit the overlap; their components are those of all such pairs."""
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    bands = classes.select("rep", F.explode("bands").alias("key"))
    groups = cut(bands.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("size")).where("size > 1"))
    met = likely_in(bands, F.col("key"), groups.select("key")).join(groups, "key")
    stars = cut(met.where("rep <> a").select("key", "size", "a", F.col("rep").alias("b")))
    tried = stars.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    tried = cut(tried.mapInPandas(_admitted(t), "a bigint, b bigint, ok boolean"))
    loose = stars.join(tried.where("not ok").select("a", "b"), ["a", "b"], "left_semi").select("key").distinct()
    rest = stars.join(loose, "key", "left_semi")
    rest = rest.select("key", "size", F.col("b").alias("rep")).unionByName(rest.select("key", "size", F.col("a").alias("rep")).distinct())
    k = F.ceil(F.col("size") / F.lit(GROUP)).cast("int")
    rest = rest.withColumn("chunk", F.pmod(F.xxhash64("rep"), k).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    rest = rest.select("rep", F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"))
    rest = rest.join(classes.select("rep", F.col("rep").alias("doc_id"), "n", "bits"), "rep").select("key", "doc_id", "n", "bits")
    links = rest.repartition("key").sortWithinPartitions("key").mapInPandas(_links(t), "a bigint, b bigint")
    return links.unionByName(tried.where("ok").select("a", "b"))


def _prepared(docs: DataFrame, n: int, t: float, id_col: str, text_col: str, pairs: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep, n, many) of every document, its own rep if it has no n-grams; and what ``_search`` finds among the classes, which are named by rep."""
    rows = doc_texts(docs, id_col, text_col).where("doc_id is not null")
    sets, classes = _classes(rows, n)
    parts = connected_components(_candidates(classes, t))
    size = parts.groupBy("component").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("k"))
    cells = parts.join(size, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = cells.select(F.col("node").alias("rep"), "chunk", (F.col("chunk") != F.col("other")).alias("across"), F.xxhash64("component", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"))
    cells = cut(cells.join(classes.select("rep", "k1", "many"), "rep").withColumnRenamed("rep", "doc_id"))
    texts = likely_in(rows, F.col("doc_id"), cells.select("doc_id")).join(cells, "doc_id").repartition("cell").sortWithinPartitions("cell", "doc_id")
    near = texts.mapInPandas(_search(n, t, pairs), PAIRS if pairs else LINKED)
    members = sets.where("n > 0").join(classes.select("n", "k1", "k2", "rep", "many"), ["n", "k1", "k2"]).select("doc_id", "rep", "n", "many")
    alone = sets.where("n = 0").select("doc_id", F.col("doc_id").alias("rep"), "n", F.lit(1).cast("bigint").alias("many"))
    return members.unionByName(alone).withColumn("n", F.col("n").cast("bigint")), near


def jaccard_pairs(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pairs of documents whose word n-gram sets have Jaccard similarity of at least ``threshold``.

    Returns (doc_a, doc_b, overlap, n_a, n_b, jaccard), doc_a < doc_b, each pair once. Words are lower-cased runs of letters and digits. Groups of exact copies
    are expanded into all their pairs here: ``similarity_classes`` has the same links in a row for each document.

    * A null or empty text, or one without a word, has no n-grams and is in no pair. A null doc_id is in no pair.
    * A text of fewer than n words has one n-gram, of all its words. Texts of any length are read whole.
    * Repeated rows are one document; of several texts under one doc_id the one with the fewest n-grams counts, of those that of the least keys.
    * Equal similarities are all reported; there is no limit on partners. An empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    members, near = _prepared(docs, n, threshold, id_col, text_col, True)
    members = members.where("n > 0")
    left = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    cross = near.join(left, "a").join(right, "b").select("x", "y", "overlap", "n_a", "n_b")
    same = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"), "n").join(right.withColumnRenamed("b", "a"), "a").where("x < y")
    same = same.select("x", "y", F.col("n").alias("overlap"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    ahead = F.col("x") < F.col("y")
    return cross.unionByName(same).select(
        F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "overlap",
        F.when(ahead, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(ahead, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
        F.round(F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap")), 6).alias("jaccard"),
    )


def similarity_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: (doc_id, class_id, n_grams, n_links).

    ``n_links`` counts the other documents that the n-gram sets of ``jaccard_pairs`` make similar, exact copies included; ``class_id`` is the least doc_id of all
    that are reached over such links, the document's own if it has none. Links are counted where they are found, so a group of copies is never expanded into its pairs.

    * A null or empty text, or one without a word, is a class of its own without links. Rows without doc_id give no row.
    * Short texts, repeated rows, several texts under one doc_id and other columns are as in ``jaccard_pairs``; an empty table gives no rows.
    """
    members, near = _prepared(docs, n, threshold, id_col, text_col, False)
    near = cut(near)
    counts = near.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "rep")
    parts = connected_components(near.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    both = members.join(parts.join(counts, "rep"), "rep", "left")
    return both.select("doc_id", F.coalesce("component", "rep").alias("class_id"), F.col("n").alias("n_grams"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))


def keep_one_per_group(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that are near or exact copies of one with a lesser doc_id in their class (``similarity_classes``).

    Documents without n-grams (null, empty) or without doc_id stay. Rows that repeat a doc_id are one document, kept or dropped together, also where
    their texts differ. An empty table stays empty; columns keep their names, order and types, whatever they are called.
    """
    gone = similarity_classes(docs, n, threshold).where("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL
), grams AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {NGRAM}
      THEN list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(w[i:i + {NGRAM - 1}], ' ')) ELSE [array_to_string(w, ' ')] END)) AS g
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS overlap FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT doc_a, doc_b FROM met JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b WHERE overlap / (x.n + y.n - overlap) >= {THRESHOLD}
), reached AS (
  SELECT DISTINCT doc_a AS doc_id, doc_a AS other FROM links UNION SELECT doc_id, doc_b FROM reached JOIN links ON doc_a = other
)
SELECT d.doc_id, coalesce((SELECT min(other) FROM reached r WHERE r.doc_id = d.doc_id), d.doc_id) AS class_id,
       coalesce((SELECT n FROM sizes s WHERE s.doc_id = d.doc_id), 0) AS n_grams, (SELECT count(*) FROM links l WHERE l.doc_a = d.doc_id) AS n_links
FROM documents d WHERE d.doc_id IS NOT NULL
"""
