"""Byte-level BPE encoding and decoding against a public rank file.

Text is cut into words as the vocabulary's pattern says (runs of one character class, with a blank before them; contractions; white space), by array operations over
code points. Distinct words are encoded once per chunk and kept in a bounded cache. A short word is a contiguous array of parts and one of the ranks
of adjacent pairs: the least rank is found by a scan, its boundary deleted, and the two neighbouring ranks refreshed, until no pair has a rank; words of
one length share the passes as rows of a matrix. Long words, where scanning is quadratic, use a heap with the same outcome.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import U64, chunks, code_points, doc_texts, mix, powers, table

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHORT = 64
CACHE = 400_000
NONE = np.int32(2**31 - 1)
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    first = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    out = np.full(0x110000, _OTHER, np.uint8)
    out[first == "L"], out[first == "N"] = _LETTER, _NUMBER
    out[_WHITE] = _SPACE
    return out


def word_starts(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pattern's words begin: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space (all but the last before a word)."""
    if not len(cp):
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    edge = np.zeros(len(cp) + 1, np.bool_)
    edge[starts] = True
    begin = edge[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begin)
    end = np.append(run[1:], len(cp))
    kinds = kind[run]
    inner = ~edge[end]  # a run follows in the same text
    blank = inner & (kinds == _SPACE)
    last = end[blank] - 1
    begin[last] = True
    begin[last[cp[last] == 32] + 1] = False
    quote = run[inner & (kinds == _OTHER) & (end - run == 1) & (cp[run] == 39)]
    quote = quote[begin[quote] & (kind[quote + 1] == _LETTER)]
    if len(quote):
        edge_or = lambda at: edge[at] | (kind[np.minimum(at, len(cp) - 1)] != _LETTER)
        one = cp[quote + 1]
        two = np.where(edge_or(quote + 2), 0, cp[np.minimum(quote + 2, len(cp) - 1)])
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        size = np.where((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, size)
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        after = quote + 1 + size
        begin[after[~edge_or(after)]] = True
    return np.flatnonzero(begin)


class Vocabulary:
    """Token bytes by id, and the table of pairs of tokens that together are a token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        by_id = [b""] * self.size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.length = np.fromiter(map(len, by_id), np.int64, self.size)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())})

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where together they are no token."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode_short(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words of one length (rows of bytes): rows of ids, and how many of each row count."""
        n, size = words.shape
        parts = self.bytes[words]
        if size == 1:
            return parts, np.ones(n, np.int64)
        ranks = self.pairs(parts[:, :-1], parts[:, 1:])
        left = np.full(n, size, np.int64)
        rows = np.arange(n)
        done_parts = parts
        while size > 1:
            least = ranks.argmin(1)
            rank = ranks[np.arange(len(rows)), least]
            go = rank != NONE
            if not go.all():
                done_parts[rows[~go], :size] = parts[~go]
                rows, parts, ranks, least, rank = rows[go], parts[go], ranks[go], least[go], rank[go]
            if not len(rows):
                return done_parts, left
            k = np.arange(len(rows))
            size -= 1
            left[rows] = size
            col = np.arange(size)
            parts = parts[k[:, None], col + (col > least[:, None])]
            parts[k, least] = rank
            col = np.arange(size - 1)
            ranks = ranks[k[:, None], col + (col >= least[:, None])] if size > 1 else ranks[:, :0]
            for side in (least - 1, least):
                there = (side >= 0) & (side < size - 1)
                if there.any():
                    r, c = k[there], side[there]
                    ranks[r, c] = self.pairs(parts[r, c], parts[r, c + 1])
        done_parts[rows, :size] = parts
        return done_parts, left

    def encode_long(self, word: bytes) -> list[int]:
        """The same by a heap of adjacent pairs over a linked list, for words of any length."""
        parts = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        first = self.pairs(np.array(parts[:-1]), np.array(parts[1:])) if n > 1 else []
        heap = [(int(r), k) for k, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        table = self.table
        gone = [False] * n
        while heap:
            rank, k = heapq.heappop(heap)
            if gone[k] or after[k] >= n or table.get(parts[k] << 32 | parts[after[k]]) != rank:
                continue
            x = after[k]
            gone[x] = True
            parts[k] = rank
            after[k] = after[x]
            if after[k] < n:
                before[after[k]] = k
                r = table.get(rank << 32 | parts[after[k]])
                if r is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0:
                r = table.get(parts[before[k]] << 32 | rank)
                if r is not None:
                    heapq.heappush(heap, (r, before[k]))
        return [p for p, g in zip(parts, gone, strict=True) if not g]

    @functools.cached_property
    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.values.tolist(), strict=True))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words on end, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        cut = np.flatnonzero(np.diff(size[order])) + 1
        for group in np.split(order, cut) if len(order) else []:
            n = int(size[group[0]])
            if n > SHORT:
                for w in group:
                    ids = self.encode_long(words[w])
                    counts[w] = len(ids)
                    found.append((np.full(len(ids), w), np.array(ids, np.int32)))
            elif n:
                rows = np.frombuffer(b"".join([words[w] for w in group]), np.uint8).reshape(len(group), n)
                ids, left = self.encode_short(rows)
                counts[group] = left
                keep = np.arange(n) < left[:, None]
                found.append((np.repeat(group, left), ids[keep]))
        if not found:
            return np.zeros(0, np.int32), counts
        owner = np.concatenate([o for o, _ in found])
        return np.concatenate([i for _, i in found])[np.argsort(owner, kind="stable")], counts

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens on end."""
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.blob[np.repeat(self.offset[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """Encodes texts; distinct words are kept in a cache of at most about ``most`` words, then it starts anew."""

    def __init__(self, vocabulary: Vocabulary, most: int = CACHE) -> None:
        self.vocabulary, self.most = vocabulary, most
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, U64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids, count = self.vocabulary.encode_words(words)
        if len(self.known) + len(words) > self.most:
            self._clear()
        at = len(self.flat) + np.cumsum(count) - count
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.count = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.count, count])[order]
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts on end, and where each text's begin (one entry more than texts)."""
        cp, starts = code_points(texts)
        begin = word_starts(cp, starts)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        end = np.append(begin[1:], len(cp))
        up, down = powers(len(cp) + 1)
        total = np.zeros(len(cp) + 1, U64)
        np.cumsum((cp.astype(U64) + U64(1)) * up[: len(cp)], out=total[1:])
        hashes, first, which = np.unique(mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64)), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, hashes)
        spot[spot == len(self.known)] = 0
        new = self.known[spot] != hashes if len(self.known) else np.ones(len(hashes), np.bool_)
        joined = "".join(texts)
        if new.any():
            if len(self.known) + int(new.sum()) > self.most:
                self._clear()
                new[:] = True
            a, b = begin[first[new]].tolist(), end[first[new]].tolist()
            self._learn(hashes[new], [joined[x:y].encode("utf-8", "surrogatepass") for x, y in zip(a, b, strict=True)])
            spot = np.searchsorted(self.known, hashes)
        at, count = self.at[spot][which], self.count[spot][which]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(at - (ends - count), count) + np.arange(int(ends[-1]))]
        per = np.concatenate([[0], ends])[np.searchsorted(begin, starts)]
        return ids, per


def _encode(shared, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                own = texts[a:b]
                ids, starts = encoder.encode(own)
                good = np.ones(len(own), np.bool_)
                if verify:
                    raw = [t.encode("utf-8", "surrogatepass") for t in own]
                    back = vocabulary.bytes_of(ids)
                    if back.tobytes() != b"".join(raw):
                        # two words with one 64-bit hash: encode the texts they are in one by one, without a cache
                        parts = [ids[starts[k] : starts[k + 1]] for k in range(len(own))]
                        for k, t in enumerate(own):
                            if vocabulary.bytes_of(parts[k]).tobytes() != raw[k]:
                                parts[k] = Encoder(vocabulary).encode([t])[0]
                                good[k] = vocabulary.bytes_of(parts[k]).tobytes() == raw[k]
                        ids = np.concatenate(parts)
                        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)), pa.array(good)], ["doc_id", "n_tokens", "ids", "round_trip"]
                )

    return run


@functools.cache
def vocabulary(path: str = PATH) -> Vocabulary:
    return Vocabulary.load(path)


def encode(docs: DataFrame, path: str = PATH, verify: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row; ``round_trip``: decoding the ids gave the text's bytes again.

    * Null and empty texts have no tokens (an empty array). A null doc_id stays null. Repeated rows each give their row.
    * Texts and words of any length are encoded whole; special tokens' strings are ordinary text. Equal ranks merge from the left.
    * Other columns are ignored, whatever their names; an empty table gives no rows. ``path`` is read by the driver only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    return doc_texts(docs).mapInArrow(_encode(shared, verify), "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, path: str = PATH) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids). Bytes that are no UTF-8 become U+FFFD, as do ids out of range; null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            out = []
            for ids in batch.column("ids").to_pylist():
                if ids is None:
                    out.append(None)
                    continue
                a = np.array([-1 if i is None else i for i in ids], np.int64)
                bad = (a < 0) | (a >= v.size)
                if bad.any():
                    cuts = np.split(a, np.flatnonzero(bad))
                    out.append("".join(("�" if len(c) and (c[0] < 0 or c[0] >= v.size) else "") + v.bytes_of(c[(c >= 0) & (c < v.size)]).tobytes().decode("utf-8", "replace") for c in cuts))
                else:
                    out.append(v.bytes_of(a).tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select(tokens["doc_id"].cast("bigint").alias("doc_id"), tokens["ids"].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def op4_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
