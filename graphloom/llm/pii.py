"""Personal data and secrets, found by a semi-Markov conditional random field.

A text is cut into islands: runs of neighbouring white-space-separated chunks that hold a digit, an "@", a known prefix of keys or what
is assigned to a secret's name. No entity of the kinds sought lies outside them, an entity never spans two, and tokens between islands
all have the outside label with score zero, so the best labelling of a text is the islands' best labellings side by side.

In an island every segment of at most ``MOST_TOKENS`` tokens, and every longer one that is a run without blanks, quotes, brackets or commas, up to ``LONGEST`` characters,
is scored as a whole (shape, checksums, length, context, whether its edges cut
a word), and dynamic programming over segment ends chooses boundaries and kinds together. Weights are fitted by
conditional likelihood (forward-backward over segments) on sentences with entities set into invented prose, ``TRAIN`` of them, from a fixed seed.
"""

from __future__ import annotations

import functools
import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import arrow_batches, doc_texts, table, temp_name

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "IBAN", "SSN")
MOST_TOKENS = 20
#: Characters of a segment of more than MOST_TOKENS tokens: keys and signed tokens are longer than addresses.
LONGEST = 4096
#: Tokens of an island that are scored at a time: memory stays the same however long it is.
BLOCK = 2000
#: Characters of an address (RFC 3696).
LONGEST_EMAIL = 320
TRAIN = 700
EPOCHS = 12
NAMES = r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)"
#: What an island needs; the same filter runs in Spark, so that texts without one never leave the JVM.
KEYS = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30}|sk-[A-Za-z0-9_-]{16}|xox[abp]-[A-Za-z0-9-]{10}|eyJ[A-Za-z0-9_-]{8}"
TRIGGER = r"[0-9@]|" + KEYS + r"|(?i)" + NAMES + r"[\"']?\s{0,2}[:=]"

# every alternative begins at a chunk's beginning, so that a chunk is looked at once, however long it is
_HOT = re.compile(r"(?<!\S)(?:[^\s0-9@]*+[0-9@]\S*|\S*?(?:" + KEYS + r")\S*)")
_GIVEN = re.compile(NAMES + r"[\"']?\s{0,2}[:=]\s{0,2}(?=\S)", re.I)
_CHUNK = re.compile(r"\S+")
#: A run that may be one entity of many tokens; base64 may end in "=".
_RUN = re.compile(r"[^\s\"'`<>()\[\]{},;=]++(?:={1,2}(?![^\s\"'`<>()\[\]{},;=]))?")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_ASSIGNED = re.compile(NAMES + r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?$", re.I)
_SAID = re.compile(NAMES + r"\s{1,2}(?:is|was)\s{0,2}:?\s{1,2}[\"']?$", re.I)
_SSN_NAMED = re.compile(r"\b(?:ssn|social security)\b[^\n]{0,20}$", re.I)
_EMAIL = re.compile(r"[\w.+%-]*[^\W_][\w+%-]*@[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{1,4}(?:[ .-]\d{2,7}){1,5}")
_PLAIN_PHONE = re.compile(r"\+\d{8,15}")
_US_PHONE = re.compile(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}")
_CARD = re.compile(r"\d{13,19}|\d{4}([ -])\d{4,6}\1\d{4,5}(?:\1\d{1,4})?")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_SPACED_SSN = re.compile(r"\d{3} \d{2} \d{4}|\d{9}")
_IPV6 = re.compile(r"[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*")
#: Beginnings of card numbers that networks have given out, and their lengths.
_ISSUED = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|35(?:2[89]|[3-8]\d)\d{12}|(?:6011|64[4-9]\d|65\d\d|62\d\d)\d{12,15}|(?:50|5[6-8]|6)\d{11,17}")
_KEY = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]+)?|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}")
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
_NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*")

FEATURES = ("bias", "email", "ip", "phone", "phone_plus", "phone_paren", "phone_digits", "card", "luhn", "iban", "mod97", "ssn", "key", "hex", "hex_long", "assigned", "assigned_value", "number", "has_space", "starts_punct", "ends_punct", "cut_left", "cut_right", "one_token", "many_tokens", "digits_few", "digits_many", "mixed", "bracket", "dotted", "ip_port", "phone_us", "ssn_named", "ipv6", "said")
_AT = {f: i for i, f in enumerate(FEATURES)}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _ipv6(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def span_features(text: str, a: int, b: int, tokens: int) -> list[int]:
    """The whole-span features that hold for text[a:b]."""
    s = text[a:b]
    on = ["bias"]
    n = sum(map(str.isdigit, s))
    if "@" in s and len(s) <= LONGEST_EMAIL and _EMAIL.fullmatch(s):
        on.append("email")
    if n and s.isascii():
        if _IP.fullmatch(s):
            on.append("ip")
        if _PHONE.fullmatch(s) or _PLAIN_PHONE.fullmatch(s):
            on.append("phone")
            if s[0] == "+":
                on.append("phone_plus")
            if "(" in s:
                on.append("phone_paren")
            if 9 <= n <= 15:
                on.append("phone_digits")
            if n == 10 and _US_PHONE.fullmatch(s):
                on.append("phone_us")
        if 13 <= n <= 19 and _CARD.fullmatch(s):
            on.append("card")
            if _ISSUED.fullmatch(digits := "".join(filter(str.isdigit, s))) and luhn(digits):
                on.append("luhn")
        if _IBAN.fullmatch(s):
            on.append("iban")
            if 15 <= len(s.replace(" ", "")) <= 34 and _mod97(s):
                on.append("mod97")
        if _SSN.fullmatch(s):
            on.append("ssn")
        elif n == 9 and _SPACED_SSN.fullmatch(s) and _SSN_NAMED.search(text, max(0, a - 40), a):
            on.append("ssn_named")
        if 3 <= len(s) <= 45 and _IPV6.fullmatch(s) and _ipv6(s):
            on.append("ipv6")
        if _HEX.fullmatch(s):
            on.append("hex")
            if len(s) >= 32:
                on.append("hex_long")
        if _NUMBER.fullmatch(s):
            on.append("number")
    if len(s) >= 14 and _KEY.fullmatch(s):
        on.append("key")
    if _ASSIGNED.search(text, max(0, a - 30), a):
        on.append("assigned")
        if len(s) >= 6 and not any(c.isspace() or c in "\"'=;," for c in s):
            on.append("assigned_value")
    elif 6 <= len(s) and n and not s.isdigit() and not any(c.isspace() or c in "\"'=;,@" for c in s) and _SAID.search(text, max(0, a - 40), a):
        on.append("said")
    if any(map(str.isspace, s)):
        on.append("has_space")
    if not (s[0].isalnum() or s[0] in "+("):
        on.append("starts_punct")
    if not (s[-1].isalnum() or s[-1] == ")"):
        on.append("ends_punct")
    before, after, beyond = text[a - 1 : a], text[b : b + 1], text[b + 1 : b + 2]
    if before.isalnum() or before and before in "@._-+/(" or before == ":" and "ipv6" in on:
        on.append("cut_left")
    if after == ":" and beyond.isdigit() and "ip" in on:
        on.append("ip_port")
    elif after.isalnum() or after and after in "@_" or after and after in ".-/:)" and beyond.isalnum():
        on.append("cut_right")
    on.append("one_token" if tokens == 1 else "many_tokens" if tokens > 6 else "bias")
    on.append("digits_few" if n < 7 else "digits_many" if n > 12 else "bias")
    if n and any(map(str.isalpha, s)):
        on.append("mixed")
    if s.count("(") != s.count(")"):
        on.append("bracket")
    if "." in s:
        on.append("dotted")
    return sorted({_AT[f] for f in on})


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """The tokens (start, end) of each island of the text."""
    runs: list[list[int]] = []
    given = [_CHUNK.match(text, m.end()).span() for m in _GIVEN.finditer(text)]
    for a, b in sorted([m.span() for m in _HOT.finditer(text)] + given):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        elif runs and not text[runs[-1][1] : a].strip() and "\n" not in text[runs[-1][1] : a] and a - runs[-1][1] <= 2:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    for a, b in runs:
        yield [m.span() for m in _TOKEN.finditer(text, a, b)]


def long_runs(text: str, tokens: list[tuple[int, int]]) -> dict[int, list[int]]:
    """Segments of more than MOST_TOKENS tokens to score, as first tokens by end token: runs, without a full stop or the like at their end, and what follows a colon in one."""
    out: dict[int, set[int]] = {}
    if len(tokens) > MOST_TOKENS:
        begins, ends = [a for a, _ in tokens], [b for _, b in tokens]
        for m in _RUN.finditer(text, begins[0], ends[-1]):
            a, b = m.span()
            y, z = b, b
            while z > a and text[z - 1] in ".:!?":
                z -= 1
            while y > a and not text[y - 1].isalnum():
                y -= 1
            x = a
            while x < y and not text[x].isalnum():
                x += 1
            for a in {a, x, text.find(":", x, y) + 1 or x}:
                for b in {y, z}:
                    i, j = bisect_left(begins, a), bisect_left(ends, b)
                    if b - a <= LONGEST and i < len(begins) and j < len(ends) and begins[i] == a and ends[j] == b and j + 1 - i > MOST_TOKENS:
                        out.setdefault(j + 1, set()).add(i)
    return {j: sorted(i) for j, i in out.items()}


def segments(text: str, tokens: list[tuple[int, int]], start: int = 0, stop: int | None = None, long: dict[int, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All segments of at most MOST_TOKENS tokens, and the long ones, that end after token ``start`` and up to ``stop``: first token, end token, features as a 0/1 matrix."""
    long = long_runs(text, tokens) if long is None else long
    i = [(i, j) for j in range(start + 1, (len(tokens) if stop is None else stop) + 1) for i in (*long.get(j, ()), *range(max(0, j - MOST_TOKENS), j))]
    x = np.zeros((len(i), len(FEATURES)))
    for row, (a, b) in enumerate(i):
        x[row, span_features(text, tokens[a][0], tokens[b - 1][1], b - a)] = 1
    at = np.array(i, dtype=np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1], x


class Model:
    """Weights of span features by kind; the outside label has length one and score zero; ``follow`` scores an entity right after another."""

    def __init__(self, weights: np.ndarray, follow: float) -> None:
        self.weights, self.follow = weights, follow

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """Entities (start, end, kind) of the best labelling; ties go to the outside label, then to the earlier start and kind."""
        out = []
        for tokens in islands(text):
            n, long = len(tokens), long_runs(text, tokens)
            outside, inside = [0.0] * (n + 1), [-np.inf] * (n + 1)
            back: list = [None] * (n + 1)
            came: list = [False] * (n + 1)
            for begin in range(0, n, BLOCK):
                stop = min(n, begin + BLOCK)
                first, _, x = segments(text, tokens, begin, stop, long)
                score = x @ self.weights
                first, kind, best = first.tolist(), score.argmax(1).tolist(), score.max(1).tolist()
                row = 0
                for j in range(begin + 1, stop + 1):
                    outside[j] = max(outside[j - 1], inside[j - 1])
                    came[j] = inside[j - 1] > outside[j - 1]
                    rows = min(j, MOST_TOKENS) + len(long.get(j, ()))
                    for k in range(row, row + rows):
                        i = first[k]
                        from_inside = inside[i] + self.follow > outside[i]
                        s = (inside[i] + self.follow if from_inside else outside[i]) + best[k]
                        if s > inside[j]:
                            inside[j], back[j] = s, (i, kind[k], from_inside)
                    row += rows
            j, state = n, inside[n] > outside[n]
            found = []
            while j:
                if state:
                    i, k, state = back[j]
                    found.append((tokens[i][0], tokens[j - 1][1], KINDS[k]))
                    j = i
                else:
                    state = came[j]
                    j -= 1
            out += found[::-1]
        return out


def _loss(model: Model, item: tuple) -> tuple[float, np.ndarray, float]:
    """Negative log likelihood of an island's gold segmentation, and its gradients."""
    first, last, x, gold, n = item
    s = x @ model.weights
    f = model.follow
    alpha = np.full((n + 1, 2), -np.inf)
    alpha[0, 0] = 0
    total = np.logaddexp.reduce(s, axis=1)
    lo = np.searchsorted(last, np.arange(n + 2))
    for j in range(1, n + 1):
        r = slice(lo[j], lo[j + 1])
        i = first[r]
        alpha[j, 0] = np.logaddexp(alpha[j - 1, 0], alpha[j - 1, 1])
        alpha[j, 1] = np.logaddexp.reduce(np.logaddexp(alpha[i, 0], alpha[i, 1] + f) + total[r])
    beta = np.full((n + 1, 2), -np.inf)
    beta[n] = 0
    by = np.argsort(first, kind="stable")
    fo = np.searchsorted(first[by], np.arange(n + 2))
    for i in range(n - 1, -1, -1):
        r = by[fo[i] : fo[i + 1]]
        go = np.logaddexp.reduce(beta[last[r], 1] + total[r])
        beta[i, 0] = np.logaddexp(beta[i + 1, 0], go)
        beta[i, 1] = np.logaddexp(beta[i + 1, 0], go + f)
    z = beta[0, 0]
    enter = np.logaddexp(alpha[first, 0], alpha[first, 1] + f)
    p = np.exp(enter[:, None] + s + beta[last, 1][:, None] - z)
    both = np.exp(alpha[first, 1] + f + total + beta[last, 1] - z).sum()
    g = x.T @ p
    score, follows, end = 0.0, 0, -1
    for row, kind in gold:
        g[:, kind] -= x[row]
        score += s[row, kind]
        if first[row] == end:
            follows += 1
        end = last[row]
    return z - score - f * follows, g, both - follows


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random, valid: bool) -> str:
    body = r.choice(["4", "4", "51", "53", "6011", "65", "3530"])
    body += _digits(r, 15 - len(body))
    right = next(c for c in "0123456789" if luhn(body + c))
    return body + (right if valid else str((int(right) + r.randint(1, 9)) % 10))


def _entity(r: random.Random, kind: str, word) -> tuple[str, str, str]:
    """Text before, the entity, text after."""
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    if kind == "EMAIL":
        local = r.choice([".".join(word() for _ in range(r.randint(8, 14))), word(), word(), word(), word() + "." + word(), word() + "." + _digits(r, 2), word() + "_" + _digits(r, 1), word() + "+" + word()])
        return "", local + "@" + r.choice(["", "mail" + _digits(r, 1) + "."]) + r.choice(["example", "host", "corp-x"]) + "." + r.choice(["com", "org", "de", "co.uk"]), ""
    if kind == "PHONE":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return "", r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+49 {a} {c}{b}", f"+33 {_digits(r, 1)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)}", f"+{r.randint(1, 99)}-{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44{a}{b}{c}"]), ""
    if kind == "IP":
        if r.random() < 0.25:
            groups = [f"{r.randint(0, 65535):x}" for _ in range(8)]
            return "", r.choice([":".join(groups), f"2001:{groups[0]}::{groups[1]}", f"fe80::{':'.join(groups[:4])}"]), ""
        most = r.choice([255, 255, 30, 9])
        return "", ".".join(str(r.randint(0, most)) for _ in range(4)), f":{r.randint(20, 65000)}" if r.random() < 0.2 else ""
    if kind == "CARD":
        d = _card(r, True)
        return "", r.choice([d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))]), ""
    if kind == "SSN":
        if r.random() < 0.3:
            return r.choice(["SSN ", "SSN: ", "social security number "]), r.choice([f"{_digits(r, 3)} {_digits(r, 2)} {_digits(r, 4)}", _digits(r, 9)]), ""
        return "", f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", ""
    if kind == "IBAN":
        body = _digits(r, 18)
        code = next(f"DE{k:02d}" for k in range(2, 100) if _mod97(f"DE{k:02d}{body}"))
        s = code + body
        return "", r.choice([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))]), ""
    way = r.randint(0, 10)
    b64 = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_") for _ in range(n))
    if way == 6:
        return "", f"eyJ{b64(r.randint(12, 40))}.eyJ{b64(r.randint(12, 200))}.{b64(r.randint(20, 90))}x", ""
    if way == 7:
        return r.choice(["token=", "secret = ", "api_key: "]), "-".join(hexes(4) for _ in range(r.randint(3, 16))), ""
    if way == 8:
        return r.choice(["password is ", "the passphrase was ", "pwd is: "]), word() + word() + _digits(r, 2), ""
    if way == 9:
        return r.choice(["password = ", '"password": "', "passwd : "]), word() + word() + word() + "x", ""
    if way == 10:
        return r.choice(["secret: ", "token = "]), word() + r.choice("-._") + word() + r.choice("-._") + word() + _digits(r, 2), ""
    if way == 0:
        return "", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), ""
    if way == 1:
        return r.choice(["token", "secret", "api_key"]) + ' = "', hexes(40), '"'
    if way == 2:
        return r.choice(["password=", "passwd=", "pwd: ", "token="]), hexes(r.choice([12, 18, 24])), ""
    if way == 3:
        return "password=", word() + r.choice("!#%") + _digits(r, 3) if r.random() < 0.3 else word() + _digits(r, 3) + word(), ""
    if way == 4:
        return "", hexes(r.choice([32, 40, 64])), ""
    return "", "ghp_" + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKL0123456789") for _ in range(36)), ""


def _negative(r: random.Random, word) -> str:
    d = lambda n: _digits(r, n)
    return r.choice([
        f"the token is {word()}", f"the secret: {word()[:3]}", f"token: {word()[:4]}", f"password was {d(1)}", f"{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", d(1), d(2), d(4), d(6), d(8), d(9), f"{d(4)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{d(4)}",
        f"{r.randint(0, 23)}:{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"${d(3)}.{d(2)}", f"{d(2)}%", f"{word()}{d(1)}", f"{word()}-{d(3)}", f"{d(3)}-{d(3)}", _card(r, False), _card(r, False), "7" + _card(r, True)[1:], d(12), f"{d(2)}:{d(2)}:{d(2)}", f"{d(3)} {d(2)} {d(4)}", f"{word()}::{word()}", f"{d(2)}.{d(2)}.{d(4)}", ".".join(word() + d(1) for _ in range(12)), "/".join(word() + d(2) for _ in range(11)), f"{r.randint(256, 999)}.{d(3)}.{d(2)}.{d(1)}", f"@{word()}", f"{word()}@{word()}", f"{d(4)} {d(4)}", f"{d(2)} {d(3)} {d(2)}", f"{d(2)}-{d(2)}",
        f"{d(1)} {d(2)} {d(1)} {d(3)}", f"CC BY-NC {r.randint(1, 4)}.0", f"{d(3)}.", f"{word().upper()}{d(2)}", f"https://{word()}.org/{d(3)}?p={d(2)}", f"x={d(2)}", f"{word()}={word()}",
    ])


def training_rows(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Invented sentences and the entities in them: (text, [(start, end, kind)])."""
    r = random.Random(seed)
    parts = ["ba", "ne", "tion", "er", "the", "ou", "schl", "é", "ñ", "ing", "st", "ar", "ó", "en", "ü", "lo", "r"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    out = []
    for _ in range(n):
        tail = r.choice(["", "", "", "###", "$$$", "&&&", "***", "%%%", "!!"])
        text, gold = "", []
        for _ in range(r.randint(3, 8)):
            x = r.random()
            if x < 0.35:
                kind = r.choice([*KINDS, "SECRET"])
                before, s, after = _entity(r, kind, word)
                lead = r.choice(["", "", "", "(", '"', "<", "["])
                text += lead + before
                gold.append((len(text), len(text) + len(s), kind))
                text += s + after + {"": "", "(": ")", '"': '"', "<": ">", "[": "]"}[lead]
            elif x < 0.65:
                text += _negative(r, word)
            else:
                text += word()
            text += r.choice(["", "", "", ".", ",", ";", "!"]) + tail + r.choice([" "] * 9 + ["\n"])
        out.append((text, gold))
    return out


@functools.cache
def fit(rows: int = TRAIN, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits the weights by AdaGrad on the islands of ``rows`` invented sentences."""
    kind_of = {k: i for i, k in enumerate(KINDS)}
    items = []
    for text, gold in training_rows(rows, seed):
        ends = {(a, b): k for a, b, k in gold}
        for tokens in islands(text):
            first, last, x = segments(text, tokens)
            where = {(tokens[i][0], tokens[j - 1][1]): row for row, (i, j) in enumerate(zip(first, last, strict=True))}
            items.append((first, last, x, sorted((where[s], kind_of[k]) for s, k in ends.items() if s in where), len(tokens)))
    model = Model(np.zeros((len(FEATURES), len(KINDS))), 0.0)
    model.weights[0] = -2.0
    seen, seen_f = np.full(model.weights.shape, 1e-2), 1e-2
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(items)
        for item in items:
            _, g, gf = _loss(model, item)
            g += 2e-4 * model.weights
            seen += g * g
            seen_f += gf * gf
            model.weights -= 0.4 * g / np.sqrt(seen)
            model.follow -= 0.4 * gf / np.sqrt(seen_f)
    return model


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def _hit(text):
    return F.coalesce(text.rlike(TRIGGER), F.lit(False))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_entities, kinds, starts, ends, redacted) of every row in which an entity is found; positions count code points from 0.

    * Null and empty texts have no entities and give no row; neither do clean texts. A null doc_id stays null.
    * Repeated rows each give their row. Very long texts are read whole. Equal scores fall to the outside label, then to the earlier start.
    * Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    model = model or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow_batches(batches):
            got = [model.decode(t) for t in texts]
            rows = [(i, t, f) for i, (t, f) in enumerate(zip(texts, got, strict=True)) if f]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array([i for i, *_ in rows], pa.int64())), pa.array([len(f) for *_, f in rows], pa.int32()), pa.array([[k for *_, k in f] for *_, f in rows], pa.list_(pa.string())),
                pa.array([[a for a, _, _ in f] for *_, f in rows], pa.list_(pa.int32())), pa.array([[b for _, b, _ in f] for *_, f in rows], pa.list_(pa.int32())), pa.array([redact(t, f) for _, t, f in rows], pa.string()),
            ], ["doc_id", "n_entities", "kinds", "starts", "ends", "redacted"])

    rows = doc_texts(docs)
    return rows.where(_hit(rows["text"])).mapInArrow(run, "doc_id bigint, n_entities int, kinds array<string>, starts array<int>, ends array<int>, redacted string")


def redact_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced by its kind in brackets, and ``n_chars``, where there is one, counted anew.

    Texts without a trigger stay in the JVM; null texts stay null, empty ones empty. Rows are redacted one by one, so repeated ones alike; very long texts are read
    whole; equal scores are settled as in ``find``. All columns keep their names, order and types; an empty table stays empty.
    """
    model = model or fit()

    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, model.decode(t)) for t in text], dtype=object)

    clean.__annotations__ = {"text": pd.Series, "return": pd.Series}
    hit, done = temp_name("hit", docs.columns), temp_name("done", docs.columns)
    # one scan: texts without a trigger go to Python as nulls
    rows = docs.withColumn(hit, _hit(docs["text"]))
    rows = rows.withColumn(done, F.pandas_udf(clean, "string")(F.when(F.col(hit), F.col("text"))))
    text = F.when(F.col(hit), F.col(done)).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(hit), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(new).select(docs.columns)


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
