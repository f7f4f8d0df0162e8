"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

The base patterns fix what is always found. The field looks at the neighbourhood of digits, ``@`` and
spelled-out addresses: candidate segments of several words are scored by features of the whole span (digit
counts, check digits, separators, the word before), and dynamic programming over segments of bounded length
chooses boundaries and kinds jointly. It finds what the patterns miss: two card numbers in one run of digits,
numbers with other separators, phone numbers without a plus, addresses with "at" and "dot" spelled out, and a
kind of its own, secrets: keys, tokens and passwords that a word announces. Its weights are trained by maximum
likelihood on sentences made from a rule below. Base spans always stay; an added span never overlaps one, but
for a secret, which may hold digits that look like a number.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS, SECRET = 4, 4
#: Longest candidate segment in words, and words of context on each side of a trigger.
MOST_WORDS, CONTEXT = 8, 2

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c in _DIGITS)


def _is_ip(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return len(parts) == 4 and all(len(p) < 4 and int(p or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; code points, end exclusive."""
    out: list[tuple[int, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if not re.search("[0-9]", text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if _is_ip(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _only_digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m.group())) <= 15]
    return out


# --- the field -----------------------------------------------------------------------------------

_EDGES = ".,;:!?\"'<>{}|*#$%&=_"
_AT, _DOT = frozenset(("at", "(at)", "[at]", "@", "{at}")), frozenset(("dot", "(dot)", "[dot]", ".", "{dot}"))
#: Words that announce a kind of data.
_CUES = {
    "email": 0, "e-mail": 0, "mail": 0, "write": 0, "address": 0, "ip": 1, "host": 1, "server": 1, "login": 1,
    "card": 2, "visa": 2, "credit": 2, "pan": 2, "call": 3, "phone": 3, "tel": 3, "mobile": 3, "fax": 3, "reach": 3,
    "token": 4, "key": 4, "apikey": 4, "api_key": 4, "api-key": 4, "secret": 4, "client_secret": 4, "password": 4, "passwd": 4, "pwd": 4,
    "bearer": 4, "access_token": 4, "auth_token": 4, "private_key": 4, "credential": 4,
}
#: What may stand between such a word and its value.
_LINKS = frozenset(("=", ":", ":=", "=>", "is"))
_SECRET = re.compile(r"(?=[A-Za-z_+/-]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/.-]{8,}")
_TRIGGER = re.compile(r"[0-9@]|(?<!\S)[(\[{](?:at|dot)[)\]}](?!\S)|(?<!\S)at(?=\s+\S+\s+dot\s)", re.IGNORECASE)
#: Words; an equals sign is one of its own.
_WORD = re.compile(r"[^\s=]+|=")

Token = tuple[str, int, int]


def _trimmed(m: re.Match) -> Token | None:
    word, start = m.group(), m.start()
    left = len(word) - len(word.lstrip(_EDGES))
    word = word.strip(_EDGES)
    return (word, start + left, start + left + len(word)) if word else (m.group(), m.start(), m.end())


def regions(text: str) -> Iterator[list[Token]]:
    """Runs of words around triggers, with places; words far from any trigger are never looked at."""
    words: list[Token] = []
    reached = -1
    for t in _TRIGGER.finditer(text):
        if t.start() < reached:
            continue
        start = t.start()
        for _ in range(CONTEXT + 1):  # back over some words
            while start > 0 and text[start - 1].isspace():
                start -= 1
            while start > 0 and not text[start - 1].isspace():
                start -= 1
        if start > reached and words:
            yield words
            words = []
        past, cursor = 0, max(start, reached, 0)
        for m in _WORD.finditer(text, cursor):
            words.append(_trimmed(m))
            if m.end() > t.start():
                past += 1
            reached = m.end()
            if past > CONTEXT:
                break
    if words:
        yield words


NAMES = (
    "bias", "words", "digits<8", "digits 8-9", "digits 10-11", "digits 12-15", "digits 16-19", "digits>19", "luhn", "card groups",
    "plain digits", "letters", "at sign", "spelled at", "spelled dot", "dotted end", "four parts", "octets", "odd octet", "plus",
    "parenthesis", "dashes", "dots", "spaces in number", "phone groups", "date", "cue", "other cue", "glued letters", "one word",
    "long", "very long", "hex", "digit share", "case mixed",
)


def span_features(words: list[Token], i: int, j: int, kind: int) -> list[float] | None:
    """Features of the segment i..j (inclusive) as the kind; None if it can't be one."""
    part = [w[0] for w in words[i : j + 1]]
    s = " ".join(part)
    low = [w.lower() for w in part]
    digits, letters = _only_digits(s), any(c.isalpha() for c in s)
    n = len(digits)
    at_word, dot_word = any(w in _AT for w in low[1:-1]), any(w in _DOT for w in low[1:-1])
    if kind == SECRET:
        if i != j or not _SECRET.fullmatch(s):
            return None
    elif kind == 0:
        if not ("@" in s or at_word) or len(part) > 1 and (low[0] in _AT | _DOT or low[-1] in _AT | _DOT):
            return None
    elif n < 4 or not (part[0][0] in "+([0123456789" and part[-1][-1] in ")]0123456789"):
        return None
    elif kind == 1 and n > 12 or kind == 2 and not 12 <= n <= 19 or kind == 3 and not 7 <= n <= 15:
        return None
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    pieces = re.split(r"\s*(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\bdot\b|\.)\s*", s, flags=re.IGNORECASE)
    octets = len(pieces) == 4 and all(p.isascii() and p.isdigit() for p in pieces)
    k = i - 1
    if k > 0 and words[k][0].lower() in _LINKS:
        k -= 1
    before = words[k][0].lower().strip(_EDGES) if k >= 0 else ""
    cue = _CUES.get(before, -1)
    return [
        1.0, len(part) / 4, float(0 < n < 8), float(8 <= n <= 9), float(10 <= n <= 11), float(12 <= n <= 15), float(16 <= n <= 19), float(n > 19),
        float(n >= 12 and luhn(digits)), float(groups in ([4] * 4, [16], [4, 6, 5])), float(s == digits), float(letters), float("@" in s),
        float(at_word), float(dot_word), float(bool(re.search(r"(?:\.|dot[)\]}]?\s)\s*[a-z]{2,6}$", s, re.IGNORECASE))), float(len(groups) == 4),
        float(octets and all(int(p[:4]) <= 255 for p in pieces)), float(octets and any(int(p[:4]) > 255 for p in pieces)), float("+" in s),
        float("(" in s and n > 0), float("-" in s), float("." in s), float(" " in s and not letters),
        float(groups[-3:] in ([3, 3, 4], [3, 4, 4], [3, 3, 3], [2, 3, 4])),
        float(bool(re.fullmatch(r"(?:1[89]|20)\d\d[-./ ]\d\d?[-./ ]\d\d?(?:\D.*)?", s))), float(cue == kind), float(cue not in (-1, kind)),
        float(bool(re.search(r"[A-Za-z][0-9]|[0-9][A-Za-z]", s)) and "@" not in s), float(len(part) == 1),
        float(len(s) >= 16), float(len(s) >= 32), float(bool(re.fullmatch("[0-9a-fA-F]+", s))), n / len(s), float(s != s.lower() and s != s.upper()),
    ]


def candidates(words: list[Token]) -> list[tuple[int, int, int, list[float]]]:
    """(first, last, kind, features) of all segments that may be personal data."""
    out = []
    for i in range(len(words)):
        for j in range(i, min(len(words), i + MOST_WORDS)):
            for kind in range(len(KINDS)):
                f = span_features(words, i, j, kind)
                if f:
                    out.append((i, j, kind, f))
    return out


def decoded(words: list[Token], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's (first, last, kind); words outside score 0."""
    ends: dict[int, list[tuple[float, int, int]]] = {}
    for i, j, kind, f in candidates(words):
        score = float(weights[kind] @ np.array(f))
        if score > 0:
            ends.setdefault(j, []).append((score, i, kind))
    best, back = [0.0] * (len(words) + 1), [None] * (len(words) + 1)
    for j in range(len(words)):
        best[j + 1], back[j + 1] = best[j], None
        for score, i, kind in ends.get(j, ()):
            if best[i] + score > best[j + 1]:
                best[j + 1], back[j + 1] = best[i] + score, (i, j, kind)
    out, at = [], len(words)
    while at > 0:
        if back[at]:
            out.append(back[at])
            at = back[at][0]
        else:
            at -= 1
    return out[::-1]


def _with_check(digits: str) -> str:
    return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))


def sentences(count: int, seed: int = 11) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """Training sentences made by rule: words, and phrases with their kind (-1: none)."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice(("an", "er", "lo", "mi", "ta", "su", "ko", "re")) for _ in range(r.randint(1, 3)))
    card = lambda: _with_check(r.choice("4569") + d(14))
    octet = lambda: str(r.randint(0, 255))
    mail = (
        lambda: f"{name()}.{d(2)}@{name()}{d(1)}.example.com", lambda: f"{name()} at {name()} dot com", lambda: f"{name()} (at) {name()} dot org",
        lambda: f"{name()} [at] {name()} [dot] net", lambda: f"{name()} @ {name()}.org", lambda: f"{name()}@{name()} dot com",
    )
    ip = (lambda: ".".join(octet() for _ in range(4)), lambda: "[.]".join(octet() for _ in range(4)), lambda: " dot ".join(octet() for _ in range(4)))
    number = (
        card, card, lambda: " ".join(re.findall("....", card())), lambda: ".".join(re.findall("....", card())), lambda: "-".join(re.findall("....", card())),
    )
    phone = (
        lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"({d(3)}) 555-{d(4)}", lambda: f"{d(3)}-555-{d(4)}", lambda: f"{d(3)}.555.{d(4)}",
        lambda: f"+{r.randint(20, 99)} {d(3)} {d(3)} {d(4)}", lambda: f"{d(3)} 555 {d(4)}",
    )
    other = (
        lambda: d(r.randint(1, 12)), lambda: d(16) if not luhn(x := d(16)) else x[:-1], lambda: f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}",
        lambda: f"{r.randint(1, 9)}.{d(1)}.{d(2)}", lambda: f"{d(4)} {d(4)}", lambda: f"19{d(2)} 20{d(2)} 20{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"id={d(6)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"{name()} at {name()}", lambda: f"at {d(2)} {name()}",
        lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{d(3)}.{r.randint(256, 999)}.{d(2)}.{d(1)}", lambda: f"{d(5)} {d(5)} {d(5)}", lambda: f"{d(3)}-{d(2)}", lambda: d(20),
        lambda: f"{d(1)} {d(2)} {d(1)} {d(3)} {d(2)} {d(1)} {d(2)}", lambda: f"{name()}-{d(3)}-{name()}", lambda: f"{name()}{d(2)}{name()}", lambda: word("0123456789abcdef", 32, 40),
        lambda: f"page={d(2)}", lambda: f"{r.choice(cues[SECRET])} {name()}", lambda: f"the {r.choice(cues[SECRET])} of {d(4)}", lambda: f"{name()} = {d(3)}{name()}",
    )
    word = lambda letters, least, most: "".join(r.choice(letters) for _ in range(r.randint(least, most)))
    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    secret = (
        lambda: word("0123456789abcdef", 32, 64), lambda: word(mixed, 16, 48), lambda: f"{word(mixed[24:49], 2, 4)}_{word(mixed, 20, 40)}",
        lambda: f"{name()}{d(2)}-{word(mixed, 6, 12)}1x", lambda: word("0123456789abcdef", 16, 40), lambda: f"{word(mixed, 8, 12)}/{word(mixed, 8, 12)}+7a",
    )
    announced = ("{} = {}", "{}={}", "{}: {}", '{} = "{}"', "{}='{}'", "{} is {}", "{} {}")
    cues = [[w for w, k in _CUES.items() if k == kind] for kind in range(len(KINDS))]
    for _ in range(count):
        parts: list[tuple[str, int]] = []
        for _ in range(r.randint(1, 3)):
            parts += [(name(), -1) for _ in range(r.randint(0, 2))]
            kind = r.choice((-1, -1, -1, 0, 1, 2, 2, 3, 4))
            if kind == SECRET:
                parts += zip(_WORD.findall(r.choice(announced).format(r.choice(cues[kind]), r.choice(secret)())), (-1, -1, -1), strict=False)
                parts[-1] = (parts[-1][0], kind)
                continue
            if kind >= 0 and r.random() < 0.25:
                parts.append((r.choice(cues[kind]), -1))
            parts.append((r.choice((mail, ip, number, phone)[kind] if kind >= 0 else other)(), kind))
        parts.append((name(), -1))
        yield " ".join(p for p, _ in parts), parts


@lru_cache
def trained(count: int = 500, steps: int = 120) -> np.ndarray:
    """Weights (kind, feature) that make the right segmentations of the training sentences likeliest."""
    data = []
    for text, parts in sentences(count):
        words, right, at = [_trimmed(m) for m in _WORD.finditer(text)], set(), 0
        for phrase, kind in parts:
            n = len(_WORD.findall(phrase))
            if kind >= 0:
                right.add((at, at + n - 1, kind))
            at += n
        found = candidates(words)
        if found:
            data.append((len(words), [(i, j, k) for i, j, k, _ in found], np.array([f for *_, f in found]), np.array([k for _, _, k, _ in found]), np.array([(i, j, k) in right for i, j, k, _ in found], float)))
    w = np.zeros((len(KINDS), len(NAMES)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        grad = np.zeros_like(w)
        for n, segments, x, kinds, y in data:
            score = (x * w[kinds]).sum(axis=1)
            power = np.exp(np.clip(score, -40, 40)).tolist()
            ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            ends: list[list[int]] = [[] for _ in range(n)]
            starts: list[list[int]] = [[] for _ in range(n)]
            for k, (i, j, _) in enumerate(segments):
                ends[j].append(k)
                starts[i].append(k)
            for j in range(n):
                ahead[j + 1] = ahead[j] + sum(ahead[segments[k][0]] * power[k] for k in ends[j])
            for i in range(n - 1, -1, -1):
                behind[i] = behind[i + 1] + sum(behind[segments[k][1] + 1] * power[k] for k in starts[i])
            z = ahead[n]
            p = np.array([ahead[i] * power[k] * behind[j + 1] / z for k, (i, j, _) in enumerate(segments)])
            np.add.at(grad, kinds, (y - p)[:, None] * x)
        grad = grad / len(data) - 2e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def all_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and added spans together; each by kind, then start."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added = []
    for words in regions(text):
        for i, j, kind in decoded(words, weights):
            s, e = words[i][1], words[j][2]
            if kind == SECRET or not any(s < b and a < e for a, b in taken):
                added.append((kind, s, e))
    return base, sorted({*base, *added})


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced together."""
    out, at, open_ = [], 0, None
    for s, e, k in [*sorted((s, e, k) for k, s, e in spans), (len(text) + 1, 0, 0)]:
        if open_ and s < open_[1]:
            open_ = (open_[0], max(open_[1], e), open_[2])
            continue
        if open_:
            out += [text[at : open_[0]], f"<{KINDS[open_[2]].upper()}>"]
            at = open_[1]
        open_ = (s, e, k)
    return "".join(out) + text[at:]


def found(docs: DataFrame) -> DataFrame:
    """Per document: base counts, the digest of base spans, all spans, and their number.

    Null text counts as empty and has no spans. Rows with equal ids are searched each. Extra columns are
    ignored; an empty table gives an empty result.
    """
    weights = trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base, every = all_spans(text, weights) if _TRIGGER.search(text) else ([], [])
                counts = [sum(k == kind for k, _, _ in base) for kind in range(BASE_KINDS)]
                rows.append((*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), len(every), len(every) - len(base)))
            got = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added"])
            got.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield got

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span masked; n_chars follows the text, other columns and null texts stay."""
    weights = trained()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, all_spans(t, weights)[1]) if t and _TRIGGER.search(t) else t)

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
