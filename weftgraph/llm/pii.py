"""Personal data: candidate spans scored by gradient-boosted trees.

Base patterns (email, ip, card, phone) always count. Beyond them, generators
with high recall propose overlapping spans in other spellings: addresses with
written-out signs, numbers without a plus sign, other separators, IPv6. Boosted
trees score each by its format and context; a span is added where its calibrated
probability reaches its kind's threshold and it overlaps nothing better.

The trees are fitted on the driver to spans generated from format rules and
look-alikes (dates, versions, book numbers, prices, hashes) by a fixed seed.

Defined cases: null text counts as empty; an empty text has no spans; spans are
in code points of the whole text; repeated rows are searched each.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._base import map_texts, platt, sigmoid, table
from weftgraph.llm._boost import Boost

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that failed from a run's first digit fails from its others, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


#: Generators of candidates; all their repetitions are bounded.
_WRITTEN = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}[ \t]{0,2}(?:[(\[{<][ ]?at[ ]?[)\]}>]|\bat\b|@)[ \t]{0,2}[\w-]{1,63}(?:[ \t]{0,2}(?:[(\[{<][ ]?(?:dot|\.)[ ]?[)\]}>]|\bdot\b|\.)[ \t]{0,2}[\w-]{1,63}){1,5}", re.I)
_WRITTEN_SIGN = re.compile(r"[(\[{<] ?(?:at|dot) ?[)\]}>]|\bdot\b|@", re.I)
_GENERATORS = [
    (1, re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")),
    (1, re.compile(r"(?<![\w.])[0-9]{1,3}(?:[ ]?[\[({]?[.][\])}]?[ ]?[0-9]{1,3}){3}(?![\w])")),
    (2, re.compile(r"(?<![\w])[0-9]{4}(?:[ ./_–-]{1,3}[0-9]{2,7}){2,4}(?![\w])")),
    (3, re.compile(r"(?<![\w+.])(?:00[0-9]{1,3}[ .-])?\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{2,5}(?:[ ./-]{1,2}[0-9]{2,5}){0,3}(?![\w])")),
]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Proposed spans; they may overlap."""
    found = set()
    if _WRITTEN_SIGN.search(text):
        found |= {(0, m.start(), m.end()) for m in _WRITTEN.finditer(text)}
    if _DIGIT.search(text):
        for kind, p in _GENERATORS:
            found |= {(kind, m.start(), m.end()) for m in p.finditer(text)}
    return sorted(found)


#: Words that speak for or against a span when they stand before it, and endings of domains.
_FOR = ("mail", "contact", "write", "phone", "tel", "call", "mobile", "fax", "whatsapp", "ip", "host", "server", "addr", "card", "visa", "credit", "mastercard", "amex", "correo", "telefon", "téléphone", "teléfono", "karte", "carte", "tarjeta")
_AGAINST = ("version", "isbn", "issn", "date", "datum", "fecha", "page", "vol", "no.", "order", "token", "sha", "hash", "price", "total", "section", "chapter", "id", "born", "year", "between")
_ENDING = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "co", "eu", "us"}


def describe(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context features of a candidate."""
    kind, a, b = span
    s, d = text[a:b], _digits(text[a:b])
    groups = re.findall(r"[0-9]+", s)
    before = text[max(0, a - 32) : a].lower()
    seps = [c for c in s if not c.isalnum()]
    low = s.lower()
    last = re.split(r"[^\w]+", low.rstrip(")]}> "))[-1]
    number = [int(g) for g in groups[:8] if len(g) < 9]
    dated = bool(re.fullmatch(r"(?:19|20)\d\d[-./ ](?:0?[1-9]|1[0-2])[-./ ](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-./ ](?:0?[1-9]|[12]\d|3[01])[-./ ](?:19|20)?\d\d", s))
    return [
        *(float(kind == k) for k in range(4)),
        float(len(s)),
        float(len(d)),
        float(sum(c.isalpha() for c in s)),
        float(len(groups)),
        float(len(groups[0]) if groups else 0),
        float(len(groups[-1]) if groups else 0),
        float(len(set(seps))),
        float(len(seps)),
        float(luhn(d) if 13 <= len(d) <= 19 else 0),
        float(len(set(map(len, groups))) == 1 and len(groups) > 1),
        float(bool(number) and max(number) <= 255),
        float(dated),
        float("(at)" in low or "[at]" in low or "{at}" in low or "( at )" in low or "[ at ]" in low or "<at>" in low),
        float("dot" in low),
        float(" at " in low),
        float("@" in s),
        float(last in _ENDING),
        float(s.count(":")),
        float(s.startswith(("(", "00"))),
        float(any(w in before for w in _FOR)),
        float(any(w in before for w in _AGAINST)),
        float(before[-1:].isalnum() or before[-1:] in tuple("=#$€/-.")),
        float(text[b : b + 1].isalnum() or text[b : b + 1] in tuple("%/€$")),
        float(number[0] if number else -1),
    ]


def _examples(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Generated candidates: features, whether personal, kind."""
    r = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *x: x[int(r.integers(len(x)))]
    word = lambda: "".join(pick(*"abcdefghijklmnoprstuvw") for _ in range(int(r.integers(2, 9))))

    def card(valid: bool) -> str:
        d = pick("4", "5", "37", "6011") + num(14)
        d = d[:15]
        check = next(c for c in "0123456789" if luhn(d + c) == valid)
        return d + check

    def split(d: str, sep: str, *sizes: int) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(d[at : at + k])
            at += k
        return sep.join(out)

    hexes = lambda k: "".join(pick(*"0123456789abcdef") for _ in range(k))
    yes = [
        lambda: f"{word()}{pick(' ', '')}{pick('(at)', '[at]', '{at}')}{pick(' ', '')}{word()} {pick('(dot)', '[dot]', '.')} {pick('com', 'org', 'de', 'net')}".replace(" . ", "."),
        lambda: f"{word()} at {word()} dot {pick('com', 'org', 'fr', 'net')}",
        lambda: ":".join(hexes(4) for _ in range(8)),
        lambda: f"fe80::{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}",
        lambda: pick("[.]", "(.)").join(str(int(r.integers(1, 256))) for _ in range(4)),
        lambda: split(card(True), pick(".", "/", "_", " - "), 4, 4, 4, 4),
        lambda: f"({num(3)}) {pick('555', num(3))}-{num(4)}",
        lambda: f"{pick('2', '3', '4', '5', '6', '7')}{num(2)}{pick('-', '.')}{num(3)}-{num(4)}",
        lambda: f"00{pick('49', '33', '34', '1')} {num(2)} {num(3)} {num(4)}",
    ]
    no = [
        lambda: f"{word()} at {word()}.{word()}",
        lambda: f"{word()} (at) {word()}. {word()}",
        lambda: f"{word()} @ {word()}.{word()}",
        lambda: f"{num(2)}:{num(2)}:{num(2)}",
        lambda: f"{num(1)}.{num(1)}. {num(1)}.{num(2)}",
        lambda: ".".join(num(3) for _ in range(4)).replace("1", "9"),
        lambda: split(card(False), pick(".", "/", "_", " - "), 4, 4, 4, 4),
        lambda: f"{pick('19', '20')}{num(2)}-0{int(r.integers(1, 10))}-{int(r.integers(10, 29))}",
        lambda: f"{int(r.integers(1, 29))}.{int(r.integers(1, 13))}.{pick('19', '20')}{num(2)}",
        lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}",
        lambda: f"{num(3)} {num(3)} {num(3)}",
        lambda: f"{pick('19', '20')}{num(2)} - {pick('19', '20')}{num(2)}",
        lambda: f"{num(5)}-{num(4)}",
        lambda: f"{num(2)}/{num(2)}/{num(4)}",
        lambda: f"{num(3)}.{num(3)}.{num(3)}",
        lambda: f"{num(4)} {num(4)} {num(4)}",
    ]
    x, y, kinds = [], [], []
    while len(y) < n:
        good = bool(r.integers(2))
        near = pick(*_FOR) if r.random() < (0.4 if good else 0.1) else pick(*_AGAINST) if r.random() < (0.02 if good else 0.3) else word()
        body = pick(*(yes if good else no))()
        text = f"{word()} {near}{pick(' ', ': ')}{body} {word()}."
        lead = text.index(body)
        for span in candidates(text):
            if span[1] < lead + len(body) and span[2] > lead:
                x.append(describe(text, span))
                # A span that takes in words around the body, or cuts it short, is no good span.
                y.append(float(good and abs(span[1] - lead) <= 1 and abs(span[2] - lead - len(body)) <= 1))
                kinds.append(span[0])
    return np.array(x), np.array(y), np.array(kinds)


@lru_cache(maxsize=1)
def model(seed: int = 5, examples: int = 3000, precision: float = 0.99) -> tuple[Boost, tuple[float, float], dict[int, float]]:
    """Trees, calibration line, and for each kind the lowest threshold with that precision on other examples."""
    x, y, _ = _examples(seed, examples)
    trees = Boost().fit(x, y)
    x, y, kinds = _examples(seed + 1, examples)
    z = trees.score(x)
    line = platt(z, y, 1 - y)
    p = sigmoid(line[0] * z + line[1])
    least = {}
    for k in range(len(KINDS)):
        q, good = p[kinds == k], y[kinds == k]
        order = np.argsort(-q, kind="stable")
        kept = good[order].cumsum() / np.arange(1, len(q) + 1)
        ok = np.flatnonzero(kept >= precision)
        least[k] = max(0.5, float(q[order][ok[-1]])) if len(ok) else 2.0
    return trees, line, least


def _merged(spans: list) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans, ascending."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(starts: list[int], ends: list[int], a: int, b: int) -> int:
    """Where the span (a, b) would stand among disjoint ascending spans, or -1 if it overlaps one."""
    i = bisect_left(starts, b)
    return -1 if i and ends[i - 1] > a else i


def spans_of(texts: list[str], fitted) -> list[tuple[list, list]]:
    """For each text its base spans, and these with the added ones, by kind and start; the trees score all candidates in one call."""
    trees, line, least = fitted
    bases = [base_spans(t) for t in texts]
    free = []
    for t, base in zip(texts, bases):
        some = candidates(t)
        taken = _merged(base) if some else None
        free.append([c for c in some if _meets(*taken, c[1], c[2]) >= 0])
    rows = [describe(t, c) for t, some in zip(texts, free) for c in some]
    p = sigmoid(line[0] * trees.score(np.array(rows)) + line[1]) if rows else np.zeros(0)
    out, at = [], 0
    for base, some in zip(bases, free):
        q, at = p[at : at + len(some)], at + len(some)
        starts, ends, added = [], [], []
        for i in sorted(range(len(some)), key=lambda i: (-q[i], some[i])):
            k, a, b = some[i]
            if q[i] >= least[k] and (place := _meets(starts, ends, a, b)) >= 0:
                starts.insert(place, a)
                ends.insert(place, b)
                added.append(some[i])
        out.append((base, sorted(base + added) if added else base))
    return out


def all_spans(text: str, fitted) -> tuple[list, list]:
    return spans_of([text], fitted)[0]


def _join(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, counts of base spans, base_sha256 and spans for every row of docs."""
    fitted = model()

    def run(texts: list) -> list[pa.Array]:
        found = spans_of([t or "" for t in texts], fitted)
        counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
        return [
            *(pa.array(c, pa.int64()) for c in counts),
            pa.array([hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in found]),
            pa.array([_join(spans) for _, spans in found]),
        ]

    return map_texts(docs, keep, "text", "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", run)


def _redacted(text: str | None, fitted, spans: list | None = None) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for k, a, b in sorted(all_spans(text, fitted)[1] if spans is None else spans, key=lambda s: (s[1], -s[2])):
        if b > at:
            out += [text[at : max(a, at)], f"[{KINDS[k].upper()}]" if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars, if there, follows the new text."""
    fitted = model()

    def run(texts: list) -> list[pa.Array]:
        found = spans_of([t or "" for t in texts], fitted)
        return [pa.array([_redacted(t, fitted, spans) for t, (_, spans) in zip(texts, found)], pa.string())]

    columns = docs.columns
    out = map_texts(docs, columns, "text", "`weft·clean` string", run)
    new = {"text": F.col("`weft·clean`"), "n_chars": F.length("`weft·clean`").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
