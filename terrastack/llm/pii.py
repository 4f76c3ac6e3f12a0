"""Personal data: base patterns, and spans that a character-level BiLSTM-CRF adds to them.

The network is trained on forms that the base doesn't know as well: addresses written with ``[at]`` or spaces,
dotted or slashed cards, phones without a plus, defanged addresses, a phone or card that the base swallows together
with the number after it, and secrets (tokens, keys, passwords), a kind of its own. What it says is taken where the best
tags beat the best ones without the span by ``MARGIN``; only arithmetic that a sequence of characters can't show is
held against it: the check digit of cards and the range of address parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.bilstm import Tagger, char_classes
from terrastack.llm.textkit import buffer, runs_of_rows

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the network: the base's, and secrets.
LEARNT = (*KINDS, "secret")
#: Windows of the network, and how far each is from the next.
WINDOW, STRIDE = 64, 32
#: Characters of a stretch that are decoded at once, and what neighbouring sections of a longer one share.
SECTION, SHARED = 8192, 512
#: Windows held in memory at a time.
HELD = 4096
#: Log-odds of a span against the best tags without it.
MARGIN = 3.0

#: No kind is without one of these.
_TRIGGER = re.compile(r"[0-9@]+|[\[({]\s?at\s?[\])}]", re.I)

# Fixed patterns of the base.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9.]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and non-overlapping within each kind, ordered by start, then kind."""
    found: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:  # from each @ to the left: no run of local characters is read twice
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub(r"[\x20-]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = sorted(spans, key=lambda x: (x[0], LEARNT.index(x[2]), x[1]))
    return ",".join(f"{k}:{s}:{e}" for s, e, k in order)


# ---------------------------------------------------------------- labelled spans


def written(rng: np.random.Generator) -> tuple[str, str, str, str]:
    """A made-up item: text before it, the item, text after it, and its kind. Forms may differ from the base's."""
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    case = pick(str, str, str, str.upper)
    kind = pick(*LEARNT)
    if kind == "email":
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), ("@ ", "."), (" [at] ", "."), ("[at]", "."), ("(at)", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "[dot]"))
        domain = dot.join([*pick((), (), (name(5) + digits(1),)), name(rng.integers(3, 10)), pick("com", "org", "net", "de", "fr", "co")])
        return "", case(f"{name(rng.integers(2, 9))}{pick('.', '_', '', '-')}{pick(name(rng.integers(2, 7)), digits(rng.integers(0, 4)))}{at}{domain}"), "", kind
    if kind == "ip":
        return "", pick(".", ".", " . ", "[.]", "(.)", "[dot]").join(str(x) for x in rng.integers(0, 256, 4)), pick("", "", f":{digits(4)}", f" {digits(16)}"), kind
    if kind == "card":
        body = (pick("4", "5", "37", "6011", digits(1)) + digits(15))[:15]
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick("", "", " ", "-", ".", "/", "  ", " - ", "_")
        return "", sep.join(body[i : i + 4] for i in range(0, 16, 4)), pick("", "", f" {digits(3)}", f" {digits(16)}") if sep in ("", ".", "/") else "", kind
    if kind == "phone":
        area, mid, end = digits(3), digits(3), digits(4)
        item = pick(f"+1 ({area}) {mid}-{end}", f"+1-{area}-{mid}-{end}", f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"+44 {digits(2)} {digits(4)} {end}", f"00{digits(2)} {area} {mid} {end}", f"{area}.{mid}.{end}", f"{area}/{mid}{end}", f"0{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"({area}) {mid} {end}")
        return pick("", "", "", "tel. ", "phone: "), item, pick("", "", "", f" {'.'.join(str(x) for x in rng.integers(1, 256, 4))}", f" {digits(16)}"), kind
    hexed = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, pick(32, 40, 40, 64)))
    free = "".join("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"[i] for i in rng.integers(0, 56, int(rng.integers(16, 40)))) + digits(1)
    word = pick("token", "token", "secret", "api_key", "apikey", "password", "passwd", "access_key", "auth", "key")
    quote = pick('"', '"', "'", "")
    before = case(word) + pick(" = ", " = ", "=", ": ", " : ", ":") + quote
    return before, case(pick(hexed, hexed, free, f"AKIA{free[:16].upper()}", f"ghp_{free}", f"sk-{free}")), quote, kind


def other(rng: np.random.Generator) -> str:
    """Characters with digits or an @ that are no personal data."""
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexed = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, pick(6, 8, 10)))
    return pick(
        f"version {digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"BY-NC {digits(1)}.0.", f"#{hexed}", digits(rng.integers(1, 7)), digits(rng.integers(1, 5)) + pick(".", ",", "!!", ")", ";"), f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}",
        f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(3)},{digits(3)}", f"{digits(1)},{digits(3)},{digits(3)}", f"@{hexed[:5]}", f"{digits(1)}.{digits(2)} %", digits(9), f"${digits(2)}.{digits(2)}",
        f"ISBN {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(4)}-{digits(4)}", f"pp. {digits(3)}-{digits(3)}", f"[{digits(2)}]", f"({digits(4)})", f"{digits(1)} {digits(1)} {digits(1)} {digits(2)}", f"x{digits(1)} = {digits(3)}", f"key = {digits(2)}", f"token {digits(2)}",
    )


def made_up(snippets: list[str], n: int, rng: np.random.Generator) -> list[tuple[str, list[Span]]]:
    """Windows of corpus prose with made-up items, and their spans."""
    prose = [s for s in snippets if s.strip()] or ["of the and in it was for that with"]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < 2 * WINDOW:
            words = prose[rng.integers(len(prose))].split()
            at = rng.integers(len(words)) if words else 0
            text += " ".join(words[at : at + rng.integers(1, 5)]) + " "
            if rng.random() < 0.5:
                before, item, after, kind = written(rng)
                text += before
                spans.append((len(text), len(text) + len(item), kind))
                text += item + after + ("", "", "", ".", ",", "!!")[rng.integers(6)] + " "
            elif rng.random() < 0.6:
                text += other(rng) + " "
        cut = int(rng.integers(0, max(1, len(text) - WINDOW)))
        out.append((text[cut : cut + WINDOW], [(max(s - cut, 0), min(e - cut, WINDOW), k) for s, e, k in spans if e > cut and s < cut + WINDOW]))
    return out


def tagged(examples: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags: 0 none, 1 + 2k the first character of kind k, 2 + 2k a later one."""
    x, y = np.zeros((len(examples), WINDOW), np.int64), np.zeros((len(examples), WINDOW), np.int64)
    for i, (text, spans) in enumerate(examples):
        c = char_classes(text[:WINDOW])
        x[i, : len(c)] = c
        for s, e, kind in spans:
            k = LEARNT.index(kind)
            y[i, s:e] = 2 + 2 * k
            if s < WINDOW:
                y[i, s] = 1 + 2 * k
    return x, y


def train(docs: DataFrame, most: int = 4000, examples: int = 6000, seed: int = 7) -> Tagger:
    """Fit on labelled spans: base spans of about ``most`` rows (smallest hashes of id and text), and made-up ones.

    At most ``4 * most`` windows of 64 characters reach the driver, whatever ids and texts repeat.
    """
    n = max(docs.count(), 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                found = base_spans(text) if re.search("[0-9@]", text) else []
                for s, e, _ in found[:4] or [(0, 0, "")]:
                    a = max(0, s - 20)
                    texts.append(text[a : a + WINDOW])
                    spans.append(joined([(max(x - a, 0), min(y - a, WINDOW), k) for x, y, k in found if y > a and x < a + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.string())], names=["text", "spans"])

    chosen = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) < most)
    windows = chosen.select("text").mapInArrow(of, "text string, spans string")
    got = windows.orderBy(F.xxhash64("text", "spans"), "text", "spans").limit(4 * most).toArrow().to_pylist()
    silver = [(r["text"], [(int(s), int(e), k) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]) for r in got]
    with_spans, without = [x for x in silver if x[1]], [x for x in silver if not x[1]]
    clean = [x for x in without if not re.search("[0-9]{7}", x[0])]  # long numbers may be what the base drops
    rng = np.random.default_rng(seed)
    x, y = tagged([*with_spans[: examples // 8], *clean[: examples // 8], *made_up([x[0] for x in without[:500]], examples, rng)])
    tagger = Tagger(1 + 2 * len(LEARNT), hidden=20, seed=seed)
    tagger.train(x, y, steps=900, seed=seed)
    return tagger


# ---------------------------------------------------------------- decoding


def sound(text: str, kind: str) -> bool:
    """Arithmetic that characters don't show: the check digit of cards, and parts of an address beyond 255."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "ip" or all(len(p) <= 3 and int(p) <= 255 for p in re.findall("[0-9]+", text))


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches of whole windows around every digit, @ and bracketed at: no kind is without one."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        s, e = max(0, (m.start() // STRIDE - 1) * STRIDE), ((m.end() - 1) // STRIDE + 1) * STRIDE + STRIDE
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def sections(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, end, from, to)``: stretches, long ones in sections that share characters; a section answers for the
    spans that start from ``from`` up to ``to``."""
    out = []
    for s, e in stretches(text):
        if e - s <= SECTION:
            out.append((s, e, s, e))
            continue
        step = SECTION - SHARED
        for a in range(s, e, step):
            b = min(a + SECTION, e)
            out.append((a, b, a if a == s else a + SHARED // 2, b if b == e else b - SHARED // 2))
            if b == e:
                break
    return out


_WEIGHT = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)[:, None]


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """Spans that the network adds to each text.

    Windows of many texts run together, ``HELD`` at a time; where windows overlap, their emissions are averaged with
    weights that fall towards a window's ends, and the transitions are decoded once over each whole section.
    """
    out: list[list[Span]] = [[] for _ in texts]
    places: list[tuple] = []
    windows: list[np.ndarray] = []

    def run() -> None:
        stacked = np.stack(windows)
        emitted = np.concatenate([tagger.emissions(stacked[a : a + 1024]) for a in range(0, len(stacked), 1024)])
        for i, section, first in places:
            out[i] += _decoded(texts[i], base[i], section, emitted[first:], tagger)
        places.clear()
        windows.clear()

    for i, text in enumerate(texts):
        for section in sections(text):
            s, e = section[:2]
            c = np.zeros(e - s, np.int64)
            own = char_classes(text[s:e])
            c[: len(own)] = own
            places.append((i, section, len(windows)))
            windows.extend(c[k : k + WINDOW] for k in range(0, e - s - STRIDE, STRIDE))
            if len(windows) >= HELD:
                run()
    if windows:
        run()
    return out


def _decoded(text: str, base: list[Span], section: tuple[int, int, int, int], emitted: np.ndarray, tagger: Tagger) -> list[Span]:
    s, e, low, high = section
    total, sums = np.zeros((e - s, tagger.k), np.float32), np.zeros((e - s, 1), np.float32)
    for w, k in enumerate(range(0, e - s - STRIDE, STRIDE)):
        total[k : k + WINDOW] += emitted[w] * _WEIGHT
        sums[k : k + WINDOW] += _WEIGHT
    length = min(e, len(text)) - s
    scores = total[:length] / sums[:length]
    tags = tagger.decode(scores)
    found, at = [], 0
    near = [(x, y) for x, y, _ in base if y > s and x < e]
    while at < length:
        if tags[at] == 0:
            at += 1
            continue
        kind, end = LEARNT[(tags[at] - 1) // 2], at + 1
        while end < length and tags[end] == 2 + 2 * LEARNT.index(kind):
            end += 1
        a, b = s + at, s + end
        first, at = at, end
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:!?\"'"):
            b -= 1
        while b > a and (text[a].isspace() or text[a] in ",;:!?\"'"):
            a += 1
        if low <= a < high and all(b <= x or a >= y for x, y in near) and _TRIGGER.search(text[a:b]) and sound(text[a:b], kind):
            lo, hi = max(0, first - 2 * WINDOW), min(length, end + 2 * WINDOW)  # what is far doesn't matter
            without = scores[lo:hi].copy()
            without[first - lo : end - lo, 1:] = -1e6
            if tagger.best(scores[lo:hi]) - tagger.best(without) >= MARGIN:
                found.append((a, b, kind))
    return found


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``(doc_id, base, spans)``: arrays of ``(start, end, kind)`` in code points, for every row of ``docs(doc_id, text)``.

    ``spans`` holds the base spans and those that the network adds, of a kind ``secret`` besides the base's; added spans
    don't overlap base ones. Null texts are empty; very long texts are decoded in sections that overlap; repeated rows
    are found alike; an empty table stays empty; other columns are ignored.
    """
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer(batch.column(1))
            hit = np.zeros(len(data) + 1, np.int64)
            bracket = (data == 91) | (data == 40) | (data == 123)
            np.cumsum(((data >= 48) & (data <= 57)) | (data == 64) | bracket, out=hit[1:])
            rows = np.flatnonzero(hit[off[1:]] > hit[off[:-1]])
            base: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            every: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            bounds = np.concatenate(([0], np.cumsum(off[rows + 1] - off[rows])))
            for a, b in runs_of_rows(bounds, 1 << 20):
                part = rows[a:b]
                texts = [data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace") for i in part]
                own = [base_spans(t) for t in texts]
                for i, b, more in zip(part, own, added_spans(texts, own, tagger)):
                    base[i], every[i] = b, b + more
            lists = [pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in v], pa.list_(kind)) for v in (base, every)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "base", "spans"])

    spans = "array<struct<start: long, `end`: long, kind: string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, f"doc_id long, base {spans}, spans {spans}")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, all spans of the base's kinds as text, secrets as text, and added spans counted."""
    kinds = F.array(*map(F.lit, LEARNT))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda x: F.struct(x["start"].alias("s"), F.array_position(kinds, x["kind"]).alias("k"), x["end"].alias("e")))), lambda y: F.concat_ws(":", F.element_at(kinds, y["k"].cast("int")), y["s"].cast("string"), y["e"].cast("string"))), ",")
    secret = lambda x: x["kind"] == "secret"
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    added = (F.size("spans") - F.size("base")).cast("long")
    return found.select(
        "doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text(F.filter("spans", lambda x: ~secret(x))).alias("spans"),
        text(F.filter("spans", secret)).alias("secrets"), added.alias("n_added"), F.size("spans").cast("long").alias("n_found"),
    )


def personal_data(docs: DataFrame, most: int = 4000) -> DataFrame:
    """Train on ``docs``, then ``find`` in every row of them."""
    return find(docs, train(docs, most))
