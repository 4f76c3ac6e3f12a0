"""Base spans against plain regular expressions; the network on held-out windows."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrastack.llm import bilstm, pii
from tests.llm.conftest import prose

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in PLAIN[kind].finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1234567890.@+-() %é\n", max_size=60))
def test_base_equals_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["me.x@a.b-c.de", "@", "a@b", "+1 (766) 555-9970", "4111 1111 1111 1111", "10.0.0.256", "1.2.3.4.5.6.7.8", "x", "é ", "..", "+", "a@b.c@d.e", "378282246310005"]), max_size=8))
def test_base_equals_plain_patterns_on_pieces(parts):
    for sep in ("", " "):
        text = sep.join(parts)
        assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("9" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 100_000, "+1" * 50_000):
        pii.base_spans(text)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    t = bilstm.Tagger(3, hidden=3, seed=1)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = rng.integers(0, bilstm.CLASSES, (4, 6)), rng.integers(0, 3, (4, 6))
    _, grads = t.gradients(x, y)
    for name in ("step", "out", "uf", "ub", "cf", "cb", "xf"):
        i = tuple(rng.integers(0, s) for s in t.p[name].shape) if name != "xf" else (int(x[0, 0]), 1)
        old, eps = t.p[name][i], 1e-3
        t.p[name][i] = old + eps
        up, _ = t.gradients(x, y)
        t.p[name][i] = old - eps
        down, _ = t.gradients(x, y)
        t.p[name][i] = old
        assert abs((up - down) / (2 * eps) - grads[name][i]) < 2e-2 * max(1, abs(grads[name][i])), name


@pytest.fixture(scope="module")
def tagger(docs):
    return pii.train(docs)


def held_out(tagger, n):
    """Made-up items that the base misses, each between words of a prose that training hasn't seen."""
    rng, words = np.random.default_rng(99), random.Random(11)
    texts, wants = [], []
    while len(texts) < n:
        before, item, after, kind = pii.written(rng)
        start = prose(words, 6) + " " + before
        text, want = f"{start}{item}{after} {prose(words, 6)}", (len(start), len(start) + len(item), kind)
        if not any(s < want[1] and e > want[0] for s, e, _ in pii.base_spans(text)):
            texts.append(text)
            wants.append(want)
    return texts, wants


def test_held_out_forms_are_found(tagger):
    texts, wants = held_out(tagger, 600)
    got = pii.added_spans(texts, [pii.base_spans(t) for t in texts], tagger)
    found = {k: [w in g for w, g in zip(wants, got) if w[2] == k] for k in pii.LEARNT}
    assert all(len(v) > 30 and sum(v) >= 0.85 * len(v) for v in found.values()), {k: (sum(v), len(v)) for k, v in found.items()}
    all_, right = sum(map(len, got)), sum(map(sum, found.values()))
    assert right >= 0.95 * all_


def test_other_numbers_are_left_alone(tagger):
    rng, words = np.random.default_rng(98), random.Random(12)
    texts = [f"{prose(words, 6)} {pii.other(rng)} {prose(words, 6)}" for _ in range(600)]
    got = pii.added_spans(texts, [pii.base_spans(t) for t in texts], tagger)
    assert sum(map(bool, got)) <= 6


def test_added_spans(tagger):
    texts = ["call (212) 555-0187 now or then", "mail jane.doe @ example.com today", "plain words, version 2.0 and 12:30", "é" * 100 + " 10.0.0.1 " + "b" * 300 + " x@y.com", 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" there', "on +1 (826) 555-4081 190.137.223.204 too", ""]
    base = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(texts, base, tagger)
    assert added[0] == [(5, 19, "phone")] and added[1] == [(5, 27, "email")] and added[2] == [] and added[6] == []
    assert base[3] == [(101, 109, "ip"), (411, 418, "email")] and added[3] == []
    assert added[4] == [(11, 51, "secret")] and base[5] == [(21, 36, "ip")] and added[5] == [(3, 20, "phone")]


def test_decoding_equals_all_paths(tagger):
    rng = np.random.default_rng(2)
    t = bilstm.Tagger(3, hidden=2, seed=3)
    t.p["step"] = rng.normal(size=(3, 3)).astype(np.float32)
    import itertools

    for _ in range(20):
        e = rng.normal(size=(6, 3)).astype(np.float32)
        score = {p: sum(e[i, x] for i, x in enumerate(p)) + sum(t.p["step"][a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=6)}
        best = max(score, key=score.get)
        assert tuple(t.decode(e)) == best and abs(t.best(e) - score[best]) < 1e-4


def test_windows_and_sections_agree_with_one_text_at_a_time(tagger, monkeypatch):
    """Batches of windows don't matter, and a long run of digits is decoded in sections as it is as a whole."""
    rng, words = np.random.default_rng(97), random.Random(13)
    pieces = []
    for _ in range(150):
        before, item, after, _ = pii.written(rng)
        pieces.append(f"{before}{item}{after} {prose(words, 3)}")
    long = " ".join(pieces)
    texts = [long, *pieces[:20]]
    base = [pii.base_spans(t) for t in texts]
    whole = pii.added_spans(texts, base, tagger)
    assert whole[0] and whole == [pii.added_spans([t], [b], tagger)[0] for t, b in zip(texts, base)]
    monkeypatch.setattr(pii, "HELD", 7)
    assert pii.added_spans(texts, base, tagger) == whole
    monkeypatch.setattr(pii, "SECTION", 2048)
    assert pii.added_spans(texts, base, tagger) == whole


def test_training_collects_a_bounded_number_of_windows(spark, empty):
    same = spark.createDataFrame([(None, "the same text 1.2.3.4 again")] * 500, "doc_id long, text string")
    tagger = pii.train(same, most=5, examples=40)
    assert tagger.k == 1 + 2 * len(pii.LEARNT) and pii.train(empty, most=5, examples=40).k == tagger.k


def test_table(spark, docs, empty, tagger):
    df = spark.createDataFrame([(1, "a me@x.org, 4111 1111 1111 1111"), (1, "a me@x.org, 4111 1111 1111 1111"), (2, None), (None, "")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r)[:5] for r in pii.digest(pii.find(df, tagger)).collect())))
    assert got == sorted(map(str, [(1, 1, 0, 1, 0), (1, 1, 0, 1, 0), (2, 0, 0, 0, 0), (None, 0, 0, 0, 0)]))
    import hashlib

    first = pii.digest(pii.find(df, tagger)).where("doc_id = 1").first()
    assert first.base_sha256 == hashlib.sha256(b"email:2:10,card:12:31").hexdigest() and first.spans.startswith("email:2:10,card:12:31")
    assert pii.digest(pii.find(empty, tagger)).count() == 0
