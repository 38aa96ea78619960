import hashlib
import random
import re
from collections import Counter

import numpy as np

from tierscope.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (2 if i % 2 else 1)
        s += x if x < 10 else x - 9
    return s % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def base(text):
    return [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in pii.spans(text, frozenset()) if s.base]


TEXTS = [None, "", "clean text", "a.b@c.de and x@y", "é mail me@x.y.z.", "@a.b a@@b.c.d a@b.c@d.e.f", "1.2.3.4.5.6.7.8 300.1.1.1 01.02.03.04",
         "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (651) 555-8500, +12 34", "+1 2 3 4 5 6 7 8 9 +49.30.1234567)", "1" * 5000,
         "1.2.3.4444 +4111111111111111 5", "999.1.1.1.1", "a" * 3000 + "@b.c", "x\n+1 555\n 555-8500 22"]


def test_base_spans_match_the_definitions():
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("12345678900  ..--+()@@abc%é") for _ in range(rng.randint(1, 90))) for _ in range(20000)]
    for t in texts:
        assert base(t) == brute(t), t


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.3
    right = (0.95, 0.8, 0.7)
    v = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) * 2 - 1 for r in right], axis=1)
    rows, n = np.unique(v, axis=0, return_counts=True)
    posterior, table = pii.reliabilities(rows, n.astype(float))
    for j, r in enumerate(right):
        assert abs(table[1, j, 2] - r) < 0.05 and abs(table[0, j, 0] - r) < 0.05
    assert abs((posterior * n).sum() / n.sum() - 0.3) < 0.05


def test_documents(spark, docs):
    people = [(100 + i, f"write to user{i}@mail.com or call +1 (651) 555-8{i:03d}, card 4111 1111 1111 1111 from 10.0.0.{i}", "en") for i in range(200)]
    spelt = [(500, "contact jane.doe (at) mail (dot) com today", "en"), (501, "phone (651) 555-8500 now", "en"),
             (502, "order 1234567890123456 version 1.2.3", "en")]
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + people + spelt + [(3, TEXTS[3], None), (None, TEXTS[3], None)]
    out = pii.find(docs(rows)).collect()
    assert len(out) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in out:
        want = brute(texts[r.doc_id])
        n = Counter(w.split(":")[0] for w in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [n[k] for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r.spans.split(",")))
    got = {r.doc_id: r for r in out}
    assert got[500].spans.startswith("email:8:") and got[502].spans == "" and got[2].spans == ""
    clean = {r.doc_id: r for r in pii.redact(docs(rows)).collect()}
    assert clean[100].text == "write to [EMAIL] or call [PHONE], card [CARD] from [IP]" and clean[100].n_chars == len(clean[100].text)
    assert clean[0].text is None and clean[2].text == "clean text" and pii.redact(docs(rows)).columns == docs(rows).columns
    assert pii.find(docs(rows).limit(0)).collect() == []


def test_overlapping_spans_are_redacted_once():
    spans = [pii.Span(3, 0, 5, True), pii.Span(2, 1, 9, True), pii.Span(0, 12, 14, True)]
    assert pii.redacted("0123456789abcdef", spans) == "[PHONE]9ab[EMAIL]ef"
