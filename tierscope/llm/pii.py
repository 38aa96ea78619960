"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides spans.

Broad patterns propose spans of four kinds.  Labelers vote for, against or
abstain: strict regular expressions, checks of the digits, gazetteers (top
domains, card issuers, calling codes), words of the context, and what the
span is embedded in.  A span's votes and shape form a pattern; there are at
most 4 * 3^5 * 12 of them, so the whole corpus is summed into counts of
patterns, and the driver gets only those.  Expectation-maximisation
estimates each labeler's reliability per kind from the counts (two classes,
votes independent given the class), and its posteriors train a logistic
regression on votes and shape, which decides each pattern.  Spans of the
base definitions are always kept; others need ``ACCEPT``.

Defined results: null text has no spans; repeated rows get equal spans;
spans of different kinds may overlap; offsets are code points with the end
exclusive; an empty table gives an empty result; ``redact`` passes all
columns on.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import append_columns, map_rows

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9

# Base definitions; an address is found from its @, so that a text is read once.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser proposals.
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[A-Za-z0-9-]{1,63})+", re.I)
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+)])(?<!\+[0-9][\x20])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")

# Gazetteers and context words: fixed values.
DOMAINS = set("com net org edu gov info io de fr es uk eu it nl ch at be pt us co biz".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|65|35")
CALLING = re.compile(r"1|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]")
CUES = {
    "email": "email e-mail mail contact write address courriel kontakt correo",
    "ip": "ip host address server from client adresse servidor",
    "card": "card visa mastercard amex credit debit carte karte tarjeta",
    "phone": "phone tel telephone call mobile fax cell telefon teléfono téléphone",
}
AGAINST = set("version release isbn issn order invoice token key id hash serial license licence".split())
_CUES = {k: set(v.split()) for k, v in CUES.items()}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
CONTEXT = 40


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        at += 1
        if m:
            yield start, m.end()
            done = at = m.end()


def proposals(text: str | None) -> list[Span]:
    """All spans that some pattern proposes, by kind and start."""
    if not text:
        return []
    out = [Span(0, a, b, True) for a, b in _emails(text)] if "@" in text else []
    if "dot" in text.lower():
        out += [Span(0, m.start(), m.end(), False) for m in _SPELT.finditer(text)]
    if ":" in text:
        out += [Span(1, m.start(), m.end(), False) for m in _IP6.finditer(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(Span(1, m.start(), m.end(), True))
    for m in _CARD.finditer(text):
        d = m.end() - m.start() > 11 and _digits(m.group())
        if d and 12 <= len(d) <= 19:
            out.append(Span(2, m.start(), m.end(), luhn(d)))
    phones = [m for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    out += [Span(3, m.start(), m.end(), True) for m in phones]
    for m in _LOCAL_PHONE.finditer(text):
        if not any(p.start() < m.end() and m.start() < p.end() for p in phones):
            out.append(Span(3, m.start(), m.end(), False))
    return out


def votes(text: str, s: Span) -> tuple[int, ...]:
    """Of each labeler: 1 for, -1 against, 0 abstains."""
    kind, found = KINDS[s.kind], text[s.start:s.end]
    digits = _digits(found)
    strict = 1 if s.base else -1 if kind == "card" else 0
    if kind == "email":
        gazetteer = 1 if re.split(r"[^a-z]+", found.lower())[-1] in DOMAINS else -1
        form = 1 if ".." not in found and not found.startswith(".") else -1
    elif kind == "ip":
        gazetteer = 0
        form = 1 if not re.search(r"(?:^|\.)0[0-9]", found) and found not in ("0.0.0.0", "1.2.3.4") else -1
    elif kind == "card":
        gazetteer = 1 if ISSUERS.match(digits) else -1
        form = (1 if luhn(digits) else -1) if len(set(digits)) > 1 else -1
    else:
        gazetteer = (1 if CALLING.match(digits) else -1) if found[0] == "+" else 0
        form = 1 if len(set(digits)) > 2 and (found.count("(") == found.count(")")) else -1
    before = {w.lower() for w in _WORD.findall(text[max(0, s.start - CONTEXT):s.start])}
    after = {w.lower() for w in _WORD.findall(text[s.end:s.end + CONTEXT])}
    context = 1 if before & _CUES[kind] else -1 if before & AGAINST else 1 if after & _CUES[kind] else 0
    left, right = text[s.start - 1:s.start], text[s.end:s.end + 1]
    alone = -1 if left.isalnum() or right.isalnum() or left in ("#", "=", "_") and left else 1
    return strict, gazetteer, form, context, alone


LABELERS = 5
SHAPES = 12


def pattern(text: str, s: Span) -> int:
    """Kind, votes and shape as one number."""
    found = text[s.start:s.end]
    marks = min(2, sum(c in " -.()" for c in found) // 2)
    digits = min(3, len(_digits(found)) // 5)
    code = s.kind
    for v in votes(text, s):
        code = code * 3 + v + 1
    return (code * 3 + marks) * 4 + digits


def _unpack(code: int) -> tuple[int, list[int], int, int]:
    code, digits = divmod(code, 4)
    code, marks = divmod(code, 3)
    v = []
    for _ in range(LABELERS):
        code, x = divmod(code, 3)
        v.append(x - 1)
    return code, v[::-1], marks, digits


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote rows with counts: posteriors, and P(vote | class) as (class, labeler, vote + 1)."""
    posterior = 1 / (1 + np.exp(-v.sum(axis=1).astype(float)))
    for _ in range(rounds):
        table, prior = np.empty((2, v.shape[1], 3)), np.empty(2)
        for c, weight in enumerate((n * (1 - posterior), n * posterior)):
            prior[c] = weight.sum() + 1.0
            for j in range(v.shape[1]):
                # A labeler is taken to be right rather more often than wrong.
                table[c, j] = np.bincount(v[:, j] + 1, weight, 3) + (np.array([0.5, 1, 2.0]) if c else np.array([2.0, 1, 0.5]))
                table[c, j] /= table[c, j].sum()
        logs = np.stack([np.log(prior[c]) + np.log(table[c, np.arange(v.shape[1]), v + 1]).sum(axis=1) for c in (0, 1)])
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return posterior, table


def _features(v: list[int], marks: int, digits: int) -> np.ndarray:
    one_hot = np.zeros(1 + 3 * LABELERS + 3 + 4)
    one_hot[0] = 1
    for j, x in enumerate(v):
        one_hot[1 + 3 * j + x + 1] = 1
    one_hot[1 + 3 * LABELERS + marks] = 1
    one_hot[4 + 3 * LABELERS + digits] = 1
    return one_hot


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights by Newton steps on soft labels, each row counting ``n`` times (scaled to mean one)."""
    w, n = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + penalty * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def decide(counts: dict[int, int]) -> dict[int, float]:
    """Probability of each pattern that occurs."""
    out = {}
    for kind in range(len(KINDS)):
        codes = sorted(c for c in counts if _unpack(c)[0] == kind)
        if not codes:
            continue
        n = np.array([counts[c] for c in codes], float)
        parts = [_unpack(c) for c in codes]
        posterior, _ = reliabilities(np.array([v for _, v, _, _ in parts]), n)
        x = np.array([_features(v, m, d) for _, v, m, d in parts])
        p = 1 / (1 + np.exp(-x @ _logistic(x, posterior, n)))
        # Both must agree: the classifier generalises the posteriors, it does not overrule the votes.
        out |= dict(zip(codes, np.minimum(p, posterior).tolist(), strict=True))
    return out


def pattern_counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        n = Counter()
        for batch in batches:
            for text in batch.column(0):
                t = text.as_py()
                n.update(pattern(t, s) for s in proposals(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["pattern", "n"])

    return docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Broadcast:
    """The accepted patterns; counts of at most 4 * 3^5 * 12 patterns come to the driver."""
    p = decide({r["pattern"]: r["n"] for r in pattern_counts(docs).collect()})
    return docs.sparkSession.sparkContext.broadcast(frozenset(c for c, x in p.items() if x >= ACCEPT))


def spans(text: str | None, accepted: frozenset[int]) -> list[Span]:
    """Base spans and accepted others, by start and kind."""
    found = [s for s in proposals(text) if s.base or pattern(text, s) in accepted]
    return sorted(found, key=lambda s: (s.start, s.kind, s.end))


def _written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and checksum of the base spans, and all spans of every document."""
    accepted = train(docs)

    def rows(batch):
        out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for text in batch["text"]:
            found = spans(text, accepted.value)
            base = [s for s in found if s.base]
            n = Counter(s.kind for s in base)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(n[k])
            out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
            out["spans"].append(_written(found))
        return out | {"doc_id": batch["doc_id"]}

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                    "base_sha256 string, spans string", rows)


def redacted(text: str, found: list[Span]) -> str:
    """Each group of overlapping spans becomes the first one's kind in brackets."""
    out, at = [], 0
    for s in found:
        if s.start >= at:
            out += [text[at:s.start], f"[{KINDS[s.kind].upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced and ``n_chars`` set to the new length."""
    accepted = train(docs)

    def rows(texts):
        new = [t if t is None else redacted(t, spans(t, accepted.value)) for t in texts]
        return {"_text": new, "_n": [None if t is None else len(t) for t in new]}

    out = append_columns(docs, "_text string, _n long", ["text"], lambda: rows)
    n = F.when(F.col("text") == F.col("_text"), F.col("n_chars")).otherwise(F.col("_n"))
    return out.withColumn("n_chars", n).withColumn("text", F.col("_text")).select(*docs.columns)
