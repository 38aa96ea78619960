import random
import zlib

import numpy as np

from tierscope.llm import language_id as L

WORDS = {"en": "the house of man with this and that for water they night", "de": "das haus und mann nicht über für wasser ich schön",
         "fr": "la maison avec été pour l'eau dans ils où très", "es": "la casa con agua niño para ellos donde muy señor"}


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i * 7 % 4]
        rows.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(5, 40))), lang))
    return rows


def test_held_out_accuracy_and_calibration(spark, docs):
    rows = corpus(600)
    out = L.identify(docs(rows)).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    lang = {i: g for i, _, g in rows}
    right = [r.lang_pred == lang[r.doc_id] for r in held]
    assert np.mean(right) >= 0.97
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.05
    # Languages of the held-out fold are never seen: changing them changes nothing.
    swapped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in rows]
    again = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs(swapped)).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in out}


def test_edges(spark, docs):
    rows = corpus(200) + [(1000, None, "en"), (1001, "", "en"), (1002, "123 %%% \n", "en"), (1003, "𝒜𝒷", "en"), (None, "the house", "zz"),
                          (1004, "the house of " * 30000, None), (1005, "the water", None), (1005, "the water", None)]
    out = L.identify(docs(rows)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1003].lang_pred in WORDS and got[1004].lang_pred == "en" and got[None].held_out is False
    assert "zz" not in {r.lang_pred for r in out} and all(0 <= r.score <= 1 for r in out)
    nothing = L.identify(docs([(1, "the house", None), (2, None, "en")])).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert L.identify(docs(rows).limit(0)).collect() == []


def test_ftrl_is_sparse_and_fits():
    rng = np.random.default_rng(0)
    rows = [(np.array([y * 10 + 1, 50 + int(rng.integers(500))]), np.array([0.8, 0.6]), int(y)) for y in rng.integers(3, size=300)]
    w = L.ftrl(rows, 3)
    assert all((x @ w[at] + w[-1]).argmax() == y for at, x, y in rows)
    assert (w != 0).any(axis=1).sum() < 520


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(L._temperature(logits * 5, y) - 5) < 0.5


def test_document_frequency_by_brute_force(spark):
    texts = ["the cat", None, "12", "the the", "über"]
    got = {r.bucket: r.df for r in L.document_frequency(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)).collect()}
    seen = [L.counts(t) for t in texts if t]
    want = sum((s > 0).astype(int) for s in seen if s is not None)
    assert got.pop(-1) == 3 and got == {int(b): int(want[b]) for b in np.flatnonzero(want)}
