import re
import uuid

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from llm import test_language_id, test_pii, test_simhash
from tierscope.llm import language_id, quality_lm
from tierscope.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gave, the documents first."""
    folder = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "language ID", "SimHash near-dedup", "PII", "best-fit packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(spark, stages):
    kept = {r.doc_id for r in quality_lm.verdicts(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
    after = rows(stages[1])
    assert set(after) == kept
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in after for i, q in quality.items() if q == 1)
    before = rows(stages[0])
    assert all(tuple(after[i]) == tuple(before[i]) for i in after)


def test_language(stages):
    before, after = rows(stages[1]), rows(stages[2])
    model = language_id.train(stages[1]).value
    for i, r in before.items():
        logits = language_id._logits(r.text, model)
        assert (i in after) == (logits is not None and _score(logits, model) >= P.MIN_LANGUAGE_SCORE)


def _score(logits, model):
    import numpy as np
    p = np.exp((logits - logits.max()) / model.temperature)
    return p.max() / p.sum()


def test_near_duplicates(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = test_simhash.brute_components({i: test_simhash.brute_fingerprint(r.text) for i, r in before.items()})
    assert set(after) == set(want.values())


def test_personal_data(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, r in before.items():
        spans = test_pii.brute(r.text)
        assert len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", after[i].text)) >= (1 if spans else 0)
        assert test_pii.brute(after[i].text) == [] and after[i].n_chars == len(after[i].text)
        if not spans:
            assert after[i].text == r.text


def test_packing(stages):
    docs = rows(stages[4])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {i: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in docs.items()}
    by_doc, by_bin = {}, {}
    for r in stages[5].collect():
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc == n
    assert all(sum(length for _, length in b) <= 2048 for b in by_bin.values())
    assert len(by_bin) <= -(-sum(n.values()) // 2048) + 2


def test_run_and_empty_and_odd_rows(spark, docs, tmp_path):
    text = "The house of the man is in the town and it was good for the day."
    table = docs([(1, text, "en"), (1, text, "en"), (2, text + " x", None), (3, None, "en"), (4, "", None), (None, text, "en"), (5, text, "en"),
                  (6, "mail a@b.co now to the man of the town", "en")])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 5, 6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert ids.count(1) == 1 and ids.count(None) == 1 and 5 not in ids and 3 not in ids and 4 not in ids and 6 in ids
    clash = ("score", "lm_chars", "_text", "fp", "lang_pred", "n")
    wide = table.selectExpr("*", *[f"doc_id * {k} as {c}" for k, c in enumerate(clash, 2)])
    for _, f in P.STAGES[:-1]:
        got = f(spark, wide, str(tmp_path))
        assert got.columns == wide.columns
        assert all(r.score == r.doc_id * 2 and r.n == r.doc_id * 7 for r in got.where("doc_id is not null").collect())
    d = table.limit(0)
    for _, f in P.STAGES:
        d = f(spark, d, str(tmp_path))
        assert d.collect() == []


def test_unlearned_languages_go(spark, docs):
    clean = test_language_id.corpus(2400)
    other = ["Miehen talo on kaupungissa ja se oli hyvä päivä ihmisille.", "Dom tego człowieka stoi w mieście i był to dobry dzień.",
             "Дом человека стоит в городе.", "qzx vkj wqp"]
    out = P.language(spark, docs(clean + [(10000 + i, t, None) for i, t in enumerate(other)]), SF).collect()
    kept = {r.doc_id for r in out}
    assert not [t for i, t in enumerate(other) if 10000 + i in kept]
    assert len(kept) >= 0.995 * len(clean)
