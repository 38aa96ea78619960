import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierscope.llm import collocations as co


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top, share=100):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, 6):
                    if i + m <= len(words):
                        f[lang, words[i:i + m]] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if any(lang == g and len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), b in found.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def texts(count, seed=1):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "Éa", "\x01", "\x08x", "a", "a\x02", "ab", "日本", "b-c", "\xa0", "z"]
    weights = [30, 20, 8, 5, 3, 2, 20, 4, 6, 4, 3, 2, 1]
    rows = []
    for i in range(count):
        ws = rng.choices(words, weights, k=rng.randint(0, 60))
        rows.append((i, "".join(w + rng.choice([" "] * 8 + ["  ", "\t", " \t ", ".", ", ", "\n", "! ", "\r\n"]) for w in ws), rng.choice(["en", "en", "en", "fr", None, "und", "é"])))
    return rows


ODD = [(900, None, None), (901, "", "en"), (902, " \t ", "en"), (903, "...", "xx"), (904, "the cat sat on the mat " * 300, "en"), (905, "w" * 100_000 + " the cat", "en"),
       *[(906, "one two three four five six", "fr")] * 30]


@pytest.mark.parametrize(("least", "run_range", "run"), [(3, 200, 300), (3, co.RANGE, co.RUN), (12, 50, 1000), (100, 500, 10 ** 6)])
def test_equals_brute_force(docs, least, run_range, run):
    rows = texts(220) + ODD
    got = co.collocations(docs(rows).repartition(4), least, 40, run_range=run_range, run=run)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 40)


def test_a_lower_share_drops_more(docs):
    rows = texts(150, 5)
    got = co.collocations(docs(rows), 4, 2000, share=60, run_range=300)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 2000, 60)


def test_empty(docs):
    assert co.collocations(docs([])).collect() == []
    assert co.collocations(docs([(1, None, None), (2, "a b c", "en")])).collect() == []


def test_sql_says_the_same(docs):
    rows = texts(200, 3) + [r for r in ODD if r[0] != 905]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    got = con.execute(co.oracle_sql(5, 50)).fetchall()
    assert sorted(got) == brute(rows, 5, 50)


def test_words_and_pieces():
    words, piece, row = co.words_of(pa.array(["x", "A b.c", "", "D", " e,\tF"]).slice(1))
    assert words.to_pylist() == [b"a", b"b", b"c", b"d", b"e", b"f"] and row.tolist() == [0, 0, 0, 2, 3, 3]
    assert [len(set(piece[i:j])) for i, j in ((0, 2), (1, 3), (2, 4), (3, 5), (4, 6))] == [1, 2, 2, 2, 2]


def test_runs_are_cut_at_boundaries():
    rng = random.Random(2)
    run = co.Run()
    run.add(pa.array([" ".join(rng.choices("abcde", k=50)) for _ in range(20)]), pa.array([rng.choice(["en", "fr"]) for _ in range(20)]))
    langs, words, columns, _ = run.sorted()
    rows = [[langs[columns[0][i] - 1], *[words[c[i] - 1] for c in columns[1:] if c[i]]] for i in range(len(columns[0]))]
    assert rows == sorted(rows)
    for b in rows[::37] + [[b"aa"], [b"en", b"bb"], [b"en", b"b"], [b"zz"], [b"fr", b"c", b"a", b"zz"]]:
        at = co.position(b, langs, words, columns)
        assert all(r < b for r in rows[:at]) and all(r >= b for r in rows[at:])


def test_many_codes_need_more_keys():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 500) * (1 << 29) for _ in range(6)]
    got, n = co.merged(columns, np.ones(500, np.int64), 1 << 30)
    expected = Counter(zip(*[c.tolist() for c in columns], strict=True))
    assert [*zip(*[c.tolist() for c in got], strict=True)] == sorted(expected) and n.tolist() == [expected[k] for k in sorted(expected)]


def test_scores_beyond_sixty_four_bits(spark):
    a, n, l, r = 9 * 10 ** 12 + 1, 10 ** 15 + 7, 10 ** 13 + 3, 10 ** 14 + 9
    found = spark.createDataFrame([("en", "a\tb", a, [l], [r], None)], "lang string, key string, a long, lefts array<long>, rights array<long>, longer long")
    row = co.scored(found, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert (row.phrase, row.l, row.r, row.score) == ("a b", l, r, 1000 * a * n // (l * r))


def test_keys_are_ordered_as_words(spark):
    words = [[b"a"], [b"a", b"b"], [b"a\x01"], [b"a\x01", b"b"], [b"a\x08"], [b"ab"], [b"\x00"], [b"\xc3\xa9"]]
    assert sorted(words) == sorted(words, key=co.escaped)
    table = spark.createDataFrame([(co.escaped(w).decode(),) for w in words], "key string")
    assert [r[0] for r in table.select(co.phrase(F.col("key"))).collect()] == [b" ".join(w).decode() for w in words]
