import re

from tierscope.llm.quality_rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    cover = {i + k for i, g in enumerate(wins) if wins.count(g) > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover),
            len(w) < 20 or 100 * len(cover) > 30 * len(w))


CLEAN = "The cat of the house and the dog is in that garden for it was on a day as bright with birds by then"
TEXTS = [None, "", " \n\t", CLEAN, CLEAN, CLEAN + "\n" + CLEAN, "a b c d e f g h " * 5, "x " * 60,
         "\n".join(["same line here"] * 12), "é ü\x0bñ \x1f|<>", "w%%% " * 40, "  lead " + CLEAN + "  ",
         " ".join(f"word{i % 900}" for i in range(20000)), " ".join("abcdefgh") + " z " + " ".join("abcdefgh"),
         "UN!! DE!! " * 30]


def test_counts_match_brute_force(docs):
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules(docs([(i, t, None) for i, t in enumerate(TEXTS)])).collect()}
    for i, t in enumerate(TEXTS):
        if len(t or "") < 50000:
            assert got[i] == brute(t), (i, t)
    assert got[12][4] == 20000 and got[12][5]


def test_verdicts(docs):
    out = {r.doc_id: r for r in quality_rules(docs([(0, CLEAN, "en"), (1, "w%%% " * 40, "en"), (2, None, None)])).collect()}
    assert out[0].kept and not out[0].base_failed
    assert not out[1].kept and not out[2].kept and out[2].base_failed


def test_empty_table(docs):
    assert quality_rules(docs([(0, "a", "b")]).limit(0)).collect() == []
