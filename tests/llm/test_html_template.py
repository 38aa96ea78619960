import pytest

from tierscope.llm import html_template as H

HEAD = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>'
MENU = '<nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy now</div>'
FOOT = "<footer>&copy; us</footer></body></html>"


def soup(i, paragraphs):
    """A layout without an article tag: only the template tells its parts."""
    body = "".join(f"<p>Story {i} part {k} with words enough to be the main text.</p>" for k in range(paragraphs))
    return (f'{HEAD}<div class="top"><p>Welcome to our site</p></div><div class="left"><a href="#">Link {i}</a></div>'
            f'<div id="main"><h1>Head {i}</h1>{body}</div><div class="end"><p>All rights reserved</p></div>')


CASES = [
    (f"{HEAD}{MENU}<article><h1>A &amp; B</h1><p><b>one<br>two</b><p>th<i>r</i>ee&nbsp; 4 &lt;5</article>{FOOT}", "A & B\n\none two\n\nthree 4 <5"),
    (f'{HEAD}<article><header><h1>H</h1></header><p>x<script>no()</script>y</p><section class="comments"><p>first!</p></section><form>f</form></article><aside>s</aside>', "H\n\nxy"),
    (f"{HEAD}{MENU}<main><p>m</p><!-- <p>no</p> --></main>{FOOT}", "m"),
    ("<p>just text 1 < 2", "just text 1 < 2"),
    ("", ""), (None, ""), ("<article>", ""), ("<!-- cut", ""), ("<article><p>cut <b", "cut"), ("<script>cut", ""),
    ('<article><p title="a>b">q</p></article></div></article><p>out', "q"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
    ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_single_pages(page, text):
    assert H.main_text(page, None, None) == text


def test_hosts(spark):
    rows = [(i, f"http://Soup.example/{i}", soup(i, 2 + i % 3), "x") for i in range(12)]
    rows += [(100 + i, f"https://one{i}.example?q", page, "x") for i, (page, _) in enumerate(CASES)]
    rows += [(200, None, "<p>a</p>", None), (201, "no host", "<p>b</p>", None), (0, rows[0][1], rows[0][2], "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, slot string")
    out = H.extract(table).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r for r in out}
    for i in range(12):
        want = [f"Head {i}"] + [f"Story {i} part {k} with words enough to be the main text." for k in range(2 + i % 3)]
        assert got[i].text == "\n\n".join(want)
    for i, (_, text) in enumerate(CASES):
        assert (got[100 + i].text, got[100 + i].n_chars) == (text, len(text))
    assert got[200].text == "a" and got[201].text == "b" and got[200].url is None
    assert H.extract(table.limit(0)).collect() == []


def test_equivalence_classes_by_brute_force(spark):
    """Equal sums mean equal occurrence vectors."""
    pages = [soup(i, 1 + i % 4) for i in range(8)]
    table = spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(4)
    sums = H.token_sums(table).collect()
    vectors = {}
    for r in sums:
        vector = []
        for p in pages:
            blocks, opened = H.parse(p)
            tokens = [H._text_token(b) for b in blocks if not b.article]
            vector.append(1 if r.token == "" else opened.get(r.token, 0) + tokens.count(r.token))
        vectors[r.token] = tuple(vector)
        assert r.pages == sum(n > 0 for n in vector)
    by_sum, by_vector = {}, {}
    for r in sums:
        by_sum.setdefault((r.low, r.high), set()).add(r.token)
        by_vector.setdefault(vectors[r.token], set()).add(r.token)
    assert sorted(map(sorted, by_sum.values())) == sorted(map(sorted, by_vector.values()))


def test_copies_of_an_article_stay(spark):
    page = f"{HEAD}{MENU}<article><h1>Same</h1><p>text</p></article>{FOOT}"
    table = spark.createDataFrame([(i, "http://h.example/", page) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in H.extract(table).collect()} == {"Same\n\ntext"}


def test_copies_in_a_layout_without_article_stay(spark):
    rows = [(i, "http://h.example/", soup(1, 3)) for i in range(6)] + [(9, "http://h.example/9", soup(9, 2))]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in out:
        i, n = (9, 2) if r.page_id == 9 else (1, 3)
        assert f"Head {i}" in r.text and r.text.count(f"Story {i} part") == n
    # Copies beside enough distinct pages: the template goes, the copied article stays.
    rows += [(20 + i, f"http://h.example/{20 + i}", soup(20 + i, 2)) for i in range(3)]
    for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.startswith("Head ") and "Story" in r.text and "Welcome" not in r.text


def test_articles_of_several_containers_stay_whole(spark):
    def page(i):
        return (f'{HEAD}<div class="top"><p>Welcome to our site</p></div><div class="story"><div class="intro"><p>Intro {i} of the story.</p></div>'
                f'<div class="body">{"".join(f"<p>Body {i} part {k} with many words of text.</p>" for k in range(4))}</div>'
                f'<div class="more"><p>End {i}.</p></div></div><div class="end"><p>All rights reserved</p></div>')

    odd = (f'{HEAD}<div class="top"><p>Welcome to our site</p></div><div class="story"><p>Short.</p></div>'
           f'<div class="other-place"><p>{"The text of this page lies elsewhere. " * 5}</p></div><div class="end"><p>All rights reserved</p></div>')
    rows = [(i, "http://h.example/", page(i)) for i in range(10)]
    for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        body = [f"Body {r.page_id} part {k} with many words of text." for k in range(4)]
        assert r.text == "\n\n".join([f"Intro {r.page_id} of the story.", *body, f"End {r.page_id}."])
    out = H.extract(spark.createDataFrame([*rows, (99, "http://h.example/", odd)], "page_id long, url string, html string")).collect()
    got = {r.page_id: r.text for r in out}
    assert "lies elsewhere" in got[99] and "Short." in got[99] and "Welcome" not in got[99]
    assert all(got[i].startswith(f"Intro {i}") and got[i].endswith(f"End {i}.") for i in range(10))


@pytest.mark.parametrize("page", [
    '<body class="has-sidebar"><article class="post comments-open"><p>The text.</p></article></body>',
    '<body><div class="social-science"><p>The text.</p></div><div class="share"><p>x</p></div></body>',
    '<main id="search"><p>The text.</p></main>'])
def test_words_do_not_strike_the_article(page):
    assert H.main_text(page, None, None) == "The text."


def test_repeated_notice_in_articles_goes(spark):
    rows = [(i, "http://h.example/", f'{HEAD}<article><h1>Head {i}</h1><p class="x">Written for our readers.</p><p>Text {i} of the story.</p></article>')
            for i in range(6)]
    for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"Head {r.page_id}\n\nText {r.page_id} of the story."
