"""Main text of web pages by template deduction over the pages of a host.

Tokens are container tags with the path of tags and classes above them, and
whole text blocks.  The occurrence vector of a token holds its count on each
page of the host; vectors are compared by their sums of per-page hashes, so
tokens of one equivalence class get equal sums and the vectors themselves
are never gathered (a host with a third of all pages is summed in parts).
Copies of a page say nothing of a template, so each html of a host counts once.
Classes that occur on most pages are valid; they nest by path, and the class
with one occurrence a page is the root of the host's template.  Its
containers delimit the slots, and text blocks of valid classes are template
text.  The slot with the article is the deepest one that leaves nothing but
template text outside, or an ``article`` or ``main`` with most of the running
text.  Each page then gives the blocks of that slot.

Template text is dropped inside articles, too.  Regions that are no article by
their tag or a word of their class (menus, forms, adverts, comments ...) count
as no text in any slot; a word never strikes ``html``, ``body``, ``main``,
``article`` or a region with most of the page's running text.  Pages of hosts without a valid
class, or without the slot or with too little of their text in it, give their
``article``, ``main`` or else whole body.

Defined results: null or empty html gives an empty text; a null url or one
without ``://`` belongs to the host ''; repeated rows give equal texts; a page
that is cut off or whose tags don't match is read as far as it goes; an empty
table gives an empty result; other columns of the input do not matter.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import checkpoint, map_rows
from tierscope.operators.skew import join_on_hot_keys

VALID_SHARE = 0.8     # a valid class occurs on this share of a host's pages, or more
VALID_PAGES = 3       # and the host has so many distinct pages
MOST_TEXT = 0.7       # a slot of an article tag holds this share of the running text or more, and so does the slot of a page

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title noscript iframe xmp".split())
SELF_CLOSING = {t: {t} for t in ("p", "li", "tr", "td", "th", "option")} | {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
KEEPS_P_OPEN = INLINE | VOID | {"object", "video", "audio", "canvas", "map", "button"}
# Regions that are not part of an article, by tag and by word of class, id or role.
OTHER_TAGS = set("nav header footer aside form script style noscript template iframe svg object button select textarea dialog menu head title".split())
OTHER_WORDS = set("""ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice
    sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies disqus respond
    share sharing social related newsletter subscribe popup modal widget toolbar pagination pager login signup search""".split())
NEVER_OTHER = {"html", "body", "main", "article"}   # by a word
IN_ARTICLE_TOO = {"header", "masthead"}   # an article's own head belongs to it

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Block:
    __slots__ = ("path", "text", "other", "article", "linked")

    def __init__(self, path, text, other, article, linked):
        self.path, self.text, self.other, self.article, self.linked = path, text, other, article, linked


def parse(page: str) -> tuple[list[Block], dict[str, int]]:
    """Text blocks in page order, and how often each container path opens."""
    blocks, opened = [], defaultdict(int)
    stack = [("", "", False, False)]          # tag, path, in a region that is no article, in an article
    parts, links, linked, at = [], 0, 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                _, path, other, article = stack[-1]
                blocks.append(Block(path, text, other, article, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(text):
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) if links else 0

    while m := _TAG.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        close, tag, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if close else 1
        if tag == "br":
            add("\n")
        if tag in RAW:
            if not close:
                opened[f"{stack[-1][1]}>{tag}"] += 1
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE or tag in VOID and tag != "hr":
            continue
        flush()
        if tag == "hr":
            continue
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    links = 0
                    break
            continue
        ends = SELF_CLOSING.get(tag, set()) | (set() if tag in KEEPS_P_OPEN else {"p"})
        if stack[-1][0] in ends:
            stack.pop()
        _, path, other, article = stack[-1]
        names = [n.lower() for _, *v in _NAMES.findall(attrs) for n in "".join(v).split()] if "=" in attrs else []
        words = {w for n in names for w in re.split(r"[^a-z0-9]+", n)}
        hit = ({tag} & OTHER_TAGS) | (set() if tag in NEVER_OTHER else words & OTHER_WORDS)
        hit = hit - IN_ARTICLE_TOO if article else hit
        path = f"{path}>{tag}{''.join('.' + n for n in sorted(names))}"
        opened[path] += 1
        if hit and not other:
            # Regions by a word alone may turn out to hold most of the text.
            other = path if not hit & OTHER_TAGS else True
        elif hit & OTHER_TAGS:
            other = True
        if attrs.endswith("/") and tag == "svg":
            continue
        stack.append((tag, path, other, article or tag == "article" and other is not True))
    add(page[at:])
    flush()
    struck, running = defaultdict(int), 0
    for b in blocks:
        if b.other is not True:
            n = len(b.text) - b.linked
            running += n
            struck[b.other] += n
    for b in blocks:
        b.other = b.other is True or bool(b.other) and struck[b.other] < MOST_TEXT * running
        b.article = b.article and not b.other
    return blocks, opened


def _inside(path: str, container: str) -> bool:
    return path == container or path.startswith(container + ">")


def _text_token(b: Block) -> str:
    return f"{b.path}\t{xxhash.xxh64_hexdigest(b.text.encode('utf-8', 'surrogatepass'))}"


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)), F.lit(""))


_SUMS = ("pages", "low", "high", "once", "running")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, html) with each html of a host once; null is as empty.  The html is shuffled compressed."""
    def pack(batch):
        texts = [(page or "").encode("utf-8", "surrogatepass") for page in batch["html"]]
        return {"host": batch["host"], "digest": [xxhash.xxh128_digest(t) for t in texts], "packed": [zlib.compress(t) for t in texts]}

    def unpack(batch):
        return {"host": batch["host"], "html": [zlib.decompress(t).decode("utf-8", "surrogatepass") for t in batch["packed"]]}

    packed = map_rows(pages.select("host", "html"), "host string, digest binary, packed binary", pack)
    return map_rows(packed.groupBy("host", "digest").agg(F.first("packed").alias("packed")), "host string, html string", unpack)


def token_sums(pages: DataFrame) -> DataFrame:
    """Per host and token: pages that hold it, sums of its vector's hashes, pages with one of it, running text inside."""
    def rows(batch):
        sums = defaultdict(lambda: [0] * len(_SUMS))
        for host, page in zip(batch["host"], batch["html"], strict=True):
            blocks, opened = parse(page or "")
            counts, running = {"": 1, **opened}, defaultdict(int)
            for b in blocks:
                if not b.other:
                    n, path = len(b.text) - b.linked, b.path
                    while path:
                        running[path] += n
                        path = path.rpartition(">")[0]
                    running[""] += n
                token = _text_token(b)
                counts[token] = counts.get(token, 0) + 1
                if not b.other:
                    running[token] += len(b.text) - b.linked
            seed = xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass"))
            for token, n in counts.items():
                h = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed)
                for i, v in enumerate((1, h & 0xFFFFFFFF, h >> 32, n == 1, running[token])):
                    sums[host, token][i] += v
        return {"host": [h for h, _ in sums], "token": [t for _, t in sums],
                **{name: [v[i] for v in sums.values()] for i, name in enumerate(_SUMS)}}

    parts = map_rows(pages.select("host", "html"), "host string, token string, " + ", ".join(f"{c} long" for c in _SUMS), rows)
    return parts.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in _SUMS])


def deduce(tokens: pd.DataFrame) -> tuple[str | None, list[str]]:
    """The article's slot and the template's text blocks, from one host's frequent tokens."""
    whole = tokens[tokens["token"] == ""].iloc[0]
    classes = tokens.groupby(["low", "high"])
    # Valid: on most pages, with one occurrence a page; the largest such class is the root.
    valid = [c for _, c in classes if (c["once"] == c["pages"]).all() and c["pages"].iloc[0] >= VALID_SHARE * whole["pages"]]
    valid.sort(key=lambda c: (-c["pages"].iloc[0], -len(c)))
    kept = [(t, running) for c in valid for t, running in zip(c["token"], c["running"], strict=True)]
    texts = {t: running for t, running in kept if "\t" in t}
    constant = list(texts)
    fixed = defaultdict(int)                  # running text of the template inside each container
    for t, running in texts.items():
        path = t.partition("\t")[0]
        while path:
            fixed[path] += running
            path = path.rpartition(">")[0]
    best, rest = None, whole["running"] - sum(texts.values())
    # From the outside in: a container is left for one inside it if what stays behind is template text alone, or if that one
    # is an article by its tag and holds most of the text; an article is never left for less.
    for t, running in sorted((x for x in kept if x[0] and "\t" not in x[0]), key=lambda x: (x[0].count(">"), x[0])):
        semantic = re.search(r">(article|main)\b[^>]*$", t)
        enough = running - fixed[t] >= rest or semantic and running >= MOST_TEXT * whole["running"]
        if running and enough and (best is None or _inside(t, best) and not re.search(r">(article|main)\b[^>]*$", best)):
            best, rest = t, running - fixed[t]
    return best, constant


def templates(sums: DataFrame) -> DataFrame:
    """host, slot, constant: one row a host with enough pages; the tokens of a host that are frequent are few."""
    pages = sums.filter("token = ''").select("host", F.col("pages").alias("all_pages"))
    frequent = sums.join(pages, "host").filter((F.col("all_pages") >= VALID_PAGES) & (F.col("pages") >= VALID_SHARE * F.col("all_pages")))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        slot, constant = deduce(frame.sort_values("token", key=lambda s: s.str.count(">")))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "slot": [slot], "constant": [constant]})

    return frequent.groupBy("host").applyInPandas(one, "host string, slot string, constant array<string>")


def main_text(page: str | None, slot: str | None, constant: list[str] | None) -> str:
    blocks, opened = parse(page or "")
    template = set(constant or ())
    if slot:
        own = [b for b in blocks if not b.other and (not template or _text_token(b) not in template)]
        held = sum(len(b.text) - b.linked for b in own if _inside(b.path, slot))
        if held < MOST_TEXT * sum(len(b.text) - b.linked for b in own):
            slot = None
    if not slot or slot not in opened:
        last = [re.match(r"[^.]*", p.rpartition(">")[2])[0] for p in opened]
        tag = next((t for t in ("article", "main") if t in last), "")
        inside = [b for b in blocks if b.article or tag == "main" and re.search(r">main\b", b.path) or not tag]
        if tag == "article" and not inside:
            inside = blocks
    else:
        inside = [b for b in blocks if _inside(b.path, slot)]
    return "\n\n".join(b.text for b in inside if not b.other and (not template or _text_token(b) not in template))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    p = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    sums = checkpoint(token_sums(distinct_pages(p)))
    n = p.groupBy("host").agg(F.count("*").alias("n"))
    # The html of frequent hosts stays where it is; their templates come to it.
    hosts = checkpoint(n.join(templates(sums), "host", "left"))
    both = join_on_hot_keys(p, hosts, "host", "n")

    def rows(batch):
        texts = [main_text(*x) for x in zip(batch["html"], batch["slot"], batch["constant"], strict=True)]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(both, "page_id long, url string, text string, n_chars long", rows)
