"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

Tokens are tags and whole text nodes in the context of their path. Tokens of a host's pages that occur the
same number of times in each page share an occurrence vector and form an equivalence class; vectors are
compared by a fingerprint, the exclusive or of hashes of (page, count), so that no vector is ever held.
Classes of enough tokens and pages make the template, ordered by place. In a page, a class is valid if its
tokens come in the template's order and do not straddle those of another class; text nodes of valid classes
are template, what stands in the slots between is data.

From the slots the article is taken: the content of the page's article or main element where there is one,
without elements that name themselves as navigation, headers, footers, asides, notices, adverts, forms or
comments; without such an element, blocks that are mostly links go as well. Text inside an article is template
only if it has the occurrences of the frame around the article, and is a small part of it. Templates are learnt
from the distinct contents of a host. A host with few pages has no
evidence of a template and only the second part applies.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import arrow_map, settle, spread, texts_of

MIN_PAGES = 4
MIN_SHARE = 0.6
MIN_CLASS = 3
MAX_STANDING = 0.25

#: A quote opens a value only after an equals sign; elsewhere it is a character like others.
_VALUES = r"(?>=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^=>]+)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea)\b{_VALUES}>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][\w:-]*)({_VALUES})>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[a-z0-9]+")

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
AWAY = frozenset("nav header footer aside form head title script style noscript template iframe svg button select option textarea dialog menu object canvas audio video map".split())
CLOSES_P = frozenset("p div ul ol li h1 h2 h3 h4 h5 h6 table section article aside nav header footer form blockquote pre hr main dl figure address".split())
#: Words in class, id or role that mark what is not the article.
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sidebar comment comments commentlist disqus cookie cookies consent gdpr notice notices alert "
    "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead social share sharing related recommended promo promotion sponsor sponsored newsletter "
    "subscribe subscription popup modal overlay widget login signup search toolbar pagination pager hidden skip contentinfo complementary form dialog reply replies respond".split()
)
#: Words that stand beside them in names of the same things, and those that mark a single paragraph.
FRAME_WORDS = frozenset("area bar block bottom box button buttons container content global icons inner item items left link links list main outer page panel posts right section site slot top unit wrap wrapper".split())
STRONG_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense cookie cookies consent gdpr notice notices sponsor sponsored newsletter".split())
CONTAINERS = frozenset("div section ul ol dl table details fieldset main article".split())
MAIN_WORDS = frozenset("main article articlebody".split())


class _Element:
    __slots__ = ("away", "key", "main", "name")

    def __init__(self, name: str, key: str, away: bool, main: bool) -> None:
        self.name, self.key, self.away, self.main = name, key, away, main


def _names_away(name: str, value: str) -> bool:
    """Whether one of the names in value consists of words for what is not the article; header-image and
    search-result hold others too, and a paragraph is not a list of related links."""
    words = AWAY_WORDS if name in CONTAINERS or name not in CLOSES_P and name not in INLINE and name != "li" else STRONG_WORDS
    for one in value.split():
        parts = _PART.findall(one)
        if any(p in words for p in parts) and all(p in AWAY_WORDS or p in FRAME_WORDS or p.isdigit() for p in parts):
            return True
    return False


def _element(name: str, raw: str) -> _Element:
    key, away, main = name, name in AWAY, name in ("article", "main")
    if raw and not raw.isspace():
        kept = []
        for m in _ATTRIBUTE.finditer(raw):
            attribute = m[1].lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if attribute in ("class", "id", "role", "itemprop"):
                kept.append(f"{attribute}={value}")
                if name not in ("html", "body"):
                    away = away or _names_away(name, value)
                    main = main or attribute in ("role", "itemprop") and any(w in MAIN_WORDS for w in _PART.findall(value))
            elif attribute == "hidden" or attribute == "aria-hidden" and value == "true" or attribute == "style" and "display:none" in value.replace(" ", ""):
                away = True
        key = name + "[" + " ".join(sorted(kept)) + "]" if kept else name
    return _Element(name, key, away, main)


def _below(path: int, key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"), seed=path)


def nodes(page: str) -> list[tuple[int, int, str, bool, int, bool, bool]]:
    """The page as a list of (kind, path, text, away, main, link, breaks): kind 0 is a tag, 1 a text node;
    path is a hash of the elements around it.

    main is the number of the outermost article or main element, from 1, or 0; breaks tells that the node
    begins a block."""
    out: list[tuple[int, int, str, bool, int, bool, bool]] = []
    stack: list[_Element] = []
    opened: Counter = Counter()
    paths = [0]
    aways, mains, links = [False], [0], [False]
    at, articles, breaks = 0, 0, True

    def push(e: _Element) -> None:
        nonlocal articles
        stack.append(e)
        opened[e.name] += 1
        paths.append(_below(paths[-1], e.key))
        main = mains[-1]
        if e.main and not main and not (aways[-1] or e.away):
            articles += 1
            main = articles
        aways.append(aways[-1] or e.away)
        mains.append(main)
        links.append(links[-1] or e.name == "a")

    def pop(n: int) -> None:
        for e in stack[-n:]:
            opened[e.name] -= 1
        del stack[-n:], paths[-n:], aways[-n:], mains[-n:], links[-n:]

    def text(raw: str) -> None:
        nonlocal breaks
        if raw:
            out.append((1, paths[-1], _html.unescape(raw), aways[-1], mains[-1], links[-1], breaks))
            breaks = False

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                breaks = breaks or m[1].lower() not in INLINE
            continue
        if name not in INLINE:
            breaks = True
        if m[2]:
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k].name == name:
                    # an end tag of an inline element does not close blocks around it
                    if name in INLINE and any(e.name not in INLINE for e in stack[k + 1 :]):
                        break
                    pop(len(stack) - k)
                    break
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1) if opened["p"] else ():
                if stack[k].name == "p":
                    pop(len(stack) - k)
                    break
                if stack[k].name not in INLINE:
                    break
        if name in ("li", "td", "tr", "option", "dt", "dd") and stack and stack[-1].name == name:
            pop(1)
        e = _element(name, m[4])
        out.append((0, _below(paths[-1], e.key), "", aways[-1] or e.away, mains[-1], links[-1], False))
        if name not in VOID and not m[4].endswith("/"):
            push(e)
    text(page[at:])
    return out


def _hash(kind: int, path: int, text: str) -> int:
    x = xxhash.xxh3_64_intdigest(f"{kind}|{' '.join(text.split())}".encode("utf-8", "surrogatepass"), seed=path)
    return x - (1 << 64) if x >= 1 << 63 else x


def tokens(page: str) -> list[int]:
    """Token of each node; blank text nodes are 0."""
    return [0 if n[0] and not n[2].strip() else _hash(n[0], n[1], n[2]) for n in nodes(page)]


def _page_tokens(batches):
    for b in batches:
        hosts, toks, vectors, places = [], [], [], []
        for host, page in zip(b["host"].to_pylist(), texts_of(b["html"]), strict=True):
            count: dict[int, list[int]] = {}
            for i, t in enumerate(tokens(page)):
                if t:
                    count.setdefault(t, [0, i])[0] += 1
            seed = xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass"))
            for t, (n, i) in count.items():
                h = xxhash.xxh3_64_intdigest(n.to_bytes(4, "little"), seed=seed)
                hosts.append(host)
                toks.append(t)
                vectors.append(h - (1 << 64) if h >= 1 << 63 else h)
                places.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(toks, pa.int64()), pa.array(vectors, pa.int64()), pa.array(places, pa.int32())], names=["host", "token", "vector", "place"])


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def _contents(pages: DataFrame) -> DataFrame:
    """host, html: each content of a host once, as equal pages are no evidence of what their host's pages share.
    Only pages that have copies are dealt by their content."""
    keys = ["host", "mark", "size"]
    marked = pages.where("html is not null").select("host", "html", F.xxhash64("html").alias("mark"), F.length("html").alias("size"))
    copied = settle(marked.groupBy(keys).count().where("count > 1").select(keys), "copied")
    once = marked.join(copied, keys, "left_semi").dropDuplicates(keys)
    return marked.join(copied, keys, "left_anti").unionByName(once).select("host", "html")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_class: int = MIN_CLASS) -> DataFrame:
    """host, template: its tokens with their class, in order of place. A token is in at least min_share of a
    host's pages, so a template has at most 1 / min_share times the mean number of tokens of a page."""
    pages = settle(_contents(spread(_with_host(pages))), "contents")
    each = arrow_map(spread(pages), _page_tokens, "host string, token long, vector long, place int")
    found = each.groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), F.count("*").alias("pages"), F.sum("place").alias("place"))
    found = settle(found.where(F.col("pages") >= min_pages), "tokens")
    size = pages.groupBy("host").agg(F.count("*").alias("all")).where(F.col("all") >= min_pages)
    often = settle(found.join(settle(size, "hosts"), "host").where(F.col("pages") >= F.col("all") * min_share), "often")
    classes = often.groupBy("host", "vector", "pages").agg(F.count("*").alias("members")).where(F.col("members") >= min_class).select("host", "vector", "pages")
    inside = often.join(settle(classes, "classes"), ["host", "vector", "pages"])
    row = F.struct((F.col("place") / F.col("pages")).alias("at"), "token", F.col("vector").alias("class"))
    return inside.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["token"].alias("token"), x["class"].alias("class"))).alias("template"))


def _valid(found: list[int], order: dict[int, int], klass: dict[int, int]) -> set[int]:
    """The classes whose first tokens come in the template's order here, and that nest."""
    first: dict[int, int] = {}
    for i, t in enumerate(found):
        if t in klass and t not in first:
            first[t] = i
    by: dict[int, list[int]] = {}
    for t in first:
        by.setdefault(klass[t], []).append(t)
    spans = []
    for c, ts in by.items():
        here = sorted(ts, key=first.__getitem__)
        if len(here) >= 2 and here == sorted(ts, key=order.__getitem__):
            spans.append((first[here[0]], first[here[-1]], c, [first[t] for t in here]))
    good: set[int] = set()
    kept: list[list[int]] = []
    for _, _, c, places in sorted(spans, key=lambda x: (x[0], -x[1])):
        # nested: all its tokens stand in one gap of each class before it
        if all(bisect(outer, places[0]) == bisect(outer, places[-1]) for outer in kept):
            good.add(c)
            kept.append(places)
    return good


def _around(inside: list[int], toks: list[int], klass: dict[int, int]) -> set[int]:
    """Classes with tokens on both sides of an article."""
    before = {klass[t] for t in toks[: inside[0]] if t in klass}
    return before & {klass[t] for t in toks[inside[-1] + 1 :] if t in klass}


def main_text(page: str, template: list[tuple[int, int]] | None = None) -> str:
    """The article's text: blocks in page order, joined by a space."""
    found = nodes(page)
    drop: set[int] = set()
    if template:
        toks = [0 if n[0] and not n[2].strip() else _hash(n[0], n[1], n[2]) for n in found]
        order = {t: i for i, (t, _) in enumerate(template)}
        klass = dict(template)
        good = _valid(toks, order, klass)
        drop = {i for i, t in enumerate(toks) if found[i][0] and t in klass and klass[t] in good}
    body = [i for i, n in enumerate(found) if n[0] and not n[3]]
    inside = [i for i in body if found[i][4]]
    if drop and inside:
        frame = _around(inside, toks, klass)
        drop = {i for i in drop if klass[toks[i]] in frame}
    blocks: list[list[int]] = []
    for i in inside or body:
        if found[i][6] or not blocks or any(found[j][6] for j in range(blocks[-1][-1] + 1, i)):
            blocks.append([])
        blocks[-1].append(i)
    # a block with anything of the page's own is a slot as a whole
    own = [b for b in blocks if not all(i in drop or not found[i][2].strip() for i in b)]
    size = lambda bs: sum(len(found[i][2].strip()) for b in bs for i in b)
    # pages that share more of an article share the article and not a frame
    blocks = own if not inside or size(own) >= (1 - MAX_STANDING) * size(blocks) else blocks
    if not inside:
        blocks = [b for b in blocks if sum(len(found[i][2].strip()) for i in b if found[i][5]) * 2 <= sum(len(found[i][2].strip()) for i in b)]
    parts = [" ".join("".join(found[i][2] for i in b).split()) for b in blocks]
    return " ".join(p for p in parts if p)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages; text is empty where there is none.

    A null html or url is empty; pages without a host are a host of their own. Equal pages and repeated rows
    count once in a template and are extracted each. Very long and deeply nested pages take time in proportion
    to their length. Other columns are ignored.
    """
    kinds = dict(pages.dtypes)
    known = settle(templates(pages), "templates")
    both = spread(_with_host(pages)).join(known, "host", "left").select("page_id", "url", "html", "host", "template")

    def run(batches):
        for b in batches:
            held: dict[str, list[tuple[int, int]]] = {}  # of the batch's hosts
            texts = []
            for i, (page, host) in enumerate(zip(texts_of(b["html"]), b["host"].to_pylist(), strict=True)):
                if host not in held:
                    held[host] = [(x["token"], x["class"]) for x in b["template"][i].as_py() or ()]
                texts.append(main_text(page, held[host]))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(both, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
