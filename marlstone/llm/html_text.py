"""HTML extraction by consensus host paths (operator 2).

First every page's containers are scored and the best one gives a vote: its path of tags and generalised classes
(digits dropped, classes of state or topic left out). Votes are counted by host and path in Spark. Then every page is read again with its host's
winning paths: the text is that of the elements on the strongest of them that holds text on the page, or of its own best
container where there is none.

Left out wherever they stand: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments; told by tag, role and whole class names. Inside an article a header keeps its headings. Names are a guess: a
container so marked (but for menus, footers, reader comments and what is hidden) counts after all if the rest of the page
has next to nothing. Character references are decoded, white space inside a
block becomes one blank, and blocks are joined by line feeds. Null html is empty and gives an empty text. A null
or odd url votes with the others of its kind. Equal rows give equal rows; an empty table gives none. Time and memory are linear in a
page's length, however deep its elements are nested or left open.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sliced, written

#: Winning paths of a host; share of the text that a container must hold for the search to go into it.
PATHS, MOST = 5, 0.85
#: How much more text than the rest of the page a container marked as noise must have to count.
PARDON = 10

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|select|object|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# What the elements of HTML and the usual class names stand for.
CONTAINERS = frozenset("html body div article main section td center table tbody tr form aside header fieldset".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address hr details summary thead tfoot th caption legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TAGS = frozenset("head nav footer button menu dialog label datalist output".split())
NOISE_TAGS = frozenset("aside form fieldset".split())
NEVER_ROLES = frozenset("navigation contentinfo search dialog alert alertdialog menu menubar toolbar".split())
NOISE_ROLES = frozenset("banner complementary form".split())
NEVER_NAMES = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs footer comment comments disqus replies reply respond pagination pager skip".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar masthead topbar sidebar aside header".split()
)
#: A last word that says nothing of what the element is for.
TAILS = frozenset("s list lists item items area box boxes wrap wrapper container section block bar slot unit link links button buttons form title inner outer top bottom left right zone holder row column panel thread".split())
#: A word that makes the name one of a state, layout or topic of what is inside.
STATES = frozenset("has no with without not is are show hide allow open closed on off enabled disabled free layout category tag topic type format status elementor".split())
OWN_HEADER = frozenset("post entry article story content".split())


class _Node:
    """own: characters of text, links: those of them in links; head: only headings count inside; out: noise."""

    __slots__ = ("tag", "label", "path", "parent", "own", "links", "headings", "article", "head", "out")

    def __init__(self, tag: str, label: str, path: int, parent: int, article: bool, head: bool, out: bool):
        self.tag, self.label, self.path, self.parent, self.article, self.head, self.out = tag, label, path, parent, article, head, out
        self.own = self.links = self.headings = 0


def meaning(name: str) -> tuple[str, bool]:
    """What a class or id says: "never", "noise", "header" or nothing, and whether it's of the article's own; judged by its last word that isn't a tail."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or not STATES.isdisjoint(words):
        return "", False
    told: list[str] = []
    for w in words:  # names without a hyphen, as "commentlist"
        if w not in NEVER_NAMES and w not in NOISE_NAMES and w not in TAILS:
            cut = next((k for k in range(len(w) - 1, 1, -1) if w[k:] in TAILS and (w[:k] in NEVER_NAMES or w[:k] in NOISE_NAMES)), 0)
            told += [w[:cut], w[cut:]] if cut else [w]
        else:
            told.append(w)
    while len(told) > 1 and told[-1] in TAILS:
        told.pop()
    last = told[-1]
    if last == "header":
        return "header", not OWN_HEADER.isdisjoint(told)
    return "never" if last in NEVER_NAMES else "noise" if last in NOISE_NAMES else "", False


def described(attrs: str) -> tuple[tuple[str, ...], frozenset[str]]:
    """Generalised classes, and what class, id, role and visibility say: of never, noise, header, own."""
    names, said = [], set()
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for token in value.split():
                what, own = meaning(token)
                said.add(what)
                if own:
                    said.add("own")
                if name == "class" and STATES.isdisjoint(words := [w.lower() for w in _WORD.findall(token)]):
                    names.append("".join(words))
        elif name == "role":
            said.add("never" if value.lower() in NEVER_ROLES else "noise" if value.lower() in NOISE_ROLES else "")
        elif name == "style":
            said.add("never" if "display:none" in value.lower().replace(" ", "") else "")
        elif name == "hidden" or name == "aria-hidden":
            said.add("never" if value.lower() in ("", "true", "hidden", "until-found") else "")
    return tuple(sorted(filter(None, names))), frozenset(said)


_told = functools.lru_cache(4096)(described)
_NOTHING = ((), frozenset())


def parse(page: str) -> tuple[list[_Node], list[tuple[int, str]]]:
    """The containers of a page in order, and its blocks of text: container and text. Noise that never counts isn't in them; other noise is marked."""
    nodes, blocks, stack = [_Node("", "", 0, -1, False, False, False)], [], [0]
    open_: Counter[str] = Counter()  # containers on the stack, by tag
    pieces: list[str] = []
    heading = False
    link = link_chars = 0
    skip, depth, inner = "", 0, {}
    at = 0

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            node = nodes[stack[-1]]
            if text and (heading or not node.head):
                node.own += len(text)
                node.links += min(len(text), link_chars)
                node.headings += heading
                blocks.append((stack[-1], text))
        link_chars = 0

    def close(tag: str) -> None:
        while True:
            last = nodes[stack.pop()].tag
            open_[last] -= 1
            if last == tag:
                return

    for m in _TAG.finditer(page):
        if not skip and m.start() > at:
            pieces.append(page[at : m.start()])
            if link:
                link_chars += m.start() - at
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, closing = tag.lower(), m["end"] or m["end2"]
        if skip:
            if closing:
                if tag == skip:
                    depth -= 1
                    if not depth:
                        skip = ""
                    continue
                if inner.get(tag, 0):
                    inner[tag] -= 1
                    continue
                if not open_[tag]:
                    continue
                skip = ""  # an element around it ends, so it does
            elif skip == "p" and tag in BLOCKS:
                skip = ""  # as any paragraph it ends here
            else:
                if tag == skip:
                    depth += 1
                elif tag not in VOID and tag != "p":
                    inner[tag] = inner.get(tag, 0) + 1
                continue
        if closing:
            if tag == "a":
                link = max(0, link - 1)
            elif tag in BLOCKS:
                flush()
                heading = False
                if open_[tag]:
                    close(tag)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "a":
            link += 1
        attrs = m["attrs"] or m["attrs2"] or ""
        names, said = _NOTHING if not attrs or tag in ("html", "body", "main") else _told(attrs) if len(attrs) < 512 else described(attrs)
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        top = nodes[stack[-1]]
        header = tag == "header" or "header" in said
        own = header and (top.article or "own" in said)
        noise = tag in NOISE_TAGS or "noise" in said or header and not own
        if tag in NEVER_TAGS or "never" in said or noise and tag not in CONTAINERS:
            if tag in BLOCKS or tag in NEVER_TAGS:
                flush()
            skip, depth, inner = tag, 1, {}
            continue
        if tag in BLOCKS:
            flush()
            heading = tag in HEADINGS
            if tag in CONTAINERS:
                if tag in ("tr", "td"):  # they end their like without a word
                    while nodes[stack[-1]].tag in (("td", "tr") if tag == "tr" else ("td",)):
                        close(nodes[stack[-1]].tag)
                    top = nodes[stack[-1]]
                label = ".".join([tag, *names])
                nodes.append(_Node(tag, label, hash((top.path, label)), stack[-1], top.article or tag == "article", top.head or own, noise))
                stack.append(len(nodes) - 1)
                open_[tag] += 1
    if not skip and at < len(page):
        pieces.append(page[at:])
    flush()
    pardon(nodes)
    return nodes, blocks


def pardon(nodes: list[_Node]) -> None:
    """Settle what is out: noise that has far more text than what counts so far is taken in, the largest first; then all below noise is out."""
    if any(n.out for n in nodes):
        whole = [max(0, n.own - n.links) for n in nodes]
        clean = list(whole)  # without noise below
        above = [-1] * len(nodes)  # the nearest noise around
        for k in range(1, len(nodes)):
            up = nodes[k].parent
            above[k] = up if nodes[up].out else above[up]
        for k in range(len(nodes) - 1, 0, -1):
            whole[nodes[k].parent] += whole[k]
            if not nodes[k].out:
                clean[nodes[k].parent] += clean[k]
        counts = clean[0]
        for k in sorted((k for k, n in enumerate(nodes) if n.out), key=lambda k: -whole[k]):
            if (above[k] < 0 or not nodes[above[k]].out) and whole[k] > PARDON * counts:
                nodes[k].out = False
                counts += clean[k]
    for n in nodes[1:]:
        n.out = n.out or nodes[n.parent].out


def scores(nodes: list[_Node]) -> tuple[list[int], list[int]]:
    """Of each container with all below it: characters outside links, and headings."""
    score = [0 if n.out else max(0, n.own - n.links) for n in nodes]
    heads = [0 if n.out else n.headings for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        score[nodes[k].parent] += score[k]
        heads[nodes[k].parent] += heads[k]
    return score, heads


def best(nodes: list[_Node]) -> tuple[int, int]:
    """The container to take and its score: characters outside links.

    From the root down, as long as one container holds nearly all of them and all headings; an article is the end.
    """
    score, heads = scores(nodes)
    below: dict[int, list[int]] = {}
    for k in range(1, len(nodes)):
        below.setdefault(nodes[k].parent, []).append(k)
    articles = [k for k, n in enumerate(nodes) if n.tag == "article"]
    top = max(articles, key=lambda k: score[k], default=None)
    if top is not None and score[top] >= score[0] / 2:
        return top, score[top]
    at = 0
    while at in below and nodes[at].tag != "main":
        down = max(below[at], key=lambda k: score[k])
        if not score[at] or score[down] < MOST * score[at] or heads[down] < heads[at]:
            break
        at = down
    return at, score[at]


def path_of(nodes: list[_Node], k: int) -> str:
    """">html>body>div.story": tags and classes from the root down."""
    labels = []
    while k > 0:
        labels.append(nodes[k].label)
        k = nodes[k].parent
    return "".join(">" + x for x in reversed(labels))


def text_of(nodes: list[_Node], blocks: list[tuple[int, str]], paths: list[str]) -> str:
    """The blocks inside the elements on the first of the paths that has text on the page, or in its best container."""
    score = scores(nodes)[0] if paths else []
    chosen: set[int] = set()
    for path in paths:
        told = functools.reduce(lambda h, label: hash((h, label)), path.split(">")[1:], 0)
        found = {k for k, n in enumerate(nodes) if n.path == told and k and not n.out}
        if any(score[k] for k in found):
            chosen = found
            break
    chosen = chosen or {best(nodes)[0]}
    inside = [False] * len(nodes)
    for k, n in enumerate(nodes):
        inside[k] = not n.out and (k in chosen or n.parent >= 0 and inside[n.parent])
    return "\n".join(t for k, t in blocks if inside[k])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and paths (strongest first): a vote for each page; ties by the sum of scores, then in path order."""
    source = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            told: dict[tuple[str, str], list[int]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes, _ = parse(page)
                k, score = best(nodes)
                if score and k:
                    sums = told.setdefault((host, path_of(nodes, k)), [0, 0])
                    sums[0] += 1
                    sums[1] += score
            cols = [[h for h, _ in told], [p for _, p in told], [n for n, _ in told.values()], [x for _, x in told.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(cols)], ["host", "path", "votes", "score"])

    votes = source.mapInArrow(vote, "host string, path string, votes bigint, score bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    ranked = votes.withColumn("rank", F.row_number().over(W.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path"))).where(F.col("rank") <= PATHS)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page."""
    winners = written(winning_paths(pages, url, html), "paths")
    source = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"), host_of(F.col(f"`{url}`")).alias("host"))
    kind = source.schema["key"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            texts = [text_of(*parse(page), paths or []) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    # The winners are a few paths for each host: Spark broadcasts the table while it is small, and else shuffles and splits skewed hosts.
    joined = source.join(winners, "host", "left").select("key", "url", "html", "paths")
    return joined.mapInArrow(read, f"`{key}` {kind}, `{url}` string, text string, n_chars bigint")
