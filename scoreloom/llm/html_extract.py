"""Main-text extraction by consensus host paths.

Every page scores its containers by the running text they hold, climbs from the best one to the article around it and
names its generalised tag-class path. Names tell boilerplate only where they leave the article's parts alone. Spark counts these votes per host; each page is then read again and the containers at its host's winning path
give the text. A page without such a container uses its own best one.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
#: Elements whose content is no text of the page; it ends at their end tag only.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style noscript template textarea iframe svg select object title".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1"
    " h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody"
    " td tfoot th thead title tr ul head".split()
)
#: Elements that hold no article text.
_OUT = frozenset("head title nav footer aside form button menu dialog fieldset label input".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Elements that are told by their labels, unless they hold the whole page or article.
_LABELLED = frozenset("div section ul ol dl table td figure center".split())
#: Of lists, tables and figures, and of paragraphs and words, only adverts, notices and comments are told.
_CONTENT = frozenset("ol dl table td figure".split())
_PARAGRAPHS, _WORDS = frozenset("p blockquote h2 h3 h4 h5 h6 address".split()), frozenset("span small ins em strong b i".split())
#: Labels that tell with whatever stands beside them, as in advert-leaderboard.
_COMMENT_ALWAYS = frozenset("comments commentlist disqus".split())
_AD_ALWAYS = frozenset("advert adverts advertisement advertisements advertising adsbygoogle sponsored gdpr".split())
_ALWAYS = _COMMENT_ALWAYS | _AD_ALWAYS | frozenset("promo cookies consent popup modal newsletter subscribe signup login sidebar navbar breadcrumb breadcrumbs masthead pagination pager".split())
#: Labels that tell alone or beside each other and words of place or form, so that notice-period and header-files do not.
_COMMENT_ALONE = frozenset("comment respond discussion replies reply".split())
_AD_ALONE = frozenset("ad ads adv notice notices cookie".split())
_ALONE = _COMMENT_ALONE | _AD_ALONE | frozenset("banner sponsor promotion alert subscription share sharing social related recommended recommendations menu nav navigation footer header".split())
_BESIDE = _ALWAYS | _ALONE | frozenset(
    "area bar block box bottom bottoms btn button buttons card cards center col column container content critical element foot form global group head icon icons info inline inner item"
    " items js label layout left link links list main message mobile module more msg outer overlay page pane panel posts primary right row section secondary site slot small"
    " static sticky strip text thread tile title toolbar top tree unit user users reader readers view widget widgets wrap wrapper x y".split()
)
#: A label that tells the state of something else or of the page, as in has-sidebar or comments-open.
_STATE = re.compile(r"(?:has|no|with|without)[-_].*|.*[-_](?:open|opened|closed|fixed|enabled|disabled)", re.S)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
_CONTAINERS = frozenset("article main section div td body".split())
#: Of the text that a container adds to a part of it, this share may be links if it is to be the article.
_LINKED = 0.3
#: An element with this share of the page's running text is not told by its labels.
_MOST = 0.9
#: Elements nested deeper than this are no elements of their own, as in browsers.
_DEEPEST = 512
#: What an open element of the key closes, up to the first element of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_SCOPE = frozenset("table td th button body article section div main aside html".split())


def tags(page: str) -> Iterator[tuple[int, int, str, dict[str, str]]]:
    """(start, end, name, attributes) of each tag and each run without text, in one pass. An end tag's name begins with
    a slash; comments, declarations and the contents of elements without text have the name ''. What is not closed
    goes on to the end of the page."""
    at, n = 0, len(page)
    while (start := page.find("<", at)) >= 0:
        follows = page[start + 1 : start + 2]
        slash = follows == "/"
        name = _NAME.match(page, start + 1 + slash)
        if not name:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else n
            elif follows and follows in "!?/":
                end = page.find(">", start + 1)
                at = end + 1 if end >= 0 else n
            else:
                at = start + 1
                continue
            yield start, at, "", {}
            continue
        tag, attributes, at = name[0].lower(), {}, name.end()
        while at < n and page[at] != ">":
            m = _ATTRIBUTE.match(page, at)
            at, value = m.end(), ""
            if m[2] or (not m[1] and page[at : at + 1] == "="):
                at += not m[2]
                if (quote := page[at : at + 1]) and quote in "\"'":
                    end = page.find(quote, at + 1)
                    value, at = (page[at + 1 : end], end + 1) if end >= 0 else ("", n)
                else:
                    unquoted = _UNQUOTED.match(page, at)
                    value, at = unquoted[0], unquoted.end()
            if m[1]:
                attributes.setdefault(m[1].lower(), value)
        if at >= n:  # never closed
            yield start, n, "", {}
            return
        at += 1
        closed = page[at - 2] == "/"
        if not slash and tag in _RAW and not closed:
            end = _RAW[tag].search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
            yield start, at, "", {}
            continue
        yield start, at, "/" + tag if slash else tag, attributes
        if closed and not slash and tag not in _VOID and tag not in _BLOCKS:
            yield at, at, "/" + tag, {}


def _kinds(label: str) -> set[str]:
    """What a label tells of its element: 'ad' (adverts and notices), 'comment', 'other' or nothing."""
    pieces = {x.lower() for x in _PIECE.findall(label)}
    if _STATE.fullmatch(label.lower()) or pieces.isdisjoint(_ALWAYS | _ALONE):
        return set()
    told = pieces & (_ALWAYS | _ALONE if pieces <= _BESIDE else _ALWAYS)
    groups = {"ad": _AD_ALWAYS | _AD_ALONE, "comment": _COMMENT_ALWAYS | _COMMENT_ALONE}
    return {name for name, group in groups.items() if told & group} or ({"other"} if told else set())


class _Node:
    __slots__ = ("by_label", "by_tag", "comments", "core", "depth", "link", "linked", "name", "out", "parent", "running", "score", "skip", "tag", "text")

    def __init__(self, tag: str, attributes: dict[str, str], parent: _Node | None):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.link = tag == "a" or (parent is not None and parent.link)
        self.core = self.out = self.by_label = self.comments = False
        self.text = self.linked = 0
        self.running = self.score = 0.0
        labels: list[str] = []
        for name in ("class", "id", "role"):
            if name in attributes and (name == "class" or tag in _CONTAINERS):
                labels += html.unescape(attributes[name]).split()
        self.name = ".".join([tag, *sorted({re.sub(r"\d+", "#", x.lower()) for x in labels})])
        roles = attributes.get("role", "").lower().split()
        self.by_tag = tag in _OUT or not _OUT_ROLES.isdisjoint(roles) or "hidden" in attributes
        if tag == "header":  # the page's, not an article's
            self.by_tag = not any(x.tag in ("article", "main", "section") for x in self.above())
        self.by_tag |= parent is not None and parent.by_tag
        self.skip = parent is not None and parent.skip
        if tag in _LABELLED or tag in _PARAGRAPHS or tag in _WORDS:
            told = {kind for label in labels for kind in _kinds(label)}
            self.comments = "comment" in told and tag in _LABELLED
            self.by_label = bool(told) if tag in _LABELLED and tag not in _CONTENT else "ad" in told or self.comments
            self.skip |= self.by_label and tag in _WORDS

    def above(self) -> Iterator[_Node]:
        node = self.parent
        while node:
            yield node
            node = node.parent

    def path(self) -> str:
        return ">".join(reversed([self.name, *(x.name for x in self.above())]))


def blocks(page: str | None) -> list[tuple[_Node, str, int]]:
    """The page's blocks of text outside boilerplate, in order: innermost element, text, characters of it in links.

    Boilerplate is told by elements and roles, and by labels of elements that hold neither a main part, a heading of
    the first rank, an article nor most of the page's running text. Where labels mark out all text they are not heeded.
    """
    nodes, found = _scan(page or "")
    for node, text, linked in found:
        if not node.by_tag:
            node.running += len(text) - linked
    for node in reversed(nodes):  # what is inside comes first
        node.core |= node.tag in ("main", "h1", "article") and not node.by_tag
        if node.parent:
            node.parent.running += node.running
            node.parent.core |= node.core and not node.comments
    total = nodes[0].running
    for by_label in (True, False):
        for node in nodes:
            told = by_label and node.by_label and (node.comments or not (node.core or node.running >= _MOST * total))
            node.out = node.by_tag or told or (node.parent is not None and node.parent.out)
        if kept := [block for block in found if not block[0].out]:
            return kept
    return []


def _scan(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All elements, outer ones first, and all blocks of text."""
    stack = [_Node("", {}, None)]
    nodes, found = [stack[0]], []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = at = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            found.append((stack[-1], text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def close_to(depth: int):
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    def add(piece: str):
        nonlocal linked
        if piece and not stack[-1].skip:
            pieces.append(html.unescape(piece))
            if stack[-1].link:
                linked += len(pieces[-1])

    for start, end, tag, attributes in tags(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        name = tag.removeprefix("/")
        if name == "br":
            pieces.append(" ")
            continue
        if name in _BLOCKS:
            flush()
        if tag != name:
            if opened[name] > 0:
                close_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name))
        elif tag not in _VOID:
            closes, scope = _CLOSES.get(tag, ({"p"}, _P_SCOPE) if tag in _BLOCKS else ((), ()))
            if any(opened[x] > 0 for x in closes):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in closes:
                        close_to(depth)
                        break
                    if stack[depth].tag in scope:
                        break
            if len(stack) < _DEEPEST:
                stack.append(_Node(tag, attributes, stack[-1]))
                nodes.append(stack[-1])
                opened[tag] += 1
    add(page[at:])
    flush()
    return nodes, found


def _around(node: _Node) -> _Node:
    """The article, else main, that node is in or is, the outermost of each but not of comments; without one, the
    outermost container below the body that is reached by steps which add running text rather than links."""
    above = [node, *node.above()]
    for tag in ("article", "main"):
        if wanted := [x for x in above if x.tag == tag and not any(y.comments for y in x.above())]:
            return wanted[0]
    for x in above[1:]:
        if x.tag not in _CONTAINERS or x.tag == "body":
            continue
        added = x.text - node.text
        if added and x.linked - node.linked > _LINKED * added:
            break
        node = x
    return node


def _best(found: list[tuple[_Node, str, int]]) -> tuple[_Node | None, float]:
    scored: dict[int, _Node] = {}
    sums: dict[int, _Node] = {}
    for node, text, linked in found:
        node.text += len(text)
        node.linked += linked
        share = 1.0 - linked / len(text)
        weight = math.sqrt(len(text)) * share * (2 if text[-1] in ".!?…" else 1)
        part, x = 1.0, node
        while x and part:
            if x.tag in _CONTAINERS:
                x.score += part * weight
                scored[id(x)] = x
                part = 0.4 if part == 1.0 else 0.0
            x = x.parent
        x = node
        while x and id(x) not in sums:
            sums[id(x)] = x
            x = x.parent
    if not scored:
        return None, 0.0
    for x in sorted(sums.values(), key=lambda x: -x.depth):
        if x.parent:
            x.parent.text += x.text
            x.parent.linked += x.linked
    most = max(x.score for x in scored.values())
    node = min((x for x in scored.values() if x.score == most), key=_Node.path)
    return _around(node), node.score


def best_path(page: str | None) -> tuple[str, float]:
    """The path of the container around the one with the most running text, and that one's score: a block counts for
    the closest container, in part for the next."""
    node, score = _best(blocks(page))
    return (node.path(), score) if node else ("", 0.0)


def extract(page: str | None, path: str | None) -> str:
    """The blocks inside the containers at path; if the page has none there, inside its own best container; without
    any container, all blocks."""
    found = blocks(page)
    node, _ = _best(found)
    for wanted in (path, node.path() if node else None):
        if not wanted:
            continue
        depth, inside = wanted.count(">"), {}
        kept = []
        for block in found:
            x = block[0]
            while x.depth > depth:
                x = x.parent
            if id(x) not in inside:
                inside[id(x)] = x.depth == depth and x.path() == wanted
            if inside[id(x)]:
                kept.append(block[1])
        if kept:
            return "\n".join(kept)
    return "\n".join(text for _, text, _ in found)


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): of the paths that pages vote for, the one with most votes, then score, then the smaller path."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [best_path(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.float64())], ["host", "path", "score"])

    votes = pages.select(_host().alias("host"), "html").mapInArrow(vote, "host string, path string, score double").where("path <> ''")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score", 3).cast("decimal(20,3)")).alias("score"))
    ranked = sums.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path")).alias("best"))
    return materialize(ranked.select("host", F.col("best.path").alias("path")), "host_paths")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row. Null html or a page without text gives ''; a null or hostless url
    is host ''. Repeated rows give a row each; other columns are not read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), path.as_py()) for page, path in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select("page_id", "url", "html")
    hosted = pages.withColumn("host", _host()).join(winning_paths(pages), "host", "left")
    kind = dict(pages.dtypes)["page_id"]
    return hosted.select("page_id", "url", "html", "path").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
