"""Main text of web pages by consensus host paths.

Every page is parsed once into containers and text blocks. The lowest container that holds every clean
block of the article (see ``Page.best``) votes, with its generalised tag-and-class path, for its host.
Votes are counted in Spark (summed before the shuffle, so a host with a third of all pages costs one
row a task). Then each page is extracted anew from the containers with its host's winning path, or from
its own best container where it has none.

Parsing takes time and memory in proportion to the page, however deep its elements nest and however
malformed its tags are: containers hold their parent and label, and only the path that is voted for is
spelled out.

Edge cases: a null html is the empty page, whose text is empty; unclosed, stray and nested tags are
tolerated; a tag without an end ends at the next ``<`` or ``>``; a null or odd url has the host ''; of
equally voted paths the longer, then smaller wins; repeated rows each get a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, read_table

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body div article main section td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tr th tbody thead tfoot caption figure figcaption address hr header footer nav aside form fieldset details summary dialog menu".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu object canvas audio video label".split())
CLOSES_P = BLOCKS - {"html", "body"}
# Whole tokens of class, id and role that mark what is not the article.
BOILERPLATE = frozenset("""nav navbar navigation menu menubar footer header masthead sidebar side aside ad ads advert adverts advertisement banner promo
promotion sponsor sponsored cookie cookies consent notice notices alert popup modal overlay toast comment comments commentlist respond reply replies disqus
share sharing social breadcrumb breadcrumbs related recommended newsletter subscribe subscription signup login search pagination pager widget
contentinfo complementary toolbar skip
sidebar-left sidebar-right left-sidebar right-sidebar sidebar-primary sidebar-secondary primary-sidebar secondary-sidebar main-sidebar side-bar
nav-bar nav-menu nav-links main-nav top-nav side-nav sub-nav site-nav footer-nav main-menu top-menu side-menu main-navigation site-navigation post-navigation
skip-link site-header site-footer page-footer main-footer footer-widgets cookie-banner cookie-notice cookie-consent cookie-bar
comment-list comments-list comments-area comment-form comment-respond related-posts related-articles related-links recommended-posts
share-buttons share-links social-links social-share social-media newsletter-signup newsletter-form newsletter-box
ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper ads-container advert-box sponsored-content promo-box
search-form search-box search-bar login-form signup-form subscribe-form widget-area""".split())
# Marks of reader comments, which are often article elements themselves.
COMMENTS = frozenset("comment comments commentlist comment-list comments-list comments-area respond reply replies disqus".split())

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea iframe svg title annotation annotation-xml".split())
RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: A tag, in which quotes count after an equals sign; and one that never ends, up to the next tag.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ENDLESS_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)>?")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
NUMBER = re.compile(r"-*\d+$")
DIGITS = re.compile(r"\d+")


def marks_in(values) -> set[str]:
    """The boilerplate tokens of class, id and role: whole ones, but for a number at their end."""
    tokens = {NUMBER.sub("", t.replace("_", "-")) for v in values for t in v.split()}
    return tokens & BOILERPLATE


def tags_of(source: str):
    """(begin, end, closing, name, attributes) of every tag and of what is no text: comments,
    declarations and raw elements have a null name. One pass: no part of the page is read twice but
    for a single search for the end of a tag that has none."""
    at, size, endless = 0, len(source), False
    while (at := source.find("<", at)) >= 0:
        mark = source[at + 1 : at + 2]
        if mark in "!?" and mark:
            comment = source.startswith("<!--", at)
            end = source.find("-->", at + 4) if comment else source.find(">", at)
            end = size if end < 0 else end + (3 if comment else 1)
            yield at, end, False, None, ""
            at = end
            continue
        m = None if endless else TAG.match(source, at)
        if m is None:
            m = ENDLESS_TAG.match(source, at)
            if m is None:
                at += 1
                continue
            endless = True
        name = m[2].lower()
        if name in RAW and not m[1]:
            closed = RAW_ENDS[name].search(source, m.end())
            end = closed.end() if closed else size
            yield at, end, False, None, ""
        else:
            end = m.end()
            yield at, end, bool(m[1]), name, m[3]
        at = end


class Page:
    """Containers as (parent, label, dropped) and blocks as (container, text, characters in links, heading)."""

    def __init__(self, source: str):
        self.containers: list[tuple[int, str, bool]] = [(-1, "", False)]
        self.blocks: list[tuple[int, str, int, bool]] = []
        self.articles: set[int] = set()
        # Elements marked as boilerplate: (the marked one around it, marked as comments, in an article); 0 is none.
        self.marks: list[tuple[int, bool, bool]] = [(0, False, False)]
        block_marks: list[int] = []
        container_marks = [0]
        mains: set[int] = set()
        # Open elements: (tag, container, dropped, in an article, mark)
        stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
        open_tags: Counter = Counter()
        text: list[str] = []
        linked = 0
        links = 0
        at = 0

        def flush() -> None:
            nonlocal linked
            if text:
                tag, container, dropped, _, mark = stack[-1]
                if not dropped:
                    words = " ".join(html.unescape("".join(text)).split())
                    if words:
                        self.blocks.append((container, words, min(linked, len(words)), tag in HEADINGS))
                        block_marks.append(mark)
                text.clear()
            linked = 0

        def pop() -> str:
            name = stack.pop()[0]
            open_tags[name] -= 1
            return name

        for begin, end, closing, name, attributes in tags_of(source):
            if begin > at and not stack[-1][2]:
                text.append(source[at:begin])
                if links:
                    linked += begin - at
            at = end
            if name is None:
                continue
            if closing:
                if name == "a":
                    links = max(0, links - 1)
                elif open_tags[name]:
                    flush()
                    while pop() != name:
                        pass
                continue
            if name == "br":
                text.append(" ")
                continue
            if name == "a":
                links += 1
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name not in BLOCKS and name not in DROPPED:
                continue
            flush()
            links = 0
            # A block ends an open paragraph; an item or cell ends the one before it.
            top = stack[-1][0]
            if top == "p" and name in CLOSES_P or top == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                pop()
            _, container, dropped, inside, mark = stack[-1]
            marks: dict[str, str] = {}
            if attributes and not attributes.isspace():
                marks = {a[0].lower(): (a[1] or a[2] or a[3]).lower() for a in ATTRIBUTE.findall(attributes)}
                if not dropped and name not in ("html", "body"):
                    dropped = HIDDEN.search(attributes) is not None
                    if name not in HEADINGS and name not in ("article", "main"):
                        tokens = marks_in(marks.values())
                        # The header of an article holds its title.
                        if tokens - {"header"} if inside else tokens:
                            self.marks.append((mark, not tokens.isdisjoint(COMMENTS), inside))
                            mark = len(self.marks) - 1
            dropped = dropped or name in DROPPED or name == "header" and not inside
            if name in CONTAINERS:
                label = ".".join([name, *sorted(DIGITS.sub("#", marks.get("class", "")).split())[:3]])
                self.containers.append((container, label, dropped))
                container = len(self.containers) - 1
                container_marks.append(mark)
                if name in ("article", "main"):
                    self.articles.add(container)
                    if name == "main":
                        mains.add(container)
            stack.append((name, container, dropped, inside or name in ("article", "main"), mark))
            open_tags[name] += 1
        if at < len(source):
            text.append(source[at:])
        flush()
        if len(self.marks) > 1:
            kept = self.kept_marks(block_marks, container_marks, mains)
            self.blocks = [b for b, mark in zip(self.blocks, block_marks, strict=True) if kept[mark]]
            self.containers = [(parent, label, dropped or not kept[mark]) for (parent, label, dropped), mark in zip(self.containers, container_marks, strict=True)]
            self.articles = {i for i in self.articles if not self.containers[i][2]}

    def kept_marks(self, block_marks: list[int], container_marks: list[int], mains: set[int]) -> list[bool]:
        """Which marked elements hold the article and are kept, so that a wrapper's name does not lose it.

        Those around a main element; where no article element has text outside all others, those around
        the longest article; and there or inside an article, those with most of the unlinked text. Comments
        are only kept where nothing else is left.
        """
        parents = [parent for parent, *_ in self.marks]
        size = [0] * len(self.marks)
        own = [0] * len(self.containers)
        for (container, words, linked, _), mark in zip(self.blocks, block_marks, strict=True):
            size[mark] += len(words) - linked
            own[container] += len(words) - linked
        outside = size[0]
        for i in range(len(size) - 1, 0, -1):
            size[parents[i]] += size[i]
        for i in range(len(own) - 1, 0, -1):
            own[self.containers[i][0]] += own[i]
        lifted = [True] + [False] * (len(size) - 1)

        comments = [False]
        for parent, of_comments, _ in self.marks[1:]:
            comments.append(of_comments or comments[parent])

        def lift(mark: int) -> None:
            while not lifted[mark]:  # what stands around a lifted mark is lifted
                lifted[mark] = True
                mark = parents[mark]

        for i in mains:
            lift(container_marks[i])
        articles = [i for i in self.articles if own[i] and not self.containers[i][2]]
        held = self.held(set(articles))
        found = any(held[b[0]] and lifted[mark] for b, mark in zip(self.blocks, block_marks, strict=True))
        wrapped = [] if found else [i for i in articles if not comments[container_marks[i]]]
        if wrapped:
            lift(container_marks[max(wrapped, key=lambda i: own[i])])
        for mark in range(1, len(size)):
            most = 2 * size[mark] > size[0] and (self.marks[mark][2] or not found)
            if most and not comments[mark] or size[mark] == size[0] and not outside and not wrapped:
                lift(mark)
        kept = [True]
        for mark in range(1, len(size)):
            kept.append(lifted[mark] and kept[parents[mark]])
        return kept

    def best(self) -> int:
        """The lowest container that holds every clean block of the article; -1 without such blocks.

        Clean blocks are not mostly links. Where article and main elements hold most of the unlinked text,
        the article is what they hold and the headings beside them; else it is all clean blocks. A single
        short word (a counter, a sign) does not widen the article unless it is a heading.
        """
        clean = [(c, words, linked, heading) for c, words, linked, heading in self.blocks if 2 * linked < len(words)]
        if self.articles:
            held = self.held(self.articles)
            inside = sum(len(words) - linked for c, words, linked, _ in clean if held[c])
            if 2 * inside >= sum(len(words) - linked for _, words, linked, _ in clean):
                clean = [b for b in clean if held[b[0]] or b[3]]
        found = {c for c, words, _, heading in clean if heading or " " in words or len(words) > 20} or {c for c, *_ in clean}
        if not found:
            return -1
        # Parents come before their children: the last container that holds all is the lowest.
        holds = [0] * len(self.containers)
        for c in found:
            holds[c] = 1
        for i in range(len(holds) - 1, -1, -1):
            if holds[i] == len(found):
                return i
            holds[self.containers[i][0]] += holds[i]
        return -1

    def path(self, container: int) -> str:
        labels = []
        while container > 0:
            labels.append(self.containers[container][1])
            container = self.containers[container][0]
        return "/".join(["", *reversed(labels)])

    def at_path(self, path: str) -> set[int]:
        """The containers with this path that are not dropped."""
        labels = path.split("/")
        same = [0]  # how many labels of the path a container and those around it are
        for parent, label, _ in self.containers[1:]:
            n = same[parent]
            same.append(n + 1 if 0 <= n < len(labels) - 1 and labels[n + 1] == label else -1)
        return {i for i, n in enumerate(same) if n == len(labels) - 1 and not self.containers[i][2]}

    def held(self, roots: set[int]) -> list[bool]:
        held = [False] * len(self.containers)
        for i, (parent, _, _) in enumerate(self.containers):
            held[i] = i in roots or parent >= 0 and held[parent]
        return held

    def inside(self, roots: set[int]) -> str:
        held = self.held(roots)
        return "\n\n".join(words for container, words, *_ in self.blocks if held[container])

    def text(self, path: str | None) -> str:
        roots = self.at_path(path) if path else set()
        return roots and self.inside(roots) or self.inside({max(self.best(), 0)})


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def consensus_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: the winning path of every host."""

    def vote(batches):
        for batch in batches:
            found = []
            for source in batch.column(1).to_pylist():
                page = Page(source)
                best = page.best()
                found.append(page.path(best) if best >= 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "path"])

    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(html_col, F.lit("")).alias("html")).mapInArrow(vote, "host string, path string")
    counted = votes.filter("path is not null").groupBy("host", "path").count()
    # max of a struct keeps one row for each host without sorting a host's paths.
    best = counted.groupBy("host").agg(F.max(F.struct("count", F.length("path").alias("size"), F.col("path"))).alias("best"))
    return best.select("host", "best.path")


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", staging: Staging | None = None) -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` of every page."""
    staging = staging or Staging(pages.sparkSession, "html")
    paths = staging.put(consensus_paths(pages, url_col=url_col, html_col=html_col), "paths")
    src = pages.select(F.col(id_col), F.col(url_col), F.coalesce(html_col, F.lit("")).alias("_html"), host_of(F.col(url_col)).alias("host"))
    # One row for each host: broadcast while Spark measures it as small, else a join whose large
    # side can be split at a hot host.
    joined = src.join(paths, "host", "left").select(id_col, url_col, "_html", "path")

    def extract(batches):
        for batch in batches:
            out = [Page(source).text(path) for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            sizes = pa.array([len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), sizes], [id_col, url_col, "text", "n_chars"])

    types = dict(pages.dtypes)
    return joined.mapInArrow(extract, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")


def op4(spark, sf_dir):
    return extract_text(read_table(spark, sf_dir, "pages"))


