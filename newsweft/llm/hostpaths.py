"""Main text of web pages by consensus of their hosts.

Each page scores its containers by the text that stands right in them. A container's path (tags and classes, without numbers) gets
the page's vote; Spark adds the votes of a host. Then every page is read again and gives the text under the nearest common container of
the best path and all other paths with a share of the host's text, or under the article or main element around it, with what stands
right in the containers above.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.session import durable

#: Fixed values. Elements whose text is no text of the page; elements that are never part of the article; elements that hold others;
#: elements that end a block of text; words of class or id that mark what surrounds an article.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
AROUND = frozenset("nav header footer aside button select menu dialog head".split())
HOLDS = frozenset("html body div article section main td th table ul ol dl figure blockquote details center form".split()) | AROUND
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HOLDS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre tr thead tbody tfoot caption figcaption hr address summary fieldset legend".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs header footer masthead comment comments commentlist reply replies disqus cookie cookies consent gdpr notice notices "
    "alert popup modal newsletter subscribe signup login share sharing social related recommended recommendations widget toolbar pagination pager "
    "copyright legal disclaimer".split()
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
#: Words with which a class tells that something is not there or is only beside it; share of the page's unlinked text from which a
#: container is kept whatever its class is.
NOT = frozenset("has have no not non with without of hide hidden show".split())
MOST = 0.8
#: Share of a host's votes from which a path has won; share of the host's text right in a path from which it belongs to the main text.
#: So a host has at most 100 and 50 such paths.
WINS, SHARE = 0.01, 0.02


def surrounds(value: str) -> bool:
    """Whether a class or id has a token that is a mark, or begins or ends with one and is not about its absence or presence."""
    for token in value.lower().split():
        words = WORD.findall(token)
        if words and (token in MARKS or ((words[0] in MARKS or words[-1] in MARKS) and NOT.isdisjoint(words))):
            return True
    return False


class Page:
    """Blocks of a page outside its surroundings: text, characters in links, and the number of the container."""

    def __init__(self, source: str):
        self.paths: list[str] = [""]
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, str]] = []
        self.links: list[int] = []
        marked = [-1]  # the nearest container around each one, or itself, that is marked by its class or is a form
        above: dict[int, int] = {}  # the nearest one around a marked container
        stack: list[tuple[str, int, bool]] = [("", 0, False)]
        text: list[str] = []
        linked, in_link, at, headline = 0, False, 0, False

        def close() -> None:
            nonlocal linked
            if text:
                line = " ".join(html.unescape("".join(text)).split())
                if line:
                    self.blocks.append((stack[-1][1], line))
                    self.links.append(min(linked, len(line)))
                text.clear()
            linked = 0

        for found in TAG.finditer(source):
            if found.start() < at:
                continue
            if found.start() > at and (headline or not stack[-1][2]):
                piece = source[at : found.start()]
                text.append(piece)
                if in_link:
                    linked += len(piece)
            at = found.end()
            if not found[2]:
                continue
            tag, ends = found[2].lower(), bool(found[1])
            if tag in RAW and not ends:
                if not found[3].endswith("/") or tag in ("script", "style", "title", "textarea"):
                    shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    at = shut.end() if shut else len(source)
                continue
            if tag == "a":
                in_link = not ends
            elif tag == "br":
                text.append(" ")
            elif tag in BLOCK:
                close()
                in_link = False
                # The headline of an article may stand in its header.
                headline = tag in HEADING and not ends and self.in_own_header(stack)
                if tag not in HOLDS:
                    continue
                if ends:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                else:
                    marks: list[str] = []
                    by_class = False
                    for a in ATTRIBUTE.finditer(found[3]):
                        value = a[2] or a[3] or a[4] or ""
                        marks += WORD.findall(value.lower())
                        by_class = by_class or surrounds(value)
                    around = stack[-1][2] or tag in AROUND
                    # An article within an article is a comment, and may be dropped.
                    spared = tag in ("html", "body", "main") or (tag == "article" and all(s[0] != "article" for s in stack))
                    outer = marked[stack[-1][1]]
                    if (by_class or tag == "form") and not spared:
                        above[len(self.paths)] = outer
                        outer = len(self.paths)
                    marked.append(outer)
                    self.paths.append(f"{self.paths[stack[-1][1]]}/{'.'.join([tag, *sorted(set(marks))])}")
                    self.parents.append(stack[-1][1])
                    stack.append((tag, len(self.paths) - 1, around))
        if at < len(source) and (headline or not stack[-1][2]):
            text.append(source[at:])
        close()
        held = dict.fromkeys(above, 0.0)
        whole = 0.0
        for (k, line), linked in zip(self.blocks, self.links, strict=True):
            size = max(0.0, len(line) - 2.0 * linked)
            whole += size
            m = marked[k]
            while m >= 0:
                held[m] += size
                m = above[m]
        # Numbers ascend from the outside in; a container stays if it holds most of the text and all around it stay.
        stays = {-1: True}
        for m, outer in above.items():
            stays[m] = stays[outer] and 0 < MOST * whole <= held[m]
        keep = [stays[marked[k]] for k, _ in self.blocks]
        self.blocks = [b for b, good in zip(self.blocks, keep, strict=True) if good]
        self.links = [n for n, good in zip(self.links, keep, strict=True) if good]

    @staticmethod
    def in_own_header(stack: list[tuple[str, int, bool]]) -> bool:
        """Whether all that is dropped around a place is a header, right in one outermost article or in an element that is kept there."""
        inner = [tag for tag, _, _ in stack]
        return inner.count("article") == 1 and AROUND.intersection(inner) == {"header"} and inner.index("article") < inner.index("header")

    def votes(self) -> dict[str, float]:
        """Score of each path: characters outside links of the blocks right in it, and half of those one level deeper."""
        out: dict[str, float] = {}
        for (k, line), linked in zip(self.blocks, self.links, strict=True):
            score = max(0.0, len(line) - 2.0 * linked)
            if score:
                out[self.paths[k]] = out.get(self.paths[k], 0.0) + score
                up = self.parents[k]
                if up > 0:
                    out[self.paths[up]] = out.get(self.paths[up], 0.0) + score / 2
        return out

    def own(self) -> dict[str, float]:
        """Characters outside links right in each path."""
        out: dict[str, float] = {}
        for (k, line), linked in zip(self.blocks, self.links, strict=True):
            if len(line) > 2 * linked:
                out[self.paths[k]] = out.get(self.paths[k], 0.0) + len(line) - 2.0 * linked
        return out

    def text(self, wanted: set[str]) -> str:
        """The blocks under the nearest common container of the wanted paths, and those right above it, in page order."""
        common: list[int] | None = None
        for k in sorted({k for (k, line), linked in zip(self.blocks, self.links, strict=True) if len(line) > 2 * linked and self.paths[k] in wanted}):
            line_up = [k]
            while line_up[-1] > 0:
                line_up.append(self.parents[line_up[-1]])
            line_up.reverse()
            common = line_up if common is None else [a for a, b in zip(common, line_up, strict=False) if a == b]
        common = common or [0]
        whole = next((k for k in common if self.paths[k].rpartition("/")[2].split(".")[0] in ("article", "main")), common[-1])
        inside = [False] * len(self.paths)
        for k in range(len(self.paths)):
            inside[k] = k == whole or (self.parents[k] >= 0 and inside[self.parents[k]])
        blocks = zip(self.blocks, self.links, strict=True)
        return "\n".join(line for (k, line), linked in blocks if inside[k] or (k in common and len(line) > 2 * linked))


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host`` and its paths, the one with most votes first."""
    return voted_paths(pages).select("host", "paths")


def voted_paths(pages: DataFrame) -> DataFrame:
    """``host``, its ``paths``, the one with most votes first, and the ``wide`` ones, with a share of the host's text right in them."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores, owns = [], [], [], []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(source or "")
                own = page.own()
                for path, score in page.votes().items():
                    hosts.append(host)
                    paths.append(path)
                    scores.append(score)
                    owns.append(own.get(path, 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64()), pa.array(owns, pa.float64())], names=["host", "path", "score", "own"])

    votes = pages.select(host_of("url").alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(vote, "host string, path string, score double, own double")
    sums = votes.groupBy("host", "path").agg(F.sum("score").alias("score"), F.sum("own").alias("own"))
    # Stored, as it is read twice: for the sums of each host and for the paths with a share of them, which are few.
    sums = durable(sums)
    total = sums.groupBy("host").agg(F.sum("score").alias("all_score"), F.sum("own").alias("all_own"))
    wins, wide = F.col("score") >= WINS * F.col("all_score"), F.col("own") >= SHARE * F.col("all_own")
    chosen = sums.join(total, "host").filter(wins | wide)
    best = F.sort_array(F.collect_list(F.when(wins, F.struct((-F.col("score")).alias("score"), "path"))))
    return chosen.groupBy("host").agg(best["path"].alias("paths"), F.sort_array(F.collect_list(F.when(wide, F.col("path")))).alias("wide"))


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    A page without a container of its host's paths uses its own best one; one without text gives an empty text, like a null html.
    A null url is the host ''. Repeated rows give repeated results. Columns besides ``page_id``, ``url`` and ``html`` are not looked at.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, paths, wide in zip(*(batch.column(c).to_pylist() for c in ("html", "paths", "wide")), strict=True):
                page = Page(source or "")
                votes = page.votes()
                own = sorted(votes, key=lambda p: (-votes[p], p))
                best = next((p for p in paths or [] if p in votes), own[0] if own else None)
                if best is not None and best not in (paths or []):
                    own_text = page.own()
                    wide = [p for p in own_text if own_text[p] >= SHARE * sum(own_text.values())]
                texts.append("" if best is None else page.text({best, *(wide or [])}))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    paths = durable(voted_paths(pages))  # stored, so that Spark knows its size when it chooses the join
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of("url").alias("host"))
    return rows.join(paths, "host", "left").select("page_id", "url", "html", "paths", "wide").mapInArrow(extract, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
