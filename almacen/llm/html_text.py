"""9. Main-text extraction by tag-path ratios.

A page is read into its text nodes, each with the path of tags from the root.
Per path, the text length and punctuation per node are aggregated; the two
ratios are smoothed over the nodes in page order, fused into one score per path
and weighted: paths through elements that announce something else (menus, footers,
forms; names such as ``sidebar``) count less, those through article or main
elements more. A path of at least half of the best score is a content path, one above a share of
the page's deviation a secondary one. Weights are relative: a name on an element around everything
changes nothing.

The smallest block around all text on content paths is the article, widened to
the article or main element around it, or else while all that is added is a
heading or on secondary paths. In a block that holds content itself everything
stays but elements of navigation, forms and the like without content; where content lies in
several parts, the parts stay. Nothing is removed by a class or an id inside the
article. The blocks that remain, in page order, are the text.

Defined cases: null or empty html and pages without text give an empty text;
unclosed and stray tags are repaired as browsers do for blocks; an attribute's quotes open only after
its equals sign; character references are decoded per text node; very long and
very deep pages take time in proportion to their length; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
                   r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)"
                   r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)>|[^<]+|<", re.S)
LOOSE = re.compile("<(?:(/)(x))??")
ATTRS = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))|(?<=\s)(hidden)(?=[\s/]|\Z)")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、؛؟।]")
# Fixed values of the HTML standard: raw-text, void and block elements, and what an opening tag closes.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog",
         "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
         "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
         "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"table", "ul", "ol", "dl", "select", "body", "html", "article", "main", "section", "div", "aside", "nav"}
PARAGRAPH_SCOPE = SCOPE | {"td", "th", "li", "blockquote"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Blocks that hold a run of text rather than an article.
RUNS = {"p", "li", "td", "th", "tr", "tbody", "thead", "table", "pre", "blockquote", "ul", "ol", "dl", "dt", "dd", *HEADINGS}
# Elements whose content is not shown as text.
UNSEEN = {"script", "style", "noscript", "template", "svg", "math", "canvas", "object", "audio", "video", "head",
          "title", "iframe", "noembed", "noframes", "xmp", "select", "textarea", "button"}
# Elements, roles and name parts that announce something other than the article.
ASIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert",
               "menu", "menubar", "form"}
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banner"
    r"|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebars?|side|rail|widgets?|header|masthead|topbar|footer|foot"
    r"|comments?|commentlist|disqus|replies|responses|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|pagination|pager"
    r"|copyright|legal|disclaimer|toolbar|skip)(?:$|[\s_-])", re.I)
#: What such an element, such a name, and an article or main element weigh.
ASIDE_WEIGHT, NAME_WEIGHT, ARTICLE_WEIGHT = 0.1, 0.3, 2.0
RADIUS, SHARE, STRONG = 2, 0.25, 0.5


class Page:
    """Elements as parallel lists (a parent comes before its children) and text nodes ``(element, text, block)``."""

    def __init__(self, page: str):
        self.tag, self.parent, self.path, self.weight, self.aside, self.unseen = [""], [-1], [0], [1.0], [False], [False]
        self.in_article = [False]
        self.texts: list[tuple[int, str, int]] = []
        self.paths: dict[tuple[int, str, float], int] = {}
        self._read(page)

    def _open(self, tag: str, attrs: str, at: int) -> int:
        aside, named, unseen = tag in ASIDE_TAGS or tag == "header" and not self.in_article[at], False, tag in UNSEEN
        for name, a, b, c, hidden in ATTRS.findall(attrs) if attrs and tag not in ("html", "body") else ():
            value, name = (a or b or c).strip(), name.lower()
            if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                unseen = True
            elif name == "role" and value.lower() in ASIDE_ROLES:
                aside = True
            elif name in ("class", "id") and ASIDE_NAMES.search(value):
                named = True
        article = tag in ("article", "main")
        factor = (ASIDE_WEIGHT if aside else 1.0) * (NAME_WEIGHT if named else 1.0)
        if article and not self.in_article[at]:
            factor *= ARTICLE_WEIGHT
        key = (self.path[at], tag, factor)
        self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
        self.tag.append(tag)
        self.parent.append(at)
        self.weight.append(self.weight[at] * factor)
        self.aside.append(aside)
        self.unseen.append(unseen or self.unseen[at])
        self.in_article.append(article or self.in_article[at])
        return len(self.tag) - 1

    def _read(self, page: str) -> None:
        stack, opened = [0], defaultdict(int)
        blocks = pos = 0

        def close(tags, stop=frozenset()) -> None:
            """Close the nearest open element of ``tags`` and all in it, unless one of ``stop`` is nearer."""
            if not any(opened[t] for t in tags):
                return
            i = len(stack) - 1
            while self.tag[stack[i]] not in tags:
                if self.tag[stack[i]] in stop:
                    return
                i -= 1
            for e in stack[i:]:
                opened[self.tag[e]] -= 1
            del stack[i:]

        last = page.rfind(">")
        while pos < len(page):
            # After the last ">" no tag ends, so none is looked for.
            m = TOKEN.match(page, pos) if pos < last or page[pos] != "<" or page.startswith("<!", pos) else LOOSE.match(page, pos)
            pos = m.end()
            tag = m[2]
            if tag is None:
                if m[0][0] != "<" or m[0] == "<":
                    self.texts.append((stack[-1], m[0], blocks))
                elif m[0].startswith("<![CDATA["):
                    self.texts.append((stack[-1], entities.escape(m[0][9:-3]), blocks))
                continue
            tag = tag.lower()
            if tag in BLOCK:
                blocks += 1
            if m[1]:
                close({tag})
                continue
            if tag in VOID:
                continue
            if tag in BLOCK:
                close({"p"}, PARAGRAPH_SCOPE)
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], SCOPE)
            if tag == "body":
                close({"head"})
            if m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            e = self._open(tag, m[3], stack[-1])
            if tag in RAW:
                end = re.compile(f"</{tag}[^>]*>", re.I).search(page, pos)
                pos = end.end() if end else len(page)
                continue
            stack.append(e)
            opened[tag] += 1


def _smooth(x: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; edges use the weights that are there."""
    k = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / (RADIUS / 2)) ** 2)
    return np.convolve(x, k)[RADIUS:-RADIUS] / np.convolve(np.ones(len(x)), k)[RADIUS:-RADIUS]


def path_scores(paths: list[int], lengths: list[int], marks: list[int], weights: list[float]) -> tuple[dict[int, float], float]:
    """Per path its smoothed, fused and weighted text and punctuation ratio, and the least score of a secondary path."""
    text, punct, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, n, c in zip(paths, lengths, marks):
        text[p] += n
        punct[p] += c
        count[p] += 1
    tpr = _smooth(np.array([text[p] / count[p] for p in paths]))
    ppr = _smooth(np.array([punct[p] / count[p] for p in paths]))
    fused = tpr / max(tpr.max(), 1e-9) * (0.5 + ppr / max(ppr.max(), 1e-9)) * np.array(weights)
    score = defaultdict(float)
    for p, f in zip(paths, fused.tolist()):
        score[p] += f / count[p]
    return score, SHARE * float(fused.std()) + 0.1 * max(score.values())


def content_paths(paths: list[int], lengths: list[int], marks: list[int], weights: list[float]) -> tuple[set[int], set[int]]:
    """Content paths, and these with the secondary ones."""
    score, limit = path_scores(paths, lengths, marks, weights)
    best = max(score.values())
    strong = {p for p, s in score.items() if s >= STRONG * best}
    return strong, strong | {p for p, s in score.items() if s >= limit}


def main_text(page: str | None) -> str:
    if not page:
        return ""
    doc = Page(page)
    texts = [(e, entities.unescape(t), b) for e, t, b in doc.texts if not doc.unseen[e]]
    seen = [(e, s) for e, t, _ in texts if (s := t.strip())]
    if not seen:
        return ""
    strong, weak = content_paths([doc.path[e] for e, _ in seen], [len(s) for _, s in seen],
                                 [len(PUNCTUATION.findall(s)) for _, s in seen], [doc.weight[e] for e, _ in seen])
    n = len(doc.tag)
    top = [t in ("", "html", "body") for t in doc.tag]
    # Per element: whether a heading is around it, the block that is no mere run of text around it, the text in it on
    # content paths, and the text nodes in it that speak against its being content.
    heading, holder, content, against = [False] * n, [0] * n, [0] * n, [0] * n
    direct = [False] * n
    for e in range(1, n):
        heading[e] = doc.tag[e] in HEADINGS or heading[doc.parent[e]]
        holder[e] = e if doc.tag[e] in BLOCK and doc.tag[e] not in RUNS else holder[doc.parent[e]]
    weight = max(doc.weight[e] for e, _ in seen if doc.path[e] in strong)
    for e, s in seen:
        if doc.path[e] in strong:
            content[e] += len(s)
            direct[holder[e]] = True
        elif doc.weight[e] < weight / 2 or doc.path[e] not in weak and not heading[e]:
            against[e] += 1
    for e in range(n - 1, 0, -1):
        content[doc.parent[e]] += content[e]
        against[doc.parent[e]] += against[e]

    # The smallest block around all content; then the article or main element around it, or wider while nothing speaks against it.
    whole = holder[max(e for e in range(n) if content[e] == content[0])]
    up = whole
    while up and doc.tag[up] not in ("article", "main"):
        up = doc.parent[up]
    if up:
        whole = up
    else:
        while not top[whole] and not top[up := doc.parent[whole]] and against[up] == against[whole]:
            whole = up

    # In a block that holds content itself, or an article, all stays but navigation and the like. Where the content lies
    # in several parts, the parts stay, and what is between them if nothing speaks against it.
    kept, free = [False] * n, [False] * n
    kept[whole] = True
    for e in range(whole, n):
        up = doc.parent[e]
        if e > whole:
            if not kept[up]:
                continue
            away = doc.aside[e] or not free[up] and against[e] and not heading[e]
            kept[e] = bool(content[e] or not away)
        free[e] = e > whole and free[up] or not top[e] and direct[e] or doc.tag[e] in ("article", "main")
    blocks: dict[int, list[str]] = {}
    for e, t, b in texts:
        if kept[e] and (free[e] or heading[e] or doc.path[e] in weak or not t.strip()):
            blocks.setdefault(b, []).append(t)
    clean = (SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return " ".join(c for c in clean if c)


def _extracted(batches):
    for b in batches:
        text = [main_text(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), b.column(1), pa.array(text, pa.string()),
             pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``."""
    return pages.select("page_id", "url", "html").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long")
